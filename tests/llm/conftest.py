import random

import pytest

SYLLABLES = "an the of er in tion on re he st ed or ti hes was wh ble ly ou nd".split()


def prose(rng, n):
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
    out = []
    for k, w in enumerate(words):
        out.append(w.capitalize() if k % 9 == 0 else w)
        out.append("\n" if k % 40 == 39 else ". " if k % 9 == 8 else " ")
    return "".join(out).strip()


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, copies, near copies, shared passages and lines, odd and empty texts."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(60, 160)) for _ in range(25)]
    passage, line = prose(rng, 40).replace("\n", " "), "All rights reserved by the authors"
    texts = list(base)
    for k in range(30):
        words = base[0].split(" ")
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    texts += [base[1]] * 12 + [base[2] + "\n" + passage, passage + "\n" + base[3], base[4][:200] + passage + base[4][200:]]
    texts += [t + f"\n  {line.upper() if k % 2 else line}\t" for k, t in enumerate(base[5:20])]
    texts += [None, "", "   \n\t ", "one", "two words", "One", "x" * 120, "x" * 120 + "y", "é ü 漢字 " * 30, "a" * 49, "a" * 49, "b" * 50, "b" * 50]
    texts.append(prose(rng, 3000))
    return [(k * 3 + 1, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def frame(spark, corpus):
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "clash", 7) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __th string, key int").repartition(5)


@pytest.fixture(scope="session")
def empty(frame):
    return frame.limit(0)


@pytest.fixture(scope="session")
def with_null_ids(spark, frame):
    more = spark.createDataFrame([(None, "a null id " * 30, "en", "src0", 1, "c", 1), (None, None, None, None, None, None, None)], frame.schema)
    return frame.unionByName(more)
