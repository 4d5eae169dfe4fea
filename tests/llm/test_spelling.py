"""Spelling variants against plain Python: all words compared through their neighbourhoods."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.llm import registry, spelling
from helixframe.llm.common import Scratch

from .brute import LOWER

SF = "/root/testdata/sf0.001"


def counts(docs, alter=True):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if alter and doc is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def edited(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def table(n):
    """(word, form, root, n, n_near, form_n) of the words with counts n."""
    near = {w: [v for v in n if edited(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items())


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = registry.QUERIES["op13_spelling_variants"](spark, SF)
    assert [t for _, t in out.dtypes] == ["string"] * 3 + ["bigint"] * 3
    want = table(counts(docs))
    assert len(want) > 300 and sum(r[1] is not None for r in want) > 20
    assert found(out) == want


@pytest.mark.parametrize("group_pairs", [0, 3, 1000])
def test_dense_words_at_every_depth(spark, group_pairs):
    """With no pairs allowed in a group every group is cut down to single places."""
    rng = random.Random(5)
    n = {"".join(rng.choices("abé", k=rng.choice([5, 5, 6, 7, 8, 12]))): rng.randint(3, 40) for _ in range(500)}
    n |= {"a" * k: k for k in range(5, 12)} | {"x" * 30 + c: 4 for c in "abc"} | {"solitary": 9}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found(spelling.variants(words, group_pairs=group_pairs)) == table(n)


def test_roots_of_a_long_chain(spark):
    forms = spark.range(300).select(F.col("id").cast("string").alias("word"), (F.col("id") + 1).cast("string").alias("form"))
    got = spelling.roots_of(forms, Scratch(spark, "test")).collect()
    assert len(got) == 300 and {r["root"] for r in got} == {"300"}


def test_odd_tables(spark, empty, with_null_ids, corpus):
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    both = with_null_ids.unionByName(with_null_ids).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    rows = 2 * [*corpus, (None, "a null id " * 30), (None, None)]
    assert found(spelling.variants(spelling.word_counts(both, alter=spelling.planted))) == table(counts(rows))
    assert found(spelling.variants(spelling.word_counts(both))) == table(counts(rows, alter=False))


def test_long_words_and_a_long_text(spark):
    long = "z" * 40_000
    texts = [f"{long} {long[1:]} ÀBCDE Àbcde àbcde abcde" for _ in range(3)] + ["letters×joined letters9split " * 40_000, "Cafés CAFÉS cafés"]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = found(spelling.variants(spelling.word_counts(frame)))
    n = counts(docs, alter=False)
    assert n["letters"] == 40_000 and got == table(n)
