"""The suffix tree against plain Python: kept contexts, scores and the unigram base."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import bytescan
from helixframe.llm import suffix_tree_lm as lm

from . import brute


def symbols(text):
    return b"".join(w.encode() + b" " for w in brute.WORD.findall((text or "").translate(brute.LOWER))) + b"\xff"


class Tree:
    def __init__(self, texts, min_count, penalty):
        self.n = Counter()
        for t in texts:
            s = b"\xff" * lm.DEPTH + symbols(t)
            for i in range(lm.DEPTH, len(s)):
                for k in range(lm.DEPTH + 1):
                    self.n[s[i - k : i], s[i]] += 1
        self.c, self.next = Counter(), {}
        for (context, b), n in self.n.items():
            self.c[context] += n
            self.next.setdefault(context, []).append(b)
        self.kept = {b""} | {x for x in self.c if 0 < len(x) <= lm.SHORT and self.c[x] >= min_count}
        for x in self.c:
            if len(x) > lm.SHORT and self.c[x] >= min_count:
                saved = sum(self.n[x, b] * math.log(self.n[x, b] / self.c[x] / self.p(x[1:], b)) for b in self.next[x])
                if saved > 0.5 * len(self.next[x]) * math.log(self.c[x]) + penalty:
                    self.kept |= {x[k:] for k in range(len(x))}

    def p(self, context, b):
        if not context:
            return (self.n[b"", b] + 0.5) / (self.c[b""] + 128)
        return (self.n[context, b] + lm.PRIOR * self.p(context[1:], b)) / (self.c[context] + lm.PRIOR)

    def score(self, text):
        s, total = b"\xff" * lm.DEPTH + symbols(text), 0.0
        for i in range(lm.DEPTH, len(s)):
            state = next(s[i - k : i] for k in range(lm.DEPTH, -1, -1) if s[i - k : i] in self.kept)
            total += math.log10(self.p(state, s[i]))
        return total


@pytest.mark.parametrize(("cells", "middle"), [(0, 0), (0, 15_000), (20_000, 15_000), (0, lm.MIDDLE_BYTES), (lm.HOT_CELLS, lm.MIDDLE_BYTES)])
def test_scores(frame, corpus, monkeypatch, cells, middle):
    """With no room, some room and room for all kept contexts in the trie and in the middle."""
    monkeypatch.setattr(lm, "HOT_CELLS", cells)
    monkeypatch.setattr(lm, "MIDDLE_BYTES", middle)
    monkeypatch.setattr(lm, "GROUP_WORDS", 1500)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 2000)
    monkeypatch.setattr(lm, "HEAVY", 50)
    monkeypatch.setattr(lm, "HELD_KEYS", 5000)
    train = ~lm.is_held_out(F.col("doc_id"))
    out = {r["doc_id"]: r for r in lm.scored(frame, train, min_count=5, penalty=2.0).collect()}
    assert len(out) == len(corpus)
    learnt = [t for i, t in corpus if zlib.crc32(str(i).encode()) % 5 != 1]
    tree = Tree(learnt, 5, 2.0)
    assert sum(len(x) == lm.DEPTH for x in tree.kept) > 50
    words = {i: brute.WORD.findall((t or "").translate(brute.LOWER)) + [None] for i, t in corpus}
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, t in corpus:
        r, ws = out[i], words[i]
        assert r["score"] == pytest.approx(tree.score(t), rel=1e-4)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))


def test_longer_contexts_help_on_held_out_prose(spark):
    import random

    from .conftest import prose

    rng = random.Random(8)
    df = spark.createDataFrame([(i, prose(rng, 150)) for i in range(300)], "doc_id long, text string")
    score = {}
    for penalty in (lm.PENALTY, 1e9):  # with the second no context longer than SHORT is kept
        found = lm.scored(df, ~lm.is_held_out(F.col("doc_id")), penalty=penalty).filter(lm.is_held_out(F.col("doc_id")))
        score[penalty] = found.agg(F.sum("score")).first()[0]
    assert score[lm.PENALTY] > score[1e9]


def test_probabilities_sum_to_one():
    column = pa.array(["the cat sat on the mat", "the cat ate the rat", None, "a\0b"] * 20)
    s, starts = lm.symbols(bytescan.Texts(column, lower=True))
    key, n = np.unique(lm.windows(s, lm._scored(starts)), return_counts=True)
    top = lm.top_of(key & np.uint64((1 << 24) - 1), n)
    nodes = lm.grown(key, n, top, 3, 1.0)
    assert nodes and nodes[-1][0] == lm.DEPTH
    trie = lm.build_trie(top, nodes, [], 3)
    unseen = 256 - (trie.logp.shape[1] - 1)
    p = 10.0 ** trie.logp[1:].astype(float)
    assert (p[:, :-1].sum(1) + p[:, -1] * unseen) == pytest.approx(np.ones(len(p)), abs=1e-4)


def test_odd_tables(spark, empty, frame):
    assert lm.scored(empty, F.lit(True)).count() == 0
    rows = [(None, "a b"), (1, None), (2, " \n"), (3, "a b"), (3, "a b"), (None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(7)).withColumn("train", F.lit("x"))
    out = lm.scored(odd, F.col("doc_id").isNull() | (F.col("doc_id") < 3)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in out) == [(False, 1, 1, 1), (False, 2, 1, 1), (False, 3, 3, 3), (False, 3, 3, 3), (True, 0, 1, 1), (True, 0, 3, 3)]
    untaught = lm.scored(odd, F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in untaught} == {(0, 0)}
    assert [r["score"] for r in untaught if r["n_tokens"] == 1] == pytest.approx([math.log10(1 / 256)] * 3)


def test_texts_read_in_another_order_are_noticed(spark):
    home = lm._parcels([(0, lm.SUMS, 5, b"")])
    df = spark.createDataFrame([(0, lm.SUMS, 5, bytearray(home.column(3)[0].as_py()))], lm.PARCEL)
    with pytest.raises(Exception, match="another order"):
        lm.assembled(df).count()
