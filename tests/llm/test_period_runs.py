"""Periodic runs against plain Python: every period, word by word."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import period_runs, registry

from .brute import WORD

SF = "/root/testdata/sf0.001"


def all_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > a and i + q - a >= max(24, 3 * q) and not any(w[a : i + q - r] == w[a + r : i + q] for r in range(1, q)):
                out.append((a, i + q - a, q))
            i += 1
    return sorted(out)


def row(doc_id, text):
    """The row of the contract."""
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_runs(seed):
    rng = random.Random(seed)
    n, kinds = rng.randint(1, 400), rng.choice([1, 2, 2, 3, 5, 60])
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 5)):
        q = rng.randint(1, max(1, n // 3))
        length = rng.randint(q, min(n, 5 * q + 20)) if q <= n else 0
        a = rng.randint(0, n - length)
        for i in range(a, a + length):
            w[i] = w[a + (i - a) % q]
        if rng.random() < 0.4:
            w[rng.randrange(n)] = kinds - 1
    assert period_runs.runs_of(np.array(w)) == all_runs(w)


def test_fibonacci_words_and_borders():
    short, long = [0], [0, 1]
    while len(long) < 600:
        short, long = long, long + short
    assert period_runs.runs_of(np.array(long)) == all_runs(long)
    for n in (23, 24, 25, 26, 27, 28):  # 24 words at least, three periods at least
        for q in (1, 7, 8, 9):
            w = [5000 + k for k in range(9)] + [k % q for k in range(n)] + [6000]
            assert period_runs.runs_of(np.array(w)) == all_runs(w) == ([(9, n, q)] if n >= max(24, 3 * q) else [])
    assert period_runs.steepest([(0, 30, 10), (5, 60, 20), (3, 24, 8), (40, 61, 20)]) == (40, 61, 20)
    assert period_runs.steepest([(0, 30, 10), (5, 60, 20)]) == (0, 30, 10) and period_runs.steepest([]) is None


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = registry.QUERIES["op12_periodic_runs"](spark, SF)
    want = sorted(row(*d) for d in docs)
    assert sum(r[1] > 0 for r in want) > 10
    assert sorted(tuple(r) for r in out.collect()) == want
    assert [t for _, t in out.dtypes] == ["bigint"] * 6 + ["string"] * 2


def test_odd_tables(spark, frame, empty, with_null_ids):
    assert period_runs.periodic_runs(empty).count() == 0
    both = with_null_ids.unionByName(with_null_ids).withColumn("__runs", F.lit("mine")).withColumn("period", F.lit(1))
    got = period_runs.periodic_runs(both)
    assert got.columns == [*both.columns, "__n_words", "__runs_", "__steepest", "__collapsed"]
    for r in got.collect():
        w = WORD.findall(r["text"] or "")
        runs = all_runs(w) if len(w) < 2500 else None
        assert r["__n_words"] == len(w) and r["__runs"] == "mine" and (runs is None or [tuple(x) for x in r["__runs_"]] == runs)
        if not r["__runs_"]:
            assert r["__steepest"] is None and r["__collapsed"] == " ".join(w)
    nulls = got.filter("doc_id is null and text is not null").select("__runs_", "__collapsed").collect()
    assert [(tuple(x) for x in r) for r in nulls] and all([tuple(x) for x in r["__runs_"]] == [(0, 90, 3)] and r["__collapsed"] == "a null id" for r in nulls)


@pytest.mark.parametrize("n", [300_000])
def test_a_very_long_text(spark, n):
    rng = random.Random(3)
    body = [f"w{rng.randrange(5000)}" for _ in range(n)]
    q, a = 41_003, 20_011
    for i in range(a + q, a + 3 * q + 5):
        body[i] = body[i - q]
    body[a + 3 * q + 5] = "other"
    for i in range(250_001, 250_001 + 24):
        body[i] = "same"
    one = period_runs.periodic_runs(spark.createDataFrame([(1, " ".join(body))], "doc_id long, text string")).collect()[0]
    assert one["__n_words"] == n and [tuple(r) for r in one["__runs"]][0][1:] == (3 * q + 5, q) and tuple(one["__steepest"]) == (250_001, 24, 1)
    assert len(one["__collapsed"].split(" ")) == n - 2 * q - 5 - 23
