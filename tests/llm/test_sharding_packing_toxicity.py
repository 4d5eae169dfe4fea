"""Sharding, packing and toxicity against plain Python, and their odd tables."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import packing, registry, sharding, toxicity
from helixframe.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def brute_tree(keys, size, n):
    """Shard of each row by weighted medians along the widest dimension."""
    shard = np.zeros(len(size), int)

    def split(rows, first, k):
        shard[rows] = first
        if k == 1 or not len(rows):
            return
        own = keys[rows]
        at = int(np.argmax(own.max(0) - own.min(0)))
        order = rows[np.argsort(own[:, at], kind="stable")]
        want, before = size[order].sum() * (k // 2) / k, np.cumsum(size[order]) - size[order]
        cross = int(np.flatnonzero(before + size[order] > want)[0])
        cut = cross + (2 * (want - before[cross]) >= size[order][cross])
        split(order[:cut], first, k // 2)
        split(order[cut:], first + k // 2, k - k // 2)

    split(np.arange(len(size)), 0, n)
    return shard


@pytest.mark.parametrize("n", [2, 7, 40])
def test_tree_equals_exact_medians(spark, n):
    rng = np.random.default_rng(n)
    keys = np.column_stack([rng.integers(0, 2**62, 600), rng.integers(0, 3, 600) * 2**59 + rng.integers(0, 2**32, 600)])
    size = rng.integers(1, 5000, 600)
    df = spark.createDataFrame([(i, *map(int, k), int(s)) for i, (k, s) in enumerate(zip(keys, size))], "id int, a long, b long, size long").repartition(4)
    out, levels = sharding.shard_tree(df, ["a", "b"], n, Scratch(spark, "test"))
    got = out.orderBy("id").toPandas()["__node"].to_numpy()
    assert (got == brute_tree(keys, size, n)).all() and sum(map(len, levels)) == n - 1


def test_sharding_query(spark):
    out = registry.QUERIES["op2_sharding"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    data = {i: (t or "").encode() for i, t in zip(docs["doc_id"], docs["text"])}
    assert sorted(out["doc_id"]) == sorted(data)
    assert all((s, c) == (len(data[i]) + 16, zlib.crc32(data[i])) for i, s, c in zip(out["doc_id"], out["size"], out["text_crc32"]))
    assert set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all() and out["shard"].between(0, 39).all()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    # Each of six cuts is off by half of the largest row at most.
    assert (out.groupby("shard")["size"].sum() - out["size"].sum() / 40).abs().max() <= 2 * out["size"].max()


def test_sharding_of_odd_rows(frame, with_null_ids, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 3)
    both = with_null_ids.unionByName(frame)
    out = sharding.shard(both.withColumn("__node", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("shard", F.lit(1)), n_shards=5).toPandas()
    assert len(out) == both.count() and out["doc_id"].isna().sum() == 2
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    again = out.dropna(subset="doc_id").groupby("doc_id")["shard"].nunique()
    assert (again == 1).all()


def brute_bins(items, capacity):
    """Bins by greedy matching of large items and best fit of the others, item by item."""
    large, small = (sorted((x for x in items if (3 * x > capacity) is big), reverse=True) for big in (True, False))
    bins = []
    while large:
        first = large.pop(0)
        second = next((x for x in large if first + x <= capacity), None)
        if second:
            large.remove(second)
        bins.append(capacity - first - (second or 0))
    for x in small:
        gap = min((g for g in bins if g >= x), default=None)
        if gap is None:
            bins.append(capacity - x)
        else:
            bins[bins.index(gap)] = gap - x
    return len(bins)


def test_plan_equals_item_by_item():
    rng = np.random.default_rng(4)
    for high in (30, 64, 100):
        items = rng.integers(1, high + 1, 700).tolist()
        assert sum(n for n, _ in packing.plan_bins(dict(Counter(items)), 100)) == brute_bins(items, 100)


def test_packing_query(spark):
    out = registry.QUERIES["op5_best_fit_packing"](spark, SF).toPandas()
    assert out["sequence_id"].nunique() == brute_bins(out["length"].tolist(), packing.CAPACITY)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= packing.CAPACITY


def test_packing_of_odd_rows(frame, with_null_ids, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 3)
    both = with_null_ids.unionByName(frame).withColumn("length", F.lit("clash")).withColumn("piece", F.lit("clash")).withColumn("__g", F.lit(1))
    out = packing.packed(both).toPandas()
    assert out["doc_id"].isna().sum() >= 2 and len(out[out["start"] == 0]) == both.count()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= packing.CAPACITY


def toxic_rows():
    import random

    from .conftest import prose

    rng = random.Random(11)
    rows = []
    for k in range(160):
        text = prose(rng, 40)
        rows.append((k, text + " you Worthless clown" if k % 4 == 0 else text, int(k % 4 == 0)))
    return rows


def test_classifier_equals_a_direct_fit(spark, monkeypatch):
    rows = toxic_rows()
    grams = lambda t: {b[i : i + n] for b in [t.lower().encode()] for n in toxicity.SIZES for i in range(len(b) - n + 1)}
    sets, y = [grams(t) for _, t, _ in rows], np.array([label for *_, label in rows], float)
    n = [Counter(g for s, label in zip(sets, y) if label == k for g in s) for k in (0, 1)]
    features = [g for g in n[0] | n[1] if n[0][g] + n[1][g] >= toxicity.MIN_DOCS]
    ratio = {g: np.log(((n[1][g] + 1) / (y.sum() + 2)) / ((n[0][g] + 1) / (len(y) - y.sum() + 2))) for g in features}
    told = {g: abs(ratio[g]) * np.sqrt((n[0][g] + n[1][g]) / len(y)) for g in features}
    chosen = sorted(features, key=lambda g: -told[g])[: toxicity.FEATURES]
    assert len(chosen) == len(features)  # so no choice among equals
    x = np.array([[ratio[g] if g in s else 0.0 for g in chosen] for s in sets])
    w, b = np.zeros(x.shape[1]), 0.0
    rate = 1 / (0.25 * (np.linalg.norm(x, 2) ** 2 / len(y) + 1) + 1e-3)
    for _ in range(4000):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - rate * (x.T @ error / len(y) + 1e-3 * w), b - rate * error.mean()
    want = 1 / (1 + np.exp(-(x @ w + b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df.select("doc_id", "text"), toxicity.train(df)).collect()}
    assert max(abs(got[i] - want[i]) for i in got) < 0.05


def test_toxicity_query_on_odd_tables(spark, tmp_path):
    rows = [(i, t, "en", "s", 1) for i, t, _ in toxic_rows()] + [(None, "x", None, None, None), (500, None, "en", "s", 0), (500, "second text", "en", "s", 0), (1, "another text of one id", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int").write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = [(i, 1, y) for i, _, y in toxic_rows()] + [(1, 1, 1), (None, 1, 1), (3, 0, None), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    query = registry.QUERIES["op10_toxicity"]
    out, again = (query(spark, f"file://{tmp_path}").toPandas().sort_values(["doc_id", "score"]) for _ in range(2))
    assert len(out) == len(rows) and out["score"].between(0, 1).all() and out["score"].tolist() == again["score"].tolist()
    held = out[out["held_out"] & (out["doc_id"] < 160)]
    assert ((held["doc_id"] % 4 == 0) == (held["predicted"] == 1)).mean() > 0.9
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet", mode="overwrite")
    assert query(spark, f"file://{tmp_path}").select("score").distinct().count() == 1


def test_written_shards_keep_the_callers_columns(spark, frame, tmp_path):
    """Columns named as the operator's own stay; the written rows are in slot order inside their shard."""
    mine = frame.withColumns({"slot": F.lit("mine"), "shard": F.lit("yours")})
    sharding.write_shards(mine, f"file://{tmp_path}/out", n_shards=4)
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert set(out.columns) == {*mine.columns, "shard_", "slot_"}
    rows = out.collect()
    assert len(rows) == mine.count() and all(r["slot"] == "mine" and r["shard"] == "yours" for r in rows)
    for k in range(4):
        assert sorted(r["slot_"] for r in rows if r["shard_"] == k) == list(range(sum(r["shard_"] == k for r in rows)))
