import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import contracts as C
from helixframe.functions import expressions as X
from helixframe.functions import numeric as N
from helixframe.operators import graphs, intervals, ordered, trees
from helixframe.sources import readers
from helixframe.streaming import windows


def test_exact_rate_test():
    got = N.poisson_rate_test(53, 2167.94419997928, 7, 3876.2995039087)
    assert got["p"] == pytest.approx(4.65639581066739e-17, rel=1e-9)
    assert (got["low"], got["high"]) == pytest.approx((6.1335, 35.2962), abs=1e-4)
    assert N.poisson_rate_test(3, 1.0, 0, 1.0)["ratio"] == math.inf


def test_fisher_exact():
    got = N.fisher_exact(358, 1, 204, 25)
    assert got["p"] == pytest.approx(4.21434756739189e-10, rel=1e-9)
    assert got["odds_ratio"] == pytest.approx(43.6728, abs=1e-3)
    stable = N.fisher_exact(318, 0, 189, 24)
    assert stable["odds_ratio"] == math.inf and stable["p"] == pytest.approx(1.32836217472945e-10, rel=1e-9)


def test_distributions():
    assert N.t_two_sided(2.2281388519, 10) == pytest.approx(0.05, abs=1e-9)
    assert N.t_quantile(0.975, 10) == pytest.approx(2.2281388519, abs=1e-8)
    assert N.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)


def test_least_squares_and_count_model():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + rng.normal(scale=0.01, size=200)
    assert N.least_squares(x, y)["beta"] == pytest.approx([1, 2, -1], abs=0.01)
    with pytest.raises(ValueError):
        N.least_squares(np.column_stack([x[:, 0], x[:, 0]]), y)
    counts = rng.poisson(np.exp(0.5 + 0.7 * x[:, 0]) * 2.0).astype(float)
    assert N.count_model(x[:, :1], counts, np.full(200, 2.0))["beta"] == pytest.approx([0.5, 0.7], abs=0.15)


def test_mixture_linkage_scaling():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(k + 0.2, 0.05, 40) for k in (1, 2, 4)])
    got = N.fixed_mean_mixture(x, np.arange(1, 6))
    assert got["offset"] == pytest.approx(0.2, abs=0.03)
    assert (got["state"] == np.repeat([1, 2, 4], 40)).all()
    d = np.abs(np.subtract.outer([0.0, 1, 10, 11, 30], [0.0, 1, 10, 11, 30]))
    merges = N.average_linkage(d)
    assert N.cut_clusters(merges, 5, clusters=3).tolist() == [0, 0, 1, 1, 2]
    assert N.newick(merges, list("abcde")).count(",") == 4
    xy, share = N.principal_coordinates(d, 2)
    assert share[0] == pytest.approx(1.0) and abs(abs(xy[4, 0] - xy[0, 0]) - 30) < 1e-6


def test_lowess_keeps_a_line():
    x = np.arange(20.0)
    assert N.lowess(x, 3 * x + 1) == pytest.approx(3 * x + 1, abs=1e-6)


def test_tree_models():
    rows = trees.parse_newick("((a:1,b:1)x:1,(c:1,d:1):1);")
    assert [r[3] for r in rows] == ["", "x", "a", "b", "", "c", "d"]
    values = {"a": 0.0, "b": 2.0, "c": 4.0, "d": 6.0}
    states = trees.brownian_states(rows, values)
    assert states[0] == pytest.approx(3.0) and states[1] == pytest.approx(1.75, abs=1e-9) or states[1] < states[4]
    _, found = trees.equal_rates_states(rows, {"a": "p", "b": "p", "c": "q", "d": "q"})
    assert found[1] == "p" and found[4] == "q"
    kept = trees.pruned(rows, {"a", "c", "d"})
    assert sorted(r[3] for r in kept if r[3]) == ["a", "c", "d"] and len(kept) == 5
    cov = trees.phylogenetic_covariance(rows, ["a", "b", "c"])
    assert cov.tolist() == [[2, 1, 0], [1, 2, 0], [0, 0, 2]]


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, `Sample Name` string")
    with pytest.raises(C.SchemaError):
        C.require_columns(df, ["x"])
    with pytest.raises(C.CardinalityError):
        C.require_unique(df, ["k"])
    assert C.resolve_column(df, exact=["sample  name"]) == "Sample Name"
    with pytest.raises(C.CardinalityError):
        C.exactly_one(df)


def test_null_rules(spark):
    df = spark.createDataFrame([(10,), (None,), (3,)], "x int")
    assert {r[0] for r in df.filter(X.keep_unless_equal(F.col("x"), 10)).collect()} == {None, 3}
    a = spark.createDataFrame([("a=1=2;junk;a=3; b = 4",)], "s string").select(X.attributes(F.col("s")).alias("m")).first()["m"]
    assert a["a"] == "3" and "junk" not in a


def test_interval_boundaries(spark):
    df = spark.createDataFrame([("g", 0, 10, 1), ("g", 2, 4, 2), ("g", 10, 12, 3), ("g", 14, 15, 4)], "grp string, s long, e long, i int")
    union = {(r["s"], r["e"]) for r in intervals.union_touching(df, ["grp"], "s", "e").collect()}
    assert union == {(0, 12), (14, 15)}
    b = df.select("grp", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("i").alias("j"))
    pairs = {(r["i"], r["j"]) for r in intervals.overlap_join_half_open(df, b, ("s", "e"), ("s2", "e2"), ["grp"], 4).filter("i < j").collect()}
    assert pairs == {(1, 2)}
    islands = {r["i"]: r["island"] for r in intervals.islands_by_running_end(df, ["grp"], "s", "e", "i", 2).collect()}
    assert islands == {1: 1, 2: 1, 3: 1, 4: 2}


def test_asof_and_bins(spark):
    left = spark.createDataFrame([("u", 5), ("u", 1)], "k string, t int")
    right = spark.createDataFrame([("u", 1, 10.0), ("u", 5, 20.0)], "k string, t int, v double")
    at = {r["t"]: r["x"] for r in ordered.asof_before(left, right, ["k"], "t", "v", "x").collect()}
    before = {r["t"]: r["x"] for r in ordered.asof_before(left, right, ["k"], "t", "v", "x", strict=True).collect()}
    assert at == {1: 10.0, 5: 20.0} and before == {1: None, 5: 10.0}
    bins = spark.createDataFrame([(10.0,), (10.1,), (None,)], "v double").select(ordered.right_closed_bin(F.col("v"), [10.0]).alias("b"))
    assert [r["b"] for r in bins.collect()] == [0, 1, None]


def test_components_of_a_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graphs.connected_components(edges).agg(F.max("component"), F.count("*")).first()[:] == (0, 61)


def test_eigenstrat(spark, tmp_path):
    (tmp_path / "g").write_text("20\n91\n")
    (tmp_path / "s").write_text("rs1 1\nrs2 1\n")
    (tmp_path / "i").write_text("x U p\ny U p\n")
    got = {(r["snp"], r["sample"]): r["dosage"] for r in readers.eigenstrat(spark, *[str(tmp_path / n) for n in "gsi"]).collect()}
    assert got == {("rs1", "x"): 0.0, ("rs1", "y"): 1.0, ("rs2", "x"): None, ("rs2", "y"): 0.5}


def test_streaming_equals_batch(spark):
    sf = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    import tempfile

    source = tempfile.mkdtemp()
    batch.write.mode("overwrite").parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    q = windows.windowed_counts(stream, "ts", "event_type", "value", "6 hours", late="365 days").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = windows.windowed_counts(batch, "ts", "event_type", "value", "6 hours")
    pick = lambda df: sorted(tuple(r) for r in df.select("start", "event_type", "n").collect())
    assert pick(spark.sql("select * from windowed")) == pick(want)
