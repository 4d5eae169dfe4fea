"""Queries over whole tables and texts, against plain Python."""

import pytest

from helixframe.plans import catalog

SF = "/root/testdata/sf0.001"


def test_unregistered_restrictions_are_gone(spark):
    """j15 and p10 have no SQL: every supplier with line items is in the result."""
    from pyspark.sql import functions as F

    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    groups = {r[0] for r in li.filter("l_linenumber = 1").select(F.col("l_suppkey")).distinct().collect()}
    assert {r[0] for r in catalog.QUERIES["p10_merged_blocks"](spark, SF).select("grp").distinct().collect()} == groups
    got = {r[0] for r in catalog.QUERIES["j15_greedy_assignment"](spark, SF).select("grp").distinct().collect()}
    assert any(g % 10 for g in got)


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Aligned texts longer than 60 letters, with short ones and ids from 200 on."""
    import random

    draw = random.Random(3)
    rows = [(i, "".join(draw.choice("ACGé-N") for _ in range(n))) for i, n in ((0, 150), (1, 130), (2, 160), (3, 20), (4, 0), (250, 140), (999, 7))]
    path = tmp_path_factory.mktemp("texts")
    spark.createDataFrame([(i, t, "s") for i, t in rows] + [(5, None, "s")], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path), dict(rows)


def test_variable_sites_of_all_places(spark, texts):
    path, rows = texts
    want = set()
    for pos, ref in enumerate(rows[0]):
        column = [t[pos] for t in rows.values() if len(t) > pos]
        other = [(-column.count(b), b) for b in set(column) - {ref, "-"}]
        if other:
            n, alt = min(other)
            want.add((pos + 1, ref, alt, -n, len(column)))
    assert {tuple(r) for r in catalog.QUERIES["p18_a22_variable_sites"](spark, path).collect()} == want


def test_states_of_all_places(spark, texts):
    path, rows = texts
    sites = [(k, a, b) for k, (a, b) in enumerate(zip(rows[0], rows[1])) if a != b]
    focal, informative = {}, {}
    for i, t in rows.items():
        at = [(t[k], a, b) for k, a, b in sites if k < len(t)]
        if at:
            left, right = sum(x == a for x, a, _ in at), sum(x == b for x, _, b in at)
            focal[i] = (left, right, len(at) - left - right)
        at = [x for x in at if x[0] not in "-N" and x[0] in x[1:]]
        if i > 1 and at:
            informative[i] = (sum(x == a for x, a, _ in at), sum(x == b for x, _, b in at))
    assert {r[0]: tuple(r)[1:] for r in catalog.QUERIES["p05_focal_states"](spark, path).collect()} == focal
    assert {r[0]: tuple(r)[1:] for r in catalog.QUERIES["p04_informative_sites"](spark, path).collect()} == informative


def test_ancestors_of_a_deep_tree(spark):
    from helixframe.operators import trees

    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "node int, parent int")
    assert trees.ancestors(chain).count() == 150 * 151 // 2
    with pytest.raises(ValueError):
        trees.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "node int, parent int"))


def test_count_model_of_all_customers(spark, tmp_path):
    import numpy as np

    from helixframe.functions import numeric as N

    rng = np.random.default_rng(1)
    n = 6000
    late = np.arange(n) >= 5000
    high, price = rng.random(n) < 0.5, rng.integers(50_000, 150_000, n).astype(float)
    done = rng.random(n) < np.where(late & high, 0.9, 0.3)
    rows = [(i, "F" if f else "O", p, "1-URGENT" if h else "5-LOW") for i, (f, p, h) in enumerate(zip(done.tolist(), price.tolist(), high.tolist()))]
    spark.createDataFrame(rows, "o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    want = N.chosen_count_model(high[:, None].astype(float), done.astype(float), price / 1e5)
    got = catalog.QUERIES["m29_m31_count_models"](spark, str(tmp_path)).first()
    assert got["rate_ratio"] == pytest.approx(float(np.exp(want["beta"][1])), rel=1e-9)
    assert got["dispersion"] == pytest.approx(want["dispersion"], rel=1e-9)
