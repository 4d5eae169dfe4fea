"""Mixtures, smooth trends, bundles, logistic scans and episodes against known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import numeric as N
from helixframe.operators import copies as C
from helixframe.operators import trees as T
from helixframe.plans import catalog

SF = "/root/testdata/sf0.001"


def test_smooth_falls_back_with_few_places():
    x, y = np.array([1.0, 2, 3]), np.array([2.0, 4, 6])
    assert N.smooth(x, y) == pytest.approx(y)
    assert np.isnan(N.smooth(x[:2], y[:2])).all() and np.isnan(N.smooth(np.ones(5), np.arange(5.0))).all()
    assert N.smooth(np.array([0.0, 0, 1, 2]), np.array([1.0, 1, 2, 5])) == pytest.approx([1, 1, 2, 5])  # a parabola
    fit = N.smooth(np.array([0.0, 1, 2, 3, 4, np.nan]), np.array([0.0, 2, 4, 6, 8, 5]))
    assert fit[:5] == pytest.approx([0, 2, 4, 6, 8]) and np.isnan(fit[5])


def test_pseudo_r2_and_permutation():
    y = np.array([1.0, 2, 3, 4])
    assert N.pseudo_r2(y, y) == 1 and N.pseudo_r2(y, np.full(4, 2.5)) == 0 and N.pseudo_r2(y, -10 * y) == 0
    assert np.isnan(N.pseudo_r2(y[:2], y[:2])) and np.isnan(N.pseudo_r2(np.ones(4), np.ones(4)))
    x = np.arange(30.0)
    rng = np.random.default_rng(0)
    bent = N.smooth_permutation(x, (x - 15) ** 2 + rng.normal(size=30), 199, 1)
    assert bent["p"] == 1 / 200 and bent["r2"] > 0.8 and abs(bent["slope"]) < 2
    assert N.smooth_permutation(x, rng.normal(size=30), 199, 1)["p"] > 0.02
    assert np.isnan(N.smooth_permutation(x[:3], x[:3], 9, 1)["p"])


def test_labelled_mixture():
    rng = np.random.default_rng(3)
    true = rng.integers(1, 6, 400).astype(float)
    x = true / 2 + 0.3 + rng.normal(0, 0.04, 400)
    m = N.labelled_mixture(x[:80], true[:80], x)
    assert m["states"][0] == max(0, np.floor((m["intercept"] + m["slope"] * x).min())) and m["states"][-1] == np.ceil((m["intercept"] + m["slope"] * x).max()) + 1
    assert (m["state"] == true).all() and m["sigma"] < 0.2 and abs(m["offset"]) < 0.1 and m["weight"].sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        N.labelled_mixture(x[:0], true[:0], x)


def test_mixture_states_follow_the_kernel(spark):
    rng = np.random.default_rng(5)
    true = rng.integers(0, 4, 120).astype(float)
    x = true * 3 + rng.normal(0, 0.9, 120)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, true)], "g int, x double, y double")
    got = [r["state"] for r in C.mixture_states(df, C.mixture_parameters(df, "g", "x", "y"), "g", "x").orderBy("x").collect()]
    assert got == N.labelled_mixture(x, true)["state"][np.argsort(x)].tolist()


def pieces(ids):
    return [(b, 10 * i, 10 * i + 10) for i, b in enumerate(ids.split())]


def test_curated_bundles():
    rows = C.curated_bundles(pieces("1 8 3 7 10 11 4 12 9 3 6 9 13 5 12 0"))
    assert [(b, t, s, e) for b, t, s, e, _ in rows] == [("0", "U", 0, 10), ("2", "R", 20, 30), ("3", "U", 30, 60), ("4", "U", 60, 70), ("5", "U", 70, 90), ("2", "R", 90, 100), ("6", "U", 100, 130), ("7", "U", 130, 140), ("1", "U", 140, 160)]
    assert [r[4] for r in rows][:3] == ["0:52:0:0:51:U", "2:34:0:1:33:R", "3:94:0:0:93:U"]
    fused = C.curated_bundles(pieces("1 2 8 3 7 4 5 0 8 3 6 5 4 12 0"))
    assert fused[0][4] == "0:52:0:0:5:U" and fused[1] == ("5", "U", 10, 30, "5:52:0:0:51:U")
    assert [r[0] for r in fused] == "0 5 2 3 4 7 5 2 6 7 4 1".split()
    assert C.curated_bundles(pieces("1 2 1 3 7 10 11 4 0"))[0][:4] == ("0", "U", 0, 30)


@pytest.mark.parametrize("ids", ["2 3 4 0", "1 3 7 4", "1 3 9 10 11 13 6 7 4 4 5 5 12", "1 3 3 4 12"])
def test_unknown_bundles_are_errors(ids):
    with pytest.raises(C.UnknownPattern):
        C.curated_bundles(pieces(ids))


def test_logistic_fit():
    # A table of 2 x 2: the coefficient is the log odds ratio, its variance the sum of reciprocals.
    x, y = np.repeat([1.0, 1, 0, 0], [30, 20, 15, 35]), np.repeat([1.0, 0, 1, 0], [30, 20, 15, 35])
    m = N.logistic_fit(x[:, None], y)
    assert m["beta"][1] == pytest.approx(np.log(30 * 35 / (20 * 15))) and m["se"][1] == pytest.approx(np.sqrt(1 / 30 + 1 / 20 + 1 / 15 + 1 / 35))
    with pytest.raises((ValueError, np.linalg.LinAlgError)):
        N.logistic_fit(y[:, None], y)


def test_phenome_scan_equals_a_fit_on_all_people(spark):
    out = {r["phenotype"]: r for r in catalog.QUERIES["m51_phenome_scan"](spark, "/root/testdata/sf0.01").collect()}
    from helixframe.plans import copies

    marks, people, _ = copies.phenome(spark, "/root/testdata/sf0.01")
    name = min(out)
    p = people.join(marks.filter(F.col("phenotype") == name), "person", "left").toPandas()
    p = p[~(p["case"] == 0)].fillna({"case": 0})
    assert (out[name]["cases"], out[name]["controls"]) == (p["case"].sum(), (p["case"] == 0).sum())
    m = N.logistic_fit(p[["dose", "sex"]].to_numpy(float), p["case"].to_numpy(float))
    assert out[name]["beta"] == pytest.approx(m["beta"][1], rel=1e-6) and out[name]["p"] == pytest.approx(m["p"][1], rel=1e-6)
    assert out[name]["p_bonferroni"] == pytest.approx(min(1, m["p"][1] * len(out))) and all(r["cases"] >= 20 for r in out.values())


def test_episodes_follow_the_nearest_gain(spark):
    """1-2-4-8 is a path; gains on 2, 4 and 8: 8 belongs to 4, 4 to 2."""
    tree = spark.createDataFrame([(1, None, 0), (2, 1, 1), (3, 1, 2), (4, 2, 5), (8, 4, 1), (9, 4, 0)], "node long, parent long, gain long")
    tips = spark.createDataFrame([(8, "b"), (9, "a"), (3, None)], "node long, order string")
    got = {r["root"]: (r["branches"], r["total_gain"], r["most_gain"], r["order"], r["order_set"], r["tips"]) for r in T.episodes(tree, T.ancestors(tree), tips).collect()}
    assert got == {2: (2, 6, 5, "Mixed", "a,b", 2), 4: (1, 1, 1, "Mixed", "a,b", 2), 3: (1, 2, 2, "Unknown", "Unknown", 1)}


def test_leave_one_out_tests(spark):
    out = {r["removed"]: r for r in catalog.QUERIES["p25_leave_one_out_tests"](spark, SF).collect()}
    li = spark.read.parquet(f"{SF}/lineitem.parquet").toPandas()
    assert set(out) == {"none", *map(str, li["l_suppkey"].unique() % 7)}
    own = li[li["l_suppkey"] % 7 != 3]
    for name, part in (("none", li), ("3", own)):
        a, b = part[part["l_linestatus"] == "O"], part[part["l_linestatus"] == "F"]
        gains = [(x["l_returnflag"] == "R").sum() for x in (a, b)]
        want = N.poisson_rate_test(int(gains[0]), a["l_quantity"].sum(), int(gains[1]), b["l_quantity"].sum())
        assert (out[name]["gains_open"], out[name]["gains_closed"]) == tuple(gains) and out[name]["p"] == pytest.approx(want["p"])
        assert out[name]["fisher_p"] == pytest.approx(N.fisher_exact(len(b) - gains[1], gains[1], len(a) - gains[0], gains[0])["p"])


def test_silhouette_of_a_matrix():
    x = np.array([0.0, 1, 10, 11, 30])
    d = np.abs(x[:, None] - x[None])
    # The first point has a = 1 and b = the mean of 10 and 11.
    s0, s1 = (10.5 - 1) / 10.5, (9.5 - 1) / 9.5
    assert N.silhouette_mean(d, np.array([0, 0, 1, 1, 2])) == pytest.approx((s0 + s1 + s1 + s0 + 0) / 5)


def test_ranks_by_ranges(spark):
    from pyspark.sql import Window

    from helixframe.operators import ordered as O

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(g), float(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 900), rng.integers(0, 200, 900)))], "g int, v double, i int").repartition(5)
    for down in (False, True):
        got = O.cumulative(df, ["g"], "v", [F.asc("i")], F.lit(1), descending=down)
        rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v") if down else F.asc("v"), "i"))
        assert got.withColumn("rank", rank).filter("rank <> total").count() == 0 and got.count() == 900
    total = O.cumulative(df, [], "i", [], F.col("v")).orderBy("i").toPandas()
    assert total["total"].tolist() == pytest.approx(np.cumsum(total["v"]).tolist())


def test_numbered_lines(spark, tmp_path):
    from helixframe.sources import readers

    for k in range(3):
        (tmp_path / f"part{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(50)))
    got = readers.numbered_lines(spark, f"file://{tmp_path}").orderBy("row").toPandas()
    assert got["row"].tolist() == list(range(1, 151))
    assert all(g["value"].tolist() == sorted(g["value"], key=lambda v: int(v[2:])) for _, g in got.groupby(got["value"].str[0]))


def test_compressed_text_and_long_files(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("(A:1,\nB:2);\n")
    assert T.read_newick(spark, f"file://{tmp_path}/t.nwk").count() == 3
    (tmp_path / "long.nwk").write_text("\n" * (T.MAX_NODES + 5))
    with pytest.raises(ValueError):
        T.read_newick(spark, f"file://{tmp_path}/long.nwk")


def span(name, s, e, exons):
    """A record with `exons` exons of 100, spread over it."""
    from helixframe.operators.units import Span

    at = np.linspace(s, e - 100, exons).astype(int) if exons > 1 else np.array([s])
    return Span(s, e, np.column_stack([at, at + 100]), name)


def test_units_of_one_strand():
    from helixframe.operators.units import UnitRules, refined

    rules = UnitRules()
    a, a2, b = span("a", 0, 8000, 9), span("a2", 500, 8500, 9), span("b", 50_000, 58_000, 9)
    rows = [
        a, a2, b,
        span("fragment", 7000, 8400, 2),
        span("stretched", 0, 17_000, 9), span("stretched2", 49_000, 66_000, 40),
        span("fused", 0, 60_000, 9), span("bridge", 8_300, 50_100, 3),
        span("partial", 100_000, 106_000, 5), span("after", 101_000, 104_000, 4), span("weak", 200_000, 200_900, 2), span("tiny", 300_000, 300_100, 1),
    ]
    units, alone = refined(rows, 8000.0, rules)
    got = {(u.s, u.e, u.kind): dict(u.members) for u in units}
    assert got[0, 8500, "complete"] == {"a": "complete seed", "a2": "complete seed", "fragment": "fragment", "fused": "fused", "bridge": "fused", "stretched": "stretched"}
    assert set(got[50_000, 58_000, "complete"]) == {"b", "fused", "bridge", "stretched2"}
    assert got[100_000, 106_000, "partial"] == {"partial": "partial seed", "after": "fragment"}
    assert got[200_000, 200_900, "weak"] == {"weak": "weak seed"} and alone == ["tiny"]


def test_units_query_places_every_record(spark):
    out = catalog.QUERIES["p07_local_units"](spark, SF).toPandas()
    assert out["name"].nunique() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert {"complete seed", "fragment"} <= set(out["role"]) and (out["unit"].isna() == (out["role"] == "unassigned")).all()
    numbered = out.dropna(subset="unit").drop_duplicates(["assembly", "unit"]).sort_values(["assembly", "unit"])
    for _, g in numbered.groupby("assembly"):
        assert g["unit"].tolist() == list(range(1, len(g) + 1))


def test_core_of_gene():
    from helixframe.operators.units import core_of_gene

    gene, free = (100, 200), (None, None)
    assert core_of_gene(gene, free, [(90, 260, 0.9), (100, 195, 0.8)], 0.9, 10)[:2] == (100, 195)  # the shorter one
    assert core_of_gene(gene, free, [(100, 150, 0.9), (155, 200, 0.7)], 0.9, 10) == (100, 200, 1.0, pytest.approx(0.8), 2)
    assert core_of_gene(gene, free, [(100, 140, 0.9), (155, 200, 0.7)], 0.9, 10) is None  # too far apart
    assert core_of_gene(gene, (95, None), [(90, 210, 0.9)], 0.9, 10) is None  # reaches into the gene before
    assert core_of_gene(gene, (95, 210), [(96, 210, 0.9), (96, 190, 0.9)], 0.9, 10)[:2] == (96, 190)
    # A run is found once spans that end or begin like a shorter one are left out.
    assert core_of_gene(gene, free, [(100, 145, 0.9), (100, 150, 0.9), (150, 200, 0.9)], 0.9, 10)[4] == 2
