"""Linkage pruning, principal components and association against plain numpy."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import numeric
from helixframe.operators import genotypes


def panel(seed, n_sites, n_samples, missing=0.05, hold=0.8):
    """Dosages in which sites copy those before them, with gaps in their numbers."""
    rng = np.random.default_rng(seed)
    g = np.zeros((n_sites, n_samples))
    for i in range(n_sites):
        new = rng.binomial(2, rng.uniform(0.05, 0.95), n_samples)
        g[i] = np.where(rng.random(n_samples) < hold, g[max(0, i - rng.integers(1, 4))], new) if i and rng.random() < 0.8 else new
    g[rng.random(g.shape) < missing] = np.nan
    return g


def long(spark, panels):
    rows = [(c, 7 * i + 100, f"s{j}", None if np.isnan(g[i, j]) else int(g[i, j])) for c, g in panels.items() for i in range(len(g)) for j in range(g.shape[1])]
    return spark.createDataFrame(rows, "chrom string, site long, sample string, dosage int").repartition(6)


def sequential(g, window, step, limit):
    kept = []
    for j in range(len(g)):
        linked = False
        for i in kept:
            if j < i // step * step + window:
                both = ~np.isnan(g[i]) & ~np.isnan(g[j])
                x, y = g[i][both], g[j][both]
                n, sx, sy = len(x), int(x.sum()), int(y.sum())
                cov, both = n * int(x @ y) - sx * sy, (n * int(x @ x) - sx * sx) * (n * int(y @ y) - sy * sy)
                linked |= cov * cov > limit * both  # exact: a squared correlation may be just the limit
        if not linked:
            kept.append(j)
    return kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linkage_pruning(spark, seed):
    panels = {"1": panel(seed, 230, 30), "2": panel(seed + 10, 61, 30, hold=0.95), "3": panel(seed + 20, 1, 30)}
    out = genotypes.linkage_pruned(long(spark, panels), ["chrom"], "site", "sample", "dosage").collect()
    assert len(out) == 230 + 61 + 1
    for c, g in panels.items():
        kept = sorted(r["ordinal"] for r in out if r["chrom"] == c and r["kept"])
        assert kept == sequential(g, 50, 5, Fraction(1, 5))
    assert all(r["site"] == 7 * r["ordinal"] + 100 for r in out)


def test_chains_through_many_chunks(spark):
    """A path of links: every second site stays, however the chunks fall."""
    n = 900
    sites = spark.range(n).select(F.lit("c").alias("g"), F.col("id").alias("ordinal"))
    links = spark.range(n - 1).select(F.lit("c").alias("g"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = genotypes.first_kept(sites, links, ["g"], 5, chunk=200)
    assert sorted(r["ordinal"] for r in out.filter("kept").collect()) == list(range(0, n, 2))
    assert genotypes.first_kept(sites, links.limit(0), ["g"], 5, chunk=200).filter("kept").count() == n
    assert genotypes.first_kept(sites.limit(0), links, ["g"], 5).count() == 0
    with pytest.raises(ValueError):
        genotypes.first_kept(sites, links, ["g"], 500, chunk=200)


def standardised(g):
    p = np.nanmean(g, axis=1) / 2
    good = (p > 0) & (p < 1)
    z = (g[good] - 2 * p[good, None]) / np.sqrt(2 * p[good] * (1 - p[good]))[:, None]
    return np.nan_to_num(z)


def test_principal_components(spark):
    rng = np.random.default_rng(5)
    home = rng.integers(0, 4, 150)
    frequency = np.clip(rng.uniform(0.2, 0.8, 400)[:, None] + rng.normal(0, 0.2, (400, 4)), 0.02, 0.98)
    g = rng.binomial(2, frequency[:, home]).astype(float)
    g[rng.random(g.shape) < 0.03] = np.nan
    g[7] = 1.0  # p = 1/2, but a constant; stays, with zeros
    g[8] = 2.0  # no variation by frequency: goes
    got, values = genotypes.principal_components(long(spark, {"1": g}), "site", "sample", "dosage", k=3, extra=5, block=64)
    z = standardised(g)
    want, vectors = np.linalg.eigh(z.T @ z / len(z))
    assert np.allclose(values, want[::-1][:3], rtol=1e-9)
    rows = {r["sample"]: r for r in got.collect()}
    mine = np.array([[rows[f"s{j}"][f"pc{i}"] for i in (1, 2, 3)] for j in range(150)])
    assert np.allclose(mine.T @ mine, np.eye(3), atol=1e-9)
    cosines = np.linalg.svd(mine.T @ vectors[:, ::-1][:, :3], compute_uv=False)
    assert np.sqrt(max(0, 1 - cosines.min() ** 2)) < 1e-6
    for i in range(3):
        assert np.allclose(np.abs(mine[:, i]), np.abs(vectors[:, -1 - i]), atol=1e-6) and mine[np.abs(mine[:, i]).argmax(), i] > 0


def test_components_of_small_tables(spark):
    g = np.array([[0, 1, 2, 0], [2, 1, 0, 2], [0, 0, 1, 1.0]])
    got, values = genotypes.principal_components(long(spark, {"1": g}), "site", "sample", "dosage")
    want = np.linalg.eigvalsh(standardised(g).T @ standardised(g) / 3)[::-1]
    assert np.allclose(values, want[: len(values)]) and len(values) == (want > 1e-10 * want[0]).sum() and got.count() == 4
    flat, values = genotypes.principal_components(long(spark, {"1": np.full((2, 3), 2.0)}), "site", "sample", "dosage")
    assert values == [] and flat.columns == ["sample"]


def test_associations_with_ten_covariates(spark):
    rng = np.random.default_rng(9)
    g = panel(4, 25, 80)
    g[3] = 1.0
    c = rng.normal(size=(80, 10)) * 10.0 ** rng.integers(-3, 4, 10) + 1000 * rng.normal(size=10)
    y = 50 + c @ rng.normal(size=10) / 100 + np.nan_to_num(g[6]) * 2 + rng.normal(size=80)
    names = [f"c{i}" for i in range(10)]
    people = spark.createDataFrame([(f"s{j}", None if j == 5 else float(y[j]), *map(float, c[j])) for j in range(80)], ", ".join(["sample string", "y double", *(f"{n} double" for n in names)]))
    out = {r["site"]: r for r in genotypes.linear_associations(long(spark, {"1": g}), people, ["chrom", "site"], "sample", "dosage", "y", names).collect()}
    assert len(out) == 25
    for i in range(25):
        ok = ~np.isnan(g[i]) & (np.arange(80) != 5)
        r = out[7 * i + 100]
        assert r["n"] == ok.sum()
        if i == 3:
            assert r["beta"] is None and r["p"] is None
            continue
        mid, spread = c[ok].mean(0), c[ok].std(0)
        x = np.column_stack([np.ones(ok.sum()), (c[ok] - mid) / spread, g[i][ok]])
        fit, rss, *_ = np.linalg.lstsq(x, y[ok], rcond=None)
        df = ok.sum() - 12
        se = np.sqrt(rss[0] / df * np.linalg.inv(x.T @ x)[-1, -1])
        assert np.allclose([r["beta"], r["se"], r["t"]], [fit[-1], se, fit[-1] / se], rtol=1e-8)
        assert abs(r["p"] - numeric.t_two_sided(fit[-1] / se, df)) < 1e-9
    few = people.limit(8)
    assert all(r["beta"] is None for r in genotypes.linear_associations(long(spark, {"1": g}), few, ["site"], "sample", "dosage", "y", names).collect())
    twin = people.withColumn("c1", F.col("c0") * 3 + 1)
    assert all(r["beta"] is None for r in genotypes.linear_associations(long(spark, {"1": g}), twin, ["site"], "sample", "dosage", "y", names).collect())


def test_many_tails_at_once():
    t = np.array([0.0, 0.1, -1.5, 4.0, 30.0, np.inf, 2.2, -0.7])
    df = np.array([3.0, 3, 10, 250, 4, 5, 1, 10])
    assert np.allclose(numeric.t_two_sided_many(t, df), [numeric.t_two_sided(a, b) if a else 1.0 for a, b in zip(t, df)], rtol=1e-12, atol=0)


def test_queries_against_numpy(spark):
    """Components and ten covariates on the test tables, where SQL has no words for them."""
    from helixframe.plans import catalog, genetics

    sf = "/root/testdata/sf0.001"
    kept = {(r["chrom"], r["site"]) for r in catalog.QUERIES["m53_linkage_pruned"](spark, sf).filter("kept").collect()}
    calls = genetics.dosages(spark, sf).toPandas()
    calls = calls[[(c, s) in kept for c, s in zip(calls["chrom"], calls["site"])]]
    z = standardised(calls.pivot(index="site", columns="sample", values="x").to_numpy(float))
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    got = catalog.QUERIES["m53_principal_components"](spark, sf).toPandas().sort_values("sample").filter(like="pc").to_numpy()
    assert got.shape == (24, 10) and np.linalg.svd(got.T @ vectors[:, ::-1][:, :10], compute_uv=False).min() > 1 - 1e-12
    out = catalog.QUERIES["m52_ten_covariates"](spark, sf).toPandas()
    assert out["n"].min() > 50 and out["p"].between(0, 1).all() and np.allclose(out["beta"] / out["se"], out["t"])
