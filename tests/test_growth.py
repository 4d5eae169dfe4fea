"""What must hold on larger or odd tables: costs that follow the input, and results that rounding doesn't decide."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import numeric as N


def test_components_keep_small_estimates(spark):
    from helixframe.operators.graphs import connected_components

    out = connected_components(spark.range(40).selectExpr("id as a", "id + 1 as b"))
    assert out.select("component").distinct().collect() == [(0,)]
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64


def test_nearest_in_plane(spark):
    from helixframe.operators.ordered import nearest_in_plane

    rng = random.Random(3)
    rows = [(k, rng.randrange(3), rng.randrange(40), rng.randrange(6) * 5) for k in range(120)] + [(900, 7, 1, 1)]
    got = {r["i"]: (r["best"], r["cost"]) for r in nearest_in_plane(spark.createDataFrame(rows, "i long, g long, x long, y long"), ["g"], "i", "x", "y").collect()}
    want = {}
    for i, g, x, y in rows:
        others = [(abs(x - u) + abs(y - v), j) for j, h, u, v in rows if h == g and j != i]
        if others:
            want[i] = min(others)[::-1]
    assert got == want


def test_best_match_builds_no_pairs(spark):
    from helixframe.plans.catalog import QUERIES

    plan = QUERIES["j14_best_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT (p_partkey" not in plan


def test_exact_tests_of_large_counts():
    n = 20_000_000
    got = N.poisson_rate_test(n, 1.0 * n, n + 8000, 1.0 * n)
    z = 8000 / (2 * n + 8000) ** 0.5
    assert got["p"] == pytest.approx(2 * N.NORMAL.cdf(-z), rel=1e-2)
    got = N.fisher_exact(n, n, n + 8000, n)
    assert got["low"] < got["odds_ratio"] < got["high"] and got["odds_ratio"] == pytest.approx(n / (n + 8000), rel=1e-6)


def test_equal_shares_are_zero_in_any_order(spark):
    from helixframe.operators.statistics import pair_differentiation

    # Two values m and m + s against two of m + s: the variance of both groups together is that within them.
    out = []
    for k in range(40):
        m, step = 0.1 * k, 0.7
        rows = [(k, "a", m), (k, "a", m + step), (k, "b", m + step), (k, "b", m + step)]
        out += rows[::-1] if k % 2 else rows
    got = pair_differentiation(spark.createDataFrame(out, "u long, g string, v double"), "u", "g", "v").toPandas()
    assert len(got) == 40 and (got["vst"] == 0).all() and (got["diff"] != 0).all()


def test_many_records_of_one_strand():
    """Sixty thousand records that overlap in one place: no pair of them is compared by itself."""
    import time

    from helixframe.operators.units import Span, UnitRules, refined

    rng = random.Random(5)
    rules = UnitRules(exons=4, min_span=600, max_compact_span=1500, max_span=1800, partial_exons=3, weak_exons=2, attach_bp=50, fused_span=2300)

    def record(k: int) -> Span:
        at, exons = rng.randrange(2500), []
        for _ in range(rng.randrange(1, 7)):
            exons.append((at, at + rng.randrange(1, 50)))
            at = exons[-1][1] + rng.randrange(1, 600)
        return Span(exons[0][0], exons[-1][1], np.array(exons, np.int64), str(k))

    began = time.time()
    units, alone = refined([record(k) for k in range(60_000)], 900.0, rules)
    assert len({name for u in units for name, _ in u.members} | set(alone)) == 60_000
    assert time.time() - began < 60


def test_cores_come_in_batches(spark):
    from helixframe.plans.catalog import QUERIES

    plan = QUERIES["p09_duplicated_cores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan


def test_states_of_a_wide_family(spark):
    """Three thousand sisters: the product of their messages has no double, and no tip is lost."""
    from helixframe.operators.messages import discrete_states

    tree = [(0, None, 0.0), (1, 0, 1.0), (2, 0, 2.0)] + [(10 + k, 1 + k % 2, 1.0) for k in range(3000)]
    tips = [(10 + k, "t", "b" if k % 10 < 3 else "a") for k in range(3000)]
    out = discrete_states(spark.createDataFrame(tree, "node long, parent long, length double"), spark.createDataFrame(tips, "node long, trait string, s string"), "trait", "s", ["a", "b"], tolerance=1e-2).collect()
    assert len(out) == 3003 and all(r["loglik"] is not None and r["probability"] > 0 for r in out)
    assert {r["node"]: r["state"] for r in out if r["node"] >= 10} == {n: s for n, _, s in tips}


def test_tree_queries_build_no_closure(spark, monkeypatch):
    from helixframe.operators import trees
    from helixframe.plans.catalog import QUERIES

    def closure(*_):
        raise AssertionError("a row for each pair of a node and an ancestor")

    monkeypatch.setattr(trees, "ancestors", closure)
    for name in ("j24_nearest_ancestor", "j25_descendant_closure", "p24_episodes"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_references_alone_are_sorted(spark):
    from helixframe.plans.catalog import QUERIES

    for name in ("p05_focal_states", "p04_informative_sites"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "IN (0,1)" in plan


def test_self_overlaps(spark):
    from helixframe.operators.intervals import self_overlaps_half_open

    rng = random.Random(2)
    rows = [(k, k % 3, a, a + rng.randrange(0, 40)) for k in range(150) for a in [rng.randrange(100)]]
    got = self_overlaps_half_open(spark.createDataFrame(rows, "i long, g long, s long, e long"), ("s", "e"), ["g"], ["i"], 16)
    got = sorted((*sorted((r["i"], r["i2"])), r["overlap"]) for r in got.collect())
    assert got == sorted((i, j, min(e, v) - max(s, u)) for i, g, s, e in rows for j, h, u, v in rows if i < j and g == h and s < v and u < e and min(e, v) > max(s, u))


def test_blocks_meet_parents_as_single_rows(spark):
    from helixframe.operators.composites import paired_blocks

    texts = {("a", 1): "ACGT", ("a", 2): "ACCN", ("a", 3): "-CG", ("b", 4): "AGGT", ("b", 5): "ACGA", ("c", 6): "TGGA"}
    letters = spark.createDataFrame([(block, hap, "k", i, x) for (hap, block), t in texts.items() for i, x in enumerate(t)], "block int, hap string, kind string, pos int, base string")
    pairs = spark.createDataFrame([(x, y) for x in "abc" for y in "abc" if x != y], "child string, parent string")
    out = paired_blocks(letters, pairs)
    # Place 2 tells the blocks of a apart (G, C, G), places 1 and 3 those of b (G, C and T, A); c has one block.
    want = {("b", "a", 4): 1, ("b", "a", 5): 1, ("c", "a", 6): 1, ("a", "b", 1): 2, ("a", "b", 2): 1, ("a", "b", 3): 1, ("c", "b", 6): 2}
    assert {(r["child"], r["parent"], r["block"]): r["sites"] for r in out.collect()} == want
    assert {(r["parent_blocks"], r["child_blocks"]) for r in out.filter("child = 'c'").collect()} == {(3, 1), (2, 1)}
    assert "count(1) AS sites" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_clusters_take_one_sort(spark, monkeypatch):
    from helixframe.operators import intervals, rounds

    monkeypatch.setattr(rounds, "TASK_ROWS", 40)
    rng = random.Random(8)
    rows = [(g, None if rng.random() < 0.05 else rng.randrange(300)) for g in (1, 2, 3, None) for _ in range(60)] + [(9, 5), (9, None), (9, None)]
    got = intervals.point_clusters(spark.createDataFrame(rows, "g int, p long"), ["g"], "p", 3)
    want = set()
    for g in {g for g, _ in rows}:
        points = sorted((p for h, p in rows if h == g), key=lambda p: (p is not None, p))
        number = points.count(None)
        if number:
            want.add((g, number, None, number))
        own = [p for p in points if p is not None]
        firsts = [i for i, p in enumerate(own) if not i or p - own[i - 1] > 3]
        for i, j in zip(firsts, [*firsts[1:], len(own)]):
            number += 1
            want.add((g, number, own[i], j - i))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan and got.rdd.getNumPartitions() == 7


@pytest.mark.parametrize("least", [200_000, 60])
def test_ranges_of_large_groups_alone(spark, monkeypatch, least):
    from helixframe.operators import ordered, rounds

    monkeypatch.setattr(ordered, "RANGED_ROWS", least)
    monkeypatch.setattr(rounds, "TASK_ROWS", 50)
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 30), rng.randrange(900), k) for k in range(500)] + [(None, 5, 900), (3, None, 901)]
    marks = [(rng.randrange(25), rng.randrange(900)) for _ in range(40)] + [(0, rng.randrange(900)) for _ in range(70)] + [(None, 5), (4, None)]
    df, b = spark.createDataFrame(rows, "g int, p int, id int"), spark.createDataFrame(marks, "g int, p int")
    number, cuts = ordered.range_cuts(df, ["g"], "p")
    assert number == 502 and [r[0] for r in cuts] == ([0] if least == 60 else [])
    near = {}
    for g, p, k in rows:
        own = [q for h, q in marks if h == g and None not in (h, q)]
        if own and p is not None:
            near[k] = min((abs(q - p), q) for q in own)[::-1]
    assert {r["id"]: (r["boundary"], r["distance"]) for r in ordered.nearest_boundary(df, b, ["g"], "p").collect()} == near
    total = {r["id"]: r["total"] for r in ordered.cumulative(df, ["g"], "p", [F.asc("id")], F.lit(1)).collect()}
    key = lambda r: (r[1] is not None, r[1], r[2])
    assert total == {r[2]: i + 1 for g in {r[0] for r in rows} for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=key))}


def test_links_over_wide_blocks(spark, monkeypatch):
    from helixframe.operators import genotypes

    rng = np.random.default_rng(11)
    x = rng.integers(0, 3, (230, 12))
    x[5::9] = x[0]
    rows = [(int(c), "c", k, f"s{i}") for k, site in enumerate(x) for i, c in enumerate(site) if rng.random() < 0.9]
    dosages = spark.createDataFrame(rows, "x int, chrom string, site int, sample string")
    links = []
    for cells in (1, 100_000):  # blocks of one window, and of eight
        monkeypatch.setattr(genotypes, "BLOCK_CELLS", cells)
        links.append(sorted(tuple(r) for r in genotypes.linked_sites(dosages, ["chrom"], "site", "sample", "x", 10, 5).select("a", "b").collect()))
    assert links[0] == links[1]
    dose = np.full(x.shape, np.nan)
    for c, _, k, i in rows:
        dose[k, int(i[1:])] = c
    want = []
    for a in range(230):
        for b in range(a + 1, min(230, a // 5 * 5 + 10)):
            both = ~np.isnan(dose[a]) & ~np.isnan(dose[b])
            u, v = dose[a, both], dose[b, both]
            if u.var() > 0 and v.var() > 0 and np.corrcoef(u, v)[0, 1] ** 2 > 0.2 + 1e-12:
                want.append((a, b))
    assert links[0] == want


def test_components_read_calls_once(spark, monkeypatch):
    from helixframe.operators import genotypes

    seen, kept = [], genotypes.settled
    monkeypatch.setattr(genotypes, "settled", lambda df: seen.append(df.columns) or kept(df))
    calls = spark.range(400).selectExpr("id % 40 as site", "id div 40 as sample", "(id * 7 + id div 11) % 3 as x")
    out, values = genotypes.principal_components(calls, "site", "sample", "x", 3)
    assert seen[0] == ["site", "sample", "__g"] and out.count() == 10 and len(values) == 3


def test_pruning_drops_what_has_gone(spark, monkeypatch):
    """Rounds keep what is left of the tree: fewer rows than five times the nodes, where every round over all nodes makes more."""
    from helixframe.operators import messages

    n, kept = 8191, []
    settled = messages.settled

    def counted(df):
        out = settled(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(messages, "settled", counted)
    up, length, rng = {k: k // 2 or None for k in range(1, n + 1)}, {k: float(1 + k % 3) for k in range(1, n + 1)}, random.Random(2)
    tips = {k for k in range(n // 2 + 1, n + 1) if rng.random() < 1 / 3}
    tree = spark.createDataFrame([(k, up[k], length[k]) for k in up], "node long, parent long, length double")
    got = {r["node"]: (r["parent"], r["length"]) for r in messages.pruned(tree, spark.createDataFrame([(k,) for k in tips], "node long")).collect()}
    children = dict.fromkeys(up, 0)
    held = set(tips)
    for k in range(n, 1, -1):
        if k in held:
            held.add(up[k])
            children[up[k]] += 1
    want = {}
    for k in held:
        if children[k] != 1:
            at, way = up[k], length[k] if up[k] else 0.0
            while at and children[at] == 1:
                at, way = up[at], way + (length[at] if up[at] else 0.0)
            want[k] = (at, way)
    assert got == want
    assert sum(kept) < 5 * n


def test_pruning_of_parents_that_are_no_nodes(spark):
    """As in the SQL of g16_pruned_tree: such a parent is the root of what it holds together, without a length, and none of one branch."""
    from helixframe.operators import messages

    rows = [(20, 10, 1.0), (21, 10, 2.0), (40, 20, 3.0), (41, 20, 4.0), (42, 21, 5.0), (90, 80, 1.0), (91, 80, 7.0), (95, 91, 2.0), (97, 96, 1.0)]
    got = messages.pruned(spark.createDataFrame(rows, "node long, parent long, length double"), spark.createDataFrame([(40,), (41,), (42,), (95,)], "node long"))
    assert {tuple(r) for r in got.collect()} == {(10, None, None), (20, 10, 1.0), (40, 20, 3.0), (41, 20, 4.0), (42, 10, 7.0), (95, None, 9.0)}
    with pytest.raises(ValueError):
        messages.pruned(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "node long, parent long, length double"), spark.createDataFrame([(1,)], "node long"))
