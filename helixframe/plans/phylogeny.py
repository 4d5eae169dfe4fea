"""Trees and models on trees, bound to the test tables (no SQL unless the rule is relational)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.contracts import collected
from ..operators import composites as P
from ..operators import messages as M
from ..operators import sequence as Q
from ..operators import trees as T
from ..operators.rounds import settled
from ..session import table
from .reading import written
from .registry import query
from .science import MATRIX_PAIRS, item_kmers


def nation_tree(n: int = 25) -> tuple[str, list[tuple]]:
    """A balanced tree over nations 0..n-1 as Newick text and as rows."""

    def build(lo: int, hi: int) -> str:
        if hi - lo == 1:
            return f"N{lo}:{1 + lo % 3}"
        mid = (lo + hi) // 2
        return f"({build(lo, mid)},{build(mid, hi)}):1"

    text = build(0, n) + ";"
    return text, T.parse_newick(text)


def nation_values(spark, d):
    """Mean balance and size class of the customers of each nation (25 rows)."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v"), F.count("*").alias("n"), F.avg(F.length("c_name")).alias("x"))
    return {f"N{r['c_nationkey']}": (r["v"], r["n"], r["x"]) for r in c.collect()}


@query("s23_newick", "SELECT 'N' || n_nationkey AS label, (1 + n_nationkey % 3)::DOUBLE AS length FROM nation")
def newick(spark, d):
    text, _ = nation_tree()
    tree = T.read_newick(spark, written(spark.createDataFrame([(text,)], "value string"), "tree"))
    return tree.filter("label <> ''").select("label", "length")


@query("k06_newick_writer")
def newick_writer(spark, d):
    pairs = collected(Q.mash_pairs(item_kmers(spark, d), "item_id", 8), MATRIX_PAIRS)
    m = pairs.pivot(index="a", columns="b", values="mash")
    ids = sorted(set(m.index) | set(m.columns))
    full = m.reindex(index=ids, columns=ids).fillna(0.0).to_numpy()
    return spark.createDataFrame([(N.newick(N.average_linkage(full + full.T), [str(i) for i in ids], ".6g"),)], "tree string")


@query("g09_threshold_clusters")
def threshold_clusters(spark, d):
    pairs = Q.mash_pairs(item_kmers(spark, d), "item_id", 8)
    height = pairs.filter("mash > 0").agg(F.percentile("mash", 0.2)).first()[0]
    p = collected(pairs, MATRIX_PAIRS)
    ids = sorted(set(p["a"]) | set(p["b"]))
    full = p.pivot(index="a", columns="b", values="mash").reindex(index=ids, columns=ids).fillna(0.0).to_numpy()
    labels = N.cut_clusters(N.average_linkage(full + full.T), len(ids), height=height)
    return spark.createDataFrame([(int(i), int(c)) for i, c in zip(ids, labels, strict=True)], "item_id long, cluster int")


@query("g15_grid_stability")
def grid_stability(spark, d):
    """Mean adjusted Rand index of each number of clusters with its neighbours."""
    p = collected(Q.mash_pairs(item_kmers(spark, d), "item_id", 8), MATRIX_PAIRS)
    ids = sorted(set(p["a"]) | set(p["b"]))
    full = p.pivot(index="a", columns="b", values="mash").reindex(index=ids, columns=ids).fillna(0.0).to_numpy()
    merges = N.average_linkage(full + full.T)
    cut = {k: N.cut_clusters(merges, len(ids), clusters=k) for k in range(2, 9)}
    two = lambda c: (c * (c - 1) / 2).sum()

    def rand(a, b):
        t = pd.crosstab(a, b).to_numpy()
        sa, sb, n = two(t.sum(1)), two(t.sum(0)), two(np.array([t.sum()]))
        return 1.0 if (sa + sb) / 2 == sa * sb / n else (two(t.ravel()) - sa * sb / n) / ((sa + sb) / 2 - sa * sb / n)

    rows = [(k, float(np.mean([rand(cut[k], cut[j]) for j in (k - 1, k + 1) if j in cut]))) for k in cut]
    return spark.createDataFrame(rows, "clusters int, stability double")


@query("g06_silhouette_scan")
def silhouette_scan(spark, d):
    """Mean silhouette over the distance matrix of the benchmark's items for each cut of their linkage; the first best one is marked."""
    p = collected(Q.mash_pairs(item_kmers(spark, d), "item_id", 8), MATRIX_PAIRS)
    ids = sorted(set(p["a"]) | set(p["b"]))
    full = p.pivot(index="a", columns="b", values="mash").reindex(index=ids, columns=ids).fillna(0.0).to_numpy()
    full = full + full.T
    merges = N.average_linkage(full)
    scores = [(k, N.silhouette_mean(full, np.asarray(N.cut_clusters(merges, len(ids), clusters=k)))) for k in range(2, min(60, len(ids) - 1) + 1)]
    best = max(scores, key=lambda x: (x[1], -x[0]))[0]
    return spark.createDataFrame([(k, s, k == best) for k, s in scores], "clusters int, silhouette double, best boolean")


@query("m36_phylogenetic_regression")
def phylogenetic_regression(spark, d):
    _, rows = nation_tree()
    v = nation_values(spark, d)
    tips = sorted(v, key=lambda t: int(t[1:]))
    got = T.phylogenetic_regression(rows, tips, np.array([[math.log(v[t][1])] for t in tips]), np.array([v[t][0] for t in tips]))
    return spark.createDataFrame([(name, float(b), float(t), got["lambda"], float(got["aic"])) for name, b, t in zip(("intercept", "log_n"), got["beta"], got["t"], strict=True)], "term string, beta double, t double, lambda double, aic double")


def nation_tips(spark, d, value):
    """The nation tree as a table and a value for each of its tips that has customers (node, trait, v)."""
    _, rows = nation_tree()
    tree = spark.createDataFrame([r[:3] for r in rows], "node long, parent long, length double")
    names = F.broadcast(spark.createDataFrame([(r[0], r[3]) for r in rows if r[3]], "node long, label string"))
    sizes = table(spark, d, "customer").groupBy(F.concat(F.lit("N"), "c_nationkey").alias("label")).agg(F.count("*").alias("n"))
    return tree, names.join(sizes, "label", "left").select("node", F.lit("size").alias("trait"), value.alias("v"))


@query("m37_ancestral_counts")
def ancestral_counts(spark, d):
    """Node values under Brownian motion, rounded half to even and not below 0, with the gains and losses of each branch."""
    tree, tips = nation_tips(spark, d, (F.col("n") % 7).cast("double"))
    found = settled(M.brownian(tree, tips, ["trait"], "v").select("node", F.greatest(F.lit(0), F.bround("value").cast("int")).alias("c")))
    both = tree.filter("parent is not null").join(found, "node").join(found.select(F.col("node").alias("parent"), F.col("c").alias("p")), "parent")
    gain, loss = F.greatest(F.lit(0), F.col("c") - F.col("p")), F.greatest(F.lit(0), F.col("p") - F.col("c"))
    return both.select(F.col("node").cast("int").alias("node"), F.col("parent").cast("int").alias("parent"), F.col("p").alias("parent_count"), F.col("c").alias("child_count"), gain.alias("gain"), loss.alias("loss"))


@query("m38_ancestral_states")
def ancestral_states(spark, d):
    tree, tips = nation_tips(spark, d, F.when(F.col("n") >= 60, "many").when(F.col("n").isNotNull(), "few"))
    out = M.discrete_states(tree, tips, "trait", "v", ["few", "many"])
    return out.select(F.col("node").cast("int").alias("node"), "state", F.col("rates")[0].alias("rate"))


_CUSTOMERS = "c AS (SELECT c_custkey, c_nationkey, n_regionkey, c_acctbal AS x, (1 + c_custkey % 3)::DOUBLE AS t, (1 + c_nationkey % 2)::DOUBLE AS tn, 1.0::DOUBLE AS tr FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def customer_tree(spark, d):
    """World, regions, nations and customers as a tree; nodes are numbered by level: 0, 1 + region, 100 + nation, 1000 + customer."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    lived = n.join(c.select(F.col("c_nationkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi")
    node = lambda df, node, parent, length: df.select(node.cast("long").alias("node"), parent.cast("long").alias("parent"), length.cast("double").alias("length"))
    root = node(spark.range(1), F.lit(0), F.lit(None), F.lit(0))
    regions = node(lived.select("n_regionkey").distinct(), 1 + F.col("n_regionkey"), F.lit(0), F.lit(1))
    nations = node(lived, 100 + F.col("n_nationkey"), 1 + F.col("n_regionkey"), 1 + F.col("n_nationkey") % 2)
    return root.union(regions).union(nations).union(node(c, 1000 + F.col("c_custkey"), 100 + F.col("c_nationkey"), 1 + F.col("c_custkey") % 3))


@query("m37_brownian_values", f"WITH {_CUSTOMERS}, n AS (SELECT c_nationkey, n_regionkey, any_value(tn) AS t, any_value(tr) AS tr, sum(x / t) / sum(1 / t) AS m, 1 / sum(1 / t) AS v FROM c GROUP BY 1, 2), r AS (SELECT n_regionkey, any_value(tr) AS t, sum(m / (t + v)) / sum(1 / (t + v)) AS m, 1 / sum(1 / (t + v)) AS v FROM n GROUP BY 1), w AS (SELECT sum(m / (t + v)) / sum(1 / (t + v)) AS x FROM r), rx AS (SELECT r.*, (m / v + w.x / t) / (1 / v + 1 / t) AS x FROM r, w), nx AS (SELECT n.*, (n.m / n.v + rx.x / n.t) / (1 / n.v + 1 / n.t) AS x FROM n JOIN rx USING (n_regionkey)) SELECT 0 AS node, round(x, 6) AS value FROM w UNION ALL SELECT 1 + n_regionkey, round(x, 6) FROM rx UNION ALL SELECT 100 + c_nationkey, round(x, 6) FROM nx UNION ALL SELECT 1000 + c_custkey, round(x, 6) FROM c")
def brownian_values(spark, d):
    """Balances of customers carried to their nations, regions and the world as the most likely ancestral values."""
    tips = table(spark, d, "customer").select((1000 + F.col("c_custkey")).alias("node"), F.lit("balance").alias("trait"), F.col("c_acctbal").alias("v"))
    return M.brownian(customer_tree(spark, d), tips, ["trait"], "v").select("node", F.round("value", 6).alias("value"))


@query("m38_rates_by_direction")
def rates_by_direction(spark, d):
    """Two states with a rate for each direction, five traits of the customers' tree (a market segment or not) fitted in one run."""
    c = table(spark, d, "customer").select((1000 + F.col("c_custkey")).alias("node"), "c_mktsegment")
    tips = c.join(F.broadcast(c.select(F.col("c_mktsegment").alias("trait")).distinct())).select("node", "trait", F.when(F.col("c_mktsegment") == F.col("trait"), "in").otherwise("out").alias("s"))
    out = M.discrete_states(customer_tree(spark, d), tips, "trait", "s", ["out", "in"], rates="different", tolerance=1e-3)
    return out.select("trait", "node", "state", F.round("probability", 3).alias("probability"))


@query("g10_bounded_clades", f"WITH {_CUSTOMERS}, n AS (SELECT c_nationkey, n_regionkey, any_value(tn) AS tn, any_value(tr) AS tr, count(*) AS k, max(t) AS far, max(t) + coalesce(max(t) FILTER (o > 1), 0) AS w FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY t DESC) AS o FROM c) GROUP BY 1, 2), r AS (SELECT n_regionkey, sum(k) AS k, max(far + tn) AS far, any_value(tr) AS tr, greatest(max(CASE WHEN k > 1 THEN w ELSE 0 END), CASE WHEN count(*) > 1 THEN max(far + tn) + max(far + tn) FILTER (o > 1) ELSE 0 END) AS w FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY far + tn DESC) AS o FROM n) GROUP BY 1), g AS (SELECT greatest(max(w), CASE WHEN count(*) > 1 THEN max(far + tr) + max(far + tr) FILTER (o > 1) ELSE 0 END) AS w FROM (SELECT *, row_number() OVER (ORDER BY far + tr DESC) AS o FROM r)) SELECT 1000 + c_custkey AS node, CASE WHEN g.w <= 6 THEN 0 WHEN r.w <= 6 THEN 1 + c.n_regionkey WHEN CASE WHEN n.k > 1 THEN n.w ELSE 0 END <= 6 THEN 100 + c.c_nationkey ELSE 1000 + c_custkey END AS cluster FROM c JOIN n USING (c_nationkey) JOIN r ON r.n_regionkey = c.n_regionkey, g")
def bounded_clades(spark, d):
    """Clades of the customers' tree in which no two are more than 6 apart."""
    return M.bounded_clades(customer_tree(spark, d), 6.0)


@query("g16_pruned_tree", "WITH RECURSIVE t AS (SELECT o_orderkey AS node, nullif(o_orderkey // 2, 0) AS parent, (1 + o_custkey % 3)::DOUBLE AS length, o_orderstatus AS s FROM orders), r AS (SELECT node, node AS anc, 0 AS steps, 0.0::DOUBLE AS way FROM t UNION ALL SELECT r.node, t.parent, r.steps + 1, r.way + t.length FROM r JOIN t ON r.anc = t.node WHERE t.parent IS NOT NULL), k AS (SELECT node FROM t WHERE s = 'F' AND node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)), m AS (SELECT DISTINCT anc AS node FROM r JOIN k USING (node)), n AS (SELECT parent AS node, count(*) AS c FROM t JOIN m USING (node) WHERE parent IS NOT NULL GROUP BY 1), z AS (SELECT node FROM m LEFT JOIN n USING (node) WHERE coalesce(c, 0) <> 1), a AS (SELECT r.node, arg_min(anc, steps) AS parent, min(way) AS length FROM r JOIN z ON z.node = r.node JOIN z y ON y.node = r.anc WHERE steps > 0 GROUP BY 1) SELECT z.node, a.parent, coalesce(a.length, (SELECT max(way) FROM r WHERE r.node = z.node)) AS length FROM z LEFT JOIN a USING (node)")
def pruned_tree(spark, d):
    """The tree of orders (parent: half the number) cut down to the finished ones at its tips."""
    o = table(spark, d, "orders")
    tree = o.select(F.col("o_orderkey").alias("node"), F.nullif(F.floor(F.col("o_orderkey") / 2), F.lit(0).cast("long")).alias("parent"), (1 + F.col("o_custkey") % 3).cast("double").alias("length"))
    return M.pruned(M.repaired_lengths(tree), o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("node")))


@query("m39_m40_simulated_states")
def simulated_states(spark, d):
    """Two-state histories down the tree of all nations from the stationary root: share of time in state 1 in each of 200 runs, one run a row."""
    _, rows = nation_tree(table(spark, d, "nation").count())
    gain, loss = 0.3, 0.5
    seed = P.stable_seed("simulated states")

    def run(batches):
        for b in batches:
            out = []
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i)])
                state, held, total = {rows[0][0]: int(rng.random() < gain / (gain + loss))}, 0.0, 0.0
                for node, parent, length, _ in rows[1:]:
                    s, left = state[parent], length
                    while left > 0:
                        step = min(left, rng.exponential(1 / (loss if s else gain)))
                        held, total, left = held + step * s, total + step, left - step
                        s = 1 - s if left > 0 else s
                    state[node] = s
                out.append(held / total)
            yield pd.DataFrame({"run": b["id"], "share": out})

    return spark.range(200).mapInPandas(run, "run long, share double")


_TREE = "t AS (SELECT o_orderkey AS node, nullif(o_orderkey // 2, 0) AS parent, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 4 ELSE 0 END AS gain, nullif(o_orderpriority, '5-LOW') AS ord FROM orders), r AS (SELECT node, node AS anc, 0 AS steps FROM t UNION ALL SELECT r.node, t.parent, r.steps + 1 FROM r JOIN t ON r.anc = t.node WHERE t.parent IS NOT NULL)"


@query("p24_episodes", f"WITH RECURSIVE {_TREE}, tips AS (SELECT node, ord FROM t WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)), o AS (SELECT anc AS node, count(DISTINCT ord) AS k, count(*) AS tips, string_agg(DISTINCT ord, ',' ORDER BY ord) AS os FROM r JOIN tips USING (node) GROUP BY 1), n AS (SELECT node, CASE k WHEN 0 THEN 'Unknown' WHEN 1 THEN os ELSE 'Mixed' END AS ord, CASE k WHEN 0 THEN 'Unknown' ELSE os END AS os, tips FROM o), g AS (SELECT node, gain FROM t WHERE gain > 0), near AS (SELECT node, arg_min(anc, steps) AS root FROM r WHERE steps > 0 AND node IN (SELECT node FROM g) AND anc IN (SELECT node FROM g) GROUP BY 1), m AS (SELECT coalesce(near.root, g.node) AS root, g.node, g.gain, n.ord FROM g LEFT JOIN near USING (node) JOIN n ON n.node = g.node) SELECT root, count(*) AS branches, sum(gain)::BIGINT AS total_gain, max(gain)::BIGINT AS most_gain, string_agg(DISTINCT m.ord, ',' ORDER BY m.ord) AS member_orders, any_value(n.ord) AS \"order\", any_value(n.os) AS order_set, any_value(n.tips) AS tips FROM m JOIN n ON n.node = m.root GROUP BY 1")
def episodes(spark, d):
    """Gain branches by their nearest ancestor with a gain, with the orders of the tips below."""
    o = table(spark, d, "orders")
    parent = F.nullif(F.floor(F.col("o_orderkey") / 2), F.lit(0).cast("long"))
    tree = o.select(F.col("o_orderkey").alias("node"), parent.alias("parent"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") % 4).otherwise(0).cast("long").alias("gain"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("order"))
    return M.episodes(tree)



@query("p17_pseudo_reference", "SELECT n_nationkey, substr(n_name, 1, 1) || 'Z' || substr(n_name, 3) AS patched, translate('0101', '01', '10') AS flipped FROM nation")
def pseudo_reference(spark, d):
    from ..functions.expressions import flipped

    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    patches = n.select("n_nationkey", F.lit(2).alias("pos"), F.lit("Z").alias("base"))
    return Q.patched(n, patches, "n_nationkey", "n_name", "pos", "base").select("n_nationkey", "patched", flipped(F.lit("0101")).alias("flipped"))


@query("m52_site_associations", "SELECT l_partkey % 50 AS site, count(*) AS n, round((covar_samp(l_quantity, l_discount) * var_samp(l_tax) - covar_samp(l_discount, l_tax) * covar_samp(l_quantity, l_tax)) / (var_samp(l_discount) * var_samp(l_tax) - covar_samp(l_discount, l_tax) * covar_samp(l_discount, l_tax)), 6) AS beta FROM lineitem GROUP BY 1")
def site_associations(spark, d):
    """Slope of price on dosage with one covariate for every site, from sums of products: one aggregation for all sites."""
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("site"), F.col("l_discount").alias("x"), F.col("l_tax").alias("z"), F.col("l_quantity").alias("y"))
    cov = lambda a, b: F.covar_samp(a, b)
    g = li.groupBy("site").agg(F.count("*").alias("n"), cov("x", "x").alias("xx"), cov("z", "z").alias("zz"), cov("x", "z").alias("xz"), cov("x", "y").alias("xy"), cov("z", "y").alias("zy"))
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    return g.select("site", "n", F.round((F.col("xy") * F.col("zz") - F.col("xz") * F.col("zy")) / det, 6).alias("beta"))
