"""Graphs, trees, sequences, composite pipelines and models on the test tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.contracts import collected
from ..operators import graphs as G
from ..operators import messages as M
from ..operators import ordered as O
from ..operators import sequence as Q
from ..operators import trees as T
from ..operators.models import CountModel
from ..session import table
from ..streaming import windows as SW
from .grouping import r6
from .registry import query


@query("g01_connected_components", "WITH RECURSIVE e AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey WHERE a.l_quantity = 50 AND b.l_quantity = 50), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a) SELECT node, min(reach) AS component FROM r GROUP BY node")
def components(spark, d):
    li = table(spark, d, "lineitem").filter("l_quantity = 50").select("l_orderkey", "l_suppkey")
    edges = li.join(li.select("l_orderkey", F.col("l_suppkey").alias("b")), "l_orderkey").filter("l_suppkey <> b").select(F.col("l_suppkey").alias("a"), "b")
    return G.connected_components(edges)


_SEQ = "s AS (SELECT item_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'etaoinshrdlucmfwypvbgkjqxz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM benchmark), k AS (SELECT DISTINCT item_id, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT item_id, unnest(list_transform(range(1, length(seq) - 6), lambda i: substr(seq, i, 8))) AS k FROM s))"


def item_kmers(spark, d, k: int = 8):
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    seq = F.translate(letters, "etaoinshrdlucmfwypvbgkjqxz", "ACGTACGTACGTACGTACGTACGTAC")
    return Q.canonical_kmers(table(spark, d, "benchmark").select("item_id", seq.alias("seq")), "item_id", "seq", k)


@query("g02_ubiquitous_kmers", f"WITH {_SEQ}, c AS (SELECT kmer FROM k GROUP BY kmer HAVING count(*) <= 0.2 * (SELECT count(DISTINCT item_id) FROM k)) SELECT item_id, count(*) AS n FROM k WHERE kmer IN (SELECT kmer FROM c) GROUP BY 1")
def ubiquitous(spark, d):
    return Q.drop_ubiquitous(item_kmers(spark, d), "item_id", 0.2).groupBy("item_id").agg(F.count("*").alias("n"))


@query("g03_mash", f"WITH {_SEQ}, n AS (SELECT item_id, count(*) AS n FROM k GROUP BY 1), b AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS n_both FROM k a JOIN k b ON a.kmer = b.kmer AND a.item_id < b.item_id GROUP BY 1, 2), p AS (SELECT x.item_id AS a, y.item_id AS b, x.n AS na, y.n AS nb FROM n x JOIN n y ON x.item_id < y.item_id), j AS (SELECT a, b, coalesce(n_both, 0) AS n_both, coalesce(n_both, 0) / (na + nb - coalesce(n_both, 0)) AS j FROM p LEFT JOIN b USING (a, b)), m AS (SELECT a, b, j, CASE WHEN n_both > 0 THEN greatest(0, -ln(2 * j / (1 + j)) / 8) END AS m FROM j) SELECT a, b, round(j, 6) AS jaccard, round(coalesce(m, (SELECT max(m) FROM m)), 6) AS mash FROM m")
def mash(spark, d):
    return Q.mash_pairs(item_kmers(spark, d), "item_id", 8).select("a", "b", r6(F.col("jaccard"), "jaccard"), r6(F.col("mash"), "mash"))


_TREE = "t AS (SELECT o_orderkey AS node, nullif(o_orderkey // 2, 0) AS parent, o_orderstatus AS status FROM orders), r AS (SELECT node, node AS anc, 0 AS steps FROM t UNION ALL SELECT r.node, t.parent, r.steps + 1 FROM r JOIN t ON r.anc = t.node WHERE t.parent IS NOT NULL)"


def order_tree(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("node"), F.nullif(F.floor(F.col("o_orderkey") / 2), F.lit(0).cast("long")).alias("parent"), F.col("o_orderstatus").alias("status"))


@query("j24_nearest_ancestor", f"WITH RECURSIVE {_TREE} SELECT t.node AS node, (SELECT arg_min(anc, steps) FROM r JOIN t u ON r.anc = u.node WHERE r.node = t.node AND steps > 0 AND u.status = 'F') AS nearest FROM t")
def nearest_ancestor(spark, d):
    tree = order_tree(spark, d)
    return M.nearest_marked(tree, tree.filter("status = 'F'").select("node"))



@query("j25_descendant_closure", f"WITH RECURSIVE {_TREE} SELECT anc AS ancestor, count(*) AS members, max(steps) AS depth FROM r GROUP BY 1")
def descendants(spark, d):
    return M.heights(order_tree(spark, d))



def numbered_nations(spark, d):
    """Nations as the nodes 1 to 25 of a binary tree; the tips are those from 13 on."""
    return table(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("id"))


@query("g11_patristic", "WITH RECURSIVE t AS (SELECT i AS node, nullif(i // 2, 0) AS parent, i % 3 + 1.0 AS len FROM (SELECT n_nationkey + 1 AS i FROM nation)), r AS (SELECT node, node AS anc FROM t UNION ALL SELECT r.node, t.parent FROM r JOIN t ON r.anc = t.node WHERE t.parent IS NOT NULL), d AS (SELECT node, sum(len) AS depth FROM (SELECT r.node, t.len FROM r JOIN t ON r.anc = t.node) GROUP BY 1), l AS (SELECT a.node AS a, b.node AS b, max(d.depth) AS lca FROM r a JOIN r b ON a.anc = b.anc AND a.node < b.node JOIN d ON d.node = a.anc WHERE a.node >= 13 AND b.node >= 13 GROUP BY 1, 2) SELECT a, b, (x.depth + y.depth - 2 * lca)::DOUBLE AS distance FROM l JOIN d x ON x.node = a JOIN d y ON y.node = b")
def patristic(spark, d):
    edges = numbered_nations(spark, d).select(F.col("id").alias("node"), F.nullif(F.floor(F.col("id") / 2), F.lit(0).cast("long")).alias("parent"), (F.col("id") % 3 + 1.0).cast("double").alias("len"))
    closure = T.ancestors(edges)
    depth = closure.join(edges.select(F.col("node").alias("ancestor"), "len"), "ancestor").groupBy("node").agg(F.sum("len").alias("depth"))
    return T.patristic(closure, depth, edges.filter("node >= 13").select("node"))


@query("g12_monophyly", "WITH RECURSIVE t AS (SELECT i AS node, nullif(i // 2, 0) AS parent FROM (SELECT n_nationkey + 1 AS i FROM nation)), r AS (SELECT node, node AS anc FROM t UNION ALL SELECT r.node, t.parent FROM r JOIN t ON r.anc = t.node WHERE t.parent IS NOT NULL), m AS (SELECT i AS node, CASE WHEN i < 16 THEN 'a' WHEN i < 20 THEN 'b' WHEN i % 2 = 0 THEN 'c' ELSE 'd' END AS cluster FROM (SELECT n_nationkey + 1 AS i FROM nation) WHERE i >= 13), s AS (SELECT cluster, count(*) AS size FROM m GROUP BY 1), c AS (SELECT anc, count(*) AS clade FROM r WHERE node >= 13 GROUP BY 1), h AS (SELECT cluster, anc, count(*) AS n FROM m JOIN r USING (node) GROUP BY 1, 2) SELECT h.cluster AS cluster, any_value(s.size) AS size, min(clade) AS clade_size, any_value(s.size) = min(clade) AS monophyletic FROM h JOIN s USING (cluster) JOIN c USING (anc) WHERE h.n = s.size GROUP BY 1")
def monophyly(spark, d):
    ids = numbered_nations(spark, d)
    edges = ids.select(F.col("id").alias("node"), F.nullif(F.floor(F.col("id") / 2), F.lit(0).cast("long")).alias("parent"))
    cluster = F.when(F.col("id") < 16, "a").when(F.col("id") < 20, "b").when(F.col("id") % 2 == 0, "c").otherwise("d")
    return T.monophyletic(T.ancestors(edges), ids.filter("id >= 13").select(F.col("id").alias("node"), cluster.alias("cluster")))


#: Pairs of 2,000 items, the largest matrix that is brought to the driver.
MATRIX_PAIRS = 2_000_000

COLUMNS = "c AS (SELECT doc_id, source AS grp, unnest(range(1, length(text) + 1)) AS pos, unnest(string_split(text, '')) AS base FROM documents WHERE length(text) > 0)"


def columns(spark, d, *references):
    return Q.columns_of(table(spark, d, "documents"), "doc_id", "source", "text", list(references))


@query("p18_a22_variable_sites", f"WITH {COLUMNS}, r AS (SELECT pos, max(base) AS ref FROM c WHERE doc_id = 0 GROUP BY 1), n AS (SELECT pos, base, count(*) AS k FROM c GROUP BY 1, 2), t AS (SELECT pos, sum(k)::BIGINT AS n FROM n GROUP BY 1), b AS (SELECT n.pos, ref, base, k, row_number() OVER (PARTITION BY n.pos ORDER BY k DESC, base) AS rn FROM n JOIN r ON n.pos = r.pos WHERE base <> ref AND base <> '-') SELECT b.pos::INT AS pos, ref, base AS alt, k AS alt_count, n FROM b JOIN t ON b.pos = t.pos WHERE rn = 1")
def variable(spark, d):
    return Q.variable_sites(columns(spark, d, 0), "source", F.col("doc_id") == 0)


@query("p05_focal_states", f"WITH {COLUMNS}, r AS (SELECT pos, max(CASE WHEN doc_id = 0 THEN base END) AS l, max(CASE WHEN doc_id = 1 THEN base END) AS r FROM c GROUP BY 1) SELECT doc_id, count_if(base = l AND base <> r) AS left_n, count_if(base = r AND base <> l) AS right_n, count_if(base <> l AND base <> r) AS other_n FROM c JOIN r USING (pos) WHERE l <> r GROUP BY 1")
def focal(spark, d):
    c = columns(spark, d, 0, 1)
    side = lambda k, name: F.max(F.when(F.col("doc_id") == k, F.col("base"))).alias(name)
    # A maximum of texts sorts its rows: only those of the two references.
    flank = c.filter(F.col("doc_id").isin(0, 1)).groupBy("pos").agg(side(0, "l"), side(1, "r")).filter("l <> r")
    b, left, right = F.col("base"), F.col("l"), F.col("r")
    return c.join(F.broadcast(flank), "pos").groupBy("doc_id").agg(F.count_if(b == left).alias("left_n"), F.count_if(b == right).alias("right_n"), F.count_if((b != left) & (b != right)).alias("other_n"))


@query("p11_p13_transitions", "WITH i AS (SELECT user_id, event_id, ts, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch(ts) AS gap FROM events) SELECT event_id, event_type || '>' || nt AS kind, gap <= 5000 AS joined FROM i WHERE nt IS NOT NULL")
def transitions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp")).select("event_id", "event_type", F.lead("event_type").over(w).alias("nt"), (F.unix_micros(F.lead("t").over(w)) - F.unix_micros("t")).alias("gap"))
    return e.filter("nt is not null").select("event_id", F.concat_ws(">", "event_type", "nt").alias("kind"), (F.col("gap") <= 5_000_000_000).alias("joined"))


@query("p15_crop_window", "SELECT l_suppkey, greatest(min(l_partkey) - 100, 0) AS lo, least(max(l_partkey) + 100, 2000) AS hi FROM lineitem WHERE l_quantity > 45 GROUP BY 1")
def crop(spark, d):
    g = table(spark, d, "lineitem").filter("l_quantity > 45").groupBy("l_suppkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"))
    return g.select("l_suppkey", F.greatest(F.col("a") - 100, F.lit(0)).alias("lo"), F.least(F.col("b") + 100, F.lit(2000)).alias("hi"))


@query("p19_anchor_interval", "SELECT l_suppkey, max(l_partkey) FILTER (l_returnflag = 'A') AS s, min(l_partkey) FILTER (l_returnflag = 'R') AS e, count(DISTINCT l_linestatus) AS contigs FROM lineitem GROUP BY 1")
def anchor_interval(spark, d):
    flag, k = F.col("l_returnflag"), F.col("l_partkey")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max(F.when(flag == "A", k)).alias("s"), F.min(F.when(flag == "R", k)).alias("e"), F.count_distinct("l_linestatus").alias("contigs"))


@query("p21_panel", "SELECT p_partkey AS site, s AS sample, coalesce(g, '.|.') AS gt FROM part, (SELECT unnest([1, 2, 3]) AS s) LEFT JOIN (SELECT l_partkey, l_suppkey, max(CASE WHEN l_quantity > 25 THEN '1|0' ELSE '0|0' END) AS g FROM lineitem GROUP BY 1, 2) ON l_partkey = p_partkey AND l_suppkey = s")
def panel(spark, d):
    sites = table(spark, d, "part").select(F.col("p_partkey").alias("site"))
    spine = sites.select("site", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("sample"))
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("site"), F.col("l_suppkey").cast("int").alias("sample")).agg(F.max(F.when(F.col("l_quantity") > 25, "1|0").otherwise("0|0")).alias("g"))
    return spine.join(g, ["site", "sample"], "left").select("site", "sample", F.coalesce("g", F.lit(".|.")).alias("gt"))



@query("p23_representative", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rn FROM customer) WHERE rn = 1")
def representative(spark, d):
    return O.best_record(table(spark, d, "customer"), ["c_nationkey"], [F.desc_nulls_last("c_acctbal"), F.asc("c_custkey")]).select("c_nationkey", "c_custkey")


@query("p27_endpoint_status", "SELECT l_orderkey, CASE WHEN list_contains(list(l_returnflag), 'R') THEN 'R' ELSE min(l_returnflag) END AS status, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS combined FROM lineitem GROUP BY 1")
def endpoint_status(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("s"))
    return g.select("l_orderkey", F.when(F.array_contains("s", "R"), "R").otherwise(F.col("s")[0]).alias("status"), F.array_join("s", "+").alias("combined"))


@query("p29_scope_table", "SELECT n_name, CASE WHEN n IS NULL THEN 'no supplier' WHEN n < 3 THEN 'too few' ELSE 'included' END AS scope, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def scope(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "nation").join(s, "n_nationkey", "left").select("n_name", F.when(F.col("n").isNull(), "no supplier").when(F.col("n") < 3, "too few").otherwise("included").alias("scope"), F.coalesce("n", F.lit(0)).alias("n"))


@query("st_sliding_windows", "WITH w AS (SELECT event_type, value, unnest([0, 1]) AS k, time_bucket(INTERVAL 6 HOUR, ts) AS b FROM events) SELECT b - k * INTERVAL 6 HOUR AS start, b - k * INTERVAL 6 HOUR + INTERVAL 12 HOUR AS \"end\", event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM w GROUP BY 1, 2, 3")
def sliding(spark, d):
    out = SW.windowed_counts(table(spark, d, "events"), "ts", "event_type", "value", "12 hours", "6 hours")
    return out.withColumn("mean_value", F.round("mean_value", 6))


@query("st_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, s")
def sessions(spark, d):
    return SW.sessions(table(spark, d, "events"), "ts", "user_id", "2 hours")


# ---- models (no SQL; checked by tests)


@query("m19_m20_trait_models")
def trait_models(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(400)).alias("bin"))
    means = li.groupBy("l_returnflag", "bin").agg(*[F.avg(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("bin")
        m = N.least_squares(p[["l_discount", "l_tax"]].to_numpy(), N.inverse_normal_ranks(p["l_quantity"].to_numpy()))
        return pd.DataFrame({"trait": p["l_returnflag"].iloc[0], "term": ["intercept", "discount", "tax"], "beta": m["beta"].round(6), "se": m["se"].round(6), "p": m["p"].round(6)})

    return means.groupBy("l_returnflag").applyInPandas(fit, "trait string, term string, beta double, se double, p double")


def summary_frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query("m33_exact_rate_tests")
def exact_rates(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("x"), (F.sum("o_totalprice") / 1e6).alias("t")).orderBy("o_orderpriority").collect()
    base = g[0]
    rows = [(r["o_orderpriority"], *[float(v) for v in N.poisson_rate_test(r["x"], r["t"], base["x"], base["t"]).values()]) for r in g[1:]]
    return summary_frame(spark, rows, "priority string, ratio double, p double, low double, high double")


@query("m34_fisher")
def fisher(spark, d):
    c = {(r["quality"], r["toxic"]): r["n"] for r in table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n")).collect()}
    got = N.fisher_exact(*[c.get(k, 0) for k in ((0, 0), (0, 1), (1, 0), (1, 1))])
    return summary_frame(spark, [tuple(float(v) for v in got.values())], "odds_ratio double, p double, low double, high double")


@query("m26_lowess_trend")
def lowess_trend(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))

    def smooth(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("day")
        x = np.arange(len(p), dtype=float)
        return p.assign(fit=N.lowess(x, p["v"].to_numpy()))

    return days.groupBy(F.lit(1).alias("all")).applyInPandas(lambda p: smooth(p[["day", "v"]]), "day date, v double, fit double")


@query("m27_bootstrap_ci")
def bootstrap(spark, d):
    means = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("v"))
    x = np.sort(collected(means, 1_000_000)["v"].to_numpy())
    low, high = N.bootstrap_interval(x, np.mean, 1000, 42)
    return summary_frame(spark, [(float(x.mean()), low, high)], "mean double, low double, high double")


@query("g04_g05_upgma")
def upgma(spark, d):
    pairs = collected(Q.mash_pairs(item_kmers(spark, d), "item_id", 8), MATRIX_PAIRS)
    ids = sorted(set(pairs["a"]) | set(pairs["b"]))
    spot = {v: k for k, v in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for r in pairs.itertuples():
        m[spot[r.a], spot[r.b]] = m[spot[r.b], spot[r.a]] = r.mash
    labels = N.cut_clusters(N.average_linkage(m), len(ids), clusters=5)
    return summary_frame(spark, [(int(i), int(c)) for i, c in zip(ids, labels, strict=True)], "item_id long, cluster int")


@query("m54_principal_coordinates")
def pcoa(spark, d):
    centres = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centres = collected(centres, 100_000)  # labels x dimensions
    c = centres.pivot(index="label", columns="i", values="x").sort_index()
    m = np.sqrt(((c.to_numpy()[:, None] - c.to_numpy()[None]) ** 2).sum(-1))
    xy, share = N.principal_coordinates(m, 2)
    return summary_frame(spark, [(int(k), float(abs(a)), float(abs(b)), float(share[0])) for k, (a, b) in zip(c.index, xy, strict=True)], "label int, axis1 double, axis2 double, share1 double")


@query("m23_m24_rank_permutation")
def rank_permutation(spark, d):
    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("s_suppkey")
        x, y = p["s_acctbal"].to_numpy(), p["s_suppkey"].to_numpy(float)
        rho, pv = N.spearman_permutation(x, y, 999, 42)
        prho, ppv = N.partial_spearman(x, y, p[["s_nationkey"]].to_numpy(float), 999, 42)
        return pd.DataFrame({"rho": [rho], "p": [pv], "partial_rho": [prho], "partial_p": [ppv]})

    return table(spark, d, "supplier").groupBy(F.lit(1).alias("all")).applyInPandas(lambda p: fit(p), "rho double, p double, partial_rho double, partial_p double")


@query("m29_m31_count_models")
def count_models(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("y"), (F.sum("o_totalprice") / 1e5).alias("t"), F.avg(F.col("o_orderpriority").startswith("1").cast("double")).alias("x"))
    model, null = CountModel(g, "y", "t", ["x"]), CountModel(g, "y", "t", [])
    poisson = model.poisson()
    full = poisson if poisson["dispersion"] <= 1.5 else model.negative_binomial(poisson["beta"])
    chi, p = N.likelihood_ratio(null.poisson()["loglik"], poisson["loglik"], 1)
    return spark.createDataFrame([(full["family"], float(np.exp(full["beta"][1])), full["dispersion"], chi, p)], "family string, rate_ratio double, dispersion double, chi2 double, p double")
