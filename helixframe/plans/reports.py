"""Queries over the report rules and breakpoints, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import ordered as O
from ..operators import rules as R
from ..session import table
from .registry import query


@query("p08_rearrangement_qc", "WITH m AS (SELECT l_suppkey AS assembly, CASE l_returnflag WHEN 'A' THEN 'target' WHEN 'N' THEN 'anchor' ELSE 'non_target' END AS kind, CASE WHEN l_returnflag = 'N' THEN 'l' ELSE 'L' END || CASE WHEN l_returnflag = 'N' THEN l_linenumber % 2 ELSE l_linenumber END AS label FROM lineitem), a AS (SELECT DISTINCT assembly, lower(label) AS label FROM m WHERE kind = 'anchor'), l AS (SELECT assembly, count(DISTINCT label) AS n, string_agg(DISTINCT label, ';' ORDER BY label) AS labels FROM m WHERE kind = 'non_target' AND NOT EXISTS (SELECT 1 FROM a WHERE a.assembly = m.assembly AND a.label = lower(m.label)) GROUP BY 1), g AS (SELECT assembly, count(*) AS models, count_if(kind = 'target') AS t, count_if(kind = 'anchor') AS a, count_if(kind = 'non_target') AS o FROM m GROUP BY 1), u AS (SELECT l_suppkey AS assembly, count(*) AS units, count_if(l_quantity >= 30) AS c, count_if(l_quantity < 30) AS p FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT g.assembly, models, t AS target_models, a AS anchor_models, o AS non_target_models, o / models AS non_target_share, coalesce(n, 0)::INT AS n_labels, coalesce(labels, 'NA') AS labels, coalesce(n, 0) >= 5 OR o / models >= 0.34 AS flag, coalesce(nullif(concat_ws(';', CASE WHEN n >= 5 THEN 'labels>=5' END, CASE WHEN o / models >= 0.34 THEN 'share>=0.34' END), ''), 'NA') AS reason, coalesce(units, 0) AS units, coalesce(c, 0) AS complete_units, coalesce(p, 0) AS partial_units FROM g LEFT JOIN l USING (assembly) LEFT JOIN u USING (assembly)")
def rearrangement_qc(spark, d):
    li = table(spark, d, "lineitem")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    kind = F.when(flag == "A", "target").when(flag == "N", "anchor").otherwise("non_target")
    label = F.when(flag == "N", F.concat(F.lit("l"), line % 2)).otherwise(F.concat(F.lit("L"), line))
    models = li.select(F.col("l_suppkey").alias("assembly"), kind.alias("kind"), label.alias("label"))
    units = li.filter("l_linenumber = 1").select(F.col("l_suppkey").alias("assembly"), F.when(F.col("l_quantity") >= 30, "complete").otherwise("partial").alias("status"))
    return R.rearrangement_qc(models, units, "assembly", "kind", "label", "status", ["complete", "partial"], 5, 0.34)


_ENDS = "e AS (SELECT l_suppkey, CASE WHEN l_discount > 0.05 THEN l_returnflag END AS s, CASE WHEN l_tax > 0.04 THEN l_returnflag END AS t FROM lineitem)"


def _ends(spark, d):
    start, end = F.when(F.col("l_discount") > 0.05, F.col("l_returnflag")), F.when(F.col("l_tax") > 0.04, F.col("l_returnflag"))
    return table(spark, d, "lineitem").select("l_suppkey", start.alias("s"), end.alias("t"))


@query("p14_endpoint_shares", f"WITH {_ENDS}, f AS (SELECT l_suppkey, coalesce(s = 'R', false)::INT + coalesce(t = 'R', false)::INT AS k FROM e) SELECT l_suppkey, count(*) AS n, count_if(k = 2) AS both_n, count_if(k = 2) / count(*) AS both_share, count_if(k >= 1) AS any_n, count_if(k >= 1) / count(*) AS any_share, count_if(k = 0) AS none_n, count_if(k = 0) / count(*) AS none_share FROM f GROUP BY 1")
def endpoint_shares(spark, d):
    return R.endpoint_summary(_ends(spark, d), ["l_suppkey"], "s", "t", "R")


@query("p14_endpoint_configurations", f"WITH {_ENDS} SELECT coalesce(s, 'none') AS start_group, coalesce(t, 'none') AS end_group, count(*) AS n FROM e GROUP BY 1, 2")
def endpoint_configurations(spark, d):
    return R.endpoint_configurations(_ends(spark, d), [], "s", "t")


@query("p22_population_samples", "WITH p AS (SELECT c_custkey, c_acctbal, CASE c_custkey % 4 WHEN 0 THEN 'AFR' WHEN 1 THEN 'AFR-W' WHEN 2 THEN 'AFRICA' END AS pop FROM customer) SELECT c_custkey, c_acctbal AS phenotype FROM p WHERE pop = 'AFR' OR pop LIKE 'AFR-%'")
def population_samples(spark, d):
    k = F.col("c_custkey") % 4
    p = table(spark, d, "customer").withColumn("pop", F.when(k == 0, "AFR").when(k == 1, "AFR-W").when(k == 2, "AFRICA"))
    return p.filter(R.in_population(F.col("pop"), "AFR")).select("c_custkey", F.col("c_acctbal").alias("phenotype"))


@query("p30_track_rows", "WITH o AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_regionkey, n_name) AS i FROM nation), m AS (SELECT s_nationkey, max(s_suppkey + length(s_name)) AS label_at FROM supplier GROUP BY 1) SELECT s_suppkey, (SELECT max(i) FROM o) - i + 1 + 0.22::DOUBLE AS y, (s_suppkey + s_suppkey + length(s_name)) / 2 AS mid, CASE WHEN regexp_matches(s_name, '[13579]$') THEN 'odd' WHEN regexp_matches(s_name, '0$') THEN 'tens' ELSE 'Other' END AS kind, label_at FROM supplier s JOIN o ON n_nationkey = s.s_nationkey JOIN m ON m.s_nationkey = s.s_nationkey")
def track_rows(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "nation")
    order = n.select(F.col("n_nationkey").alias("s_nationkey"), F.row_number().over(Window.orderBy("n_regionkey", "n_name")).alias("ordinal"))
    s = table(spark, d, "supplier").withColumn("last", F.col("s_suppkey") + F.length("s_name"))
    out = R.track_rows(s, order, "s_nationkey", "s_suppkey", "last", [("odd", "[13579]$"), ("tens", "0$")], "s_name", 0.22)
    return out.select("s_suppkey", "y", "mid", "kind", "label_at")


_FLANKS = "u AS (SELECT c_custkey AS hap, c_nationkey AS g, 'SH' || c_nationkey % 3 AS major, CASE WHEN c_custkey % 11 = 0 THEN 'NA' ELSE 'SH' || c_custkey % 5 END AS member FROM customer), v AS (SELECT c_custkey AS hap, length(c_mktsegment) AS g, 'SH' || length(c_mktsegment) % 4 AS major, 'SH' || c_custkey % 5 AS member FROM customer WHERE c_custkey % 7 > 0)"


@query("g17_recombinant_candidates", f"WITH {_FLANKS}, b AS (SELECT hap, u.g AS g1, v.g AS g2, u.major AS major1, v.major AS major2, CASE WHEN u.member = 'NA' THEN '' ELSE u.member END AS m1, v.member AS m2 FROM u JOIN v USING (hap)), c AS (SELECT *, CASE WHEN m1 <> '' THEN m1 ELSE m2 END AS observed FROM b), k AS (SELECT * FROM c WHERE observed <> major1 AND observed <> major2), l AS (SELECT k.hap, count(*) AS n, min(c.hap) AS first FROM k JOIN c ON c.g1 = k.g1 AND c.m1 = k.major1 AND c.g2 <> k.g2 GROUP BY 1), r AS (SELECT k.hap, count(*) AS n, min(c.hap) AS first FROM k JOIN c ON c.g2 = k.g2 AND c.m2 = k.major2 AND c.g1 <> k.g1 GROUP BY 1) SELECT hap, observed, g1, major1, g2, major2, coalesce(l.n, 0)::INT AS n_left, l.first AS first_left, coalesce(r.n, 0)::INT AS n_right, r.first AS first_right FROM k LEFT JOIN l USING (hap) LEFT JOIN r USING (hap)")
def recombinant_candidates(spark, d):
    c = table(spark, d, "customer")
    k, sh = F.col("c_custkey"), lambda x: F.concat(F.lit("SH"), x)
    one = c.select(k.alias("hap"), F.col("c_nationkey").alias("g"), sh(F.col("c_nationkey") % 3).alias("major"), F.when(k % 11 == 0, "NA").otherwise(sh(k % 5)).alias("member"))
    size = F.length("c_mktsegment")
    other = c.filter(k % 7 > 0).select(k.alias("hap"), size.alias("g"), sh(size % 4).alias("major"), sh(k % 5).alias("member"))
    out = R.recombinant_candidates(one, other, "hap", "g", "major", "member")
    return out.select("hap", "observed", "g1", "major1", "g2", "major2", F.size("left").alias("n_left"), F.get("left", F.lit(0)).alias("first_left"), F.size("right").alias("n_right"), F.get("right", F.lit(0)).alias("first_right"))


_POINTS = "e AS (SELECT l_suppkey, l_orderkey, l_linenumber, (l_partkey + l_quantity)::BIGINT AS p FROM lineitem), f AS (SELECT *, CASE WHEN lag(p) OVER w IS NULL OR p - lag(p) OVER w > 3 THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY l_suppkey ORDER BY p)), c AS (SELECT l_suppkey, p, sum(n) OVER (PARTITION BY l_suppkey ORDER BY p RANGE UNBOUNDED PRECEDING) AS k FROM f), b AS (SELECT l_suppkey, min(p) AS q FROM c GROUP BY l_suppkey, k)"


@query("p16_point_boundaries", f"WITH {_POINTS}, x AS (SELECT e.*, q AS low FROM e ASOF LEFT JOIN b ON e.l_suppkey = b.l_suppkey AND e.p >= b.q), y AS (SELECT x.*, q AS high FROM x ASOF LEFT JOIN b ON x.l_suppkey = b.l_suppkey AND x.p <= b.q), z AS (SELECT *, CASE WHEN high IS NULL OR p - low <= high - p THEN low ELSE high END AS boundary FROM y) SELECT l_orderkey, l_linenumber, boundary, abs(p - boundary) AS distance FROM z WHERE abs(p - boundary) <= 5")
def point_boundaries(spark, d):
    """Boundaries are the first points of clusters with gaps of 3 at most; each point has its nearest one within 5."""
    e = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("p"))
    b = I.point_clusters(e, ["l_suppkey"], "p", 3).select("l_suppkey", "p")
    return O.nearest_boundary(e, b, ["l_suppkey"], "p", 5).select("l_orderkey", "l_linenumber", "boundary", "distance")
