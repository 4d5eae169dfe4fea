"""Queries over dosage tables and haplotype origins, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composites as P
from ..operators import genotypes as G
from ..operators.rounds import settled
from ..session import table
from .registry import query

DOSAGES = "g AS (SELECT l_partkey % 20 AS chrom, l_partkey AS site, l_orderkey % 24 AS sample, sum(l_quantity)::BIGINT % 3 AS x FROM lineitem GROUP BY 1, 2, 3)"


def dosages(spark, d):
    """Every part is a site of one of 20 groups, every remainder of the order number a sample; some calls are missing."""
    li = table(spark, d, "lineitem")
    keys = ((F.col("l_partkey") % 20).alias("chrom"), F.col("l_partkey").alias("site"), (F.col("l_orderkey") % 24).alias("sample"))
    return li.groupBy(*keys).agg((F.sum("l_quantity").cast("long") % 3).alias("x"))


_VARY = "(count(*) * sum({0}.x * {0}.x) - sum({0}.x) * sum({0}.x))"


@query(
    "m53_linkage_pruned",
    f"WITH RECURSIVE {DOSAGES}, s AS (SELECT chrom, site, row_number() OVER (PARTITION BY chrom ORDER BY site) - 1 AS o FROM (SELECT DISTINCT chrom, site FROM g)), h AS (SELECT chrom, o, sample, x::DOUBLE AS x FROM g JOIN s USING (chrom, site)), "
    "e AS (SELECT a.chrom, a.o AS a, b.o AS o FROM h a JOIN h b ON a.chrom = b.chrom AND a.sample = b.sample AND b.o > a.o AND b.o < a.o // 5 * 5 + 50 GROUP BY ALL "
    f"HAVING {_VARY.format('a')} * {_VARY.format('b')} > 0 AND pow(count(*) * sum(a.x * b.x) - sum(a.x) * sum(b.x), 2) > 0.2 * ({_VARY.format('a')} * {_VARY.format('b')})), "
    "n AS (SELECT chrom, o, list(a) AS before FROM e GROUP BY 1, 2), r AS (SELECT DISTINCT chrom, 0::BIGINT AS o, [0::BIGINT] AS kept FROM s UNION ALL SELECT r.chrom, s.o, CASE WHEN list_has_any(kept, coalesce(before, [])) THEN kept ELSE list_append(kept, s.o) END FROM r JOIN s ON s.chrom = r.chrom AND s.o = r.o + 1 LEFT JOIN n ON n.chrom = s.chrom AND n.o = s.o) "
    "SELECT s.chrom, s.site, s.o AS ordinal, list_contains(kept, s.o) AS kept FROM r JOIN s ON s.chrom = r.chrom AND s.o = r.o",
)
def linkage_pruned(spark, d):
    """Windows of 50 sites, moved by 5, squared correlation above 0.2."""
    return G.linkage_pruned(dosages(spark, d), ["chrom"], "site", "sample", "x")


@query("m53_principal_components")
def principal_components(spark, d):
    """Ten components of the pruned sites."""
    calls = settled(dosages(spark, d))
    kept = G.linkage_pruned(calls, ["chrom"], "site", "sample", "x").filter("kept").select("chrom", "site")
    return G.principal_components(calls.join(kept, ["chrom", "site"]), "site", "sample", "x")[0]


def customer_dosages(spark, d):
    """Twenty sites with a dosage for each customer who has ordered one of their parts."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.groupBy((F.col("l_partkey") % 20).alias("site"), F.col("o_custkey").alias("sample")).agg((F.sum("l_quantity").cast("long") % 3).alias("x"))


@query(
    "m52_two_covariates",
    "WITH d AS (SELECT l_partkey % 20 AS site, o_custkey AS sample, sum(l_quantity)::BIGINT % 3 AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), j AS (SELECT site, x, c_acctbal AS y, c_nationkey AS u, c_custkey % 7 AS v FROM d JOIN customer ON c_custkey = sample), "
    "a AS (SELECT site, x - regr_intercept(x, u) OVER w - regr_slope(x, u) OVER w * u AS x, y - regr_intercept(y, u) OVER w - regr_slope(y, u) OVER w * u AS y, v - regr_intercept(v, u) OVER w - regr_slope(v, u) OVER w * u AS v FROM j WINDOW w AS (PARTITION BY site)), "
    "b AS (SELECT site, x - regr_slope(x, v) OVER w * v AS x, y - regr_slope(y, v) OVER w * v AS y FROM a WINDOW w AS (PARTITION BY site)), "
    "f AS (SELECT site, count(*) AS n, regr_slope(y, x) AS beta, sqrt((regr_syy(y, x) - pow(regr_slope(y, x), 2) * regr_sxx(y, x)) / (count(*) - 4) / regr_sxx(y, x)) AS se FROM b GROUP BY 1) SELECT site, n, round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 6) AS t FROM f",
)
def two_covariates(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").alias("u"), (F.col("c_custkey") % 7).alias("v"))
    out = G.linear_associations(customer_dosages(spark, d), people, ["site"], "sample", "x", "y", ["u", "v"])
    return out.select("site", "n", *(F.round(c, 6).alias(c) for c in ("beta", "se", "t")))


@query("m52_ten_covariates")
def ten_covariates(spark, d):
    """Balance on dosage with ten covariates: nation, remainders of the customer's number and what their orders come to."""
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("most"), F.min("o_totalprice").alias("least"))
    rests = [(F.col("c_custkey") % k).alias(f"rest{k}") for k in (7, 11, 13, 17, 19)]
    people = table(spark, d, "customer").join(spent, "c_custkey").select(F.col("c_custkey").alias("sample"), F.col("c_acctbal").alias("y"), "c_nationkey", "n_orders", "mean", "most", "least", *rests)
    return G.linear_associations(customer_dosages(spark, d), people, ["site"], "sample", "x", "y", people.columns[2:])


_SIDES = {"view": "Father", "signup": "Father", "error": "Mother", "purchase": "Mother"}
_SIDE = "CASE WHEN {0} IN ('view', 'signup') THEN 'Father' WHEN {0} IN ('error', 'purchase') THEN 'Mother' END"


@query(
    "p06_transmitting_parent",
    "WITH b AS (SELECT user_id, event_id // 40 AS bin, event_type AS p, round(max(value), 0) AS v FROM events WHERE event_type <> 'click' GROUP BY 1, 2, 3), k AS (SELECT DISTINCT user_id, bin FROM b), l AS (SELECT unnest(['view', 'signup', 'error', 'purchase']) AS p), f AS (SELECT user_id, bin, p, coalesce(v, 0) AS v FROM k CROSS JOIN l LEFT JOIN b USING (user_id, bin, p)), "
    "m AS (SELECT user_id, bin, max(v) AS best FROM f GROUP BY 1, 2), w AS (SELECT user_id, bin, CASE WHEN count(*) = 1 AND max(best) > 0 THEN max(p) END AS w FROM f JOIN m USING (user_id, bin) WHERE v >= best - 1e-6 GROUP BY 1, 2), o AS (SELECT user_id, bin, coalesce(last_value(w IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bin ROWS UNBOUNDED PRECEDING), 'Unknown') AS four_way FROM w), "
    f"c AS (SELECT *, count_if({_SIDE.format('four_way')} = 'Father') OVER w AS father, count_if({_SIDE.format('four_way')} = 'Mother') OVER w AS mother FROM o WINDOW w AS (PARTITION BY user_id)), t AS (SELECT *, CASE WHEN father > mother THEN 'Father' WHEN mother > father THEN 'Mother' ELSE 'Unknown' END AS parent FROM c), "
    f"x AS (SELECT t.user_id, t.bin, arg_max(p, v) AS p, max(v) - min(v) AS lead FROM t JOIN f ON f.user_id = t.user_id AND f.bin = t.bin AND {_SIDE.format('p')} = parent GROUP BY 1, 2), y AS (SELECT t.*, CASE WHEN lead > 1e-6 THEN x.p END AS two FROM t LEFT JOIN x ON x.user_id = t.user_id AND x.bin = t.bin) "
    "SELECT user_id, bin, four_way, father AS father_bins, mother AS mother_bins, parent, coalesce(two, 'Unknown') AS constrained, coalesce(last_value(two IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bin ROWS UNBOUNDED PRECEDING), 'Unknown') AS constrained_carried FROM y",
)
def transmitting_parent(spark, d):
    e = table(spark, d, "events").filter("event_type <> 'click'")
    b = e.groupBy("user_id", F.floor(F.col("event_id") / 40).alias("bin"), "event_type").agg(F.round(F.max("value"), 0).alias("v"))
    out = P.trio_origins(b, ["user_id"], "bin", "event_type", "v", _SIDES)
    return out.select("user_id", "bin", "four_way", F.col("Father_bins").alias("father_bins"), F.col("Mother_bins").alias("mother_bins"), "parent", "constrained", "constrained_carried")
