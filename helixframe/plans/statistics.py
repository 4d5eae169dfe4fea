"""Scalar rules and statistics that stay in the JVM, on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import intervals as I
from ..operators import ordered as O
from ..operators import statistics as S
from ..session import table
from .grouping import r6
from .registry import query

_DIFF = """g AS (SELECT l_partkey AS unit, r_name AS g, l_quantity AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 s AS (SELECT unit, g, count(v) AS n, avg(v) AS m, var_samp(v) AS v FROM g GROUP BY 1, 2),
 p AS (SELECT a.unit, a.g AS a, b.g AS b, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.v AS va, b.v AS vb FROM s a JOIN s b ON a.unit = b.unit AND a.g < b.g WHERE a.n >= 2 AND b.n >= 2),
 q AS (SELECT unit, a, b, ma - mb AS diff, ((na - 1) * va + (nb - 1) * vb + na * nb / (na + nb) * (ma - mb) * (ma - mb)) / (na + nb - 1) AS total, (na * va + nb * vb) / (na + nb) AS within FROM p),
 t AS (SELECT unit, a, b, diff, CASE WHEN total > 0 AND (total - within) / total >= 0 THEN (total - within) / total END AS vst FROM q)"""


@query("vst_rank", f"WITH {_DIFF}, k AS (SELECT *, round(vst * abs(diff), 9) AS metric FROM t WHERE vst IS NOT NULL AND diff <> 0) SELECT unit, a, b, round(vst, 6) AS vst, round(diff, 6) AS diff, round(metric, 4) AS metric, row_number() OVER (PARTITION BY a, b ORDER BY metric DESC, unit) AS rank, round(row_number() OVER (PARTITION BY a, b ORDER BY metric DESC, unit) * 1.0 / count(*) OVER (PARTITION BY a, b), 6) AS percentile FROM k")
def vst_rank(spark, d):
    """Population-differentiation ranking: part (unit), supplier region (group), quantity (value)."""
    place = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "lineitem").join(place.select(F.col("s_suppkey").alias("l_suppkey"), "r_name"), "l_suppkey").select(F.col("l_partkey").alias("unit"), "r_name", "l_quantity")
    out = S.ranked_differentiation(S.pair_differentiation(rows, "unit", "r_name", "l_quantity"), "unit")
    return out.select("unit", "a", "b", r6(F.col("vst"), "vst"), r6(F.col("diff"), "diff"), F.round("metric", 4).alias("metric"), "rank", r6(F.col("percentile"), "percentile"))


@query("m01_m03_guarded_scalars", "SELECT event_id, round(CASE WHEN v > 0 THEN 10 / v END, 6) AS ratio, round(ln(1 + v), 6) AS l1p, round(coalesce(v, 0) + coalesce(w, 0), 6) AS skipping, round(v + w, 6) AS propagating, round(greatest(least(v, 75), 25), 6) AS clipped FROM (SELECT event_id, value AS v, nullif(event_id % 4, 0)::DOUBLE AS w FROM events)")
def guarded(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("value").alias("v"), F.nullif((F.col("event_id") % 4).cast("double"), F.lit(0.0)).alias("w"))
    v, w = F.col("v"), F.col("w")
    return e.select("event_id", r6(X.guarded_ratio(F.lit(10.0), v), "ratio"), r6(F.log1p(v), "l1p"), r6(X.sum_skipping_nulls(v, w), "skipping"), r6(v + w, "propagating"), r6(X.clip(v, 25.0, 75.0), "clipped"))


@query("m05_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0)::BIGINT AS half FROM lineitem")
def half_even(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.half_even(F.col("l_quantity") / 2).cast("long").alias("half"))


@query("m06_m46_endpoints_depth", "SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, round(l_extendedprice / 3000.0, 6) AS depth FROM lineitem")
def endpoints(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.least("l_partkey", "l_suppkey").alias("lo"), F.greatest("l_partkey", "l_suppkey").alias("hi"), r6(F.col("l_extendedprice") / 3000.0, "depth"))


@query("m10_m11_site_diversity", "WITH s AS (SELECT l_partkey AS site, count(*) AS n, count_if(l_returnflag = 'R') AS k FROM lineitem GROUP BY 1) SELECT site, round(CASE WHEN n >= 2 THEN 2.0 * k / n * (1 - k * 1.0 / n) * n / (n - 1) END, 6) AS pi, round(CASE WHEN n >= 2 THEN 2.0 * k * (n - k) / (n * (n - 1)) END, 6) AS pi_haploid FROM s WHERE least(k * 1.0 / n, 1 - k * 1.0 / n) >= 0.05")
def site_diversity(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("site")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    p = F.col("k") / F.col("n")
    return s.filter(F.least(p, 1 - p) >= 0.05).select("site", r6(S.diversity(F.col("k"), F.col("n")), "pi"), r6(S.haploid_diversity(F.col("k"), F.col("n")), "pi_haploid"))


_SITES = "s AS (SELECT l_partkey AS site, count(*) AS n, count_if(l_returnflag = 'R') AS k FROM lineitem GROUP BY 1), v AS (SELECT site, n, k, CASE WHEN n >= 2 THEN 2.0 * k * (n - k) / (n * (n - 1)) END AS pi FROM s), w AS (SELECT unnest(range(greatest(0, floor((site - 200) / 100.0)::BIGINT + 1), site // 100 + 1)) * 100 AS w, * FROM v)"


def windowed_sites(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("site")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    s = s.withColumn("pi", S.haploid_diversity(F.col("k"), F.col("n")))
    return I.sliding_windows(s, "site", 200, 100).withColumnRenamed("window_start", "w")


@query("m12_tajima_windows", f"WITH {_SITES}, g AS (SELECT w, sum(pi) AS pi, count_if(k > 0 AND k < n)::DOUBLE AS s, min(n)::DOUBLE AS n FROM w GROUP BY 1), a AS (SELECT *, list_sum(list_transform(range(1, n::INT), lambda i: 1.0::DOUBLE / i)) AS a1, list_sum(list_transform(range(1, n::INT), lambda i: 1.0::DOUBLE / (i * i))) AS a2 FROM g WHERE s >= 2 AND n >= 4) SELECT w::BIGINT AS w, round((pi - s / a1) / sqrt(((n + 1) / (3 * (n - 1)) - 1 / a1) / a1 * s + (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) * s * (s - 1)), 6) AS d FROM a")
def tajima(spark, d):
    g = windowed_sites(spark, d).groupBy("w").agg(F.sum("pi").alias("pi"), F.count_if((F.col("k") > 0) & (F.col("k") < F.col("n"))).alias("s"), F.min("n").cast("int").alias("n"))
    return g.select(F.col("w").cast("long").alias("w"), r6(S.tajima_d(F.col("pi"), F.col("s"), F.col("n")), "d")).filter("d is not null")


@query("m13_window_diversity", f"WITH {_SITES} SELECT w::BIGINT AS w, count(pi) AS callable, round(sum(pi) / nullif(count(pi), 0), 6) AS pi_callable, round(coalesce(sum(pi), 0) / 200, 6) AS pi_length FROM w GROUP BY 1")
def window_diversity(spark, d):
    return windowed_sites(spark, d).groupBy(F.col("w").cast("long").alias("w")).agg(F.count("pi").alias("callable"), r6(F.try_divide(F.sum("pi"), F.count("pi")), "pi_callable"), r6(F.coalesce(F.sum("pi"), F.lit(0.0)) / 200, "pi_length"))


@query("m14_m15_empirical_p", "WITH o AS (SELECT l_suppkey AS k, avg(l_quantity) AS obs FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), n AS (SELECT l_suppkey AS k, l_quantity AS v FROM lineitem WHERE l_returnflag = 'N') SELECT k, round(avg(CASE WHEN v <= obs THEN 1.0 ELSE 0.0 END), 6) AS lower_share, round(avg(CASE WHEN v >= obs THEN 1.0 ELSE 0.0 END), 6) AS upper_share, round((count_if(v >= obs) + 1) / (count(v) + 1), 6) AS p FROM n JOIN o USING (k) GROUP BY k")
def empirical_p(spark, d):
    li = table(spark, d, "lineitem")
    o = li.filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("k")).agg(F.avg("l_quantity").alias("obs"))
    n = li.filter("l_returnflag = 'N'").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("v"))
    v, obs = F.col("v"), F.col("obs")
    return n.join(o, "k").groupBy("k").agg(r6(S.tail_share(v, obs, lower=True), "lower_share"), r6(S.tail_share(v, obs), "upper_share"), r6(S.plus_one_p(v, obs), "p"))


@query("m16_percentile_ci", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 6) AS lo, round(quantile_cont(o_totalprice, 0.975), 6) AS hi FROM orders GROUP BY 1")
def percentile_ci(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.percentile("o_totalprice", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return g.select("o_orderpriority", r6(F.col("q")[0], "lo"), r6(F.col("q")[1], "hi"))


@query("m17_regression", "SELECT l_suppkey, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT l_quantity) >= 2")
def regression(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("l_quantity").alias("x"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"), r6(F.regr_r2("l_extendedprice", "l_quantity"), "r2"))
    return g.filter("n >= 3 and x >= 2").drop("x")


@query("m21_bonferroni", "WITH p AS (SELECT l_suppkey AS k, (count_if(l_discount > 0.09) + 1) / (count(*) + 1) AS p FROM lineitem GROUP BY 1) SELECT k, round(least(1.0, p * count(*) OVER ()), 6) AS adjusted, least(1.0, p * count(*) OVER ()) < 0.05 AS significant FROM p")
def bonferroni(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(((F.count_if(F.col("l_discount") > 0.09) + 1) / (F.count("*") + 1)).alias("p"))
    tests = p.agg(F.count("*").alias("m"))
    adjusted = F.least(F.lit(1.0), F.col("p") * F.col("m"))
    return p.crossJoin(F.broadcast(tests)).select("k", r6(adjusted, "adjusted"), (adjusted < 0.05).alias("significant"))


@query("m22_spearman", "WITH r AS (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_returnflag, l_tax) - 1) / 2.0 AS b FROM lineitem) SELECT g, round(corr(a, b), 6) AS rho FROM r GROUP BY g")
def spearman(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_tax")
    ranked = O.midrank(O.midrank(li, "l_quantity", "a", ["g"]), "l_tax", "b", ["g"])
    return ranked.groupBy("g").agg(r6(F.corr("a", "b"), "rho"))


@query("m25_pearson_guarded", "SELECT l_suppkey, CASE WHEN stddev_pop(l_discount) > 1e-12 AND stddev_pop(l_tax) > 1e-12 THEN round(corr(l_discount, l_tax), 6) END AS r FROM lineitem GROUP BY 1")
def pearson(spark, d):
    ok = (F.stddev_pop("l_discount") > 1e-12) & (F.stddev_pop("l_tax") > 1e-12)
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.when(ok, F.round(F.corr("l_discount", "l_tax"), 6)).alias("r"))


@query("m32_m35_rate_ratios", "WITH c AS (SELECT l_suppkey AS k, count_if(l_returnflag = 'R') AS a, sum(l_quantity) FILTER (l_linestatus = 'O') AS ta, count_if(l_returnflag = 'A') AS b, sum(l_quantity) FILTER (l_linestatus = 'F') AS tb FROM lineitem GROUP BY 1) SELECT k, round(((a + 0.5) / ta) / ((b + 0.5) / tb), 6) AS ratio, round(ln(((a + 0.5) / ta) / ((b + 0.5) / tb)), 6) AS log_ratio, round(exp(ln(((a + 0.5) / ta) / ((b + 0.5) / tb)) + 1.96 * sqrt(1 / (a + 0.5) + 1 / (b + 0.5))), 5) AS upper FROM c")
def rate_ratios(spark, d):
    q = F.col("l_quantity")
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.sum(F.when(F.col("l_linestatus") == "O", q)).alias("ta"), F.count_if(F.col("l_returnflag") == "A").alias("b"), F.sum(F.when(F.col("l_linestatus") == "F", q)).alias("tb"))
    ratio = S.haldane_ratio(F.col("a"), F.col("ta"), F.col("b"), F.col("tb"))
    se = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    return c.select("k", r6(ratio, "ratio"), r6(F.log(ratio), "log_ratio"), F.round(F.exp(F.log(ratio) + 1.96 * se), 5).alias("upper"))


@query("m42_accuracy_rmse", "SELECT target, round(avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse, count(*) AS n FROM (SELECT unnest(['flag', 'line']) AS target, unnest([quality, quality + 1]) AS y, unnest([toxic, 1 - toxic]) AS yhat FROM labels) GROUP BY 1")
def accuracy(spark, d):
    rows = table(spark, d, "labels").select(F.explode(F.array(F.struct(F.lit("flag").alias("target"), F.col("quality").alias("y"), F.col("toxic").alias("yhat")), F.struct(F.lit("line").alias("target"), (F.col("quality") + 1).alias("y"), (1 - F.col("toxic")).alias("yhat")))).alias("x")).select("x.*")
    return rows.groupBy("target").agg(r6(F.avg((F.col("y") == F.col("yhat")).cast("double")), "accuracy"), r6(F.sqrt(F.avg((F.col("y") - F.col("yhat")) * (F.col("y") - F.col("yhat")))), "rmse"), F.count("*").alias("n"))


@query("m43_m45_copy_features", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / (l_quantity * 730 / 2) * 2, 3) AS copies, greatest(l_linenumber - 1, 0) AS extra, round(l_quantity / ((l_quantity + l_linenumber) * 2), 6) AS support FROM lineitem")
def copy_features(spark, d):
    q, price, n = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(price / (q * 730 / 2) * 2, 3).alias("copies"), F.greatest(n - 1, F.lit(0)).alias("extra"), r6(q / ((q + n) * 2), "support"))


@query("m44_informative_weight", "WITH g AS (SELECT l_orderkey, list(l_discount * 10) AS gf FROM lineitem GROUP BY 1) SELECT l_orderkey, round(list_avg(gf) / len(gf), 9) AS weight, len(list_filter(gf, lambda x: round(x, 6) >= 0.7)) AS kept FROM g")
def informative_weight(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_discount") * 10).alias("gf"))
    mean = F.aggregate("gf", F.lit(0.0), lambda a, x: a + x) / F.size("gf")
    return g.select("l_orderkey", F.round(mean / F.size("gf"), 9).alias("weight"), F.size(F.filter("gf", lambda x: F.round(x, 6) >= 0.7)).cast("long").alias("kept"))


@query("m47_m49_composite_score", "SELECT p_partkey, round(CASE WHEN p_size > 10 THEN 2 ELSE 0 END + CASE WHEN p_brand LIKE '%1' THEN 1.5 ELSE 0 END - least(p_retailprice / 1000, 1.2), 6) AS score FROM part")
def composite(spark, d):
    score = F.when(F.col("p_size") > 10, 2.0).otherwise(0.0) + F.when(F.col("p_brand").like("%1"), 1.5).otherwise(0.0) - F.least(F.col("p_retailprice") / 1000, F.lit(1.2))
    return table(spark, d, "part").select("p_partkey", r6(score, "score"))


@query("m48_vector_geometry", "WITH c AS (SELECT [1.0] || list_transform(range(63), lambda i: 0.0) AS c) SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(degrees(acos(greatest(-1.0, least(1.0, embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))))))), 4) AS angle FROM embeddings")
def geometry(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("embedding")[0].cast("double") / norm))
    return table(spark, d, "embeddings").select("vec_id", F.round(norm, 5).alias("norm"), F.round(F.degrees(F.acos(cosine)), 4).alias("angle"))


@query("m50_zscore", "SELECT p_partkey, CASE WHEN stddev_samp(p_retailprice) OVER w > 0 THEN round((p_retailprice - avg(p_retailprice) OVER w) / stddev_samp(p_retailprice) OVER w, 6) END AS z FROM part WINDOW w AS (PARTITION BY p_brand)")
def zscore(spark, d):
    p = table(spark, d, "part")
    g = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), F.stddev_samp("p_retailprice").alias("s"))
    return p.join(g, "p_brand").select("p_partkey", F.when(F.col("s") > 0, F.round((F.col("p_retailprice") - F.col("m")) / F.col("s"), 6)).alias("z"))


@query("m56_percentile_columns", "SELECT p_partkey, round((SELECT count(*) FROM part q WHERE q.p_size <= p.p_size) * 1.0 / (SELECT count(*) FROM part), 6) AS size_pct, round((SELECT count(*) FROM part q WHERE q.p_retailprice <= p.p_retailprice) * 1.0 / (SELECT count(*) FROM part), 6) AS price_pct FROM part p")
def percentile_columns(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    n = p.agg(F.count("*").alias("n"))
    out = p
    for c, name in (("p_size", "size_pct"), ("p_retailprice", "price_pct")):
        below = O.cumulative(p.groupBy(c).agg(F.count("*").alias("c")), [], c, [], F.col("c")).select(c, F.col("total").alias(name))
        out = out.join(below, c)
    return out.crossJoin(F.broadcast(n)).select("p_partkey", r6(F.col("size_pct") / F.col("n"), "size_pct"), r6(F.col("price_pct") / F.col("n"), "price_pct"))


@query("g06_silhouette", "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i])))) AS s, count(*) AS n FROM v a, v b GROUP BY 1, 2, 3), m AS (SELECT vec_id, la, max(CASE WHEN la = lb AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM d GROUP BY 1, 2) SELECT vec_id, round((b - a) / greatest(a, b), 5) AS score FROM m")
def silhouette(spark, d):
    return S.silhouette(table(spark, d, "embeddings"), "vec_id", "embedding", "label").select("vec_id", F.round("score", 5).alias("score"))


@query("g07_adjusted_rand", "WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2), t AS (SELECT sum(n * (n - 1) / 2.0) AS ab, sum(n) AS n FROM c), a AS (SELECT sum(n * (n - 1) / 2.0) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY quality)), b AS (SELECT sum(n * (n - 1) / 2.0) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY toxic)) SELECT round((ab - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)), 6) AS adjusted_rand FROM t, a, b")
def adjusted_rand(spark, d):
    return S.adjusted_rand(table(spark, d, "labels"), "quality", "toxic").select(r6(F.col("adjusted_rand"), "adjusted_rand"))


@query("g14_cluster_relabel", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, row_number() OVER (ORDER BY n DESC, label) AS new_label FROM c")
def relabel(spark, d):
    c = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return c.select("label", F.row_number().over(Window.orderBy(F.desc("n"), "label")).alias("new_label"))
