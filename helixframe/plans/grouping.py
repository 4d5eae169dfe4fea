"""Aggregations on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..functions import expressions as X
from ..operators import ordered as O
from ..operators import statistics as S
from ..session import table
from .registry import query


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("a01_group_sum_no_null_key", "SELECT k, round(sum(o_totalprice), 2) AS total FROM (SELECT nullif(o_orderstatus, 'P') AS k, o_totalprice FROM orders) WHERE k IS NOT NULL GROUP BY k")
def group_sum(spark, d):
    o = table(spark, d, "orders").select(F.expr("nullif(o_orderstatus, 'P')").alias("k"), "o_totalprice")
    return o.filter("k is not null").groupBy("k").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a02_a14_finite_mean", "SELECT user_id, round(avg(x) FILTER (isfinite(x)), 6) AS mean_value FROM (SELECT user_id, CASE WHEN event_id % 13 = 0 THEN 'nan'::DOUBLE ELSE value END AS x FROM events) GROUP BY user_id")
def finite_mean(spark, d):
    x = F.when(F.col("event_id") % 13 == 0, float("nan")).otherwise(F.col("value"))
    return table(spark, d, "events").groupBy("user_id").agg(r6(F.avg(X.finite(x)), "mean_value"))


@query("a03_exact_median", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 6) AS median_price FROM part GROUP BY p_brand")
def exact_median(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(r6(F.percentile("p_retailprice", 0.5), "median_price"))


@query("a04_exact_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey")
def exact_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"))


@query("a05_first_constant", "SELECT n_regionkey, max(r_name) AS region, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def first_constant(spark, d):
    joined = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_regionkey").agg(F.max("r_name").alias("region"), F.count("*").alias("nations"))


@query("a06_unique_string_join", "SELECT p_brand, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def unique_join(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ";").alias("types"))


@query("a07_ordered_string_agg", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ';' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def ordered_agg(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["l_partkey"].cast("string")), ";").alias("parts"))


@query("a08_first_seen_join", "SELECT user_id, string_agg(event_type, ';' ORDER BY first_id) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2) GROUP BY user_id")
def first_seen(spark, d):
    seen = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    return seen.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_id", "event_type"))), lambda x: x["event_type"]), ";").alias("kinds"))


@query("a09_min_max_range", "SELECT user_id, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(max(value) - min(value), 6) AS range_value FROM events GROUP BY user_id")
def min_max(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(r6(F.min("value"), "lo"), r6(F.max("value"), "hi"), r6(F.max("value") - F.min("value"), "range_value"))


@query("a10_a11_variances", "SELECT l_suppkey, round(var_samp(l_quantity), 6) AS v1, round(stddev_samp(l_quantity), 6) AS s1, round(stddev_pop(l_quantity), 6) AS s0 FROM lineitem GROUP BY l_suppkey")
def variances(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(r6(F.var_samp("l_quantity"), "v1"), r6(F.stddev_samp("l_quantity"), "s1"), r6(F.stddev_pop("l_quantity"), "s0"))


@query("a13_weighted_mean", "SELECT l_returnflag, round(sum(l_discount * w) FILTER (w > 0) / sum(w) FILTER (w > 0), 6) AS mean_discount FROM (SELECT l_returnflag, l_discount, l_quantity - 10 AS w FROM lineitem) GROUP BY 1")
def weighted(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(S.weighted_mean(F.col("l_discount"), F.col("l_quantity") - 10), "mean_discount"))


@query("a15_value_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def value_counts(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))


@query("a16_crosstab", "SELECT s AS quality, count(*) FILTER (toxic = 0) AS t0, count(*) FILTER (toxic = 1) AS t1, count(*) FILTER (toxic = 2) AS t2 FROM (SELECT unnest([0, 1, 2]) AS s) LEFT JOIN labels ON quality = s GROUP BY s")
def crosstab(spark, d):
    table_ = S.zero_filled_pivot(table(spark, d, "labels"), "quality", "toxic", [0, 1, 2])
    spine = spark.range(3).select(F.col("id").cast("int").alias("quality"))
    out = spine.join(table_, "quality", "left").na.fill(0)
    return out.select("quality", *[F.col(str(k)).alias(f"t{k}") for k in range(3)])


@query("a17_pivot_mean", "SELECT year(l_shipdate)::INT AS ship_year, l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS o, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS f FROM lineitem GROUP BY 1, 2")
def pivot_mean(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("ship_year"), "l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.avg("l_quantity"))
    return p.select("ship_year", "l_returnflag", r6(F.col("O"), "o"), r6(F.col("F"), "f"))


@query("a18_multi_count", "SELECT l_suppkey, count_if(l_discount > 0.05 AND l_tax > 0.04) AS both_high, count_if(l_discount > 0.05 OR l_tax > 0.04) AS any_high, count_if(l_discount = 0) AS zero FROM lineitem GROUP BY 1")
def multi_count(spark, d):
    a, b = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(a & b).alias("both_high"), F.count_if(a | b).alias("any_high"), F.count_if(F.col("l_discount") == 0).alias("zero"))


@query("a19_two_level_rollup", "SELECT l_returnflag, count(*) AS replicates, sum(hits)::BIGINT AS hits, round(avg(hits * 1.0 / n), 6) AS mean_share FROM (SELECT l_returnflag, l_suppkey, count(*) AS n, count_if(l_quantity > 25) AS hits FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def two_level(spark, d):
    first = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"), F.sum((F.col("l_quantity") > 25).cast("long")).alias("h"))
    return first.groupBy("l_returnflag").agg(F.count("*").alias("replicates"), F.sum("h").alias("hits"), r6(F.avg(F.col("h") / F.col("n")), "mean_share"))


@query("a20_unpivot_levels", "SELECT level, count_if(hit) AS hits FROM (SELECT unnest(['l1', 'l2', 'l3']) AS level, unnest([l_quantity <= 10, l_quantity <= 20, l_quantity <= 30]) AS hit FROM lineitem) GROUP BY level")
def unpivot_levels(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", *[(F.col("l_quantity") <= 10 * k).alias(f"l{k}") for k in (1, 2, 3)])
    return li.unpivot(["l_orderkey"], ["l1", "l2", "l3"], "level", "hit").groupBy("level").agg(F.count_if("hit").alias("hits"))


@query("a21_majority_label", "SELECT user_id, coalesce(nullif(event_type, ''), 'Unknown') AS label FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1")
def majority(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = O.best_record(counts, ["user_id"], [F.desc("n"), F.asc("event_type")])
    return best.select("user_id", F.coalesce(F.expr("nullif(event_type, '')"), F.lit("Unknown")).alias("label"))


@query("a23_mode_first_seen", "SELECT l_suppkey, l_quantity AS mode_quantity FROM (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, min(l_orderkey * 10 + l_linenumber)) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1")
def mode_first(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return O.best_record(counts, ["l_suppkey"], [F.desc("n"), F.asc("at")]).select("l_suppkey", F.col("l_quantity").alias("mode_quantity"))


@query("a24_predominant_state", "SELECT l_suppkey, CASE WHEN count_if(l_linestatus = 'O') >= count_if(l_linestatus = 'F') THEN 1 ELSE 0 END AS state, round(greatest(count_if(l_linestatus = 'O'), count_if(l_linestatus = 'F')) * 1.0 / count(*), 6) AS share FROM lineitem GROUP BY 1")
def predominant(spark, d):
    alt, ref = F.count_if(F.col("l_linestatus") == "O"), F.count_if(F.col("l_linestatus") == "F")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.when(alt >= ref, 1).otherwise(0).alias("state"), r6(F.greatest(alt, ref) / F.count("*"), "share"))


@query("a26_concordance", "SELECT l_suppkey, round(count_if(a = b) * 1.0 / nullif(count_if(a IS NOT NULL AND b IS NOT NULL), 0), 6) AS concordance, round(1 - count_if(a IS NOT NULL AND b IS NOT NULL) * 1.0 / count(*), 6) AS missing FROM (SELECT l_suppkey, nullif(l_quantity::INT % 3, 2) AS a, nullif((l_discount * 100)::INT % 3, 2) AS b FROM lineitem) GROUP BY 1")
def concordance(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.expr("nullif(cast(l_quantity as int) % 3, 2)").alias("a"), F.expr("nullif(cast(round(l_discount * 100) as int) % 3, 2)").alias("b"))
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return li.groupBy("l_suppkey").agg(r6(F.try_divide(F.count_if(F.col("a") == F.col("b")), both), "concordance"), r6(1 - both / F.count("*"), "missing"))


@query("a27_completeness", "SELECT count(*) AS n, count_if(value IS NULL) AS null_value, count_if(ts IS NULL) AS null_ts FROM events")
def completeness(spark, d):
    e = C.require_complete(table(spark, d, "events"), ["value", "ts"], "events")
    return e.agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("null_value"), F.count_if(F.col("ts").isNull()).alias("null_ts"))


@query("a28_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity").dropDuplicates()


@query("a29_best_record", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY nullif(value, 0.0) DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn = 1")
def best_event(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return O.best_record(e, ["user_id"], [F.expr("nullif(value, 0.0D)").desc_nulls_last(), F.asc("event_id")])


@query("a30_exactly_two", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2 AND list_sort(list(DISTINCT l_linestatus)) = ['F', 'O']")
def exactly_two(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("l_linestatus")).alias("s"))
    return g.filter((F.col("n") == 2) & (F.col("s") == F.array(F.lit("F"), F.lit("O")))).select("l_orderkey")


@query("a31_global_summary", "SELECT round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(quantile_cont(value, 0.5), 6) AS med FROM events")
def global_summary(spark, d):
    return table(spark, d, "events").agg(r6(F.min("value"), "lo"), r6(F.max("value"), "hi"), r6(F.percentile("value", 0.5), "med"))


@query("a32_null_group_kept", "SELECT nullif(c_mktsegment, 'BUILDING') AS seg, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2")
def null_group(spark, d):
    return table(spark, d, "customer").groupBy(F.expr("nullif(c_mktsegment, 'BUILDING')").alias("seg"), "c_nationkey").agg(F.count("*").alias("n"))


@query("a33_exposure_rate", "SELECT o_orderpriority, round(count_if(o_orderstatus = 'F') / sum(o_totalprice) * 1e6, 6) AS rate FROM orders GROUP BY 1")
def exposure_rate(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(r6(X.infinite_ratio(F.count_if(F.col("o_orderstatus") == "F"), F.sum("o_totalprice")) * 1e6, "rate"))


@query("a34_single_row", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def single_row(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1)


@query("a35_cube", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count("*").alias("n"))


@query("a35_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def rollup(spark, d):
    j = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@query("a37_region_summary", "SELECT l_suppkey, count(*) AS windows, count_if(l_tax > 0) AS callable, round(sum(l_discount * l_quantity) FILTER (l_quantity > 0) / sum(l_quantity) FILTER (l_quantity > 0), 6) AS weighted, round(avg(l_tax), 6) AS mean_tax, coalesce(sum(l_linenumber), 0)::BIGINT AS callable_sum FROM lineitem GROUP BY 1")
def region_summary(spark, d):
    """Suppliers as regions, their line items as windows."""
    li = table(spark, d, "lineitem").groupBy("l_suppkey")
    return li.agg(F.count("*").alias("windows"), F.count_if(F.col("l_tax") > 0).alias("callable"), r6(S.weighted_mean(F.col("l_discount"), F.col("l_quantity")), "weighted"), r6(F.avg("l_tax"), "mean_tax"), F.coalesce(F.sum("l_linenumber"), F.lit(0)).cast("long").alias("callable_sum"))


@query("a38_a43_called_samples", "SELECT count_if(called = 1) AS with_call, count(*) AS samples, round(1 - avg(called), 6) AS missing FROM (SELECT l_suppkey, max(CASE WHEN l_discount > 0.09 AND l_tax > 0.07 THEN 1 ELSE 0 END) AS called FROM lineitem GROUP BY 1)")
def called_samples(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max(((F.col("l_discount") > 0.09) & (F.col("l_tax") > 0.07)).cast("int")).alias("called"))
    return per.agg(F.count_if(F.col("called") == 1).alias("with_call"), F.count("*").alias("samples"), r6(1 - F.avg("called"), "missing"))


@query("a40_nested_subsets", "SELECT subset, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price FROM (SELECT 'all' AS subset, o_totalprice FROM orders UNION ALL SELECT 'stable', o_totalprice FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def nested_subsets(spark, d):
    tags = F.array_compact(F.array(F.lit("all"), F.when(F.col("o_orderstatus") == "F", "stable")))
    return table(spark, d, "orders").select(F.explode(tags).alias("subset"), "o_totalprice").groupBy("subset").agg(F.count("*").alias("n"), r6(F.avg("o_totalprice"), "mean_price"))


@query("a41_observed_row", "SELECT count_if(o_orderstatus = 'F') AS gains, round(sum(o_totalprice) / 1e6, 6) AS time_total, round(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') / sum(o_totalprice), 6) AS time_share, round(((count_if(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') + 0.5) / sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT')) / ((count_if(o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT') + 0.5) / sum(o_totalprice) FILTER (o_orderpriority <> '1-URGENT')), 6) AS ratio FROM orders")
def observed_row(spark, d):
    gain, urgent, t = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")
    ta, tb = F.sum(F.when(urgent, t)), F.sum(F.when(~urgent, t))
    return table(spark, d, "orders").agg(F.count_if(gain).alias("gains"), r6(F.sum(t) / 1e6, "time_total"), r6(ta / F.sum(t), "time_share"), r6(S.haldane_ratio(F.count_if(gain & urgent), ta, F.count_if(gain & ~urgent), tb), "ratio"))


@query("a42_null_summary", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS med, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, count_if(isfinite(value)) AS finite_n, count(*) AS total_n, round((count_if(value >= 50) + 1) / (count(value) + 1), 6) AS p FROM events GROUP BY 1")
def null_summary(spark, d):
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975)))
    g = table(spark, d, "events").groupBy("event_type").agg(q.alias("q"), F.count_if(X.finite(F.col("value")).isNotNull()).alias("finite_n"), F.count("*").alias("total_n"), r6(S.plus_one_p(F.col("value"), F.lit(50)), "p"))
    return g.select("event_type", r6(F.col("q")[0], "med"), r6(F.col("q")[1], "lo"), r6(F.col("q")[2], "hi"), "finite_n", "total_n", "p")


# ---- sorts, limits, sets


@query("o01_mixed_sort", "SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_retailprice DESC NULLS LAST, p_partkey) AS place FROM part")
def mixed_sort(spark, d):
    # Ranks by range partition: no task holds all rows.
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    sizes = p.groupBy("p_brand").agg(F.count("*").alias("n"))
    before = sizes.select("p_brand", F.coalesce(F.sum("n").over(Window.orderBy("p_brand").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey"))
    return p.withColumn("rank", rank).join(before, "p_brand").select("p_partkey", (F.col("before") + F.col("rank")).alias("place"))


@query("o02_natural_sort", "SELECT c_name, row_number() OVER (ORDER BY regexp_extract(c_name, '^(\\D*)', 1), regexp_extract(c_name, '(\\d+)', 1)::BIGINT, c_name) AS place FROM (SELECT 'chr' || c_nationkey AS c_name FROM (SELECT DISTINCT c_nationkey FROM customer))")
def natural_sort(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")).alias("c_name")).distinct()
    return c.select("c_name", F.row_number().over(Window.orderBy(X.natural_key(F.col("c_name")))).alias("place"))


@query("o03_top_one", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def top_one(spark, d):
    best = O.best_record(table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")])
    return best.select("l_suppkey", "l_orderkey", "l_linenumber")


@query("o04_top_categories", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 5")
def top_categories(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(5)


@query("o05_first_ten", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS rn FROM nation) WHERE rn <= 3 GROUP BY 1")
def first_ten(spark, d):
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.slice(ordered, 1, 3), lambda x: x["n_name"]), ",").alias("names"))


@query("o06_union_columns", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def union_columns(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("o07_aggregate_category", "SELECT seg, count(*) AS n FROM (SELECT c_mktsegment AS seg FROM customer UNION ALL SELECT 'ALL' FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY seg")
def aggregate_category(spark, d):
    s = F.col("c_mktsegment")
    tags = F.array_compact(F.array(s, F.when(s != "BUILDING", "ALL")))
    return table(spark, d, "customer").select(F.explode(tags).alias("seg")).groupBy("seg").agg(F.count("*").alias("n"))


@query("o08_intersect", "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("o09_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 50")
def except_(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").filter("l_quantity = 50").select("l_partkey"))


@query("o10_set_equality", "SELECT (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)) = 0 AND (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)) = 0 AS equal_sets")
def set_equality(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit(1).alias("side"))
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit(2).alias("side"))
    sides = a.unionByName(b).groupBy("k").agg(F.count_distinct("side").alias("n"))
    return sides.agg((F.count_if(F.col("n") < 2) == 0).alias("equal_sets"))


@query("o11_outer_union", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 9500 GROUP BY 1) b ON a.k = b.k")
def outer_union(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").filter("s_acctbal > 9500").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full").na.fill(0)
