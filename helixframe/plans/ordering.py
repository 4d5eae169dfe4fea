"""Window and ordered operators on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import intervals as I
from ..operators import ordered as O
from ..session import table
from .filters_joins import INTERVALS, shipments
from .grouping import r6
from .registry import query

EVENT_S = "floor(epoch(ts))::BIGINT"


def events(spark, d):
    return table(spark, d, "events").withColumn("sec", F.unix_timestamp("ts"))


@query("w01_rank_percentile", "SELECT p_brand, p_partkey, row_number() OVER w AS rk, round(row_number() OVER w * 1.0 / count(*) OVER (PARTITION BY p_brand), 6) AS pct FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)")
def rank_percentile(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("rk"), F.count("*").over(Window.partitionBy("p_brand")).alias("n"))
    return p.select("p_brand", "p_partkey", "rk", r6(F.col("rk") / F.col("n"), "pct"))


@query("w02_midrank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY floor(o_totalprice / 1000)) + (count(*) OVER (PARTITION BY o_orderstatus, floor(o_totalprice / 1000)) - 1) / 2.0 AS midrank FROM orders")
def midrank(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("v"))
    return O.midrank(o, "v", "midrank", ["o_orderstatus"]).select("o_orderkey", "midrank")


@query("w03_lag_lead", "SELECT event_id, lag(event_id) OVER w AS prev_id, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_lead(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("prev_id"), F.lead("event_id").over(w).alias("next_id"))


@query("w04_running_end_islands", f"WITH i AS ({INTERVALS}), m AS (SELECT *, max(e) OVER (PARTITION BY grp ORDER BY s, id * 10 + line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM i), f AS (SELECT *, sum(CASE WHEN pm IS NULL OR s - pm >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY s, id * 10 + line) AS island FROM m) SELECT grp, island::BIGINT AS island, min(s) AS s, max(e) AS e, count(*) AS n FROM f GROUP BY 1, 2")
def islands(spark, d):
    i = shipments(spark, d).withColumn("tie", F.col("id") * 10 + F.col("line"))
    marked = I.islands_by_running_end(i, ["grp"], "s", "e", "tie", 1)
    return marked.groupBy("grp", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"))


@query("w05_point_clusters", f"WITH e AS (SELECT user_id, {EVENT_S} AS sec FROM events), f AS (SELECT *, CASE WHEN lag(sec) OVER w IS NULL OR sec - lag(sec) OVER w > 21600 THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec)), c AS (SELECT user_id, sec, sum(n) OVER (PARTITION BY user_id ORDER BY sec RANGE UNBOUNDED PRECEDING) AS cluster FROM f) SELECT user_id, cluster::BIGINT AS cluster, min(sec) AS sec, count(*) AS size FROM c GROUP BY 1, 2")
def point_clusters(spark, d):
    return I.point_clusters(events(spark, d).select("user_id", "sec"), ["user_id"], "sec", 21600)


@query("w06_interval_union", f"WITH e AS (SELECT user_id, {EVENT_S} AS s, {EVENT_S} + floor(value * 100)::BIGINT AS e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM e), f AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, island::BIGINT AS island, min(s) AS s, max(e) AS e, count(*) AS parts FROM f GROUP BY 1, 2")
def interval_union(spark, d):
    e = events(spark, d).select("user_id", F.col("sec").alias("s"), (F.col("sec") + F.floor(F.col("value") * 100)).alias("e"))
    return I.union_touching(e, ["user_id"], "s", "e")


@query("w07_backtrack_chunks", "WITH e AS (SELECT event_id, user_id, ts, value, CASE event_id % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS dir FROM events), l AS (SELECT *, lag(value) OVER w AS pv, lag(dir) OVER w AS pd FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), f AS (SELECT *, CASE WHEN pv IS NULL THEN 1 WHEN (CASE WHEN (CASE WHEN pd IN ('+', '-') THEN pd ELSE dir END) = '-' THEN value - pv ELSE pv - value END) > 10 THEN 1 ELSE 0 END AS n FROM l) SELECT event_id, (sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS chunk FROM f")
def backtrack(spark, d):
    i = F.col("event_id") % 3
    e = table(spark, d, "events").withColumn("dir", F.when(i == 0, "+").when(i == 1, "-").otherwise("."))
    return O.chunks_on_backtrack(e, ["user_id"], ["ts", "event_id"], "value", "dir", 10.0).select("event_id", "chunk")


@query("w08_trim_to_predicate", "WITH b AS (SELECT user_id, min(event_id) FILTER (value > 80) AS lo, max(event_id) FILTER (value > 80) AS hi FROM events GROUP BY 1) SELECT e.event_id FROM events e JOIN b USING (user_id) WHERE e.event_id BETWEEN lo AND hi")
def trim_group(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    return O.trimmed(e, ["user_id"], "event_id", F.col("value") > 80).select("event_id")


@query("w09_locf", "SELECT event_id, coalesce(last_value(CASE WHEN value > 50 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'Unknown') AS origin FROM events")
def locf(spark, d):
    e = table(spark, d, "events")
    return O.locf(e, ["user_id"], ["ts", "event_id"], F.when(F.col("value") > 50, F.col("event_type")), "origin", "Unknown").select("event_id", "origin")


@query("w10_prefix_sum", "SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS before_sum FROM events")
def prefix(spark, d):
    return O.prefix_sum(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", "s").select("event_id", r6(F.col("s"), "before_sum"))


@query("w11_running_label", "SELECT p_partkey, p_brand || '_' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS label FROM part")
def running_label(spark, d):
    return O.running_label(table(spark, d, "part"), "p_brand", [F.col("p_partkey").asc()], "label").select("p_partkey", "label")


@query("w12_renumber", "SELECT s_nationkey, s_suppkey, printf('unit%04d', row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS unit FROM supplier")
def renumber(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.format_string("unit%04d", F.row_number().over(w)).alias("unit"))


STRANDED = f"SELECT *, CASE WHEN grp % 2 = 0 THEN '-' ELSE '+' END AS strand FROM ({INTERVALS})"


def stranded(spark, d):
    return shipments(spark, d).withColumn("strand", F.when(F.col("grp") % 2 == 0, "-").otherwise("+"))


@query("w13_strand_order", f"SELECT id, line, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN strand = '-' THEN -s ELSE s END, id, line) AS place FROM ({STRANDED})")
def strand_order(spark, d):
    w = Window.partitionBy("grp").orderBy(F.when(F.col("strand") == "-", -F.col("s")).otherwise(F.col("s")), "id", "line")
    return stranded(spark, d).select("id", "line", F.row_number().over(w).alias("place"))



@query("w14_core_extension", f"SELECT id, line, e, CASE WHEN nxt > e THEN nxt ELSE e END AS extended, CASE WHEN nxt > e THEN nxt - e ELSE 0 END AS spacer FROM (SELECT *, lead(s) OVER (PARTITION BY grp ORDER BY s, id, line) AS nxt FROM ({STRANDED}))")
def core_extension(spark, d):
    nxt = F.lead("s").over(Window.partitionBy("grp").orderBy("s", "id", "line"))
    i = stranded(spark, d).withColumn("nxt", nxt)
    more = F.col("nxt") > F.col("e")
    return i.select("id", "line", "e", F.when(more, F.col("nxt")).otherwise(F.col("e")).alias("extended"), F.when(more, F.col("nxt") - F.col("e")).otherwise(F.lit(0).cast("long")).alias("spacer"))



@query("w15_slice_min", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def slice_min(spark, d):
    return O.best_record(table(spark, d, "orders"), ["o_custkey"], [F.asc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w16_rolling_time_windows", f"WITH e AS (SELECT {EVENT_S} // 3600 AS h, value FROM events), w AS (SELECT unnest(range(greatest(0, floor((h - 24) / 6.0)::BIGINT + 1), h // 6 + 1)) * 6 AS start_h, value FROM e) SELECT start_h::BIGINT AS start_h, count(*) AS n, round(avg(value), 6) AS mean_value FROM w GROUP BY 1")
def rolling(spark, d):
    e = events(spark, d).select(F.floor(F.col("sec") / 3600).alias("h"), "value")
    w = I.sliding_windows(e, "h", 24, 6)
    return w.groupBy(F.col("window_start").cast("long").alias("start_h")).agg(F.count("*").alias("n"), r6(F.avg("value"), "mean_value"))


@query("w17_adaptive_tail", "WITH a AS (SELECT floor((SELECT max(o_totalprice) FROM orders) - o_totalprice) AS age FROM orders), b AS (SELECT floor(age / 20000)::BIGINT AS b FROM a), s AS (SELECT unnest(range((SELECT max(b) FROM b) + 1)) AS b), c AS (SELECT s.b, count(b.b) AS n FROM s LEFT JOIN b ON s.b = b.b GROUP BY 1), t AS (SELECT min(b) AS t FROM c WHERE n < 500) SELECT least(b.b, coalesce(t, b.b)) AS bin, count(*) AS n FROM b, t GROUP BY 1")
def adaptive_tail(spark, d):
    o = table(spark, d, "orders").select("o_totalprice")
    top = o.agg(F.max("o_totalprice").alias("top"))
    age = o.crossJoin(F.broadcast(top)).select(F.floor(F.col("top") - F.col("o_totalprice")).alias("age"))
    return O.adaptive_tail_bins(age, "age", 20000, 500).groupBy("bin").agg(F.count("*").alias("n"))


@query("w18_right_closed_bins", "SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 25 THEN 1 WHEN l_quantity <= 49 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def right_closed(spark, d):
    return table(spark, d, "lineitem").groupBy(O.right_closed_bin(F.col("l_quantity"), [10, 25, 49]).alias("bin")).agg(F.count("*").alias("n"))


@query("w19_sliding_density", "WITH p AS (SELECT l_partkey AS pos, l_discount AS v FROM lineitem), w AS (SELECT unnest(range(greatest(0, floor((pos - 100) / 50.0)::BIGINT + 1), pos // 50 + 1)) * 50 AS start_pos, v FROM p) SELECT start_pos::BIGINT AS start_pos, count(*) AS sites, round(count(*) / 100.0, 6) AS density, round(sum(v), 6) AS total FROM w GROUP BY 1")
def sliding_density(spark, d):
    w = I.sliding_windows(table(spark, d, "lineitem").select("l_partkey", "l_discount"), "l_partkey", 100, 50)
    return w.groupBy(F.col("window_start").cast("long").alias("start_pos")).agg(F.count("*").alias("sites"), r6(F.count("*") / 100.0, "density"), r6(F.sum("l_discount"), "total"))


@query("w20_scan_min_interval", "WITH w AS (SELECT l_partkey // 50 AS wstart, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, arg_min(wstart, (q, wstart)) AS best_window, min(q) AS q FROM w GROUP BY 1")
def scan_min(spark, d):
    w = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_partkey") / 50).alias("w"), "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return w.groupBy("l_suppkey").agg(F.min_by("w", F.struct("q", "w")).alias("best_window"), F.min("q").alias("q"))


@query("w22_tail_alignment", "WITH b AS (SELECT o_orderpriority AS p, floor(o_totalprice / 50000)::BIGINT AS b FROM orders) SELECT p, CASE WHEN b >= 6 THEN max(CASE WHEN b >= 6 THEN b END) OVER (PARTITION BY p) ELSE b END AS aligned FROM b")
def tail_alignment(spark, d):
    b = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.floor(F.col("o_totalprice") / 50000).alias("b"))
    top = b.filter("b >= 6").groupBy("p").agg(F.max("b").alias("m"))
    return b.join(F.broadcast(top), "p", "left").select("p", F.when(F.col("b") >= 6, F.col("m")).otherwise(F.col("b")).alias("aligned"))


@query("w23_signature_ordinal", "WITH s AS (SELECT DISTINCT p_brand, p_type FROM part), k AS (SELECT p_brand, p_type, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) AS o, count(*) OVER (PARTITION BY p_brand) AS n FROM s) SELECT p_brand, p_type, CASE WHEN n > 1 THEN p_brand || '.' || o ELSE p_brand END AS label FROM k")
def signature_ordinal(spark, d):
    s = table(spark, d, "part").select("p_brand", "p_type").distinct()
    o, n = F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_type")), F.count("*").over(Window.partitionBy("p_brand"))
    k = s.withColumns({"o": o, "n": n})
    return k.select("p_brand", "p_type", F.when(F.col("n") > 1, F.concat_ws(".", "p_brand", F.col("o").cast("string"))).otherwise(F.col("p_brand")).alias("label"))


@query("w24_position_map", "SELECT event_id, count_if(event_type <> 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ungapped FROM events")
def position_map(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.count_if(F.col("event_type") != "click").over(w).alias("ungapped"))


@query("w25_ntile_family", "SELECT p_partkey, ntile(4) OVER w AS q, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, nth_value(p_partkey, 2) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)")
def ntile_family(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "part").select("p_partkey", F.ntile(4).over(w).alias("q"), r6(F.percent_rank().over(w), "pr"), r6(F.cume_dist().over(w), "cd"), F.nth_value("p_partkey", 2).over(whole).alias("second"))


@query("w26_oriented_coordinates", f"SELECT id, line, CASE WHEN strand = '-' THEN 20000 - e ELSE s END AS o_start, CASE WHEN strand = '-' THEN 20000 - s ELSE e END AS o_end, s + 1 AS start_1based FROM ({STRANDED})")
def oriented(spark, d):
    n, strand = F.lit(20000).cast("long"), F.col("strand")
    a, b = X.oriented(F.col("s"), n, strand), X.oriented(F.col("e"), n, strand)
    return stranded(spark, d).select("id", "line", F.least(a, b).alias("o_start"), F.greatest(a, b).alias("o_end"), (F.col("s") + 1).alias("start_1based"))

