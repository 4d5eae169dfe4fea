"""Filters, predicates and joins on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..functions import expressions as X
from ..operators import intervals as I
from ..operators import ordered as O
from ..session import table
from .registry import query


@query("f01_required_columns", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def required_columns(spark: SparkSession, d: str) -> DataFrame:
    return C.require_columns(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"]).filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")


@query("f02_inclusive_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag = 'R'")
def inclusive_between(spark, d):
    return table(spark, d, "lineitem").filter(F.col("l_quantity").between(10, 12) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber")


@query("f03_cohort_null_semantics", "WITH c AS (SELECT c_custkey, nullif(c_nationkey, 3) AS nation, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer) SELECT c_custkey, nation, segment FROM c WHERE nation IS DISTINCT FROM 10 AND segment IS NULL OR nation = 5")
def cohort(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr("nullif(c_nationkey, 3)").alias("nation"), F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"))
    return c.filter((X.keep_unless_equal(F.col("nation"), 10) & F.col("segment").isNull()) | (F.col("nation") == 5))


@query("f04_regex_exclusion", "SELECT p_partkey, p_type FROM part WHERE NOT regexp_matches(p_type, '^(PROMO|SMALL)')")
def regex_exclusion(spark, d):
    return table(spark, d, "part").filter(~F.col("p_type").rlike("^(PROMO|SMALL)")).select("p_partkey", "p_type")


@query("f05_any_column_regex", "SELECT p_partkey, regexp_matches(p_name, '(?i)brand#1|steel|a1') OR regexp_matches(p_brand, '(?i)brand#1|steel|a1') OR regexp_matches(p_type, '(?i)brand#1|steel|a1') AS flagged FROM part")
def any_column_regex(spark, d):
    flagged = F.exists(F.array("p_name", "p_brand", "p_type"), lambda x: x.rlike("(?i)brand#1|steel|a1"))
    return table(spark, d, "part").select("p_partkey", flagged.alias("flagged"))


@query("f06_prefix_keep_null", "SELECT c_custkey FROM (SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS s FROM customer) WHERE s IS NULL OR NOT starts_with(s, 'AUTO')")
def prefix_filter(spark, d):
    s = F.expr("nullif(c_mktsegment, 'MACHINERY')")
    return table(spark, d, "customer").filter(~F.coalesce(F.startswith(s, F.lit("AUTO")), F.lit(False))).select("c_custkey")


@query("f07_membership", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 7, 12))")
def membership(spark, d):
    chosen = table(spark, d, "customer").filter(F.col("c_nationkey").isin(1, 7, 12)).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(chosen, "o_custkey", "left_semi").select("o_orderkey")


@query("f08_drop_nulls", "SELECT event_id, value FROM (SELECT event_id, nullif(value, 0.0) AS value, nullif(event_type, 'click') AS t FROM events) WHERE value IS NOT NULL AND t IS NOT NULL")
def drop_nulls(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr("nullif(value, 0.0D)").alias("value"), F.expr("nullif(event_type, 'click')").alias("t"))
    return e.na.drop(subset=["value", "t"]).select("event_id", "value")


@query("f09_complete_cases", "SELECT trait, count(*) AS n, round(avg(v), 6) AS mean_v FROM (SELECT l_orderkey, l_linenumber, unnest(['quantity', 'discount', 'tax']) AS trait, unnest([nullif(l_quantity, 25.0), nullif(l_discount, 0.0), nullif(l_tax, 0.0)]) AS v FROM lineitem) WHERE v IS NOT NULL GROUP BY trait")
def complete_cases(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("nullif(l_quantity, 25.0D)").alias("quantity"), F.expr("nullif(l_discount, 0.0D)").alias("discount"), F.expr("nullif(l_tax, 0.0D)").alias("tax"))
    return li.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "trait", "v").filter("v is not null").groupBy("trait").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean_v"))


@query("f10_finite", "SELECT event_id, round(x, 6) AS x FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'inf'::DOUBLE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value END AS x FROM events) WHERE isfinite(x)")
def finite_filter(spark, d):
    x = F.when(F.col("event_id") % 7 == 0, float("inf")).when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", X.finite(x).alias("x")).filter("x is not null").select("event_id", F.round("x", 6).alias("x"))


@query("f11_first_reason", "SELECT o_orderkey, CASE WHEN o_orderstatus IS NULL OR trim(o_orderstatus) = '' THEN 'no status' WHEN o_totalprice < 20000 THEN 'small' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'included' END AS reason FROM orders")
def first_reason(spark, d):
    status = F.col("o_orderstatus")
    rules = [("no status", status.isNull() | (F.trim(status) == "")), ("small", F.col("o_totalprice") < 20000), ("urgent", F.col("o_orderpriority") == "1-URGENT")]
    return table(spark, d, "orders").select("o_orderkey", X.first_reason(rules).alias("reason"))


@query("f12_all_reasons", "SELECT l_orderkey, l_linenumber, coalesce(nullif(concat_ws(',', CASE WHEN l_quantity < 5 THEN 'few' END, CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END), ''), 'PASS') AS reasons FROM lineitem")
def all_reasons(spark, d):
    rules = [("few", F.col("l_quantity") < 5), ("discount", F.col("l_discount") > 0.08), ("returned", F.col("l_returnflag") == "R")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.all_reasons(rules).alias("reasons"))


@query("f13_priority_class", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)anchor|5$') THEN 'anchor' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) THEN 'target' WHEN p_size <= 10 THEN 'like' ELSE 'other' END AS class FROM part")
def priority_class(spark, d):
    listed = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("listed", F.lit(True))
    rules = [("anchor", F.col("p_name").rlike("(?i)anchor|5$")), ("target", F.coalesce("listed", F.lit(False))), ("like", F.col("p_size") <= 10)]
    return table(spark, d, "part").join(listed, "p_partkey", "left").select("p_partkey", X.first_reason(rules, "other").alias("class"))


@query("f14_region_case", "SELECT event_id, CASE WHEN value >= 80 AND user_id % 10 >= 2 THEN 'east' WHEN value >= 40 THEN 'mid' WHEN user_id % 10 < 2 THEN 'south' ELSE 'west' END AS zone FROM events")
def region_case(spark, d):
    u = F.col("user_id") % 10
    return table(spark, d, "events").select("event_id", F.when((F.col("value") >= 80) & (u >= 2), "east").when(F.col("value") >= 40, "mid").when(u < 2, "south").otherwise("west").alias("zone"))


SEGMENTS = {"AUTOMOBILE": "vehicle", "MACHINERY": "vehicle", "BUILDING": "home", "FURNITURE": "home", "HOUSEHOLD": "home"}


@query("f15_recode", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'vehicle' WHEN c_mktsegment IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD') THEN 'home' ELSE c_mktsegment END AS kind FROM customer")
def recode(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.lookup_code(F.col("c_mktsegment"), SEGMENTS).alias("kind"))


@query("f16_lineage_token", "SELECT p_partkey, coalesce(list_filter(t, lambda x: x IN ('STEEL', 'BRASS', 'TIN'))[1], t[list_position(t, 'ANODIZED') + 1]) AS token FROM (SELECT p_partkey, string_split(p_type, ' ') AS t FROM part)")
def lineage_token(spark, d):
    t = F.split("p_type", " ")
    direct = F.get(F.filter(t, lambda x: x.isin("STEEL", "BRASS", "TIN")), F.lit(0))
    after = F.when(F.array_position(t, "ANODIZED") > 0, F.get(t, F.array_position(t, "ANODIZED").cast("int")))
    return table(spark, d, "part").select("p_partkey", F.coalesce(direct, after).alias("token"))


@query("f17_code_map_lenient", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def code_map(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.lookup_code(F.col("o_orderstatus"), {"F": "filled", "O": "open"}).alias("status"))


@query("f18_no_inner_stop", "SELECT doc_id, strpos(substr(text, 1, greatest(length(text) - 1, 0)), '.') = 0 AS intact FROM documents")
def inner_stop(spark, d):
    head = F.substring(F.col("text"), F.lit(1), F.greatest(F.length("text") - 1, F.lit(0)))
    return table(spark, d, "documents").select("doc_id", (F.instr(head, ".") == 0).alias("intact"))


@query("f19_gap_qc", "SELECT doc_id, regexp_matches(text, '(?i)e{2,}') OR len(regexp_extract_all(text, '(?i)n')) > 0.09 * length(text) AS gappy FROM documents")
def gap_qc(spark, d):
    share = F.regexp_count("text", F.lit("(?i)n")) > 0.09 * F.length("text")
    return table(spark, d, "documents").select("doc_id", (F.col("text").rlike("(?i)e{2,}") | share).alias("gappy"))


@query("f20_length_filter", "SELECT p_partkey FROM part WHERE p_size + p_partkey % 3 - p_partkey % 5 + 1 BETWEEN 8 AND 12")
def length_filter(spark, d):
    length = F.col("p_size") + F.col("p_partkey") % 3 - F.col("p_partkey") % 5 + 1
    return table(spark, d, "part").filter(length.between(8, 12)).select("p_partkey")


@query("f21_quality_flag", "SELECT s_suppkey, s_acctbal >= 1000 AND lower(s_name) LIKE 'supplier%' AND s_nationkey % 2 = 0 AS passes FROM supplier")
def quality_flag(spark, d):
    df = C.with_defaults(table(spark, d, "supplier"), {"gap_free": F.lit(True)})
    return df.select("s_suppkey", ((F.col("s_acctbal") >= 1000) & F.lower("s_name").like("supplier%") & (F.col("s_nationkey") % 2 == 0) & F.col("gap_free")).alias("passes"))


@query("f22_levels", "SELECT l_orderkey, l_linenumber, l_quantity <= 10 AS hit_l1, l_quantity <= 20 AND l_discount <= 0.05 AS hit_l2, l_quantity <= 30 AND l_discount <= 0.05 AND l_tax <= 0.04 AS hit_l3 FROM lineitem")
def levels(spark, d):
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    bounds = {"l1": (10, None, None), "l2": (20, 0.05, None), "l3": (30, 0.05, 0.04)}
    hit = lambda a, b, c: (q <= a) & (F.lit(True) if b is None else disc <= b) & (F.lit(True) if c is None else tax <= c)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[hit(*v).alias(f"hit_{k}") for k, v in bounds.items()])


INTERVALS = "SELECT l_orderkey AS id, l_linenumber AS line, l_suppkey AS grp, (epoch(l_shipdate) / 86400)::BIGINT AS s, (epoch(l_shipdate) / 86400)::BIGINT + l_quantity::BIGINT AS e FROM lineitem"


def shipments(spark, d):
    """Line items as half-open day intervals [ship day, ship day + quantity) by supplier."""
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400).cast("long")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("grp"), day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))


@query("f23_containment", f"WITH i AS ({INTERVALS}), b AS (SELECT min(s) AS lo, max(e) AS hi FROM i) SELECT id, line FROM i, b WHERE s >= lo + (hi - lo) // 3 AND e <= hi - (hi - lo) // 3")
def containment(spark, d):
    """Intervals inside the middle third of all days."""
    i = shipments(spark, d)
    lo, hi = i.agg(F.min("s"), F.max("e")).first()
    third = (hi - lo) // 3
    return i.filter((F.col("s") >= lo + third) & (F.col("e") <= hi - third)).select("id", "line")


@query("f24_overlap", f"WITH i AS ({INTERVALS}), b AS (SELECT (min(s) + max(e)) // 2 AS mid FROM i) SELECT id, line FROM i, b WHERE e > mid AND s < mid + 10")
def overlap(spark, d):
    """Intervals that overlap the ten days from the middle of all days on."""
    i = shipments(spark, d)
    lo, hi = i.agg(F.min("s"), F.max("e")).first()
    mid = (lo + hi) // 2
    return i.filter((F.col("e") > mid) & (F.col("s") < mid + 10)).select("id", "line")


@query("f25_reorder_defaults", "SELECT r_name, r_regionkey, 'none' AS note FROM region")
def reorder(spark, d):
    return C.reordered(C.with_defaults(table(spark, d, "region"), {"note": F.lit("none")}), ["r_name", "absent"])


@query("f27_alias_ids", "SELECT c_custkey, replace(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'CAR' ELSE c_mktsegment END, 'HOUSE', 'HOME') AS segment FROM customer")
def alias_ids(spark, d):
    whole = table(spark, d, "customer").replace({"AUTOMOBILE": "CAR"}, subset=["c_mktsegment"])
    return whole.select("c_custkey", F.replace("c_mktsegment", F.lit("HOUSE"), F.lit("HOME")).alias("segment"))


@query("f28_fuzzy_column", "SELECT c_custkey, c_acctbal AS balance FROM customer")
def fuzzy_column(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.col(C.resolve_column(c, exact=["Balance"], contains=["ACCT", "bal"])).alias("balance"))


@query("f29_center_mask", f"WITH i AS ({INTERVALS}) SELECT id, line FROM i WHERE (s + e) / 2.0 >= 9000 AND (s + e) / 2.0 < 9200 AND NOT ((s + e) / 2.0 >= 9050 AND (s + e) / 2.0 < 9060)")
def center_mask(spark, d):
    c = (F.col("s") + F.col("e")) / 2.0
    return shipments(spark, d).filter((c >= 9000) & (c < 9200) & ~((c >= 9050) & (c < 9060))).select("id", "line")


@query("f32_overlapping_aggregates", "SELECT a.n_name AS a, b.n_name AS b, a.n_regionkey = b.n_regionkey AS same_parent FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def overlapping_aggregates(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a"), F.col("n_regionkey").alias("ra")), n.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b"), F.col("n_regionkey").alias("rb"))
    return a.join(F.broadcast(b), F.col("ka") < F.col("kb")).select("a", "b", (F.col("ra") == F.col("rb")).alias("same_parent"))


@query("f33_stars", "SELECT event_id, CASE WHEN p <= 0.01 THEN '***' WHEN p <= 0.05 THEN '**' WHEN p <= 0.10 THEN '*' ELSE '' END AS stars FROM (SELECT event_id, nullif(value, 0.0) / 100 AS p FROM events)")
def star_levels(spark, d):
    return table(spark, d, "events").select("event_id", X.stars(F.expr("nullif(value, 0.0D)") / 100).alias("stars"))


@query("f34_sentinel_number", "SELECT event_id, try_cast(nullif(nullif(x, '..'), '') AS DOUBLE) AS v FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '..' WHEN 1 THEN '' WHEN 2 THEN 'abc' ELSE event_id::VARCHAR END AS x FROM events)")
def sentinel_number(spark, d):
    i = F.col("event_id")
    x = F.when(i % 4 == 0, "..").when(i % 4 == 1, "").when(i % 4 == 2, "abc").otherwise(i.cast("string"))
    return table(spark, d, "events").select("event_id", X.number_or_null(x).alias("v"))


# ---- joins


@query("j01_inner_no_null_keys", "SELECT o_orderkey, c_name FROM orders JOIN (SELECT nullif(c_custkey, 7) AS k, c_name FROM customer) ON o_custkey = k")
def inner_join(spark, d):
    c = table(spark, d, "customer").select(F.expr("nullif(c_custkey, 7)").alias("o_custkey"), "c_name").filter("o_custkey is not null")
    return table(spark, d, "orders").join(c, "o_custkey").select("o_orderkey", "c_name")


@query("j02_left_outer", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def left_outer(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")


@query("j03_many_to_one", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def many_to_one(spark, d):
    n = C.require_unique(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], "nation")
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("j04_coalesced_sides", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, coalesce(a.v <> b.v, false) AS disagree FROM (SELECT c_nationkey AS k, min(c_mktsegment) AS v FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, max(c_mktsegment) AS v FROM customer WHERE c_nationkey > 5 GROUP BY 1) b ON a.k = b.k")
def coalesced_sides(spark, d):
    c = table(spark, d, "customer")
    a = c.filter("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_mktsegment").alias("va"))
    b = c.filter("c_nationkey > 5").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_mktsegment").alias("vb"))
    return a.join(b, "k", "full").select("k", F.coalesce("va", "vb").alias("v"), F.coalesce(F.col("va") != F.col("vb"), F.lit(False)).alias("disagree"))


@query("j05_semi_site_key", "SELECT l_orderkey, l_linenumber FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_returnflag = a.l_returnflag AND b.l_linestatus = a.l_linestatus AND b.l_quantity >= 48)")
def semi_site_key(spark, d):
    li = table(spark, d, "lineitem")
    keys = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    return li.join(li.filter("l_quantity >= 48").select(*keys), keys, "left_semi").select("l_orderkey", "l_linenumber")


@query("j06_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def anti(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("j07_last_wins_lookup", "SELECT p_partkey, label FROM part LEFT JOIN (SELECT l_partkey, arg_max(l_returnflag || l_linestatus, l_orderkey * 10 + l_linenumber) AS label FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def last_wins(spark, d):
    last = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max_by(F.concat("l_returnflag", "l_linestatus"), F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("label"))
    return table(spark, d, "part").select("p_partkey").join(last, "p_partkey", "left")


@query("j08_two_key_lookup", "WITH k AS (SELECT DISTINCT unnest([n_name, n_nationkey::VARCHAR]) AS k, n_regionkey AS r FROM nation), ok AS (SELECT k, min(r) AS r FROM k GROUP BY k HAVING count(DISTINCT r) = 1), q AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE s_nationkey::VARCHAR END AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT s_suppkey, r AS region FROM q JOIN ok USING (k)")
def two_key_lookup(spark, d):
    n = table(spark, d, "nation")
    keys = n.select("n_regionkey", F.explode(F.array("n_name", F.col("n_nationkey").cast("string"))).alias("k")).distinct()
    single = keys.groupBy("k").agg(F.min("n_regionkey").alias("region"), F.count_distinct("n_regionkey").alias("m")).filter("m = 1").drop("m")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.col("s_nationkey").cast("string")).alias("k"))
    return s.join(single, "k").select("s_suppkey", "region")


@query("j09_interval_overlap", f"WITH i AS ({INTERVALS}) SELECT a.id AS id, a.line AS line, b.id AS id2, b.line AS line2, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM i a JOIN i b ON a.grp = b.grp AND a.s < b.e AND b.s < a.e WHERE a.id * 10 + a.line < b.id * 10 + b.line")
def interval_overlap(spark, d):
    i = shipments(spark, d)
    b = i.select(F.col("id").alias("id2"), F.col("line").alias("line2"), "grp", F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = I.overlap_join_half_open(i, b, ("s", "e"), ("s2", "e2"), ["grp"], 64)
    return pairs.filter("id * 10 + line < id2 * 10 + line2").select("id", "line", "id2", "line2", "overlap")



@query("j10_point_in_interval", f"WITH i AS ({INTERVALS}), p AS (SELECT o_orderkey, o_orderkey % 100 + 1 AS grp, (epoch(o_orderdate) / 86400)::BIGINT AS pos FROM orders) SELECT o_orderkey, pos, id, line, CASE WHEN id IS NOT NULL THEN greatest(s - pos, pos - e, 0) END AS distance FROM p LEFT JOIN i ON i.grp = p.grp AND pos BETWEEN s - 2 AND e + 2")
def point_in_interval(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 100 + 1).alias("grp"), F.floor(F.unix_timestamp("o_orderdate") / 86400).cast("long").alias("pos"))
    out = I.point_join_closed(p, shipments(spark, d), "pos", ("s", "e"), ["grp"], 2, 64)
    return out.select("o_orderkey", "pos", "id", "line", "distance")



@query("j11_asof_prefix_sum", "WITH e AS (SELECT event_id, user_id, ts, value FROM events), p AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e) SELECT q.event_id, round(coalesce((SELECT arg_max(run, (ts, event_id)) FROM p WHERE p.user_id = q.user_id AND p.ts < q.ts), 0.0), 6) AS before_sum FROM e q")
def asof_prefix_sum(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = e.withColumn("run", F.sum("value").over(w))
    latest = run.groupBy("user_id", "ts").agg(F.max_by("run", "event_id").alias("run"))
    out = O.asof_before(e, latest, ["user_id"], "ts", "run", "before_sum", strict=True)
    return out.select("event_id", F.round(F.coalesce("before_sum", F.lit(0.0)), 6).alias("before_sum"))



@query("j12_theta_self", f"WITH i AS ({INTERVALS}) SELECT a.id AS id, a.line AS line, b.id AS id2, b.line AS line2 FROM i a JOIN i b ON a.grp = b.grp AND a.s < b.e AND b.s < a.e AND (a.id, a.line) < (b.id, b.line) WHERE (least(a.e, b.e) - greatest(a.s, b.s)) >= 0.8 * least(a.e - a.s, b.e - b.s)")
def theta_self(spark, d):
    i = shipments(spark, d)
    b = i.select(F.col("id").alias("id2"), F.col("line").alias("line2"), "grp", F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = I.overlap_join_half_open(i, b, ("s", "e"), ("s2", "e2"), ["grp"], 64).filter("id < id2 or (id = id2 and line < line2)")
    return pairs.filter("overlap >= 0.8D * least(e - s, e2 - s2)").select("id", "line", "id2", "line2")



@query("j13_exon_overlap", f"WITH i AS ({INTERVALS}) SELECT a.id AS id, b.id AS id2, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS bp, count(*) AS pairs FROM i a JOIN i b ON a.grp = b.grp AND a.s < b.e AND b.s < a.e AND a.id < b.id GROUP BY 1, 2")
def exon_overlap(spark, d):
    pairs = I.self_overlaps_half_open(shipments(spark, d), ("s", "e"), ["grp"], ["id", "line"], 64).filter("id <> id2")
    pairs = pairs.select(F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("id2"), "overlap")
    return pairs.groupBy("id", "id2").agg(F.sum("overlap").alias("bp"), F.count("*").alias("pairs"))



@query("j14_best_match", "SELECT a AS p_partkey, b AS best, round(score, 6) AS score FROM (SELECT a.p_partkey AS a, b.p_partkey AS b, -abs(a.p_retailprice - b.p_retailprice) - abs(a.p_size - b.p_size) AS score, row_number() OVER (PARTITION BY a.p_partkey ORDER BY round(-abs(a.p_retailprice - b.p_retailprice) - abs(a.p_size - b.p_size), 6) DESC, b.p_partkey) AS rn FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey) WHERE rn = 1")
def best_match(spark, d):
    # Prices have two decimals: in millionths, costs are whole numbers.
    p = table(spark, d, "part").select("p_brand", "p_type", "p_partkey", F.round(F.col("p_retailprice") * 1e6).cast("long").alias("x"), (F.col("p_size") * 1_000_000).cast("long").alias("y"))
    near = O.nearest_in_plane(p, ["p_brand", "p_type"], "p_partkey", "x", "y")
    return near.select("p_partkey", "best", F.round(-F.col("cost") / 1e6, 6).alias("score"))


@query("j16_bounded_product", "SELECT a.n_name AS n_name, r.r_name AS r_name FROM nation a, region r WHERE a.n_regionkey <> r.r_regionkey AND length(a.n_name) > length(r.r_name)")
def bounded_product(spark, d):
    return table(spark, d, "nation").crossJoin(F.broadcast(table(spark, d, "region"))).filter("n_regionkey <> r_regionkey and length(n_name) > length(r_name)").select("n_name", "r_name")


@query("j17_unordered_pairs", "WITH p AS (SELECT a.r_name AS a, b.r_name AS b, a.r_regionkey AS ka, b.r_regionkey AS kb FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey) SELECT a, b, CASE WHEN ka = 0 AND kb = 1 THEN 'not assessed' ELSE 'assessed' END AS status FROM p")
def unordered_pairs(spark, d):
    r = table(spark, d, "region")
    a, b = r.select(F.col("r_regionkey").alias("ka"), F.col("r_name").alias("a")), r.select(F.col("r_regionkey").alias("kb"), F.col("r_name").alias("b"))
    pairs = a.join(F.broadcast(b), F.col("ka") < F.col("kb"))
    done = pairs.filter("not (ka = 0 and kb = 1)").select("a", "b", F.lit("assessed").alias("status"))
    return done.unionByName(pairs.filter("ka = 0 and kb = 1").select("a", "b", F.lit("not assessed").alias("status")))


@query("j18_comparators", "SELECT a.s_suppkey AS s_suppkey, string_agg(b.s_suppkey::VARCHAR, ';' ORDER BY b.s_suppkey) AS comparators FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey AND (a.s_acctbal > 0) <> (b.s_acctbal > 0) GROUP BY 1")
def comparators(spark, d):
    s = table(spark, d, "supplier")
    b = s.select("s_nationkey", F.col("s_suppkey").alias("k2"), (F.col("s_acctbal") > 0).alias("p2"))
    pairs = s.join(b, "s_nationkey").filter((F.col("s_suppkey") != F.col("k2")) & ((F.col("s_acctbal") > 0) != F.col("p2")))
    return pairs.groupBy("s_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k2")), lambda x: x.cast("string")), ";").alias("comparators"))


@query("j19_paired_panels", "SELECT a.c_custkey AS k, a.c_name AS name_a, b.s_name AS name_b FROM customer a JOIN supplier b ON replace(a.c_name, 'Customer#', '') = replace(b.s_name, 'Supplier#', '')")
def paired_panels(spark, d):
    a = table(spark, d, "customer").select(F.replace("c_name", F.lit("Customer#"), F.lit("")).alias("base"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name_a"))
    b = table(spark, d, "supplier").select(F.replace("s_name", F.lit("Supplier#"), F.lit("")).alias("base"), F.col("s_name").alias("name_b"))
    return C.require_unique(a, ["base"]).join(C.require_unique(b, ["base"]), "base").drop("base")


@query("j20_parent_child", "SELECT c.o_orderkey AS node, p.o_orderkey AS parent, c.o_orderpriority AS child_class, p.o_orderpriority AS parent_class FROM orders c LEFT JOIN orders p ON p.o_orderkey = c.o_orderkey // 2")
def parent_child(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("child_class"))
    p = o.select(F.col("node").alias("parent"), F.col("child_class").alias("parent_class"))
    return o.join(p, F.floor(F.col("node") / 2) == F.col("parent"), "left").select("node", "parent", "child_class", "parent_class")


@query("j21_nearest_boundary", "WITH b AS (SELECT DISTINCT p_size * 7 AS b FROM part), c AS (SELECT event_id, value FROM events), m AS (SELECT event_id, b, abs(value - b) AS d, row_number() OVER (PARTITION BY event_id ORDER BY abs(value - b), b) AS rn FROM c, b WHERE abs(value - b) <= 2) SELECT event_id, b::BIGINT AS boundary FROM m WHERE rn = 1")
def nearest_boundary(spark, d):
    b = table(spark, d, "part").select((F.col("p_size") * 7).cast("long").alias("boundary")).distinct()
    bins = b.withColumn("bin", F.explode(F.sequence(F.floor((F.col("boundary") - 2) / 8), F.floor((F.col("boundary") + 2) / 8))))
    pairs = table(spark, d, "events").select("event_id", "value", F.floor(F.col("value") / 8).alias("bin")).join(bins, "bin")
    pairs = pairs.withColumn("off", F.abs(F.col("value") - F.col("boundary"))).filter("off <= 2")
    return pairs.groupBy("event_id").agg(F.min_by("boundary", F.struct("off", "boundary")).alias("boundary"))


@query("j22_list_order", "SELECT n_name, o AS place FROM nation JOIN (SELECT unnest(['NATION_7', 'NATION_3', 'NATION_12', 'NATION_20']) AS n, unnest([0, 1, 2, 3]) AS o) ON n = n_name")
def list_order(spark, d):
    order = spark.createDataFrame([(n, k) for k, n in enumerate(["NATION_7", "NATION_3", "NATION_12", "NATION_20"])], "n_name string, place int")
    return table(spark, d, "nation").join(F.broadcast(order), "n_name").orderBy("place").select("n_name", "place")


@query("j23_leave_one_out", "WITH p AS (SELECT DISTINCT o_orderpriority AS removed FROM orders) SELECT removed, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean FROM p JOIN orders ON o_orderpriority <> removed GROUP BY removed")
def leave_one_out(spark, d):
    # Totals less each class's own: no row meets another.
    own = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("removed")).agg(F.count("*").alias("c"), F.sum("o_totalprice").alias("t"))
    every = own.agg(F.sum("c").alias("C"), F.sum("t").alias("T"))
    return own.crossJoin(F.broadcast(every.select(F.col("C").alias("cc"), F.col("T").alias("tt")))).select("removed", (F.col("cc") - F.col("c")).alias("n"), F.round(F.col("tt") - F.col("t"), 2).alias("total"), F.round((F.col("tt") - F.col("t")) / (F.col("cc") - F.col("c")), 6).alias("mean"))


@query("j26_exactly_one", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def exactly_one(spark, d):
    n = table(spark, d, "nation")
    row = C.exactly_one(n.filter("n_nationkey = 7"), "nation")
    return n.filter(F.col("n_nationkey") == row["n_nationkey"]).select("n_nationkey", "n_name")
