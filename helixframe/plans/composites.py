"""Composite operators on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import composites as P
from ..operators import intervals as I
from ..session import table
from .filters_joins import INTERVALS, shipments
from .grouping import r6
from .registry import query
from .science import COLUMNS, columns


@query("a12_mean_depth", f"WITH i AS ({INTERVALS}), w AS (SELECT unnest(range(8000, 11000, 100)) AS ws), c AS (SELECT grp, ws, sum(greatest(0, least(e, ws + 100) - greatest(s, ws))) AS bp FROM i JOIN w ON s < ws + 100 AND e > ws GROUP BY 1, 2) SELECT grp, ws::BIGINT AS ws, round(bp / 100.0, 6) AS depth FROM c")
def mean_depth(spark, d):
    w = spark.range(8000, 11000, 100).select(F.col("id").alias("ws"), (F.col("id") + 100).alias("we"))
    both = I.overlap_join_half_open(shipments(spark, d), w, ("s", "e"), ("ws", "we"), [], 100)
    return both.groupBy("grp", "ws").agg(r6(F.sum("overlap") / 100.0, "depth"))


@query("a25_minority_groups", "WITH s AS (SELECT l_partkey AS site, l_returnflag AS g, CASE WHEN count_if(l_linestatus = 'O') >= count_if(l_linestatus = 'F') THEN 1 ELSE 0 END AS st FROM lineitem GROUP BY 1, 2), c AS (SELECT site, string_agg(g, ',' ORDER BY g) FILTER (st = 1) AS a, string_agg(g, ',' ORDER BY g) FILTER (st = 0) AS r, count_if(st = 1) AS na, count_if(st = 0) AS nr FROM s GROUP BY 1) SELECT site, CASE WHEN na = 0 OR nr = 0 THEN '-1' WHEN na < nr THEN a WHEN nr < na THEN r ELSE r || '|' || a END AS minority FROM c")
def minority(spark, d):
    alt, ref = F.count_if(F.col("l_linestatus") == "O"), F.count_if(F.col("l_linestatus") == "F")
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("site"), F.col("l_returnflag").alias("g")).agg((alt >= ref).alias("st"))
    names = lambda keep: F.array_sort(F.collect_set(F.when(keep, F.col("g"))))
    c = s.groupBy("site").agg(names(F.col("st")).alias("a"), names(~F.col("st")).alias("r"))
    na, nr = F.size("a"), F.size("r")
    text = lambda x: F.array_join(x, ",")
    return c.select("site", F.when((na == 0) | (nr == 0), "-1").when(na < nr, text("a")).when(nr < na, text("r")).otherwise(F.concat_ws("|", text("r"), text("a"))).alias("minority"))


@query("a39_units_from_seeds", f"WITH i AS (SELECT * FROM ({INTERVALS})), m AS (SELECT *, max(e) OVER (PARTITION BY grp ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM i), f AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m), u AS (SELECT grp, k, min(s) AS s, max(e) AS e FROM f GROUP BY 1, 2) SELECT grp, min(s) AS s, max(e) AS e, count(*) AS exons, sum(e - s)::BIGINT AS bp FROM u GROUP BY 1")
def units(spark, d):
    u = I.union_touching(shipments(spark, d), ["grp"], "s", "e")
    return u.groupBy("grp").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("exons"), F.sum(F.col("e") - F.col("s")).alias("bp"))



@query("m02_logs", "SELECT event_id, CASE WHEN value > 0 THEN round(log10(value), 6) END AS l10 FROM events")
def logs(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("value") > 0, F.round(F.log10("value"), 6)).alias("l10"))


@query("p02_structural_labels", "WITH c AS (SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag) AS path, count_if(l_returnflag = 'A') AS a, count_if(l_returnflag = 'N') AS n, count_if(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1), p AS (SELECT *, CASE WHEN a > 0 THEN 'A' || a ELSE '' END || CASE WHEN n > 0 THEN 'N' || n ELSE '' END || CASE WHEN r > 0 THEN 'R' || r ELSE '' END AS prefix FROM c), s AS (SELECT DISTINCT prefix, path FROM p), o AS (SELECT prefix, path, dense_rank() OVER (PARTITION BY prefix ORDER BY path) AS k, count(*) OVER (PARTITION BY prefix) AS m FROM s) SELECT l_orderkey, CASE WHEN m > 1 THEN prefix || '.' || k ELSE prefix END AS label FROM p JOIN o USING (prefix, path)")
def structural_labels(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    n = lambda f: F.count_if(F.col("l_returnflag") == f)
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["l_returnflag"]), "").alias("path"), n("A").alias("a"), n("N").alias("n"), n("R").alias("r"))
    from ..functions.expressions import copy_label

    p = c.select("l_orderkey", "path", copy_label({"A": F.col("a"), "N": F.col("n"), "R": F.col("r")}).alias("prefix"))
    s = p.select("prefix", "path").distinct()
    o = s.withColumns({"k": F.dense_rank().over(Window.partitionBy("prefix").orderBy("path")), "m": F.count("*").over(Window.partitionBy("prefix"))})
    return p.join(o, ["prefix", "path"]).select("l_orderkey", F.when(F.col("m") > 1, F.concat_ws(".", "prefix", F.col("k").cast("string"))).otherwise(F.col("prefix")).alias("label"))


@query("p03_blocks", "WITH e AS (SELECT user_id, event_id, ts, event_type IN ('click', 'view') AS u FROM events), f AS (SELECT *, CASE WHEN u AND coalesce(lag(u) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) THEN 0 ELSE 1 END AS n FROM e) SELECT event_id, (sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS block FROM f")
def blocks(spark, d):
    e = table(spark, d, "events")
    return P.blocks_of_runs(e, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("click", "view")).select("event_id", "block")


@query("p04_informative_sites", f"WITH {COLUMNS}, p AS (SELECT pos, max(CASE WHEN doc_id = 0 THEN base END) AS pa, max(CASE WHEN doc_id = 1 THEN base END) AS pb FROM c GROUP BY 1) SELECT doc_id, count_if(base = pa) AS from_a, count_if(base = pb) AS from_b FROM c JOIN p USING (pos) WHERE pa <> pb AND doc_id > 1 AND (base = pa OR base = pb) AND base NOT IN ('-', 'N') GROUP BY 1")
def informative(spark, d):
    c = columns(spark, d, 0, 1)
    side = lambda k, name: F.max(F.when(F.col("doc_id") == k, F.col("base"))).alias(name)
    # A maximum of texts sorts its rows: only those of the two references.
    p = c.filter(F.col("doc_id").isin(0, 1)).groupBy("pos").agg(side(0, "pa"), side(1, "pb")).filter("pa <> pb")
    rows = c.filter("doc_id > 1").join(F.broadcast(p), "pos").filter("(base = pa or base = pb) and base not in ('-', 'N')")
    return rows.groupBy("doc_id").agg(F.count_if(F.col("base") == F.col("pa")).alias("from_a"), F.count_if(F.col("base") == F.col("pb")).alias("from_b"))


@query("p06_trio_origin", "WITH b AS (SELECT user_id, event_id // 20 AS bin, event_type AS p, round(max(value), 0) AS v FROM events GROUP BY 1, 2, 3), m AS (SELECT user_id, bin, max(v) AS best FROM b GROUP BY 1, 2), w AS (SELECT user_id, bin, CASE WHEN count(*) = 1 AND max(best) > 0 THEN max(p) END AS w FROM b JOIN m USING (user_id, bin) WHERE v >= best - 1e-6 GROUP BY 1, 2) SELECT user_id, bin, coalesce(last_value(w IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bin ROWS UNBOUNDED PRECEDING), 'Unknown') AS origin FROM w")
def trio_origin(spark, d):
    b = table(spark, d, "events").groupBy("user_id", F.floor(F.col("event_id") / 20).alias("bin"), "event_type").agg(F.round(F.max("value"), 0).alias("v"))
    return P.origin_by_bins(b, ["user_id"], "bin", "event_type", "v")


@query("p08_qc_summary", "WITH g AS (SELECT l_suppkey, count(*) AS n, count_if(l_quantity < 3) AS few, count_if(l_discount > 0.095) AS cut FROM lineitem GROUP BY 1) SELECT l_suppkey, n, coalesce(nullif(concat_ws(',', CASE WHEN n < 590 THEN 'rare' END, CASE WHEN few > 25 THEN 'small' END, CASE WHEN cut > 30 THEN 'discounted' END), ''), 'PASS') AS reasons FROM g")
def qc_summary(spark, d):
    from ..functions.expressions import all_reasons

    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") < 3).alias("few"), F.count_if(F.col("l_discount") > 0.095).alias("cut"))
    return g.select("l_suppkey", "n", all_reasons([("rare", F.col("n") < 590), ("small", F.col("few") > 25), ("discounted", F.col("cut") > 30)]).alias("reasons"))


@query("p12_p28_endpoint_hits", f"WITH i AS ({INTERVALS}), p AS (SELECT p_partkey, p_partkey % 100 + 1 AS grp, 9000 + p_partkey AS pos FROM part) SELECT p_partkey, count(id) AS hits, count(id) > 0 AS te_hit FROM p LEFT JOIN i ON i.grp = p.grp AND pos BETWEEN s - 5 AND e + 5 GROUP BY 1")
def endpoint_hits(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 100 + 1).alias("grp"), (F.col("p_partkey") + 9000).alias("pos"))
    hits = I.point_join_closed(p, shipments(spark, d), "pos", ("s", "e"), ["grp"], 5, 64)
    return hits.groupBy("p_partkey").agg(F.count("id").alias("hits"), (F.count("id") > 0).alias("te_hit"))



@query("p14_endpoint_statistics", "SELECT l_suppkey, count_if(a AND b) AS both_ends, count_if(a OR b) AS any_end, count_if(NOT a AND NOT b) AS no_end FROM (SELECT l_suppkey, l_discount > 0.05 AS a, l_tax > 0.04 AS b FROM lineitem) GROUP BY 1")
def endpoint_statistics(spark, d):
    a, b = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(a & b).alias("both_ends"), F.count_if(a | b).alias("any_end"), F.count_if(~a & ~b).alias("no_end"))


@query("p16_breakpoints", "WITH e AS (SELECT l_suppkey, (l_partkey + l_quantity)::BIGINT AS p FROM lineitem), f AS (SELECT *, CASE WHEN lag(p) OVER w IS NULL OR p - lag(p) OVER w > 3 THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY l_suppkey ORDER BY p)), c AS (SELECT l_suppkey, p, sum(n) OVER (PARTITION BY l_suppkey ORDER BY p RANGE UNBOUNDED PRECEDING) AS k FROM f) SELECT l_suppkey, k::BIGINT AS cluster, min(p) AS p, count(*) AS size FROM c GROUP BY 1, 2")
def breakpoints(spark, d):
    e = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") + F.col("l_quantity")).cast("long").alias("p"))
    return I.point_clusters(e, ["l_suppkey"], "p", 3)


@query("p20_whitelist", "SELECT DISTINCT p_type AS value FROM part WHERE p_size > 5 UNION SELECT DISTINCT p_brand FROM part WHERE p_size > 5")
def whitelist(spark, d):
    p = table(spark, d, "part").filter("p_size > 5")
    return p.select(F.explode(F.array("p_type", "p_brand")).alias("value")).distinct()


@query("p22_parent_population", "SELECT c_custkey FROM customer WHERE regexp_matches('AFR' || CASE WHEN c_custkey % 3 = 0 THEN '-X' WHEN c_custkey % 3 = 1 THEN '' ELSE 'ICA' END, '^AFR(-.*)?$')")
def parent_population(spark, d):
    k = F.col("c_custkey") % 3
    name = F.concat(F.lit("AFR"), F.when(k == 0, "-X").when(k == 1, "").otherwise("ICA"))
    return table(spark, d, "customer").filter(name.rlike("^AFR(-.*)?$")).select("c_custkey")


@query("p25_leave_one_out_rates", "WITH o AS (SELECT l_returnflag || l_linestatus AS cls, l_suppkey % 7 AS ord, count(*) AS n, sum(l_quantity) AS t FROM lineitem GROUP BY 1, 2), r AS (SELECT DISTINCT ord AS removed FROM o) SELECT removed, cls, sum(n)::BIGINT AS n, round(sum(n) / sum(t), 6) AS rate FROM r JOIN o ON ord <> removed GROUP BY 1, 2")
def leave_one_out_rates(spark, d):
    o = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("cls"), (F.col("l_suppkey") % 7).alias("ord")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("t"))
    r = o.select(F.col("ord").alias("removed")).distinct()
    return o.join(F.broadcast(r), F.col("ord") != F.col("removed")).groupBy("removed", "cls").agg(F.sum("n").alias("n"), r6(F.sum("n") / F.sum("t"), "rate"))


@query("p30_plot_table", "SELECT n_name, row_number() OVER (ORDER BY n_regionkey, n_name) AS tip, (n_nationkey + 0.5)::DOUBLE AS mid, max(length(n_name)) OVER (PARTITION BY n_regionkey)::INT AS label_at FROM nation")
def plot_table(spark, d):
    n = table(spark, d, "nation")
    w = Window.partitionBy("n_regionkey")
    return n.select("n_name", F.row_number().over(Window.orderBy("n_regionkey", "n_name")).alias("tip"), (F.col("n_nationkey") + 0.5).cast("double").alias("mid"), F.max(F.length("n_name")).over(w).alias("label_at"))


@query("g17_recombinants", "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus AND a.l_suppkey < b.l_suppkey AND a.l_quantity >= 40 AND b.l_quantity < 10 GROUP BY 1, 2")
def recombinants(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_suppkey", "l_quantity")
    a = li.filter("l_quantity >= 40").withColumnRenamed("l_suppkey", "a").drop("l_quantity")
    b = li.filter("l_quantity < 10").withColumnRenamed("l_suppkey", "b").drop("l_quantity")
    return a.join(b, ["l_orderkey", "l_returnflag", "l_linestatus"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("k08_json_summary", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def json_summary(spark, d):
    from ..sources import writers

    g = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return writers.json_summary(g).select(F.from_json("value", "o_orderstatus string, n long").alias("j")).select("j.*")


@query("m53_site_filters", "WITH s AS (SELECT l_partkey AS site, count(*) AS n, count_if(l_tax > 0) AS called, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS k FROM lineitem GROUP BY 1) SELECT site FROM s WHERE least(k * 1.0 / n, 1 - k * 1.0 / n) >= 0.05 AND 1 - called * 1.0 / n <= 0.05")
def site_filters(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("site")).agg(F.count("*").alias("n"), F.count_if(F.col("l_tax") > 0).alias("called"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    p = F.col("k") / F.col("n")
    return s.filter((F.least(p, 1 - p) >= 0.05) & (1 - F.col("called") / F.col("n") <= 0.05)).select("site")


@query("j15_greedy_assignment")
def greedy(spark, d):
    i = shipments(spark, d)
    a = i.filter("line = 1").select("grp", F.col("id").alias("a"), "s", "e")
    b = i.filter("line > 1").select("grp", (F.col("id") * 10 + F.col("line")).alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = I.overlap_join_half_open(a, b, ("s", "e"), ("s2", "e2"), ["grp"], 64).withColumn("share", F.col("overlap") / (F.col("e") - F.col("s")))
    pairs = pairs.select("grp", "a", "s", "b", "share", F.col("overlap").cast("double").alias("overlap"), (-F.abs(F.col("s") - F.col("s2"))).cast("double").alias("near"))
    return P.greedy_assignment(pairs, ["grp"], "a", "b", ["s"], ["share", "overlap", "near"])


@query("p10_merged_blocks")
def merged_blocks(spark, d):
    i = shipments(spark, d).filter("line = 1").select("grp", F.col("s").alias("qs"), F.col("e").alias("qe"), (F.col("s") + F.col("id") % 3).alias("ts"), (F.col("e") + F.col("id") % 3).alias("te"))
    return P.merged_to_fixpoint(i, ["grp"], 5, 2)


@query("g13_disjoint_clades")
def clades(spark, d):
    c = table(spark, d, "supplier").select((F.col("s_nationkey") % 3).alias("grp"), F.explode(F.array(F.col("s_nationkey") % 5, F.col("s_nationkey") % 7 + 10)).alias("clade"), "s_suppkey")
    return P.disjoint_clades(c, "grp", "clade", "s_suppkey", 2)




@query("f30_localised", f"WITH i AS ({INTERVALS}), w AS (SELECT min(s) AS lo, max(e) AS hi FROM i WHERE grp = 7) SELECT id, line FROM i, w WHERE s >= lo AND e <= hi")
def localised(spark, d):
    i = shipments(spark, d)
    lo, hi = i.filter("grp = 7").agg(F.min("s"), F.max("e")).first()
    return i.filter((F.col("s") >= lo) & (F.col("e") <= hi)).select("id", "line")



@query("f31_attachable", f"WITH i AS (SELECT * FROM ({INTERVALS})), p AS (SELECT a.id AS id, a.line AS line, b.id AS id2, b.line AS line2, least(a.e, b.e) - greatest(a.s, b.s) AS o, a.e - a.s AS la, b.e - b.s AS lb FROM i a JOIN i b ON a.grp = b.grp AND a.s < b.e AND b.s < a.e AND (a.id, a.line) < (b.id, b.line)) SELECT id, line, id2, line2, o >= 0.5 * la OR o >= 0.5 * lb AS attachable, la > 3 * lb OR lb > 3 * la AS stretched FROM p")
def attachable(spark, d):
    i = shipments(spark, d)
    b = i.select(F.col("id").alias("id2"), F.col("line").alias("line2"), "grp", F.col("s").alias("s2"), F.col("e").alias("e2"))
    p = I.overlap_join_half_open(i, b, ("s", "e"), ("s2", "e2"), ["grp"], 64).filter("id < id2 or (id = id2 and line < line2)")
    la, lb, o = F.col("e") - F.col("s"), F.col("e2") - F.col("s2"), F.col("overlap")
    return p.select("id", "line", "id2", "line2", ((o >= 0.5 * la) | (o >= 0.5 * lb)).alias("attachable"), ((la > 3 * lb) | (lb > 3 * la)).alias("stretched"))



@query("w21_frames", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(value) RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM events")
def frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("v").rangeBetween(-5, 5)
    return table(spark, d, "events").withColumn("v", F.floor("value")).select("event_id", F.count("*").over(w).alias("near"))


@query("x24_natural_key", "SELECT p_brand, regexp_extract(p_brand, '^(\\D*)', 1) || lpad(regexp_extract(p_brand, '(\\d+)', 1), 20, '0') AS key FROM (SELECT DISTINCT p_brand FROM part)")
def natural_keys(spark, d):
    from ..functions.expressions import natural_key

    return table(spark, d, "part").select("p_brand").distinct().select("p_brand", natural_key(F.col("p_brand")).alias("key"))


@query("m07_x28_number_text")
def number_text(spark, d):
    rows = table(spark, d, "region").orderBy("r_regionkey").collect()  # five rows
    return spark.createDataFrame([(r["r_name"], P.stable_seed(r["r_name"]), P.short_number(r["r_regionkey"] / 3e7)) for r in rows], "name string, seed long, text string")


@query("m18_m57_trend")
def trend(spark, d):
    """Slope toward the present of the daily mean of each event type, its p and 95 % limits; null for fewer than three days."""
    from ..functions import numeric as N

    days = table(spark, d, "events").groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.avg("value").alias("v"))
    g = days.groupBy("event_type").agg(F.count("*").alias("n"), F.regr_slope("v", -F.col("day")).alias("slope"), F.regr_sxx("v", -F.col("day")).alias("sxx"), F.regr_r2("v", -F.col("day")).alias("r2"), F.regr_syy("v", -F.col("day")).alias("syy"))

    def tests(batches):
        for p in batches:
            df = p["n"] - 2
            se = ((p["syy"] * (1 - p["r2"]) / df) / p["sxx"]) ** 0.5
            t = p["slope"] / se
            ok = p["n"] >= 3
            half = [N.t_quantile(0.975, k) * s if good else None for k, s, good in zip(df, se, ok, strict=True)]
            yield p.assign(p=[N.t_two_sided(a, k) if good else None for a, k, good in zip(t, df, ok, strict=True)], low=p["slope"] - half, high=p["slope"] + half)[["event_type", "n", "slope", "p", "low", "high"]]

    return g.mapInPandas(tests, "event_type string, n long, slope double, p double, low double, high double")
