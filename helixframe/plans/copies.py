"""Mixtures, bundles, pairs of haplotypes and phenome scans on the test tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import copies as C
from ..operators.composites import paired_blocks
from ..session import table
from .reading import place
from .registry import query


def assay(spark, d):
    """A feature near a third of the copies, and the copies."""
    copies = (F.col("c_custkey") % 5 + 1).cast("double")
    noise = (F.pmod(F.col("c_custkey") * 7919, F.lit(1000)) - 500) / 30000.0
    return table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("grp"), (copies / 3 + 0.1 + noise).alias("x"), copies.alias("y"))


@query("m28_k09_mixture", "SELECT c_custkey, (c_custkey % 5 + 1)::BIGINT AS state FROM customer")
def mixture(spark, d):
    """Copies of all customers by mixtures fitted on the labels of every other one; the models go through a Parquet table."""
    x = assay(spark, d)
    path = place(spark, "mixture-models")
    C.mixture_parameters(x.filter("c_custkey % 2 = 0"), "grp", "x", "y", x).write.parquet(path)
    return C.mixture_states(x, spark.read.parquet(path), "grp", "x").select("c_custkey", "state")


@query("m26_smooth_permutation")
def smooth_permutation(spark, d):
    """Pseudo-R2 of the smooth trend of the daily mean of each event type, its permutation p and the slope toward the past."""
    days = table(spark, d, "events").groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.avg("value").alias("v"))

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("day")
        got = N.smooth_permutation(p["day"].to_numpy(float), p["v"].to_numpy(), 199, 1)
        return pd.DataFrame([{"event_type": p["event_type"].iloc[0], **got}])

    return days.groupBy("event_type").applyInPandas(fit, "event_type string, r2 double, p double, slope double, points long, permutations long")


@query("k10_matrix_table", "SELECT a.r_regionkey::INT AS i, b.r_regionkey::INT AS j, abs(length(a.r_name) - length(b.r_name))::DOUBLE AS value FROM region a, region b")
def matrix_table(spark, d):
    """A matrix as a long table: written, read back and checked to be symmetric."""
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("i"), F.length("r_name").alias("n"))
    cells = r.crossJoin(F.broadcast(r.select(F.col("i").alias("j"), F.col("n").alias("m")))).select("i", "j", F.abs(F.col("n") - F.col("m")).cast("double").alias("value"))
    path = place(spark, "matrix")
    cells.write.parquet(path)
    back = spark.read.parquet(path)
    mirror = back.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("v"))
    return back.join(mirror, ["i", "j"]).select("i", "j", F.when(F.col("value") == F.col("v"), F.col("value")).alias("value"))


@query("s28_gzip", "SELECT n_nationkey, n_name FROM nation")
def gzip(spark, d):
    """Compressed text, known by its suffix."""
    path = place(spark, "gzip")
    table(spark, d, "nation").select(F.concat_ws("\t", "n_nationkey", "n_name").alias("value")).write.option("compression", "gzip").text(path)
    parts = F.split(F.col("value"), "\t")
    return spark.read.text(path).select(parts[0].cast("int").alias("n_nationkey"), parts[1].alias("n_name"))


#: Raw pieces of four kinds of haplotypes.
RAW = ("1 3 7 10 11 4 12 0", "1 8 3 6 9 13 5 2 8 3 7 10 11 4 12 0", "1 2 8 3 7 4 5 0 8 3 6 5 4 12 0", "1 2 1 3 6 9 13 5 0")


@query("p01_principal_bundles", "SELECT s_suppkey AS hap, CASE s_suppkey % 4 WHEN 0 THEN '0+2+3+4+1' WHEN 1 THEN '0+2+6+7+5+2+3+4+1' WHEN 2 THEN '0+5+2+3+4+7+5+2+6+7+4+1' ELSE '0+2+6+7+1' END AS path, CASE s_suppkey % 4 WHEN 0 THEN 'UUUUU' WHEN 1 THEN 'URUUURUUU' WHEN 2 THEN 'UURURUURURRU' ELSE 'UUUUU' END AS kinds, CASE s_suppkey % 4 WHEN 0 THEN 80 WHEN 1 THEN 160 WHEN 2 THEN 150 ELSE 90 END::BIGINT AS last FROM supplier")
def bundles(spark, d):
    kinds = F.split(F.element_at(F.array(*[F.lit(x) for x in RAW]), (F.col("s_suppkey") % 4 + 1).cast("int")), " ")
    raw = table(spark, d, "supplier").select(F.col("s_suppkey").alias("hap"), F.posexplode(kinds).alias("place", "bundle")).withColumns({"s": F.col("place") * 10, "e": F.col("place") * 10 + 10})
    out = C.principal_bundles(raw, "hap", "place")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"]), "")
    return out.groupBy("hap").agg(F.first("path").alias("path"), joined.alias("kinds"), F.max("e").alias("last"))


_LETTERS = "SELECT p_partkey AS block, p_brand AS hap, left(p_brand, 7) AS species, CASE p_size % 2 WHEN 0 THEN 'Gene' ELSE 'Intergenic' END AS kind, unnest(range(1, length(p_type) + 1)) AS pos, unnest(string_split(p_type, '')) AS base FROM part"


@query("p26_paired_blocks", f"WITH c AS ({_LETTERS}), b AS (SELECT DISTINCT block, hap, species, kind FROM c), n AS (SELECT hap, kind, count(*) AS n FROM b GROUP BY 1, 2), w AS (SELECT DISTINCT x.hap AS child, y.hap AS parent, x.species FROM b x JOIN b y ON x.species = y.species AND x.hap <> y.hap), p AS (SELECT hap, kind, pos, count(*) AS k, list(DISTINCT base) AS bases, bool_or(base IN ('-', 'N')) AS gap FROM c GROUP BY 1, 2, 3), i AS (SELECT w.parent, c.hap AS child, c.kind, c.block, count(*) AS sites FROM w JOIN c ON c.hap = w.child JOIN p ON p.hap = w.parent AND p.kind = c.kind AND p.pos = c.pos JOIN n ON n.hap = p.hap AND n.kind = p.kind WHERE p.k = n.n AND len(p.bases) > 1 AND NOT p.gap AND c.base NOT IN ('-', 'N') AND list_contains(p.bases, c.base) GROUP BY 1, 2, 3, 4) SELECT w.child, w.parent, b.kind, b.block, pn.n AS parent_blocks, cn.n AS child_blocks, coalesce(i.sites, 0) AS sites FROM w JOIN b ON b.hap = w.child JOIN n pn ON pn.hap = w.parent AND pn.kind = b.kind JOIN n cn ON cn.hap = w.child AND cn.kind = b.kind LEFT JOIN i ON i.parent = w.parent AND i.child = w.child AND i.kind = b.kind AND i.block = b.block WHERE pn.n >= 2")
def pairs_of_blocks(spark, d):
    """Brands of one series as haplotypes, parts as their blocks, letters of the part's type as an alignment."""
    p = table(spark, d, "part").withColumn("kind", F.when(F.col("p_size") % 2 == 0, "Gene").otherwise("Intergenic"))
    letters = p.select(F.col("p_partkey").alias("block"), F.col("p_brand").alias("hap"), "kind", F.posexplode(F.split("p_type", "")).alias("pos", "base")).filter("base <> ''")
    haps = p.select(F.substring("p_brand", 1, 7).alias("species"), F.col("p_brand").alias("hap")).distinct()
    pairs = haps.withColumnRenamed("hap", "child").join(haps.withColumnRenamed("hap", "parent"), "species").filter("child <> parent").select("child", "parent")
    return paired_blocks(letters, pairs)


def phenome(spark, d):
    """Customers as people, months of orders as codes and phenotypes; the month before is the excluded range."""
    month = F.date_format("o_orderdate", "yyyyMM")
    records = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), month.alias("code")).distinct()
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), (F.col("c_acctbal") / 1000).alias("dose"), (F.col("c_nationkey") % 2).alias("sex"))
    codes = records.select("code", F.col("code").alias("phenotype")).distinct()
    exclusions = codes.select("phenotype", F.date_format(F.add_months(F.to_date("phenotype", "yyyyMM"), -1), "yyyyMM").alias("excluded"))
    return C.phenome_marks(records, people, codes, exclusions, "person"), people, codes


@query("m51_phenome_cells", "WITH r AS (SELECT DISTINCT o_custkey AS person, strftime(o_orderdate, '%Y%m') AS p FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)), x AS (SELECT DISTINCT person, strftime(strptime(p || '01', '%Y%m%d') + INTERVAL 1 MONTH, '%Y%m') AS p FROM r), k AS (SELECT DISTINCT p FROM r) SELECT k.p AS phenotype, count(r.person) AS cases, count(*) FILTER (r.person IS NULL AND x.person IS NULL) AS controls FROM k CROSS JOIN customer c LEFT JOIN r ON r.person = c.c_custkey AND r.p = k.p LEFT JOIN x ON x.person = c.c_custkey AND x.p = k.p GROUP BY 1")
def phenome_cells(spark, d):
    return C.phenome_counts(*phenome(spark, d))


@query("m51_phenome_scan")
def phenome_scan(spark, d):
    marks, people, _ = phenome(spark, d)
    return C.phenome_scan(marks, people, "person", "dose", ["sex"])


@query("p25_leave_one_out_tests")
def leave_one_out_tests(spark, d):
    """Exact rate and association tests of line items by status, over all and over each but one ship mode class."""
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).cast("string").alias("ord"), (F.col("l_linestatus") == "O").alias("open"), "l_quantity", (F.col("l_returnflag") == "R").alias("gain"))
    counts = li.groupBy("ord", "open").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("time"), F.count_if("gain").alias("gains"))
    removed = counts.select(F.col("ord").alias("removed")).distinct().unionByName(spark.createDataFrame([("none",)], "removed string"))
    side = lambda c, is_open: F.sum(F.when(F.col("open") == is_open, F.col(c)).otherwise(0)).alias(f"{c}_{'open' if is_open else 'closed'}")
    kept = counts.join(F.broadcast(removed), F.col("ord") != F.col("removed")).groupBy("removed").agg(*[side(c, o) for c in ("n", "time", "gains") for o in (True, False)])

    def tests(batches):
        for p in batches:
            rows = []
            for r in p.itertuples(index=False):
                rate = N.poisson_rate_test(r.gains_open, r.time_open, r.gains_closed, r.time_closed)
                table_ = N.fisher_exact(r.n_closed - r.gains_closed, r.gains_closed, r.n_open - r.gains_open, r.gains_open)
                corrected = ((r.gains_open + 0.5) / r.time_open) / ((r.gains_closed + 0.5) / r.time_closed)
                rows.append((r.removed, r.gains_open, r.gains_closed, rate["ratio"], corrected, rate["p"], rate["low"], rate["high"], table_["odds_ratio"], table_["p"]))
            yield pd.DataFrame(rows, columns=["removed", "gains_open", "gains_closed", "ratio", "corrected", "p", "low", "high", "odds_ratio", "fisher_p"]).replace(np.inf, np.nan)

    return kept.mapInPandas(tests, "removed string, gains_open long, gains_closed long, ratio double, corrected double, p double, low double, high double, odds_ratio double, fisher_p double")
