"""Local units and duplicated cores on the test tables (no SQL: their rules depend on order)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import units as U
from ..session import table
from .registry import query

#: Rules for records of up to some 2,500 days instead of bases.
DAYS = U.UnitRules(exons=4, min_span=600, max_compact_span=1500, max_span=1800, partial_exons=3, weak_exons=2, attach_bp=50, fused_span=2300)


@query("p07_local_units")
def local_units(spark, d):
    """Orders as records: their line items are exons, each from its ship day on for as many days as its quantity."""
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400).cast("long")
    li = table(spark, d, "lineitem").select("l_orderkey", day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))
    exons = I.union_touching(li, ["l_orderkey"], "s", "e").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("exons"))
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("assembly"), F.col("o_orderpriority").alias("chrom"), F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand"))
    records = o.join(exons, F.col("o_orderkey") == F.col("l_orderkey"))
    records = records.select("assembly", "chrom", "strand", F.col("o_orderkey").cast("string").alias("name"), F.col("exons")[0]["s"].alias("s"), F.element_at("exons", -1)["e"].alias("e"), "exons")
    return U.local_units(records, "assembly", DAYS)


@query("p09_duplicated_cores")
def duplicated_cores(spark, d):
    """Orders of a customer as genes of a haplotype of forty days, its line items as aligned spans."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(F.unix_timestamp("o_orderdate") / 86400).cast("long").alias("gs"))
    genes = o.select("o_custkey", F.col("o_orderkey").alias("gene"), "gs", (F.col("gs") + 40).alias("ge"))
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400).cast("long")
    li = table(spark, d, "lineitem").join(o.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    spans = li.select("o_custkey", day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"), (1 - F.col("l_discount")).cast("double").alias("identity"))
    return U.duplicated_cores(genes, spans, "o_custkey", 0.5, 10)
