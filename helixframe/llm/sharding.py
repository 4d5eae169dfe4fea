"""Sharding by a k-d tree over document metadata.

A node of k shards is cut along its widest metadata dimension at the weighted median
(the quantile floor(k/2)/k of bytes), until each leaf is one shard of about the target
bytes. The median is found by distributed histograms: four rounds of BINS equal-width
bins over (dimension value, hash) keys, each round zooming into the bin that holds
the target weight; all nodes of a level share a job. What reaches the driver is one row
for each node, and what is broadcast is one row for each cut: both are bounded by the
number of shards, never by the documents.

Dimensions: log of the size in bytes, source, language and id, each scaled to [0, 1] over
the corpus, so that widths compare. Equal values are told apart by a hash of the row.

Cases: null texts have 16 bytes; null dimension values share one place and null ids count as 0; repeated rows
have one key, so they share a shard; an empty table gives no rows;
shards may be empty when there are fewer documents than shards. Ties of a cut go by the order keys, slots by doc_id, then text_crc32. Texts
of any length count by their bytes alone. write_shards keeps all columns of the caller; its own get underscores where a name is taken.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, free_name, if_small

BINS = 4096
ROUNDS = 4
OVERHEAD = 16
SLOT_ROWS = 50_000
#: Order keys have 30 bits of the dimension's value and 32 bits of a hash of the row.
SCALE, HASH_BITS = (1 << 30) - 1, 32


def _spot(c: Column) -> Column:
    """Place of a categorical value in [0, 1]."""
    return F.pmod(F.xxhash64(c), F.lit(1 << 20)) / F.lit(float((1 << 20) - 1))


def dimensions(df: DataFrame) -> dict[str, Column]:
    return {"__d0": F.log2(F.col("size").cast("double")), "__d1": _spot(F.col("source")), "__d2": _spot(F.col("lang")), "__d3": F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))}


def _small(spark, columns: dict[str, list], kinds: dict[str, pa.DataType]) -> DataFrame:
    """A table of a row for each node (an Arrow table becomes a local relation, so no job runs for it)."""
    return F.broadcast(spark.createDataFrame(pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()})))


def _nodes(spark, rows: list[tuple], names: str) -> DataFrame:
    kinds = {"__node": pa.int32(), "at": pa.int32(), "lo": pa.int64(), "step": pa.int64(), "want": pa.float64(), "cut": pa.int64(), "right": pa.int32()}
    return _small(spark, {n: [r[i] for r in rows] for i, n in enumerate(names.split())}, kinds)


def shard_tree(slim: DataFrame, dims: list[str], n_shards: int, scratch: Scratch) -> tuple[DataFrame, list[list[tuple[int, int, int, int]]]]:
    """slim (size, one long order key per dimension) plus __node, the shard; and the cuts of each level
    (node, dimension, key, first shard on the right). Every level is a table, so a job reads one table and joins one list of nodes."""
    spark = slim.sparkSession
    out = slim.withColumn("__node", F.lit(0))
    nodes = {0: n_shards}
    levels: list[list[tuple[int, int, int, int]]] = []
    while any(k > 1 for k in nodes.values()):
        extent = out.groupBy("__node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
        zoom = []
        for r in extent.collect():
            k = nodes[r["__node"]]
            if k > 1:
                at = max(range(len(dims)), key=lambda i: r[f"hi{dims[i]}"] - r[f"lo{dims[i]}"])
                lo, hi = r[f"lo{dims[at]}"], r[f"hi{dims[at]}"]
                zoom.append((r["__node"], at, lo, hi - lo + 1, float(r["w"]) * (k // 2) / k))
        got = {}
        for _ in range(ROUNDS):
            cut = out.join(_nodes(spark, [(n, at, lo, -(-width // BINS), want) for n, at, lo, width, want in zoom], "__node at lo step want"), "__node")
            key = F.array(*dims)[F.col("at")]
            bins = (
                cut.select("__node", "size", "want", F.floor((key - F.col("lo")) / F.col("step")).alias("bin"))
                .filter(f"bin between 0 and {BINS - 1}")
                .groupBy("__node", "want", "bin")
                .agg(F.sum("size").alias("w"))
            )
            before = F.coalesce(F.sum("w").over(Window.partitionBy("__node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            found = bins.withColumn("before", before).filter("before + w > want").groupBy("__node").agg(F.min_by(F.struct("bin", "before", "w"), "bin").alias("b")).collect()
            got = {r["__node"]: r["b"] for r in found}
            # Weights that lie below the zoomed bin are taken off what is still wanted.
            zoom = [(n, at, lo + got[n]["bin"] * -(-width // BINS), -(-width // BINS), want - got[n]["before"]) if n in got else (n, at, lo + width, 1, want) for n, at, lo, width, want in zoom]
        cuts = []
        for n, at, lo, width, want in zoom:
            # The last bin holds few rows or one: it goes to the side that is nearer to the target.
            left = n in got and 2 * want >= got[n]["w"]
            cuts.append((n, at, lo + (width if left else 0), n + nodes[n] // 2))
        levels.append(cuts)
        out = (
            out.join(_nodes(spark, cuts, "__node at cut right"), "__node", "left")
            .withColumn("__node", F.when(F.array(*dims)[F.col("at")] >= F.col("cut"), F.col("right")).otherwise(F.col("__node")))
            .drop("at", "cut", "right")
        )
        out = scratch.save(out, f"level{len(levels)}")
        if len(levels) > 1:
            scratch.drop(f"level{len(levels) - 1}")
        nodes = {m: k for n, c in nodes.items() for m, k in (((n, c // 2), (n + c // 2, c - c // 2)) if c > 1 else ((n, c),))}
    return out, levels


def order_keys(sized: DataFrame, names: list[str], facts) -> dict[str, Column]:
    """One long order key for each dimension: SCALE steps of its value, then a hash of the row."""
    tie = F.xxhash64("doc_id", "text_crc32", "size").bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    keys = {}
    for c in names:
        lo, hi = facts[f"lo{c}"] or 0.0, facts[f"hi{c}"] or 0.0
        place = (F.col(c) - F.lit(lo)) / F.lit((hi - lo) or 1.0)
        keys[c] = F.shiftleft((place * SCALE).cast("long"), HASH_BITS) + tie
    return keys


def shard(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; give n_shards, or target_bytes for a leaf."""
    scratch = Scratch(docs.sparkSession, "sharding")
    filled = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", "source", "lang", (F.octet_length(filled) + OVERHEAD).cast("long").alias("size"), F.crc32(filled).alias("text_crc32"))
    sized = scratch.save(sized.withColumns(dimensions(sized)), "sized")
    names = [c for c in sized.columns if c.startswith("__d")]
    facts = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), *[f(c).alias(f"{n}{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if n_shards is None:
        n_shards = max(1, -(-int(facts["total"]) // int(target_bytes)))
    keys = order_keys(sized, names, facts)
    slim = scratch.save(sized.select("doc_id", "size", "text_crc32", *[k.alias(c) for c, k in keys.items()]), "slim")
    scratch.drop("sized")
    placed, levels = shard_tree(slim, names, n_shards, scratch)
    if levels:
        scratch.drop("slim")
    placed = placed.select("doc_id", "size", "text_crc32", F.col("__node").alias("shard"))

    # Slots: a rank inside one of the groups of the shard, of some SLOT_ROWS rows each, after the rows of the groups before it.
    groups = placed.groupBy("shard").agg(F.ceil(F.count("*") / SLOT_ROWS).cast("int").alias("__n"))
    grouped = placed.join(F.broadcast(groups), "shard").withColumn("__g", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("__n")).cast("int")).drop("__n")
    before = Window.partitionBy("shard").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.groupBy("shard", "__g").agg(F.count("*").alias("n")).select("shard", "__g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    starts = if_small(scratch.save(starts, "starts"))
    rank = F.row_number().over(Window.partitionBy("shard", "__g").orderBy("doc_id", "text_crc32"))
    return grouped.join(starts, ["shard", "__g"]).withColumn("slot", (F.col("__from") + rank - 1).cast("long")).drop("__g", "__from")


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """The documents themselves, one folder for each shard, in slot order."""
    placed = shard(docs, **how).select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), "shard", "slot").dropDuplicates(["__id", "__crc"])
    shard_name, slot_name = free_name(docs, "shard"), free_name(docs, "slot")
    wide = docs.select(F.struct("*").alias("__row"))
    crc = F.crc32(F.coalesce(F.col("__row.text"), F.lit("")))
    joined = wide.join(placed, F.col("__row.doc_id").eqNullSafe(F.col("__id")) & (crc == F.col("__crc"))).select("__row.*", F.col("shard").alias(shard_name), F.col("slot").alias(slot_name))
    joined.repartition(shard_name).sortWithinPartitions(shard_name, slot_name).write.partitionBy(shard_name).parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
