"""Operators on sequences kept as strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import reverse_complement


MATRIX_SIZE = 20_000


def canonical_kmers(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """key, kmer: distinct k-mers, each the smaller of itself and its reverse complement; windows with other letters are left out."""
    spots = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - k + 1)).otherwise(F.array().cast("array<int>"))
    windows = df.select(key, F.explode(F.transform(spots, lambda i: F.substring(F.col(seq), i, F.lit(k)))).alias("w"))
    plain = windows.filter(F.col("w").rlike("^[ACGT]+$"))
    return plain.select(key, F.least("w", reverse_complement(F.col("w"))).alias("kmer")).distinct()


def drop_ubiquitous(kmers: DataFrame, key: str, share: float) -> DataFrame:
    """K-mers of at most `share` of the sequences."""
    n = kmers.select(key).distinct().agg(F.count("*").alias("__n"))
    common = kmers.groupBy("kmer").agg(F.count("*").alias("__c")).crossJoin(F.broadcast(n)).filter(F.col("__c") <= share * F.col("__n")).select("kmer")
    return kmers.join(common, "kmer")


def mash_pairs(kmers: DataFrame, key: str, k: int) -> DataFrame:
    """a, b, jaccard, mash of all pairs of sequences (a distance matrix; more than MATRIX_SIZE sequences are an error); pairs
    without a shared k-mer get the largest finite distance."""
    sizes = kmers.groupBy(key).agg(F.count("*").alias("n"))
    if sizes.limit(MATRIX_SIZE + 1).count() > MATRIX_SIZE:
        raise ValueError(f"a matrix of more than {MATRIX_SIZE} sequences")
    a, b = kmers.select(F.col(key).alias("a"), "kmer"), kmers.select(F.col(key).alias("b"), "kmer")
    shared = a.join(b, "kmer").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    spine = sizes.select(F.col(key).alias("a"), F.col("n").alias("na")).join(sizes.select(F.col(key).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    pairs = spine.join(shared, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    j = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    pairs = pairs.withColumn("jaccard", j).withColumn("raw", F.when(F.col("both") > 0, F.greatest(F.lit(0.0), -F.log(2 * j / (1 + j)) / k)))
    top = pairs.agg(F.max("raw").alias("top"))
    return pairs.crossJoin(F.broadcast(top)).select("a", "b", "jaccard", F.coalesce("raw", "top").alias("mash"))


def patched(df: DataFrame, patches: DataFrame, key: str, seq: str, pos: str, base: str) -> DataFrame:
    """df plus patched: the sequence with the bases of its patches (1-based positions) put in."""
    entries = patches.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(pos, base))).alias("__p"))
    joined = df.join(entries, key, "left")
    chars = F.transform(F.split(seq, ""), lambda c, i: F.coalesce(F.try_element_at(F.col("__p"), i + 1), c))
    return joined.withColumn("patched", F.coalesce(F.array_join(chars, ""), F.col(seq))).drop("__p")


def columns_of(df: DataFrame, key: str, group: str, seq: str, references: list) -> DataFrame:
    """key, group, pos (1-based), base of aligned sequences, of all columns that every reference sequence (by key) has; other columns
    have no reference base and so no result. Sequences that are shorter lack the later columns."""
    lengths = df.filter(F.col(key).isin(references)).groupBy(key).agg(F.max(F.length(seq)).alias("n")).collect()  # a row a reference
    width = min((r["n"] or 0 for r in lengths), default=0) if len(lengths) == len(references) else 0
    letters = F.substring(seq, 1, width)
    return df.select(key, group, F.posexplode(F.split(letters, "")).alias("p", "base")).filter("base <> ''").select(key, group, (F.col("p") + 1).alias("pos"), "base")


def variable_sites(columns: DataFrame, group: str, reference: Column, gap: str = "-") -> DataFrame:
    """pos, ref, alt, alt_count, n of alignment columns with more than one base; alt is the commonest other base, the
    smaller letter on ties. `reference` tells which rows hold the reference base."""
    ref = columns.filter(reference).groupBy("pos").agg(F.max("base").alias("ref"))
    counts = columns.groupBy("pos", "base").agg(F.count("*").alias("c")).join(ref, "pos")
    total = counts.groupBy("pos").agg(F.sum("c").alias("n"))
    other = counts.filter((F.col("base") != F.col("ref")) & (F.col("base") != gap))
    best = other.groupBy("pos", "ref").agg(F.min_by(F.struct("base", "c"), F.struct(-F.col("c"), F.col("base"))).alias("x"))
    return best.join(total, "pos").select("pos", "ref", F.col("x.base").alias("alt"), F.col("x.c").alias("alt_count"), "n")
