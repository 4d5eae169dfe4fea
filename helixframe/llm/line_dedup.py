"""Line dedup by levelled sorted runs of line hashes (DataFrame functions only).

A run is a Parquet table of (h1, h2, n_docs) sorted by the 128-bit hash of the
line key. Each batch of documents merge-anti-joins the keys that the runs have
already settled (found in min_docs documents or more) and adds the rest as a run of
its own at level 0; `fanout` runs of one level are merged into one run of the next,
so a key is rewritten O(log batches) times.

Keys whose hash the runs settle lose all their lines. To find those lines without
gathering a hot line in one task, the hits are looked up in two ways: keys with at
least total/HEAVY_KEYS of all key rows (there can be no more than HEAVY_KEYS of them)
are broadcast, all others meet the lines in a shuffled join.

Cases: a null or empty text is one empty line, and empty keys are never dropped; rows
with a null doc_id are documents like any other; repeated rows count as documents of
their own; a very long text is split whole, row by row; ties can't arise, as all lines of a key stay or go; an empty table gives an empty result; other columns are carried through, and a new column whose name is
taken gets underscores after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, Scratch, ascii_lower, free_name, let

HEAVY_KEYS = 20_000
KEY = ["__h1", "__h2"]
KEPT = "__kept"


def line_keys(text: Column) -> Column:
    """The key of each line, in order: stripped, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)))


def hashed(df: DataFrame, key: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != key], F.xxhash64(key).alias("__h1"), F.xxhash64(F.lit(1), key).alias("__h2"))


class LineRuns:
    """Levels of sorted runs of line-key hashes with the number of documents that hold each."""

    def __init__(self, scratch: Scratch, min_docs: int, fanout: int = 2):
        self.scratch, self.min_docs, self.fanout = scratch, min_docs, fanout
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.made = 0

    def _write(self, counts: DataFrame) -> tuple[str, DataFrame]:
        self.made += 1
        name = f"run{self.made}"
        return name, self.scratch.save(counts.repartition(*KEY).sortWithinPartitions(*KEY), name)

    def merged(self) -> DataFrame | None:
        runs = [df for level in self.levels for _, df in level]
        if not runs:
            return None
        out = runs[0]
        for df in runs[1:]:
            out = out.unionByName(df)
        return out.groupBy(*KEY).agg(F.sum("__n").alias("__n"))

    def settled(self) -> DataFrame | None:
        """Keys that min_docs documents or more are known to hold."""
        merged = self.merged()
        return None if merged is None else merged.filter(F.col("__n") >= self.min_docs)

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n) of one batch of documents."""
        settled = self.settled()
        fresh = batch if settled is None else batch.join(settled.hint("merge"), KEY, "left_anti")
        run, level = self._write(fresh.groupBy(*KEY).agg(F.sum("__n").alias("__n"))), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            old = self.levels[level]
            both = old[0][1]
            for _, df in old[1:]:
                both = both.unionByName(df)
            run = self._write(both.groupBy(*KEY).agg(F.sum("__n").alias("__n")))
            for name, _ in old:
                self.scratch.drop(name)
            self.levels[level] = []
            level += 1

    def drop(self) -> None:
        for level in self.levels:
            for name, _ in level:
                self.scratch.drop(name)
        self.levels = []


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs (doc_id, text, ...) plus __n_lines, __n_dropped and __kept, the text without the lines
    whose key min_docs documents or more hold. New names are free_name() of these."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    slim = docs.select("doc_id", F.xxhash64("text").alias("__th"), "text")

    # One scan: distinct keys of each document, counted per batch of documents before any shuffle.
    keys = slim.select(
        F.pmod(F.xxhash64("doc_id", "__th"), F.lit(batches)).cast("int").alias("__b"),
        F.explode(F.array_distinct(line_keys(F.col("text")))).alias("__k"),
    ).filter("__k <> ''")
    spool = scratch.save(hashed(keys, "__k").groupBy("__b", *KEY).agg(F.count("*").alias("__n")), "spool", "__b")

    runs = LineRuns(scratch, min_docs, fanout)
    for b in range(batches):
        runs.add(spool.filter(F.col("__b") == b).select(*KEY, "__n"))
    frequent = scratch.save(runs.settled().select(*KEY), "frequent")

    total = spool.agg(F.sum("__n")).first()[0] or 0
    heavy_from = max(min_docs, -(-total // HEAVY_KEYS))
    heavy = spool.groupBy(*KEY).agg(F.sum("__n").alias("__n")).filter(F.col("__n") >= heavy_from).select(*KEY)
    heavy = scratch.save(heavy, "heavy")
    runs.drop()
    scratch.drop("spool")
    light = frequent.join(heavy, KEY, "left_anti")

    lines = slim.select("doc_id", "__th", F.posexplode(line_keys(F.col("text"))).alias("__i", "__k")).filter("__k <> ''")
    lines = hashed(lines, "__k").join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), KEY, "left")
    # A line settled by the broadcast needs no partner: it goes on under a key of its own, evenly spread.
    lines = lines.withColumn("__h1", F.when(F.col("__heavy"), F.xxhash64("__h1", "doc_id", "__th", "__i")).otherwise(F.col("__h1")))
    hits = lines.join(light.withColumn("__light", F.lit(True)), KEY, "left").filter("__heavy or __light")
    hits = hits.groupBy("doc_id", "__th").agg(F.collect_set("__i").alias("__drop"))
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("__th").alias("__th2"), "__drop")

    # The caller's columns travel as one struct, so that no name can clash.
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    same = F.col("__row.doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("__row.text") == F.col("__th2"))
    joined = wide.join(hits, same, "left").withColumn("__drop", F.coalesce("__drop", F.array().cast("array<int>")))
    lines_of = F.split(F.coalesce(F.col("__row.text"), F.lit("")), "\n")
    out = joined.withColumn(
        "__x",
        let(
            F.struct(lines_of.alias("l"), F.col("__drop").alias("d")),
            lambda v: F.struct(
                F.size(v["l"]).cast("long").alias("n"),
                F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(v["l"]) - 1), v["d"]), lambda i: F.get(v["l"], i)), "\n").alias("kept"),
            ),
        ),
    )
    new = {"__n_lines": F.col("__x.n"), "__n_dropped": F.size("__drop").cast("long"), KEPT: F.col("__x.kept")}
    return out.select("__row.*", *[c.alias(free_name(docs, name)) for name, c in new.items()])


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    out = drop_frequent_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


_LINES = """
 lines AS (SELECT doc_id, i, l, regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS k
  FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}))),
 frequent AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)"""

OP4_SQL = f"""WITH {_LINES.format(docs='documents')}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (SELECT k FROM frequent)) AS n_dropped,
 sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM frequent)), '')) AS kept_sha256
FROM lines GROUP BY doc_id"""
