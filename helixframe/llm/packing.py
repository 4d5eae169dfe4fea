"""Best-fit packing of token sequences by large-item matching.

Pieces matter to the plan by their length only, so the plan is made on the number of
pieces of each length (at most `capacity` counts, whatever the size of the corpus):
pieces above a third of the capacity are matched greedily, the longest with the longest
that still fits, so two at most share a bin; the others, longest first, go to the
smallest gap that takes them, or open new bins. The plan is a list of segments: ranks
[first, last] of one length take one place in consecutive bins. Every piece then finds
its place by its rank among the pieces of its length, without any row leaving the executors.

The plan holds at most three bin classes for each length and `capacity` items in a class,
which bounds what is broadcast.

Cases: a null or empty text is a document of the end id alone; rows with null ids are packed
like others; repeated rows are packed as often as they occur; unequal texts of one id are documents of their own; pieces of equal length are ranked
by doc_id, piece and start (a tie changes places, never lengths); a very long text is encoded whole in one task, then cut. Only doc_id and text are read, so
other columns can't clash, and none is returned; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, documents

CAPACITY, END_ID = 1024, 2
RANK_ROWS = 50_000

class Encoder:
    """ids of whole texts as the tokenizer file gives them.

    Where the same vocabulary is at hand as a rank file, texts without special tokens take the faster
    library for rank files; it gives the same ids (tests compare them).
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not (self.special and self.special.search(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(*files) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    if files not in _ENCODERS:
        _ENCODERS[files] = Encoder(*files)
    return _ENCODERS[files]


def tokenizer_files(tokenizer: str | None = None) -> tuple:
    """The arguments of encoder(): a tokenizer file, by default the public one with its rank file and pattern."""
    if tokenizer is not None:
        return (tokenizer,)
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document; keep_ids adds the ids themselves."""
    files = tokenizer_files(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files).ids
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out: dict[str, list] = defaultdict(list)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4", copy=False)
                    n = len(ids)
                    # Whole pieces are counted from the end, so only the first may be shorter.
                    ends = [*range(n % capacity or capacity, n + 1, capacity)]
                    for k, end in enumerate(ends):
                        start = ends[k - 1] if k else 0
                        part = ids[start:end]
                        for name, v in (("doc_id", doc), ("piece", k), ("start", start), ("length", end - start), ("ids_crc32", zlib.crc32(part.tobytes()))):
                            out[name].append(v)
                        if keep_ids:
                            out["ids"].append(part.astype(np.int32))
                kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if keep_ids else {})
                yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in kinds.items()], names=list(kinds))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + (", ids array<int>" if keep_ids else ""))


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of bins, lengths in each) for the counts of pieces by length."""
    left = {n: c for n, c in counts.items() if c}
    bins: list[tuple[int, tuple[int, ...]]] = []
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for m in [m for m in large if m <= min(n, capacity - n)]:
            if not left[n]:
                break
            take = left[n] // 2 if m == n else min(left[n], left[m])
            if take:
                bins.append((take, (n, m)))
                left[n] -= take
                left[m] -= take
        if left[n]:
            bins.append((left[n], (n,)))
            left[n] = 0
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for c, items in bins:
        gaps[capacity - sum(items)].append((c, items))
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[n]
        for gap in sorted(g for g in gaps if g >= n):
            fits = gap // n
            classes = gaps.pop(gap)
            for b, items in classes:
                full = min(b, c // fits)
                if full:
                    gaps[gap - fits * n].append((full, items + (n,) * fits))
                    c, b = c - full * fits, b - full
                if b and c:
                    # fewer than `fits` are left: they share one bin
                    gaps[gap - n * c].append((1, items + (n,) * c))
                    c, b = 0, b - 1
                if b:
                    gaps[gap].append((b, items))
            if not c:
                break
        if c:
            fits = capacity // n
            full, rest = divmod(c, fits)
            if full:
                gaps[capacity - fits * n].append((full, (n,) * fits))
            if rest:
                gaps[capacity - rest * n].append((1, (n,) * rest))
    return [x for classes in gaps.values() for x in classes]




def segments(bins: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): one for each place in each class of bins."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, items in bins:
        offset = 0
        for n in items:
            out.append((n, used[n], used[n] + count - 1, sequence, offset))
            used[n] += count
            offset += n
        sequence += count
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, start, length, ...) plus sequence_id and offset."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = segments(plan_bins(counts, capacity)) or [(0, 0, 0, 0, 0)]
    names = ("length", "__r0", "__r1", "__s0", "offset")
    plan = spark.createDataFrame(pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, zip(*plan, strict=True), strict=True)}))
    # A rank inside one of the groups of the length, of some RANK_ROWS pieces each, after the pieces of the groups before it.
    sizes = {"length": list(counts) or [0], "__n": [-(-n // RANK_ROWS) for n in counts.values()] or [1]}
    grouped = parts.join(F.broadcast(spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in sizes.items()}))), "length")
    grouped = grouped.withColumn("__g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("__n"))).drop("__n")
    before = Window.partitionBy("length").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.groupBy("length", "__g").agg(F.count("*").alias("n")).select("length", "__g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    rank = F.row_number().over(Window.partitionBy("length", "__g").orderBy("doc_id", "piece", "start"))
    few = sum(sizes["__n"]) <= BROADCAST_ROWS
    ranked = grouped.join(F.broadcast(starts) if few else starts, ["length", "__g"]).withColumn("__r", F.col("__from") + rank - 1)
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & F.col("__r").between(F.col("__r0"), F.col("__r1"))).drop(plan["length"])
    return placed.withColumn("sequence_id", F.col("__s0") + F.col("__r") - F.col("__r0")).drop("__g", "__from", "__r", "__r0", "__r1", "__s0")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.save(pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces"), capacity)


COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir)).select(*COLUMNS)
