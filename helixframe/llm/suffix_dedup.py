"""Removal of repeated passages by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte is removed if it is covered by a LENGTH-byte string that also starts in a document with a
smaller id. A transform of the whole corpus fits no machine, so equal windows are brought together first:
 1. Every window of LENGTH bytes selects the K-gram of smallest hash inside it (the leftmost of equal ones), so
    equal windows select the same K-gram. Consecutive windows with one selected place are one segment, and only the
    hash and place of the segment are shuffled. K-grams that one document alone holds are dropped.
 2. The remaining segments are cut out of their texts and grouped by K-gram. All but the first document with
    equal segments lose the whole segment.
 3. The distinct segments of groups with two or more are concatenated; a suffix array by prefix doubling gives
    their transform. Intervals of suffixes with equal prefixes of SEED bytes are expanded backward, one byte a
    step and all intervals of a level at once; intervals with fewer than two suffixes are dropped, and
    the expansion stops at LENGTH. The suffixes of an interval are equal windows; all but those in the interval's
    smallest document are repeats.
K-grams that a part of the texts holds often are spread over many tasks in step 1, and groups of more than
HOT_SEGMENTS segments are refined before step 3: their K-gram grows, level by level, until groups fit a task (see refined).
Exact copies of a text are settled by their hash and take part through their smallest id only.

Cases: null and empty texts have no bytes; texts shorter than LENGTH lose nothing; a text of MOST_BYTES or more is an error; rows with a null id are left as
they are; rows that share an id never remove bytes from each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import BASE, INVERSE, TABLE, U64, Texts, halves, mix, powers
from .common import Scratch, documents, hot_join

LENGTH, K, SEED = 50, 16, 32
PART_BYTES = 1 << 21  # of texts at once; numpy holds some 80 bytes for each
BATCH_BYTES = 1 << 20
SIDE, SIDE_BITS = (LENGTH - K) // 2, 4
BROADCAST_IDS, BROADCAST_TEXTS = 1_000_000, 200_000
HOT_ROWS = 64
PIECE = 16  # members of a segment that are dealt together
HOT_SEGMENTS = 10_000
MOST_BYTES = 1 << 28  # of a text
MARK = -(1 << 63)
SEPARATOR = 255  # no byte of UTF-8


def _segments(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the selected K-gram, text number and place of each segment (see packed)."""
    m = len(texts.data)
    none = np.zeros(0, np.int64)
    if m >= MOST_BYTES:
        raise ValueError(f"a text of {m} bytes; places have room for {MOST_BYTES}")
    if m < LENGTH:
        return none.astype(U64), none, none
    total, back = texts.prefix()
    x = mix((total[K:] - total[:-K]) * back[: m - K + 1])
    a = ((x >> U64(28)) << U64(28)) | np.arange(len(x), dtype=U64)
    for shift in (1, 2, 4, 8, 16):
        a = np.minimum(a[:-shift], a[shift:])
    a = np.minimum(a[:-3], a[3:])  # LENGTH - K + 1 = 35 places
    last = np.repeat(texts.offsets[1:], np.diff(texts.offsets)) - LENGTH
    starts = np.flatnonzero(np.arange(m) <= last)
    chosen = (a[starts] & U64((1 << 28) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1])) if len(chosen) else none
    doc = np.searchsorted(texts.offsets, starts[first], side="right") - 1
    lo, windows = starts[first], np.diff(np.append(first, len(chosen)))
    spot = chosen[first]
    sides = []
    for begin in (spot - SIDE, spot + K):
        begin = np.clip(begin, 0, m - SIDE)
        sides.append((mix((total[begin + SIDE] - total[begin]) * back[begin]) >> U64(64 - SIDE_BITS)).astype(np.int64))
    return x[spot], doc, packed(lo - texts.offsets[doc], spot - lo, windows, *sides)


def packed(lo: np.ndarray, at: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In one value: SIDE_BITS of a hash of the bytes on either side of the K-gram, the first window (31 bits), the place of
    the K-gram after it and the number of windows (6 bits each). The salt stands above bit 52."""
    return (left << (43 + SIDE_BITS)) | (right << 43) | (lo << 12) | (at << 6) | n


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (place >> 12) & ((1 << 31) - 1), (place >> 6) & 63, place & 63


def _shared_side(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows that agree with a row of another document in their K-gram and in one of its sides: a window holds the
    K-gram and SIDE bytes on one side of it at least, so other rows share no window."""
    _, at, n = unpacked(place)
    out = np.zeros(len(h), bool)
    for there, shift in ((at >= SIDE, 43 + SIDE_BITS), (n + LENGTH - 1 - at - K >= SIDE, 43)):
        rows = np.flatnonzero(there)
        side = (place[rows] >> shift) & ((1 << SIDE_BITS) - 1)
        order = np.lexsort((side, h[rows]))
        rows, side = rows[order], side[order]
        if not len(rows):
            continue
        first = np.flatnonzero(np.append(True, (h[rows][1:] != h[rows][:-1]) | (side[1:] != side[:-1])))
        some = np.minimum.reduceat(doc[rows], first) < np.maximum.reduceat(doc[rows], first)
        out[rows] |= np.repeat(some, np.diff(np.append(first, len(rows))))
    return out


def anchors(docs: DataFrame) -> DataFrame:
    """h, doc, place of each segment. K-grams that a part holds HOT_ROWS times go on under many salts (above bit 52 of
    place), with one mark without a salt that tells their other rows that they are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in halves(whole, 1, PART_BYTES):
                h, doc, place = _segments(Texts(b.column(1)))
                ids = b.column(0).to_numpy(zero_copy_only=False)[doc] if len(doc) else doc
                u, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
                hot = count >= HOT_ROWS
                if hot.any():
                    low, high = np.full(len(u), np.iinfo(np.int64).max), np.full(len(u), np.iinfo(np.int64).min)
                    np.minimum.at(low, inverse, ids)
                    np.maximum.at(high, inverse, ids)
                    hot &= low < high
                    rows = np.flatnonzero(hot[inverse])
                    place[rows] |= (1 + rows % 1000) << 52  # 10 bits
                    marks = u[hot]
                    h, ids, place = np.concatenate([h, marks]), np.concatenate([ids, np.full(len(marks), MARK)]), np.concatenate([place, np.zeros(len(marks), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids), pa.array(place)], names=["h", "doc", "place"])

    return docs.select("doc", "text").mapInArrow(run, "h long, doc long, place long")


def repeated(rows: DataFrame) -> DataFrame:
    """Segments whose K-gram two documents or more hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        known = None  # a K-gram already known to be repeated
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            h, doc, place = cols
            if not len(h):
                continue
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            low, high, top = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first), np.maximum.reduceat(place, first)
            # Rows with a mark or a salt have partners in other tasks; of the rest, some side must be shared.
            sure = (low == MARK) | (top >> 52 > 0)
            again = low < high
            if known is not None and h[0] == known:
                sure[0] = True
            sizes = np.diff(np.append(first, len(h)))
            last = first[-1]
            whole_batch = len(first) == 1 and again[0]  # a group longer than a batch goes on as it is
            if whole_batch:
                sure[0] = True
            held, known = None, h[-1] if sure[-1] else None
            keep = np.repeat(sure, sizes)
            keep[:last] |= np.repeat(again, sizes)[:last] & _shared_side(h[:last], doc[:last], place[:last]) if last else False
            if not sure[-1]:
                held = [c[last:] for c in cols]
            keep &= doc != MARK
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(doc[keep]), pa.array(place[keep] & ((1 << 52) - 1))], names=["h", "doc", "place"])
        if held is not None and len(held[0]):
            keep = _shared_side(*held) & (held[1] != MARK)
            yield pa.RecordBatch.from_arrays([pa.array(held[0][keep]), pa.array(held[1][keep]), pa.array(held[2][keep] & ((1 << 52) - 1))], names=["h", "doc", "place"])

    salt = F.shiftright("place", 52)
    return rows.repartition("h", salt).sortWithinPartitions("h").mapInArrow(run, "h long, doc long, place long")


def _cut(rows: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes], pa.Array, pa.Array]]:
    """h, segment, doc, place of the rows (doc, text, segments), a part of the texts at a time."""
    for b in halves(rows, 1, PART_BYTES):
        texts = b.column(1).cast(pa.binary()).to_pylist()
        lists = b.column(2)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(b.num_rows), sizes)
        h, place = (lists.flatten().field(i) for i in range(2))
        lo, _, n = unpacked(place.to_numpy(zero_copy_only=False))
        seg = [texts[i][p : p + m + LENGTH - 1] for i, p, m in zip(text.tolist(), lo.tolist(), n.tolist(), strict=True)]
        yield h, seg, b.column(0).take(pa.array(text)), place


def cut_out(rows: DataFrame) -> DataFrame:
    """rows (doc, text, segments) -> h, segment, doc, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for h, seg, doc, place in _cut(whole):
                yield pa.RecordBatch.from_arrays([h, pa.array(seg, pa.binary()), doc, place], names=["h", "segment", "doc", "place"])

    return rows.select("doc", "text", "segments").mapInArrow(run, "h long, segment binary, doc long, place long")


def cut_out_together(rows: DataFrame) -> DataFrame:
    """rows (doc, text, segments) -> h, segment, members (doc, place): the rows of equal segments of a part of the texts are one row, so
    a segment's bytes are shuffled and looked up once for each part that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for h, seg, doc, place in _cut(whole):
                found: dict[tuple[int, bytes], list[int]] = {}
                for i, key in enumerate(zip(h.to_pylist(), seg, strict=True)):
                    found.setdefault(key, []).append(i)
                order = pa.array([i for same in found.values() for i in same], pa.int64())
                ends = pa.array(np.cumsum([0, *map(len, found.values())]), pa.int32())
                members = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([doc.take(order), place.take(order)], names=["doc", "place"]))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.binary()), members], names=["h", "segment", "members"])

    return rows.select("doc", "text", "segments").mapInArrow(run, "h long, segment binary, members array<struct<doc:long,place:long>>")


def _ranks(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    key = first if second is None else first.astype(np.int64) * (len(first) + 1) + second
    order = np.argsort(key)
    sorted_ = key[order]
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(np.append(False, sorted_[1:] != sorted_[:-1]), dtype=np.int32)
    return out


def _later(rank: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros(len(rank), np.int32)
    out[:-by] = rank[by:] + 1
    return out


def may_repeat(groups: np.ndarray, segments: list[bytes], at: np.ndarray) -> np.ndarray:
    """Which segments can share a window with another of their group: a window holds the K-gram and SIDE bytes on
    one side of it at least, so one of the two sides must be shared."""
    size = np.array([len(s) for s in segments])
    text = np.frombuffer(b"".join(segments), np.uint8)
    total = np.zeros(len(text) + 1, U64)
    np.cumsum(TABLE[text] * powers(BASE, len(text)), out=total[1:])
    back = powers(INVERSE, len(text) + 1)
    anchor = np.cumsum(size) - size + at
    out = np.zeros(len(segments), bool)
    for there, start in ((at >= SIDE, anchor - SIDE), (size - at - K >= SIDE, anchor + K)):
        rows = np.flatnonzero(there)
        side = mix((total[start[rows] + SIDE] - total[start[rows]]) * back[start[rows]])
        _, inverse, count = np.unique(mix(side + groups[rows].view(U64)), return_inverse=True, return_counts=True)
        out[rows] |= count[inverse] > 1
    return out


def smallest_documents(segments: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment number, window and smallest document of every window of LENGTH bytes that two segments hold."""
    sep = bytes([SEPARATOR])
    text = np.frombuffer(sep + sep.join(segments) + sep * LENGTH, np.uint8)
    size = np.array([len(s) for s in segments])
    begin = 1 + np.cumsum(size + 1) - (size + 1)
    n = len(text)
    word = np.zeros(n, U64)
    for k in range(8):
        word[: n - k] |= text[k:].astype(U64) << U64(56 - 8 * k)
    rank = _ranks(word)
    rank = _ranks(rank, _later(rank, 8))
    rank = _ranks(rank, _later(rank, 16))  # SEED bytes
    order = np.argsort(rank.astype(np.int64) * (n + 1) + _later(rank, LENGTH - SEED))  # by LENGTH bytes
    spot = np.empty(n, np.int32)
    spot[order] = np.arange(n, dtype=np.int32)
    bwt = text[order - 1]
    before = spot[order - 1]
    seg = np.repeat(np.arange(len(segments)), size + 1)
    seg = np.concatenate([[0], seg, np.full(n - 1 - len(seg), len(segments) - 1)])
    left = begin[seg] + size[seg] - np.arange(n)

    def groups(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of intervals with two suffixes or more, and the number of each row's interval."""
        new = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1 if len(ids) else new
        return rows[many], number[many]

    rows = np.flatnonzero(left[order] >= SEED)
    rows, ids = groups(rows, rank[order[rows]])
    fresh = np.full(n, -1, np.int64)
    for _ in range(LENGTH - SEED):
        inside = bwt[rows] != SEPARATOR
        rows, ids = rows[inside], ids[inside]
        to = before[rows]
        fresh[to] = ids * 256 + bwt[rows]
        to.sort()
        ids = fresh[to]
        rows, ids = groups(to, ids)
    if not len(rows):
        none = np.zeros(0, np.int64)
        return none, none, none
    place = order[rows]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    least = np.minimum.reduceat(docs[seg[place]], first)
    return seg[place], place - begin[seg[place]], np.repeat(least, np.diff(np.append(first, len(ids))))


def solved(rows: DataFrame) -> DataFrame:
    """rows (h, segment, doc, place) -> doc, a, b: spans of removed bytes."""

    def spans(found: list[tuple[int, bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, docs, place = (np.array([f[i] for f in found], np.int64) for i in (0, 2, 3))
        lo, at, _ = unpacked(place)
        some = np.flatnonzero(may_repeat(h, [f[1] for f in found], at))
        if not len(some):
            return docs[:0], lo[:0], lo[:0]
        docs, lo = docs[some], lo[some]
        seg, window, least = smallest_documents([found[i][1] for i in some.tolist()], docs)
        hit = least < docs[seg]
        start = lo[seg[hit]] + window[hit]
        doc = docs[seg[hit]]
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + LENGTH)) if len(doc) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1 if len(first) else first
        return doc[first], start[first], start[last] + LENGTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple[int, int, int]] = []
        pending: list[tuple[int, bytes, int, int]] = []
        size = 0
        group: list[tuple[int, bytes, int, int]] = []

        def out(parts):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(p[i], np.int64) for p in parts])) for i in range(3)], names=["doc", "a", "b"])

        last, seen_segment = None, None
        for b in batches:
            for h, segment, doc, place in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if h != last:
                    if len(group) > 1:
                        pending += group
                        size += sum(len(g[1]) for g in group)
                    group, last, seen_segment = [], h, None
                if segment != seen_segment:
                    seen_segment, holder = segment, doc
                    group.append((h, segment, doc, place))
                elif doc > holder:
                    lo = (place >> 12) & ((1 << 31) - 1)
                    whole.append((doc, lo, lo + len(segment)))
                else:
                    group.append((h, segment, doc, place))  # the same segment again in the first document
            parts = []
            if whole:
                parts.append(list(zip(*whole, strict=True)))
                whole = []
            if size > BATCH_BYTES:
                parts.append(spans(pending))
                pending, size = [], 0
            if parts:
                yield out(parts)
        if len(group) > 1:
            pending += group
        parts = [list(zip(*whole, strict=True))] if whole else []
        if pending:
            parts.append(spans(pending))
        if parts:
            yield out(parts)

    ordered = rows.repartition("h").sortWithinPartitions("h", "segment", "doc", "place")
    return ordered.select("h", "segment", "doc", "place").mapInArrow(run, "doc long, a long, b long")


def _halves() -> Column:
    """The two parts of a segment whose windows hold, beside the core [at, at + size), the `side` bytes before it or after it."""
    last, side, at, size = F.octet_length("segment") - LENGTH, F.col("side"), F.col("at"), F.col("size")
    end = F.least(last, at - side)
    left = F.struct(F.lit(0).alias("a"), end.alias("b"), (at - side).alias("at"), F.xxhash64("h", F.lit(0), F.substring("segment", at - side + 1, side)).alias("h"))
    begin = F.greatest(F.lit(0), at - side + 1)
    right = F.struct(begin.alias("a"), last.alias("b"), at.alias("at"), F.xxhash64("h", F.lit(1), F.substring("segment", at + size + 1, side)).alias("h"))
    return F.filter(F.array(left, right), lambda x: x["a"] <= x["b"])


def refined(rows: DataFrame, scratch: Scratch, hot_segments: int) -> tuple[DataFrame, list[DataFrame]]:
    """Groups of any size (rows of cut_out_together), cut down to groups that solved() takes: the rows left (h, segment, doc, place)
    and the spans (doc, a, b) settled on the way.

    Equal segments of a group are settled first: all but the smallest document lose them, and only that one's goes on. A window of LENGTH bytes
    holds, beside what all of a group share (at first the K-gram), half of the missing bytes or more on one side; so the key of a group that is
    still too long grows by that side, and keys that one document alone holds are dropped. The missing bytes halve from level to level, and with
    none missing a group is one window, which is settled as equal segments are.
    """
    rows = scratch.save(rows, "hot-segments")
    ids, keys = F.col("members.doc"), ["h", "segment"]
    first = rows.groupBy(*keys).agg(F.min(F.array_min(ids)).alias("holder"), F.max(F.array_max(ids)).alias("most"), F.count("*").alias("__c"))
    first = scratch.save(first.filter((F.col("holder") < F.col("most")) | (F.col("__c") > HOT_ROWS)).drop("most"), "hot-holders")
    held = scratch.save(hot_join(rows, first, keys, HOT_ROWS, "left", BROADCAST_TEXTS).withColumn("n", F.octet_length("segment")), "hot-held")
    scratch.drop("hot-segments")
    scratch.drop("hot-holders")
    spans = [scratch.save(later(held), "hot-spans")]
    own = F.filter("members", lambda m: F.col("holder").isNull() | (m["doc"] == F.col("holder")))
    lo, at = F.shiftright("m.place", 12).bitwiseAND(F.lit((1 << 31) - 1)).cast("long"), F.shiftright("m.place", 6).bitwiseAND(F.lit(63)).cast("int")
    now = scratch.save(held.select("h", "segment", F.explode(own).alias("m")).select("h", "segment", "m.doc", lo.alias("lo"), at.alias("at"), at.alias("gram")), "hot-0")
    scratch.drop("hot-held")
    done, size, level = None, K, 0
    while True:
        missing = LENGTH - size
        side = -(-missing // 2)
        level += 1
        parts = now.withColumns({"size": F.lit(size), "side": F.lit(side)})
        parts = parts.select("segment", "doc", "lo", "gram", F.explode(_halves()).alias("x"))
        start = F.col("x.a")
        parts = parts.select("x.h", F.substring("segment", start + 1, F.col("x.b") - start + LENGTH).alias("segment"), "doc", (F.col("lo") + start).alias("lo"), (F.col("x.at") - start).cast("int").alias("at"), (F.col("gram") - start).cast("int").alias("gram"))
        parts = scratch.save(parts, f"hot-parts-{level}")
        scratch.drop(f"hot-{level - 1}")
        same = scratch.save(parts.groupBy(*keys).agg(F.min("doc").alias("holder"), F.max("doc").alias("most"), F.count("*").alias("__c")), f"hot-same-{level}")
        shared = same.groupBy("h").agg(F.min("holder").alias("low"), F.max("most").alias("high"), F.count("*").alias("n"), F.sum("__c").alias("__c")).filter("low < high")
        shared = scratch.save(shared.select("h", (F.col("n") > hot_segments).alias("hot"), (F.col("n") > 1).alias("several"), "__c"), f"hot-shared-{level}")
        again = same.filter("holder < most").drop("most")
        parts = scratch.save(hot_join(hot_join(parts, again, keys, HOT_ROWS, "left", BROADCAST_TEXTS), shared, ["h"], HOT_ROWS), f"hot-known-{level}")
        for name in ("parts", "same", "shared"):
            scratch.drop(f"hot-{name}-{level}")
        size += side
        repeats = parts.filter("holder < doc")
        spans.append(repeats.select("doc", F.col("lo").alias("a"), (F.col("lo") + F.octet_length("segment")).alias("b")))
        rest = parts.filter("several and (holder is null or holder >= doc)")
        place = F.shiftleft("lo", 12).bitwiseOR(F.shiftleft(F.col("gram").cast("long"), 6)).bitwiseOR((F.octet_length("segment") - LENGTH + 1).cast("long"))
        small = rest.filter("not hot").select("h", "segment", "doc", place.alias("place"))
        done = small if done is None else done.unionByName(small)
        now = scratch.save(rest.filter("hot").select("h", "segment", "doc", "lo", "at", "gram"), f"hot-{level}") if size < LENGTH else None
        if now is None or now.isEmpty():
            return done, spans


def later(held: DataFrame) -> DataFrame:
    """doc, a, b of the members after the holder of their segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            doc, place = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
            holder, n = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), sizes) for i in (1, 2))
            lo = unpacked(place)[0]
            gone = doc > holder
            yield pa.RecordBatch.from_arrays([pa.array(x[gone].astype(np.int64)) for x in (doc, lo, lo + n)], names=["doc", "a", "b"])

    # Rows hold many members or few: cut into pieces that are dealt by their content, so that each task gets its share of copies.
    pieces = F.transform(F.sequence(F.lit(0), F.expr(f"(size(members) - 1) div {PIECE}").cast("int")), lambda i: F.slice("members", i * PIECE + 1, F.lit(PIECE)))
    rows = held.filter("holder is not null").select(F.explode(pieces).alias("members"), "holder", "n")
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), held.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts, F.xxhash64("members")).mapInArrow(run, "doc long, a long, b long")


def finished(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, spans, copy) -> the text's bytes without the spans; copy: the whole text repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans, copy in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = text or b""
                if copy:
                    merged = [(0, len(data))] if len(data) >= LENGTH else []
                else:
                    merged = []
                    for s in sorted((s["a"], s["b"]) for s in spans or ()):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]))
                        else:
                            merged.append(s)
                edges = [0, *[x for s in merged for x in s], len(data)]
                kept = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.select("doc_id", "text", "spans", "copy").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = texts.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.octet_length("text").alias("m")).filter(f"doc_id is not null and m >= {LENGTH}")
    slim = scratch.save(slim, "slim")
    firsts = slim.groupBy("t1", "t2", "m").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).filter("c > 1")
    copies = scratch.save(slim.join(firsts, ["t1", "t2", "m"]).filter("doc_id > first").select(F.col("doc_id").alias("doc"), "t1").distinct(), "copies")

    # Few ids of copies are sent to the texts; beyond BROADCAST_IDS the texts are shuffled to them.
    gone = copies.select("doc").distinct()
    gone = F.broadcast(gone) if copies.count() <= BROADCAST_IDS else gone
    named = texts.filter("doc_id is not null").withColumnRenamed("doc_id", "doc").join(gone, "doc", "left_anti")
    again = scratch.save(repeated(anchors(named)), "repeated")
    # Groups too long for one task are few (their number is checked before they are broadcast).
    hot = scratch.save(again.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > HOT_SEGMENTS).select("h"), "hot")
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot

    def segments(rows: DataFrame) -> DataFrame:
        return named.join(rows.groupBy("doc").agg(F.collect_set(F.struct("h", "place")).alias("segments")), "doc")

    if n_hot:
        # Marked in one lookup and written, so that no join makes the rows of hot groups alone.
        marked = again.join(hot.withColumn("hot", F.lit(1)), "h", "left").select("h", "doc", "place", F.coalesce("hot", F.lit(0)).alias("hot"))
        marked = scratch.save(marked, "marked")
        scratch.drop("repeated")
        cold, hots = (segments(marked.filter(F.col("hot") == i)) for i in (0, 1))
        small, parts = refined(cut_out_together(hots), scratch, HOT_SEGMENTS)
        # Cut out first and written, so the shuffled texts are gone when the segments are shuffled.
        cold = scratch.save(cut_out(cold), "cold")
        scratch.drop("marked")
        spans = solved(cold).unionByName(solved(small))
        for part in parts:
            spans = spans.unionByName(part)
    else:
        cold = scratch.save(cut_out(segments(again)), "cold")
        scratch.drop("repeated")
        spans = solved(cold)
    spans = scratch.save(spans, "spans")
    for name in ("cold", "hot", "hot-spans", *(f"hot-known-{k}" for k in range(1, 9))):
        scratch.drop(name)

    per = spans.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    marks = copies.groupBy("doc", "t1").agg(F.lit(True).alias("copy"))
    rows = texts.withColumn("__t", F.xxhash64("text")).join(per, F.col("doc_id") == F.col("doc"), "left").drop("doc")
    rows = rows.join(marks, (F.col("doc_id") == F.col("doc")) & (F.col("__t") == F.col("t1")), "left")
    return finished(rows.withColumn("copy", F.coalesce("copy", F.lit(False))))


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
