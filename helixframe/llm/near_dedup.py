"""MinHash near-dedup by a multi-index Hamming join.

Every text has a signature of VALUES 16-bit minhashes. Two texts are candidates if their
signatures differ in at most 2 * chunks - 1 places. The signature is split into chunks; by the pigeonhole
principle such a pair has a chunk with at most one error, so a key for each chunk and each place that
may be wrong (the place left out) brings every such pair together. The number of chunks follows
from the similarity: at 0.85 a value differs with probability 0.15, and 13 chunks miss a pair with a
probability below 1e-6. Links are confirmed on the full shingle sets.

No group is compared pair by pair:
 1. texts with equal shingle sets are one node (their smallest id);
 2. in every bucket of a key each node is compared with the smallest node of the bucket only; what is
    confirmed is contracted into components;
 3. pairs that share a bucket but not a component are compared in blocks of BLOCK nodes: blocks of the bucket's largest
    component with blocks of its other nodes, and these with each other; a unit of two blocks returns at most a spanning
    forest of its links.
Hot buckets are spread over many units, whatever their size, and a node is sent once for each block it must meet; only
components of the same bucket that step 2 couldn't join meet again.

Cases: null texts and texts without words have no shingles and no links; shorter texts than a
shingle are one shingle; rows with a null doc_id are returned unlinked (component null, kept);
repeated rows of one id are one node (of unequal texts of one id any one counts); ties: the smallest id of a group stands for it. A very long text is
shingled whole in one task. Only doc_id and text are read, so other columns can't clash, and none is returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import U64, Texts, halves, mix
from .common import Scratch, documents, hot_join, if_small
from .components import components

VALUES = 64
MISSED = 1e-6
BLOCK = 256
PART_BYTES = 1 << 19  # arrays of a part stay in the processor's cache
CHUNK_ROWS = 8_192
BROADCAST_IDS, BROADCAST_BUCKETS = 1_000_000, 500_000
_rng = np.random.default_rng(7)
SEEDS = _rng.integers(0, 2**64, VALUES, dtype=np.uint64)
ODD = _rng.integers(0, 2**64, VALUES, dtype=np.uint64) | U64(1)


def shingles(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles, sorted within each text, and their number in each text."""
    begins, ends, per = texts.words()
    total, back = texts.prefix()
    word = mix((total[ends] - total[begins]) * back[begins])
    doc = np.repeat(np.arange(texts.n), per)
    n = len(word)
    h = np.full(max(0, n - size + 1), U64(size), U64)
    for k in range(size if n >= size else 0):
        h = mix(h * U64(0x9E3779B97F4A7C15) + word[k : n - size + 1 + k])
    inside = doc[: n - size + 1] == doc[size - 1 :] if n >= size else np.zeros(0, bool)
    h, at = h[inside], doc[: max(0, n - size + 1)][inside]
    short = np.flatnonzero((per > 0) & (per < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(per)])
        one = np.full(len(short), U64(0), U64)
        for k in range(size - 1):
            there = per[short] > k
            one[there] = mix(one[there] * U64(0x9E3779B97F4A7C15) + word[first[short[there]] + k] + U64(1))
        h, at = np.concatenate([h, one]), np.concatenate([at, short])
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    h, at = h[new], at[new]
    return h, np.bincount(at, minlength=texts.n)


def signatures(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, VALUES) 16-bit minhashes; texts without shingles have zeros."""
    out = np.zeros((len(counts), VALUES), np.uint16)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = (np.cumsum(counts) - counts)[full]
    x = np.empty_like(h)
    for k in range(VALUES):
        np.bitwise_xor(h, SEEDS[k], out=x)
        np.multiply(x, ODD[k], out=x)
        least = np.minimum.reduceat(x, starts)
        out[full, k] = (mix(least) >> U64(48)).astype(np.uint16)
    return out


def chunks_for(share: int) -> int:
    """The fewest chunks for which 2 * chunks - 1 errors are exceeded with a probability below MISSED by
    signatures of texts at the similarity share / 100; a chunk then has at most one error."""
    p, chunks = 1 - share / 100, 1
    while sum(math.comb(VALUES, k) * p**k * (1 - p) ** (VALUES - k) for k in range(2 * chunks, VALUES + 1)) > MISSED:
        chunks += 1
    return chunks


def keys(sig: np.ndarray, chunks: int) -> np.ndarray:
    """(texts, keys): a hash of each chunk with each of its places left out."""
    wide, out = sig.astype(np.uint64), []
    edges = np.linspace(0, VALUES, chunks + 1).round().astype(int)
    for c in range(chunks):
        places = range(edges[c], edges[c + 1])
        for gone in places:
            h = np.full(len(sig), U64(c * 64 + gone + 1), U64)
            for p in places:
                if p != gone:
                    h = mix(h * U64(0x9E3779B97F4A7C15) + wide[:, p])
            out.append(h)
    return np.stack(out, 1) if len(sig) else np.zeros((0, 1), U64)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def signed(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in halves(whole, 1, PART_BYTES):
                h, counts = shingles(Texts(b.column(1), lower=True), size)
                sig = signatures(h, counts)
                full = np.flatnonzero(counts)
                sums = np.zeros((2, b.num_rows), U64)
                if len(full):
                    starts = (np.cumsum(counts) - counts)[full]
                    sums[0, full], sums[1, full] = np.add.reduceat(h, starts), np.add.reduceat(mix(h + U64(12345)), starts)
                one, two = sums
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _binary(sig)], names=["doc_id", "n", "s1", "s2", "sig"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sig binary")


def keyed(reps: DataFrame, chunks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                k = keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, VALUES), chunks)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(np.repeat(ids, k.shape[1]))], names=["key", "doc"])

    return reps.select("doc_id", "sig").mapInArrow(run, "key long, doc long")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """doc, set: the sorted 64-bit shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in halves(whole, 1, PART_BYTES):
                h, counts = shingles(Texts(b.column(1), lower=True), size)
                parts = np.split(h, np.cumsum(counts)[:-1]) if b.num_rows else []
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.tobytes() for p in parts], pa.binary())], names=["doc", "set"])

    return docs.mapInArrow(run, "doc long, set binary")


def close_pairs(pairs: DataFrame, errors: int) -> DataFrame:
    """Pairs (a, b, sa, sb) whose signatures differ in `errors` places at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, VALUES) for i in (2, 3))
            keep = pa.array((x != y).sum(1) <= errors)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _linked(first: np.ndarray, others: list[np.ndarray], share: int) -> np.ndarray:
    """Which sets have 100 * intersection >= share * union with the first."""
    if not len(others):
        return np.zeros(0, bool)
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    hit = first[np.minimum(np.searchsorted(first, every), len(first) - 1)] == every
    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= share * (sizes + len(first) - both)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted input, gathered by their first `keys` columns."""
    rows, current = [], None
    for b in batches:
        for row in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True):
            if row[:keys] != current and rows:
                yield rows
                rows = []
            current = row[:keys]
            rows.append(row)
    if rows:
        yield rows


def star_links(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Confirmed pairs (a, b); b's set is sent once to each unit of about BLOCK partners."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("units"))
    placed = pairs.join(sizes, "b").select("b", F.pmod(F.xxhash64("a"), F.col("units")).cast("int").alias("unit"), F.col("a").alias("doc"))
    heads = sizes.select("b", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"), F.col("b").alias("doc"))
    rows = placed.unionByName(heads).join(sets, "doc").select("b", "unit", (F.col("doc") != F.col("b")).cast("int").alias("other"), "doc", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, at = None, None
        for whole in batches:
            a, b = [], []
            for lead, _, other, doc, s in zip(*[whole.column(i).to_pylist() for i in range(5)], strict=True):
                if not other:
                    head, at = np.frombuffer(s, U64), lead
                elif at == lead and _linked(head, [np.frombuffer(s, U64)], share)[0]:
                    a.append(doc)
                    b.append(lead)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("b", "unit").sortWithinPartitions("b", "unit", "other").mapInArrow(run, "a long, b long")


def paired_blocks(rows: DataFrame) -> DataFrame:
    """rows (key, doc, comp, main, mains, others): the nodes of buckets with several components, the largest of them and the numbers of
    blocks of its nodes and of the others -> (key, u, v, doc, comp, block), a row for each unit of two blocks a node takes part in.

    Nodes of the largest component aren't compared with each other, so they meet the blocks of the others only (u, v >= 0); two
    blocks of others meet in (-1 - u, v), u <= v. A bucket with few others grows with its size, not with its square.
    """
    is_main = F.col("comp") == F.col("main")
    place = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    unit = lambda u, v, block: F.struct(u.cast("int").alias("u"), v.cast("int").alias("v"), block.cast("int").alias("block"))
    own = place("others")
    of_main = each("others", lambda o: unit(place("mains"), o, F.lit(0)))
    of_other = F.concat(each("mains", lambda b: unit(b, own, F.lit(1))), each("others", lambda o: unit(-1 - F.least(own, o), F.greatest(own, o), own)))
    return rows.select("key", "doc", "comp", F.explode(F.when(is_main, of_main).otherwise(of_other)).alias("x")).select("key", "x.u", "x.v", "doc", "comp", "x.block")


def cross_units(rows: DataFrame, chunks: int) -> DataFrame:
    """rows (key, u, v, doc, comp, block, sig), the nodes of one or two blocks of a bucket (see paired_blocks) ->
    (key, u, v, doc, comp, partners): the nodes that have a close partner in another component.

    A pair is handled in the first bucket that its signatures share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": pa.int64(), "u": pa.int32(), "v": pa.int32(), "doc": pa.int64(), "comp": pa.int64(), "partners": pa.list_(pa.int64())}

        def solve(groups: list[list[tuple]]) -> pa.RecordBatch:
            out: list[tuple] = []
            flat = [r for g in groups for r in g]
            doc, comp, block = (np.array([r[i] for r in flat], np.int64) for i in (3, 4, 5))
            sig = np.frombuffer(b"".join(r[6] for r in flat), np.uint16).reshape(-1, VALUES)
            all_keys = keys(sig, chunks)
            ends = np.cumsum([len(g) for g in groups])
            own = np.repeat(np.array([g[0][0] for g in groups], np.int64), [len(g) for g in groups]).view(U64)
            place = (all_keys == own[:, None]).argmax(1)
            for end, g in zip(ends.tolist(), groups, strict=True):
                lo = end - len(g)
                key, u, v = g[0][:3]
                c, s, first = comp[lo:end], sig[lo:end], place[lo]
                earlier = all_keys[lo:end, :first]
                _, inverse, number = np.unique(c, return_inverse=True, return_counts=True)
                weight = number[inverse]
                partners: dict[int, list[int]] = {}
                for i in range(len(g)):
                    # the side whose component has fewer nodes here keeps the list
                    may = (c != c[i]) & ((weight[i] < weight) | ((weight[i] == weight) & (c[i] > c)))
                    if u != -1 - v:
                        may &= block[lo:end] != block[lo + i]
                    js = np.flatnonzero(may)
                    if len(js):
                        js = js[(s[js] != s[i]).sum(1) < 2 * chunks]
                    if len(js) and first:
                        js = js[~(earlier[js] == earlier[i]).any(1)]
                    if len(js):
                        partners.setdefault(i, []).extend(doc[lo + js].tolist())
                        for j in js.tolist():
                            partners.setdefault(j, [])
                out += [(key, u, v, int(doc[lo + i]), int(c[i]), p) for i, p in partners.items()]
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))

        groups: list[list[tuple]] = []
        held = 0
        for group in _runs(batches, 3):
            if any(r[4] != group[0][4] for r in group):
                groups.append(group)
                held += len(group)
            if held > CHUNK_ROWS:
                yield solve(groups)
                groups, held = [], 0
        if groups:
            yield solve(groups)

    ordered = rows.repartition("key", "u", "v").sortWithinPartitions("key", "u", "v")
    return ordered.select("key", "u", "v", "doc", "comp", "block", "sig").mapInArrow(run, "key long, u int, v int, doc long, comp long, partners array<long>")


def cross_links(units: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links between components; a pair of components is joined once in a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 3):
            own = {r[3]: np.frombuffer(r[6], U64) for r in group}
            comp = {r[3]: r[4] for r in group}
            root: dict[int, int] = {}

            def find(x, root=root):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            a, b = [], []
            for r in group:
                todo = [p for p in r[5] if p in own and find(comp[p]) != find(comp[r[3]])]
                for p, hit in zip(todo, _linked(own[r[3]], [own[p] for p in todo], share), strict=True):
                    if hit and find(comp[p]) != find(comp[r[3]]):
                        root[find(comp[p])] = find(comp[r[3]])
                        a.append(r[3])
                        b.append(p)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = units.join(sets, "doc").select("key", "u", "v", "doc", "comp", "partners", "set")
    return rows.repartition("key", "u", "v").sortWithinPartitions("key", "u", "v").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, share: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; links have 100 * intersection >= share * union of
    `size`-word shingles."""
    scratch, chunks = Scratch(docs.sparkSession, "near-dedup"), chunks_for(share)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = scratch.save(signed(slim, size), "sigs")
    full = sigs.filter("n > 0 and doc_id is not null")
    same = full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("__c"))
    same = scratch.save(same.filter("__c > 1"), "same")
    members = hot_join(full.select("doc_id", "n", "s1", "s2"), same, ["s1", "s2", "n"], BLOCK, "left")
    members = scratch.save(members.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")).distinct(), "members")
    copies = members.filter("doc_id <> rep").select("doc_id").join(members.filter("doc_id = rep").select("doc_id"), "doc_id", "left_anti")
    copies = if_small(scratch.save(copies.distinct(), "copies"))
    reps = scratch.save(full.join(copies, "doc_id", "left_anti").select("doc_id", "sig").dropDuplicates(["doc_id"]), "reps")

    keyed_reps = keyed(reps, chunks)
    shared = keyed_reps.groupBy("key").agg(F.count("*").alias("c"), F.min("doc").alias("lead")).filter("c > 1")
    buckets = scratch.save(keyed_reps.join(shared, "key").select("key", "doc", "lead", "c"), "buckets")

    sig = reps.select(F.col("doc_id").alias("doc"), "sig")
    pairs = buckets.filter("doc <> lead").select(F.col("doc").alias("a"), F.col("lead").alias("b")).distinct()
    pairs = pairs.join(sig.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b")
    pairs = scratch.save(close_pairs(pairs, 2 * chunks - 1), "pairs")

    def sets_for(ids: DataFrame, name: str) -> DataFrame:
        # Few ids are sent to the texts; beyond BROADCAST_IDS the texts are shuffled to them.
        ids = scratch.save(ids.withColumnRenamed("doc", "doc_id"), f"{name}-ids")
        there = slim.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
        return scratch.save(sets_of(there, size).dropDuplicates(["doc"]), name)

    sets = sets_for(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "sets")
    links = scratch.save(star_links(pairs, sets, share), "star")
    comp = scratch.save(components(links, scratch, "first"), "first")

    joined = buckets.join(comp.select(F.col("node").alias("doc"), "component"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("comp"))
    per = joined.groupBy("key", "comp").agg(F.count("*").alias("k"))
    mixed = per.groupBy("key").agg(F.max_by("comp", F.struct("k", -F.col("comp"))).alias("main"), F.max("k").alias("m"), F.sum("k").alias("c")).filter("c > m")
    mixed = scratch.save(mixed.select("key", "main", F.ceil(F.col("m") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("c") - F.col("m")) / BLOCK).cast("int").alias("others"), F.col("c").alias("__c")), "mixed")
    rows = joined.select("key", "doc", "comp")
    if mixed.count() <= BROADCAST_BUCKETS:
        rows = rows.join(F.broadcast(mixed.drop("__c")), "key")
    else:
        rows = hot_join(scratch.save(rows.join(mixed.select("key"), "key", "left_semi"), "mixed-rows"), mixed, ["key"], 8 * BLOCK)
    rows = paired_blocks(rows)
    units = scratch.save(cross_units(rows.join(sig, "doc"), chunks), "units")
    more = units.select("doc").distinct().join(sets, "doc", "left_anti")
    sets = sets.unionByName(sets_for(more, "more"))
    links = links.unionByName(scratch.save(cross_links(units, sets, share), "cross"))
    comp = components(links, scratch, "all")
    for name in ("reps", "buckets", "pairs", "sets", "more", "units", "mixed", "same", "copies", "sets-ids", "more-ids", "mixed-rows"):
        scratch.drop(name)

    found = members.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select(F.col("doc_id").alias("__id"), F.coalesce("component", "rep").alias("__c")).groupBy("__id").agg(F.min("__c").alias("__c"))
    out = sigs.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("__id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("__c", "doc_id").alias("component_id"))


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), size=3, share=85)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
