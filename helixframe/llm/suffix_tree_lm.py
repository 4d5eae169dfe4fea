"""Language-model scoring with a probabilistic suffix tree.

A text is read as its words (A-Z lower-cased), each closed by a space, and an end symbol; the symbols are
bytes (255, no byte of UTF-8, is the end and what stands before a text), so every text has a probability.

Counting: one pass over the training texts counts all windows of DEPTH + 1 symbols (exact keys, summed in each task and
packed by the last three symbols of their context, by which they meet and are summed as they come); the counts of shorter
contexts are sums of those.
Growing: a context that occurs MIN_COUNT times or more is kept if the code length it saves (its count times the divergence of its
next-symbol distribution from that of its suffix, in nats) exceeds what its parameters cost: half the log
of its count for each symbol that follows it, and PENALTY. Suffixes of kept contexts are kept, and so are all
contexts of one or two symbols. Distributions are smoothed towards those of the suffix. The thresholds are counts, so
the tree grows with the corpus.
Scoring: the longest kept suffix of what was read gives the next symbol's probability. The most frequent contexts, as
many as fit HOT_CELLS cells, go to all tasks as a trie, the next ones, as many as fit MIDDLE_BYTES, in sparse form. A position
whose next longer suffix is kept but in neither goes to the task that holds the subtree below that suffix: such a suffix is
rare, so no task gets many. Positions travel as arrays, grouped by destination.

The word-unigram base: about HEAVY_ROWS sampled texts name the words that may be frequent; they are counted in each
task of the counting pass. All other words travel to the task that counts them, and only the sums of their documents
come back. The sample decides where a word is counted, never what its count is.

Cases: null, empty and blank texts are the end token alone; without training texts all counts are 0 and
every symbol has the same probability; rows with null ids belong to the training texts; repeated rows count as often as they
occur; a very long text is counted and scored whole in one task; equal counts make equal probabilities, so ties decide nothing; only doc_id and text are
read, so other columns can't clash, and none is returned; an empty table gives no rows. docs is read three times and must give the same rows in the same
order each time (a table does); otherwise the run fails with an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import SPACE, U64, Texts, halves, mix
from .common import Scratch, documents, small_batches

DEPTH = 6
MIN_COUNT = 20
PENALTY = 12.0
PRIOR = 5.0
HOT_CELLS = 3_000_000
MIDDLE_BYTES, MIDDLE_NODE = 48_000_000, 84
HEAVY, HEAVY_ROWS = 20_000, 4_000
BATCH_ROWS, PART_BYTES = 500, 1 << 18
HELD_KEYS = 1_000_000
WINDOW_BYTES, TAIL_BYTES = 1 << 23, 1 << 22
GROUP_WORDS, GROUP_DOCS = 1_000_000, 32_000
BUCKET_TOKENS = 3_000_000
END = 255
SHORT = 2  # contexts up to this length are all kept
TRAIN_BIT = np.uint16(1 << 15)


def word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    begins, ends, per = texts.words()
    total, back = texts.prefix()
    return mix((total[ends] - total[begins]) * back[begins]) | U64(1), per


def symbols(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, DEPTH ends before each, and where each text's symbols begin (and the end)."""
    begins, ends, per = texts.words()
    n_docs = texts.n
    lengths = ends - begins
    first = np.concatenate([[0], np.cumsum(per)])
    chars = np.concatenate([[0], np.cumsum(lengths)])
    doc_of_word = np.repeat(np.arange(n_docs), per)
    starts = chars[first[:-1]] + first[:-1] + np.arange(n_docs) * (DEPTH + 1) + DEPTH
    out = np.full(chars[-1] + len(begins) + n_docs * (DEPTH + 1), END, np.uint8)
    keep = ~SPACE[texts.data]
    word_at = chars[:-1] + np.arange(len(begins)) + doc_of_word * (DEPTH + 1) + DEPTH
    place = np.repeat(word_at - chars[:-1], lengths) + np.arange(chars[-1])
    out[place] = texts.data[keep]
    out[word_at + lengths] = 32
    return out, np.append(starts, len(out) + DEPTH)


def _scored(starts: np.ndarray) -> np.ndarray:
    """Positions of the symbols proper."""
    lengths = np.diff(starts) - DEPTH
    return np.repeat(starts[:-1] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def windows(s: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The symbol at each position and the `depth` symbols before it, oldest in the highest byte."""
    key = np.zeros(len(at), U64)
    for k in range(depth, -1, -1):
        key <<= U64(8)
        key |= s[at - k]
    return key


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 1


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of n of each."""
    order = np.argsort(key, kind="stable")
    k, c = key[order], n[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def heavy_words(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Hashes of the words that make up 1/HEAVY of the sampled texts' words or more, at least two of them (at most HEAVY words);
    and about how many bytes all texts have, which sets numbers of tasks only."""
    total = docs.count()
    if not total:
        return np.zeros(0, U64), 0
    sample = docs.select("text").sample(fraction=min(1.0, HEAVY_ROWS / total), seed=5).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, tokens, rows, size = [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0, 0, 0
        for whole in batches:
            for b in halves(whole, 0, PART_BYTES):
                texts = Texts(b.column(0), lower=True)
                words, _ = word_hashes(texts)
                tokens, rows, size = tokens + len(words), rows + texts.n, size + len(texts.data)
                u, c = np.unique(words, return_counts=True)
                keys, counts = ([x] for x in _sums(np.concatenate([*keys, u]), np.concatenate([*counts, c])))
        heavy = keys[0][(counts[0] * HEAVY >= tokens) & (counts[0] > 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(heavy.view(np.int64), size * total // max(rows, 1)))], names=["word"])

    found = sample.mapInArrow(run, "word long").toPandas()["word"].to_numpy(np.int64)
    return (np.sort(found[:-1].view(U64)), int(found[-1])) if len(found) else (np.zeros(0, U64), 0)


def _spots(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in the sorted array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    spot = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return spot, sorted_[spot] == values


def _pack(key: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys and their counts; differences are stored by byte, so they compress well."""
    gaps = np.diff(key, prepend=U64(0))
    planes = gaps.view(np.uint8).reshape(-1, 8).T.tobytes() + n.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), np.uint8).reshape(12, -1)
    gaps, n = (np.ascontiguousarray(x.T).view(kind).ravel() for x, kind in ((planes[:8], U64), (planes[8:], np.uint32)))
    return np.cumsum(gaps, dtype=U64), n.astype(np.int64)


WINDOWS, SHORTS, FREQUENT, FACTS = range(4)
COUNTS = "kind int, dest int, data binary"


def _counts(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "dest", "data"])


def _by_task(kind: int, key: np.ndarray, n: np.ndarray, tasks: int) -> list[tuple]:
    """Counts for the tasks that sum them. Windows go by the last SHORT + 1 symbols of their context."""
    dest = (mix(((key >> U64(8)) & _mask(SHORT + 1)) if kind == WINDOWS else key + U64(kind)) % U64(tasks)).astype(np.int32)
    order = np.argsort(dest, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(dest[order]) > 0)) if len(key) else []
    parts = (order[lo:hi] for lo, hi in zip(first, [*first[1:], len(key)], strict=False))
    return [(kind, int(dest[rows[0]]), _pack(key[rows], n[rows])) for rows in parts]


def corpus_counts(docs: DataFrame, heavy: np.ndarray, tasks: int) -> DataFrame:
    """docs (text, train) -> packed keys and counts, a row for each kind and task: WINDOWS of the training texts, their ends (SHORTS),
    the heavy words in training texts (FREQUENT), and all tokens, training tokens and training texts (FACTS 0 to 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held, facts, frequent = 0, np.zeros(3, np.int64), np.zeros(len(heavy), np.int64)
        short = [np.zeros(0, U64), np.zeros(0, np.int64)]
        for whole in batches:
            for b in halves(whole, 0, PART_BYTES):
                train = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
                _, _, per = Texts(b.column(0)).words()
                learn = Texts(b.column(0).filter(b.column(1)), lower=True)
                words, _ = word_hashes(learn)
                facts += [per.sum() + len(per), len(words) + learn.n, train.sum()]
                spot, hit = _spots(heavy, words)
                frequent += np.bincount(spot[hit], minlength=len(heavy))
                s, starts = symbols(learn)
                key = windows(s, _scored(starts))
                key.sort()
                if not len(key):
                    continue
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                keys.append(key[first])
                counts.append(np.diff(np.append(first, len(key))).astype(np.int32))
                ends = _sums(keys[-1] & _mask(SHORT + 1), counts[-1])
                short = _sums(*(np.concatenate(x) for x in zip(short, ends, strict=True)))
                held += len(first)
                if held > HELD_KEYS:
                    k, c = _sums(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [k], [c], len(k)
                    if 2 * held > HELD_KEYS:
                        yield _counts(_by_task(WINDOWS, k, c, tasks))
                        keys, counts, held = [], [], 0
        if keys:
            yield _counts(_by_task(WINDOWS, *_sums(np.concatenate(keys), np.concatenate(counts)), tasks))
        there = frequent > 0
        rows = _by_task(SHORTS, *short, tasks) + _by_task(FREQUENT, heavy[there], frequent[there], tasks) + _by_task(FACTS, np.arange(3, dtype=U64), facts, tasks)
        yield _counts(rows)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, held, known = None, [], 0, 0

        def summed():
            return [_sums(*(np.concatenate(x) for x in zip(*parts, strict=True)))]

        for b in batches:
            for kind, dest, data in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if (kind, dest) != current and parts:
                    yield _counts([(*current, _pack(*summed()[0]))])
                    parts, held, known = [], 0, 0
                current = kind, dest
                parts.append(_unpack(data))
                held += len(parts[-1][0])
                if held > 2 * known + HELD_KEYS // 2:
                    parts = summed()
                    held = known = len(parts[0][0])
        if parts:
            yield _counts([(*current, _pack(*summed()[0]))])

    own = docs.select("text", "train").mapInArrow(run, COUNTS)
    return own.repartition("dest").sortWithinPartitions("dest", "kind").mapInArrow(sums, COUNTS)


def _mask(length: int) -> np.uint64:
    return U64((1 << (8 * length)) - 1)


@dataclass
class Top:
    """The contexts of up to SHORT symbols: keys (context and symbol), smoothed probabilities, context keys and counts by length."""

    root: np.ndarray
    pairs: list[np.ndarray]
    p: list[np.ndarray]
    contexts: list[np.ndarray]
    counts: list[np.ndarray]


def top_of(key: np.ndarray, n: np.ndarray) -> Top:
    """key: SHORT context symbols and the next symbol. There are at most 256 ** (SHORT + 1) keys, whatever the corpus."""
    last = np.bincount((key & U64(255)).astype(np.int64), n, 256) + 0.5
    root = last / last.sum()
    pairs, p, contexts, counts = [np.arange(256, dtype=U64)], [root], [np.zeros(1, U64)], [np.array([n.sum()])]
    for k in range(1, SHORT + 1):
        pair, c = _sums(key & _mask(k + 1), n)
        context, total = _sums(pair >> U64(8), c)
        each = total[np.searchsorted(context, pair >> U64(8))]
        above = p[-1][np.searchsorted(pairs[-1], pair & _mask(k))]
        pairs.append(pair)
        p.append((c + PRIOR * above) / (each + PRIOR))
        contexts.append(context)
        counts.append(total)
    return Top(root, pairs, p, contexts, counts)


NODES = "depth int, context long, c long, above array<long>, symbols binary, logp binary"


def grown(key: np.ndarray, n: np.ndarray, top: Top, min_count: int, penalty: float) -> list[tuple]:
    """Kept contexts longer than SHORT among windows with whole groups of equal last SHORT + 1 context symbols: for each depth
    (depth, contexts, counts, counts of the suffixes by length, symbols in each, all symbols, all log10 probabilities)."""
    levels = []
    above_pairs, above_p = top.pairs[SHORT], top.p[SHORT]
    for k in range(SHORT + 1, DEPTH + 1):
        pair, c = _sums(key & _mask(k + 1), n)
        start = np.flatnonzero(np.append(True, (pair[1:] >> U64(8)) != (pair[:-1] >> U64(8)))) if len(pair) else np.zeros(0, int)
        size = np.diff(np.append(start, len(pair)))
        context, total = pair[start] >> U64(8), np.add.reduceat(c, start) if len(pair) else c
        each = np.repeat(total, size)
        above = above_p[np.searchsorted(above_pairs, pair & _mask(k))]
        p = (c + PRIOR * above) / (each + PRIOR)
        saved = np.add.reduceat(c * np.log(c / each / above), start) if len(pair) else np.zeros(0)
        keep = (total >= min_count) & (saved > 0.5 * size * np.log(total) + penalty)
        levels.append([k, context, total, size, pair, p, keep])
        above_pairs, above_p = pair, p
    for shorter, longer in zip(levels[-2::-1], levels[:0:-1], strict=True):
        shorter[6][np.searchsorted(shorter[1], longer[1][longer[6]] & _mask(shorter[0]))] = True
    out = []
    for i, (k, context, total, size, pair, p, keep) in enumerate(levels):
        if not keep.any():
            break
        kept = context[keep]
        above = np.stack([*[top.counts[j][np.searchsorted(top.contexts[j], kept & _mask(j))] for j in range(1, SHORT + 1)], *[b[2][np.searchsorted(b[1], kept & _mask(b[0]))] for b in levels[: i + 1]]], 1)
        rows = np.repeat(keep, size)
        out.append((k, kept, total[keep], above, size[keep], (pair[rows] & U64(255)).astype(np.uint8), np.log10(p[rows]).astype(np.float32)))
    return out


def tree_nodes(grams: DataFrame, top: Top, min_count: int = MIN_COUNT, penalty: float = PENALTY) -> DataFrame:
    """The kept contexts longer than SHORT, a row each; a row of grams has all windows with the ends it has."""

    def batch(k, context, c, above, size, symbol, logp):
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        binary = lambda data, width: pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(data)])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * k), pa.array(above.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(size), k, np.int32)), pa.array(context.view(np.int64)), pa.array(c), lists, binary(symbol, 1), binary(logp, 4)], names=["depth", "context", "c", "above", "symbols", "logp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                for found in grown(*_unpack(data.as_py()), top, min_count, penalty):
                    yield batch(*found)

    return grams.select("data").mapInArrow(run, NODES)


@dataclass
class Trie:
    """The most frequent contexts. Row 0 is empty, row 1 the root; child[node, class] is the node of the context with one
    older symbol, 0 (not kept), -1 (kept in the middle) or -2 (kept elsewhere). two[class, class] starts after two symbols."""

    classes: np.ndarray
    child: np.ndarray
    logp: np.ndarray

    def __post_init__(self):
        w = self.child.shape[1]
        one = self.child[1]
        self.two = np.where((one > 0)[:, None], self.child[np.maximum(one, 0)], 0).ravel()
        self.two_best = np.where(self.two > 0, self.two, np.repeat(np.where(one > 0, one, 1), w)).astype(np.int32)


def build_trie(top: Top, nodes: list[tuple], outside: list[tuple[int, np.ndarray, int]], min_count: int = MIN_COUNT) -> Trie:
    """nodes as from grown(), each depth once; outside: (depth, contexts, mark) of kept contexts right below the trie."""
    seen = np.flatnonzero(top.root > top.root.min())
    width = len(seen) + 1  # the last class stands for all symbols that never occurred
    classes = np.full(256, width - 1, np.int32)
    classes[seen] = np.arange(len(seen))
    some = np.setdiff1d(np.arange(256), seen)[:1]
    levels = [(0, np.zeros(1, U64), top.counts[0], np.array([width]), None, None)]
    for k in range(1, SHORT + 1):
        keep = top.counts[k] >= min_count
        size = np.bincount(np.searchsorted(top.contexts[k], top.pairs[k] >> U64(8)), minlength=len(keep))
        rows = np.repeat(keep, size)
        levels.append((k, top.contexts[k][keep], top.counts[k][keep], size[keep], (top.pairs[k][rows] & U64(255)).astype(np.uint8), np.log10(top.p[k][rows]).astype(np.float32)))
    levels += [(k, context, c, size, symbol, lp) for k, context, c, _, size, symbol, lp in nodes]
    n = 1 + sum(len(x[1]) for x in levels)
    child, logp = np.zeros((n, width), np.int32), np.zeros((n, width), np.float32)
    base = np.log10(top.root)
    logp[1, : len(seen)], logp[1, width - 1] = base[seen], base[some[0]] if len(some) else base.min()
    at, ids, above = 2, {0: np.array([1])}, {0: np.zeros(1, U64)}
    for k, context, c, size, symbol, lp in levels[1:]:
        order = np.argsort(context)
        own = np.empty(len(context), np.int64)
        own[order] = at + np.arange(len(context))
        up = ids[k - 1][np.searchsorted(above[k - 1], context & _mask(k - 1))]
        logp[own] = logp[up] + np.log10(PRIOR / (c + PRIOR)).astype(np.float32)[:, None]
        logp[np.repeat(own, size), classes[symbol]] = lp
        child[up, classes[(context >> U64(8 * (k - 1))).astype(np.int64)]] = own
        ids[k], above[k] = own[order], context[order]
        at += len(context)
    for k, context, mark in outside:
        up = ids[k - 1][np.searchsorted(above[k - 1], context & _mask(k - 1))]
        child[up, classes[(context >> U64(8 * (k - 1))).astype(np.int64)]] = mark
    return Trie(classes, child, logp)


@dataclass
class Middle:
    """Contexts less frequent than those of the trie, by key (depth and context): seen[node] has a bit for each symbol that follows,
    logp the values of all of them from start[node] on, rank[node] how many are in earlier words of seen; far[node] has a bit
    for each older symbol whose context is kept elsewhere."""

    keys: np.ndarray
    escape: np.ndarray
    seen: np.ndarray
    rank: np.ndarray
    start: np.ndarray
    logp: np.ndarray
    far: np.ndarray

    def continued(self, key: np.ndarray, depth: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of windows whose suffix of length `depth` is here, and the rows that go on elsewhere with the length there."""
        value, depth = value.copy(), depth.copy()
        symbol = key & U64(255)
        word, bit = (symbol >> U64(6)).astype(np.int64), symbol & U64(63)
        rows_far, depth_far = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
        for k in range(SHORT + 1, DEPTH + 1):
            rows = np.flatnonzero(depth == k)
            spot, hit = _spots(self.keys, _node_key((key[rows] >> U64(8)) & _mask(k), k))
            rows, spot = rows[hit], spot[hit]
            bits, b = self.seen[spot, word[rows]], bit[rows]
            place = self.start[spot] + self.rank[spot, word[rows]] + np.bitwise_count(bits & ((U64(1) << b) - U64(1)))
            there = (bits >> b) & U64(1) > 0
            value[rows] = np.where(there, self.logp[np.minimum(place, len(self.logp) - 1)], self.escape[spot] + value[rows])
            if k < DEPTH:
                older = (key[rows] >> U64(8 * (k + 1))) & U64(255)
                out = (self.far[spot, (older >> U64(6)).astype(np.int64)] >> (older & U64(63))) & U64(1) > 0
                rows_far.append(rows[out])
                depth_far.append(np.full(int(out.sum()), k + 1, np.uint8))
                depth[rows[~out]] = k + 1
        return value, np.concatenate(rows_far), np.concatenate(depth_far)


def _node_key(context: np.ndarray, depth) -> np.ndarray:
    return context | (np.asarray(depth).astype(U64) << U64(56))


def build_middle(nodes: list[tuple], outside: list[tuple[int, np.ndarray]]) -> Middle:
    """nodes as from grown(), each depth once; outside: (depth, contexts) of kept contexts right below these."""
    none = np.zeros(0, np.int64)
    keys = np.concatenate([none.astype(U64), *[_node_key(x[1], x[0]) for x in nodes]])
    c, size = (np.concatenate([none, *[x[i] for x in nodes]]) for i in (2, 4))
    symbol, logp = (np.concatenate([none.astype(kind), *[x[i] for x in nodes]]) for i, kind in ((5, np.uint8), (6, np.float32)))
    order = np.argsort(keys)
    start = np.cumsum(size) - size
    node, symbol = np.repeat(np.arange(len(keys)), size), symbol.astype(np.int64)

    def bits(rows, value):
        out = np.zeros((len(keys), 4), U64)
        np.bitwise_or.at(out, (rows, value >> 6), U64(1) << (value & 63).astype(U64))
        return out

    seen = bits(node, symbol)
    rank = np.bitwise_count(seen)
    rank = (np.cumsum(rank, 1) - rank).astype(np.uint8)
    rows_far, older = [none], [none]
    for k, context in outside:
        spot, hit = _spots(keys[order], _node_key(context & _mask(k - 1), k - 1))
        rows_far.append(order[spot[hit]])
        older.append((context[hit] >> U64(8 * (k - 1))).astype(np.int64))
    far = bits(np.concatenate(rows_far), np.concatenate(older))
    escape = np.log10(PRIOR / (c + PRIOR)).astype(np.float32)
    return Middle(keys[order], escape[order], seen[order], rank[order], start[order].astype(np.int32), logp.astype(np.float32), far[order])


def fitted(tree: DataFrame, top: Top, least: int, middle: int, min_count: int = MIN_COUNT) -> tuple[Trie, Middle]:
    """The trie of the contexts that occur `least` times or more and the middle of those that occur `middle` times or more, built in
    one task (HOT_CELLS and MIDDLE_BYTES bound them)."""
    names = ["classes", "child", "trie_logp", "keys", "escape", "seen", "rank", "start", "logp", "far"]
    kinds = [np.int32, np.int32, np.float32, U64, np.float32, U64, np.uint8, np.int32, np.float32, U64]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def data(column, kind):
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends)

        parts = []
        for b in batches:
            symbol, size = data(b.column(4), np.uint8)
            parts.append([b.column(0).to_numpy(), b.column(1).to_numpy().view(U64), b.column(2).to_numpy(), b.column(3).to_numpy(), size.astype(np.int64), symbol, data(b.column(5), np.float32)[0]])
        blank = [np.zeros(0, kind) for kind in (np.int64, U64, np.int64, np.int64, np.int64, np.uint8, np.float32)]
        depth, context, c, above, size, symbol, logp = (np.concatenate(x) for x in zip(blank, *parts, strict=True))
        hot, mid = c >= least, (c >= middle) & (c < least)

        def nodes(chosen):
            out = []
            for k in np.unique(depth[chosen]).tolist():
                own = chosen & (depth == k)
                each = np.repeat(own, size)
                out.append((k, context[own], c[own], None, size[own], symbol[each], logp[each]))
            return out

        below_trie = (above >= least) | (depth == SHORT + 1)
        outside = [(k, context[(depth == k) & which & below_trie], mark) for k in range(SHORT + 1, DEPTH + 1) for which, mark in ((mid, -1), (c < middle, -2))]
        trie = build_trie(top, nodes(hot), [x for x in outside if len(x[1])], min_count)
        rest = build_middle(nodes(mid), [(k, context[(depth == k) & (c < middle) & ~below_trie]) for k in range(SHORT + 2, DEPTH + 1)])
        arrays = (trie.classes, trie.child, trie.logp, rest.keys, rest.escape, rest.seen, rest.rank, rest.start, rest.logp, rest.far)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=names)

    above = F.coalesce(F.try_element_at("above", F.col("depth") - 1), F.lit(0))
    near = tree.filter((F.col("c") >= middle) | (F.col("depth") == SHORT + 1) | (above >= middle))
    slim = near.select(F.col("depth").cast("long"), "context", "c", above.cast("long"), *[F.when(F.col("c") >= middle, F.col(x)).alias(x) for x in ("symbols", "logp")])
    got = slim.repartition(1).mapInArrow(run, ", ".join(f"{n} binary" for n in names)).first()
    if got is None:
        return build_trie(top, [], [], min_count), build_middle([], [])
    classes, child, trie_logp, *rest = (np.frombuffer(got[n], kind) for n, kind in zip(names, kinds, strict=True))
    width = int(classes.max()) + 1
    rest = [x.reshape(-1, 4) if n in ("seen", "rank", "far") else x for n, x in zip(names[3:], rest, strict=True)]
    return Trie(classes, child.reshape(-1, width), trie_logp.reshape(-1, width)), Middle(*rest)


def read_positions(trie: Trie, middle: Middle, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability of each position by the trie and the middle; and the positions (as numbers) whose next longer suffix
    is kept elsewhere, that suffix's length, and their windows."""
    w = trie.child.shape[1]
    child = trie.child.ravel()
    c = trie.classes[s]
    spot = c[at - 1] * w + c[at - 2]
    best, node = trie.two_best[spot], trie.two[spot]
    rows = np.flatnonzero(node > 0)
    node = node[rows]
    left, depths, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int32)]
    for k in range(SHORT + 1, DEPTH + 1):
        node = child[node * w + c[at[rows] - k]]
        out = np.flatnonzero(node < 0)
        left.append(rows[out])
        depths.append(np.full(len(out), k, np.uint8))
        marks.append(node[out])
        on = np.flatnonzero(node > 0)
        rows, node = rows[on], node[on]
        best[rows] = node
    lp = trie.logp.ravel()[best.astype(np.int64) * w + c[at]]
    rows, depth, mark = (np.concatenate(x) for x in (left, depths, marks))
    key = windows(s, at[rows])
    here = np.flatnonzero(mark == -1)
    value, far, far_depth = middle.continued(key[here], depth[here], lp[rows[here]])
    lp[rows[here]] = value
    depth[here[far]] = far_depth
    away = np.concatenate([np.flatnonzero(mark == -2), here[far]])
    return lp, rows[away], depth[away], key[away]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key + U64(0x5851F42D)) % U64(buckets)).astype(np.int32)


def _root(key: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last `depth` context symbols of a window, with their number above them."""
    shift = depth.astype(U64) * U64(8)
    return ((key >> U64(8)) & ((U64(1) << shift) - U64(1))) | (depth.astype(U64) << U64(56))


HOME, NODE, TAIL, WORDS, SUMS, TYPES = range(6)
PARCEL = "dest int, kind int, grp long, data binary"
_PARCEL = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _parcels(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _PARCEL, strict=True)], names=["dest", "kind", "grp", "data"])


def _dealt(dest: np.ndarray, kind: int, grp: int, *columns: np.ndarray) -> list[tuple]:
    """One parcel for each destination, with its part of the columns one after the other."""
    order = np.argsort(dest, kind="stable")
    first = np.flatnonzero(np.append(True, dest[order][1:] != dest[order][:-1])) if len(dest) else []
    columns = tuple(c[order] for c in columns)
    ends = np.append(first, len(dest))
    return [(int(dest[order[lo]]), kind, grp, b"".join(c[lo:hi].tobytes() for c in columns)) for lo, hi in zip(ends[:-1], ends[1:], strict=True)] if len(dest) else []


def _opened(data: bytes, *kinds) -> list[np.ndarray]:
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


HOME_KINDS = (np.int64, np.uint8, np.int64, np.int64, np.float64, np.float64)


def read_texts(docs: DataFrame, tree, heavy: np.ndarray, counts: np.ndarray, buckets: int) -> DataFrame:
    """Parcels of each group of texts: HOME with ids, tokens and the sums known here, WORDS and TAIL for what others know.
    tree: a broadcast Trie and Middle."""
    known = np.log10(counts + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, middle), task, seq = tree.value, TaskContext.get().partitionId(), 0
        home, words_, tail = [], [], []
        n_docs = held = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*home, strict=True)]
            # The name of a group holds a checksum, so a group that was read in another order is noticed.
            check = int(mix(np.add.reduce(mix(columns[0].view(U64) + np.arange(len(columns[0]), dtype=U64)), keepdims=True))[0] >> U64(52))
            grp = (task << 32) | (seq << 12) | check
            rows = [(int(_bucket(np.array([grp], U64), buckets)[0]), HOME, grp, b"".join(c.astype(k).tobytes() for c, k in zip(columns, HOME_KINDS, strict=True)))]
            for kind, parts in ((WORDS, words_), (TAIL, tail)):
                if parts:
                    dest, *data = (np.concatenate(x) for x in zip(*parts, strict=True))
                    rows += _dealt(dest, kind, grp, *data)
            return _parcels(rows)

        for whole in batches:
            for b in halves(whole, 1, PART_BYTES):
                for lo in range(0, b.num_rows, GROUP_DOCS):
                    part = b.slice(lo, GROUP_DOCS)
                    if home and (held >= GROUP_WORDS or n_docs + part.num_rows > GROUP_DOCS):
                        yield flush()
                        home, words_, tail, n_docs, held, seq = [], [], [], 0, 0, seq + 1
                    texts = Texts(part.column(1), lower=True)
                    words, per = word_hashes(texts)
                    doc = np.repeat(np.arange(texts.n), per)
                    train = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                    spot, hit = _spots(heavy, words)
                    base = np.bincount(doc[hit], known[spot[hit]], texts.n) if len(heavy) else np.zeros(texts.n)
                    there = np.bincount(doc[hit], counts[spot[hit]] > 0, texts.n) if len(heavy) else np.zeros(texts.n)
                    light, light_doc = words[~hit], doc[~hit]
                    mark = (light_doc + n_docs).astype(np.uint16) | np.where(train[light_doc], TRAIN_BIT, np.uint16(0))
                    words_.append((_bucket(light, buckets), light, mark))
                    s, starts = symbols(texts)
                    at = _scored(starts)
                    lp, rows, depth, key = read_positions(model, middle, s, at)
                    first = np.concatenate([[0], np.cumsum(np.diff(starts) - DEPTH)]).astype(np.int64)
                    score = np.add.reduceat(lp.astype(np.float64), first[:-1]) if texts.n else np.zeros(0)
                    if len(rows):
                        owner = np.searchsorted(first, rows, side="right") - 1 + n_docs
                        tail.append((_bucket(_root(key, depth), buckets), key | (depth.astype(U64) << U64(56)), lp[rows], owner.astype(np.uint16)))
                    ids = part.column(0)
                    home.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), per + 1, there, base, score))
                    n_docs += texts.n
                    held += len(light) + len(rows)
        if home:
            yield flush()

    return docs.select("doc_id", "text", "train").mapInArrow(run, PARCEL)


def tail_nodes(tree: DataFrame, least: int, buckets: int) -> DataFrame:
    """A parcel for each kept context that occurs less than `least` times, for the task of its shortest suffix that does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            depth, context, c = (b.column(i).to_numpy() for i in (0, 1, 2))
            root = np.full(len(depth), DEPTH + 1)
            for i, counts in enumerate(b.column(3).to_pylist()):
                root[i] = next(k for k, x in enumerate(counts, 1) if k > SHORT and x < least)
            dest = _bucket(_root(context.view(U64) << U64(8), root), buckets)
            lead = np.stack([depth.astype(np.int64), context, c], 1)
            rows = [(d, NODE, -1, head.tobytes() + s + p) for d, head, s, p in zip(dest.tolist(), lead, b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield _parcels(rows)

    return tree.filter(F.col("c") < least).select("depth", "context", "c", "above", "symbols", "logp").mapInArrow(run, PARCEL)


class Subtrees:
    """The kept contexts of one destination."""

    def __init__(self, rows: list[bytes]):
        lead = np.array([np.frombuffer(r, np.int64, 3) for r in rows], np.int64).reshape(-1, 3)
        key = lead[:, 1].view(U64) | (lead[:, 0].astype(U64) << U64(56))
        order = np.argsort(key)
        self.keys = key[order]
        self.escape = np.log10(PRIOR / (lead[order, 2] + PRIOR))
        sizes = np.array([(len(rows[i]) - 24) // 5 for i in order], np.int64)
        symbol = np.frombuffer(b"".join(rows[i][24 : 24 + n] for i, n in zip(order, sizes, strict=True)), np.uint8)
        self.logp = np.frombuffer(b"".join(rows[i][24 + n :] for i, n in zip(order, sizes, strict=True)), np.float32)
        self.pairs = np.repeat(np.arange(len(order)), sizes) * 256 + symbol

    def scores(self, key: np.ndarray, lp: np.ndarray) -> np.ndarray:
        """log10 probabilities: key is a window with the length of its shortest suffix outside the trie on top."""
        depth, value = (key >> U64(56)).astype(np.int64), lp.astype(np.float64)
        symbol, context = (key & U64(255)).astype(np.int64), (key >> U64(8)) & _mask(DEPTH)
        for k in range(SHORT + 1, DEPTH + 1):
            rows = np.flatnonzero(depth == k)
            spot, hit = _spots(self.keys, (context[rows] & _mask(k)) | U64(k << 56))
            rows, spot = rows[hit], spot[hit]
            pair, seen = _spots(self.pairs, spot * 256 + symbol[rows])
            value[rows] = np.where(seen, self.logp[pair], self.escape[spot] + value[rows])
            depth[rows] = k + 1
        return value


def resolved(parcels: DataFrame) -> DataFrame:
    """HOME as it was; SUMS (text number, known words, base, score) for WORDS and TAIL; TYPES: number of distinct training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dest, nodes, words, tail, held = None, [], [], [], 0

        def sums(group, doc, there, base, score):
            n = int(doc.max()) + 1
            number = np.bincount(doc, minlength=n)
            some = np.flatnonzero(number)
            per = [np.bincount(doc, x, n)[some] for x in (there, base, score)]
            return (0, SUMS, group, b"".join(x.tobytes() for x in (some.astype(np.uint16), per[0].astype(np.int64), per[1], per[2])))

        def words_done():
            opened = [(g, *_opened(x, U64, np.uint16)) for g, x in words]
            every = np.concatenate([x[1] for x in opened])
            mark = np.concatenate([x[2] for x in opened])
            _, number = np.unique(every, return_inverse=True)
            c = np.bincount(number, (mark & TRAIN_BIT) > 0)
            base, there, at, rows = np.log10(c + 0.5)[number], (c > 0)[number], 0, []
            for g, w, m in opened:
                own = slice(at, at + len(w))
                rows.append(sums(g, (m & ~TRAIN_BIT).astype(np.int64), there[own], base[own], np.zeros(len(w))))
                at += len(w)
            return [*rows, (0, TYPES, -1, np.int64((c > 0).sum()).tobytes())]

        def tail_done():
            tree, rows = Subtrees(nodes), []
            opened = [(g, *_opened(x, U64, np.float32, np.uint16)) for g, x in tail]
            gain = tree.scores(np.concatenate([x[1] for x in opened]), np.concatenate([x[2] for x in opened])) - np.concatenate([x[2] for x in opened])
            at = 0
            for g, _, lp, doc in opened:
                zero = np.zeros(len(lp))
                rows.append(sums(g, doc.astype(np.int64), zero, zero, gain[at : at + len(lp)]))
                at += len(lp)
            return rows

        for b in batches:
            for d, kind, grp, data in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if d != dest or (held > TAIL_BYTES and kind == TAIL):
                    if tail:
                        yield _parcels(tail_done())
                    tail, held = [], 0
                if d != dest:
                    if words:
                        yield _parcels(words_done())
                    dest, nodes, words = d, [], []
                if kind == HOME:
                    yield _parcels([(0, HOME, grp, data)])
                elif kind == NODE:
                    nodes.append(data)
                elif kind == TAIL:
                    tail.append((grp, data))
                    held += len(data)
                else:
                    words.append((grp, data))
        if tail:
            yield _parcels(tail_done())
        if words:
            yield _parcels(words_done())

    return parcels.repartition("dest").sortWithinPartitions("dest", "kind", "grp").mapInArrow(run, PARCEL)


def assembled(parcels: DataFrame) -> DataFrame:
    """A row for each text; rows with `types` alone count distinct training words."""
    names = ["doc_id", "n_tokens", "n_known", "base", "score", "types"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, home = None, None

        def texts() -> pa.RecordBatch:
            ids, null, tokens, there, base, score = home
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(tokens), pa.array(there), pa.array(base), pa.array(score), pa.nulls(len(ids), pa.int64())], names=names)

        for b in batches:
            for kind, grp, data in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                if kind == TYPES:
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds[:-1]], pa.array(np.frombuffer(data, np.int64))], names=names)
                    continue
                if grp != current:
                    if home is not None:
                        yield texts()
                    if kind != HOME:
                        raise RuntimeError("the texts came in another order when they were read again")
                    current, home = grp, [x.copy() for x in _opened(data, *HOME_KINDS)]
                    continue
                doc, *more = _opened(data, np.uint16, np.int64, np.float64, np.float64)
                for column, x in zip(home[3:], more, strict=True):
                    column[doc] += x
        if home is not None:
            yield texts()

    schema = "doc_id long, n_tokens long, n_known long, base double, score double, types long"
    return parcels.repartition("grp").sortWithinPartitions("grp", "kind").mapInArrow(run, schema)


def scored(docs: DataFrame, train: Column, min_count: int = MIN_COUNT, penalty: float = PENALTY) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; `train` marks the rows to learn from."""
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return _scores(docs, train, min_count, penalty)


def _scores(docs: DataFrame, train: Column, min_count: int, penalty: float) -> DataFrame:
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "suffix-tree")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    heavy, size = heavy_words(rows)
    counts = scratch.save(corpus_counts(rows, heavy, 1 + size // WINDOW_BYTES), "counts")
    by_kind = {}
    for r in counts.filter(F.col("kind") != WINDOWS).collect():  # bounded by the numbers of symbols and of heavy words
        by_kind.setdefault(r["kind"], []).append(_unpack(r["data"]))
    by_kind = {k: _sums(*(np.concatenate(x) for x in zip(*parts, strict=True))) for k, parts in by_kind.items()}
    none = np.zeros(0, U64), np.zeros(0, np.int64)
    facts = dict(zip(*(x.tolist() for x in by_kind.get(FACTS, none)), strict=True))
    tokens, train_tokens, train_texts = (facts.get(k, 0) for k in range(3))
    heavy_counts = np.zeros(len(heavy), np.int64)
    found, n = by_kind.get(FREQUENT, none)
    heavy_counts[np.searchsorted(heavy, found)] = n

    grams = counts.filter(F.col("kind") == WINDOWS)
    top = top_of(*by_kind.get(SHORTS, none))
    tree = scratch.save(tree_nodes(grams, top, min_count, penalty), "tree")
    # The trie takes the contexts above a count that so many contexts reach, the middle those above a lower one.
    room = [HOT_CELLS // (1 + int((top.root > top.root.min()).sum())) - sum(int((c >= min_count).sum()) for c in top.counts[1:]), MIDDLE_BYTES]
    by_count = tree.groupBy(F.floor(8 * F.log2("c")).cast("int").alias("b")).agg(F.count("*").alias("n"), F.sum(MIDDLE_NODE + 4 * F.length("symbols")).alias("size")).collect()
    least = [1 << 62, 1 << 62]
    for r in sorted(by_count, reverse=True):
        tier = 0 if room[0] >= r["n"] else 1
        room[0] = room[0] - r["n"] if not tier else -1
        room[1] -= r["size"] if tier else 0
        if room[1] < 0:
            break
        for i in range(tier, 2):
            least[i] = math.ceil(2 ** (r["b"] / 8))
    model = spark.sparkContext.broadcast(fitted(tree, top, *least, min_count))
    scratch.drop("counts")

    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    parcels = read_texts(rows, model, heavy, heavy_counts, buckets).unionByName(tail_nodes(tree, least[1], buckets))
    out = scratch.save(assembled(resolved(parcels)), "rows")
    model.destroy()
    scratch.drop("tree")
    types = (out.agg(F.sum("types")).first()[0] or 0) + int((heavy_counts > 0).sum()) + (1 if train_texts else 0)
    norm = math.log10(train_tokens + 0.5 * (types + 1))
    return out.filter("types is null").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.lit(1 if train_texts else 0)).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(math.log10(train_texts + 0.5)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
    )


def op8_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    out = scored(documents(spark, sf_dir), ~is_held_out(F.col("doc_id")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
