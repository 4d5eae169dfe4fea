"""Periodic runs of words: stretches that repeat themselves at least three times, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) that no word beside it
extends, of at least MIN_LENGTH words and three periods. Block matching finds them all: at scale s, a power of two, the text
is cut into aligned blocks of s words. A run of period q in [s, 2s) is at least 3q long, so one of the blocks lies in its
first 2s - 1 words and comes again q words later, still in the run; with blocks of BASE words this also holds for every shorter
period, as 2 * BASE - 1 + q <= MIN_LENGTH. The blocks of a scale are the keys (sequences of integers) of one Aho-Corasick automaton, the text is searched once
for all of them, and an occurrence at a distance of the scale is a seed, extended to both sides word by word as far as the
period holds. Blocks that can't come again within 2s words (a pair of their words doesn't) are not searched for.

A seed inside a stretch found before whose period divides its own distance would give the same stretch and is passed over.
That leaves one extension for each stretch, and of the periods of a stretch the smallest: scales and distances ascend.

A text is one row and one task's work. The keys of a scale are BASE numbers long, numbers of stretches of s / BASE words told apart
by prefix doubling, so an automaton has fewer nodes than the text has words.

Cases: a null, empty or blank text has no words and no run, its collapsed text is empty; repeated rows and rows with null ids are
treated alike, each by itself; ties between runs of the same exponent go to the smallest start, then period; texts of any
length are searched whole; the caller's columns stay, and new ones get underscores where a name is taken; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import halves
from .common import documents, free_name, let

MIN_LENGTH, MIN_PERIODS = 24, 3
#: No stretch has this number (the largest that a key may hold).
NOTHING = 2**32 - 1
#: The smallest blocks, for periods below 2 * BASE: the largest power of two with 2 * BASE - 1 + MIN_LENGTH / MIN_PERIODS <= MIN_LENGTH.
BASE = 8
PART_BYTES = 4 << 20
NO_SPACE = "[^\\x20\\x09-\\x0D]+"
WORD = re.compile(NO_SPACE)


def numbered(words: list[str]) -> np.ndarray:
    """Equal words have equal numbers."""
    number = dict(zip(dict.fromkeys(words), count(), strict=False))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _returns(ids: np.ndarray) -> np.ndarray:
    """How many words after place i the pair of words there starts again (a large number: never)."""
    pairs = ids[:-1] * (ids.max() + 1) + ids[1:]
    order = np.argsort(pairs, kind="stable")
    same = pairs[order[1:]] == pairs[order[:-1]]
    out = np.full(len(pairs), np.iinfo(np.int64).max)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _doubled(names: np.ndarray, t: int) -> np.ndarray:
    """Numbers of the stretches of 2t words from numbers of those of t words: equal stretches, equal numbers."""
    first, second = names[:-t], names[t:]
    return np.unique(first * (names.max() + 1) + second, return_inverse=True)[1] if len(first) else names[:0]


def _matches(names: np.ndarray, blocks: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of all occurrences of the blocks (starts, multiples of s) at distances of the scale.

    names are the numbers of all stretches of s / BASE words. A key is the BASE stretches of a block, and the text is read in
    s / BASE turns, each from another first word on, so keys and failure links stay short at every scale.
    """
    t = s // BASE
    automaton, number, owner = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}, np.full(len(names) // s + 2, -1)
    for p, key in zip(blocks.tolist(), map(tuple, names[blocks[:, None] + np.arange(BASE) * t].tolist()), strict=True):
        if key not in number:
            number[key] = len(number)
            automaton.add_word(key, number[key])
        owner[p // s] = number[key]
    automaton.make_automaton()
    starts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # The stretches in which the blocks may come again: each block and 2s words after it, joined where they touch.
    cuts = [*np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 4 * s) > 3 * s).tolist(), len(blocks)]
    for lo, hi in pairwise(cuts):
        a = int(blocks[lo])
        part = names[a : int(blocks[hi - 1]) + 3 * s]
        turns = np.full((-(-len(part) // t) + 1) * t, NOTHING)
        turns[: len(part)] = part
        turns = turns.reshape(-1, t).T
        found = np.array(list(automaton.iter(tuple(turns.ravel().tolist()))), np.int64).reshape(-1, 2)
        turn, place = np.divmod(found[:, 0], turns.shape[1])
        starts.append(a + (place - (BASE - 1)) * t + turn)
        keys.append(found[:, 1])
    start, key = np.concatenate(starts), np.concatenate(keys)
    out = []
    for least, back in ((s, 0),) if s > BASE else ((1, 0), (1, s)):
        p = (start - least) // s * s - back
        ok = (p >= 0) & (start - p < 2 * s)
        ok[ok] = owner[p[ok] // s] == key[ok]
        out.append((p[ok], (start - p)[ok]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _agree(one: np.ndarray, other: np.ndarray) -> int:
    """How many of the first elements are the same; looks at twice as many each time."""
    n, at, step = min(len(one), len(other)), 0, 64
    while at < n:
        differ = one[at : min(n, at + step)] != other[at : min(n, at + step)]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + len(differ), 2 * step
    return n


def _inside(p: np.ndarray, end: np.ndarray, stretches: np.ndarray) -> np.ndarray:
    """Which of [p, end) lie in one of the stretches (rows start, end)."""
    stretches = stretches[np.argsort(stretches[:, 0], kind="stable")]
    furthest = np.maximum.accumulate(stretches[:, 1])
    k = np.searchsorted(stretches[:, 0], p, "right") - 1
    return (k >= 0) & (furthest[np.maximum(k, 0)] >= end)


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(ids)
    if n < MIN_LENGTH:
        return []
    back = _returns(ids)
    if back.min() > n:
        return []
    stretches, s, names, t = np.zeros((0, 3), np.int64), BASE, ids, 1  # start, end, period; names of t words
    while s == BASE or MIN_PERIODS * s <= n:
        rows = n // s
        fits = np.concatenate([back, back[-1:]])[: rows * s].reshape(rows, s)[:, : s - 1].max(axis=1) < 2 * s
        blocks = np.flatnonzero(fits) * s
        length = stretches[:, 1] - stretches[:, 0]
        known = stretches[(length >= np.maximum(MIN_LENGTH, MIN_PERIODS * stretches[:, 2])) & (stretches[:, 2] <= s)]
        if len(blocks) and len(known):  # what comes again inside a run comes after whole periods
            blocks = blocks[~_inside(blocks, np.minimum(blocks + 3 * s, n), known)]
        if len(blocks):
            while BASE * t < s:
                names, t = _doubled(names, t), 2 * t
            p, d = _matches(names, blocks, s)
            order = np.lexsort((p, d))
            p, d = p[order], d[order]
            long = stretches[stretches[:, 1] - stretches[:, 0] >= s + 1]
            for a, b, q in long[np.argsort(long[:, 0] - long[:, 1], kind="stable")][:32].tolist():
                rest = ~((p >= a) & (p + s + d <= b) & (d % q == 0))
                p, d = p[rest], d[rest]
            new: list[tuple[int, int, int]] = []
            cuts = [*np.flatnonzero(np.diff(d, prepend=-1)).tolist(), len(d)]
            for lo, hi in pairwise(cuts):
                q, mine = int(d[lo]), p[lo:hi]
                known = np.concatenate([long, np.array(new, np.int64).reshape(-1, 3)])
                known = known[q % known[:, 2] == 0]
                if len(known):
                    mine = mine[~_inside(mine, mine + s + q, known)]
                end = 0
                for at in mine.tolist():
                    if at + s + q <= end:
                        continue
                    right = at + s + _agree(ids[at + s :], ids[at + s + q :])
                    left = at - _agree(ids[:at][::-1], ids[q : at + q][::-1])
                    end = right + q
                    new.append((left, end, q))
            stretches = np.concatenate([stretches, np.array(new, np.int64).reshape(-1, 3)])
        s *= 2
    length = stretches[:, 1] - stretches[:, 0]
    kept = stretches[length >= np.maximum(MIN_LENGTH, MIN_PERIODS * stretches[:, 2])]
    return sorted((a, b - a, q) for a, b, q in kept.tolist())


def steepest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __n_words, __runs (by start, then period), __steepest and __collapsed: the words left, joined by one space,
    when of each run only the first period is kept."""
    names = [free_name(docs, c) for c in ("__n_words", "__runs", "__steepest", "__collapsed")]
    kinds = (T.LongType(), T.ArrayType(RUN), RUN, T.StringType())
    column = docs.columns.index(text)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in halves(whole, column, PART_BYTES):
                n_words, found, best, collapsed = [], [], [], []
                for value in batch.column(column).to_pylist():
                    words = WORD.findall(value or "")
                    runs = runs_of(numbered(words))
                    if runs:
                        gone = np.zeros(len(words) + 1, np.int64)
                        for start, length, period in runs:
                            gone[start + period] += 1
                            gone[start + length] -= 1
                        words, n = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g], len(words)
                    else:
                        n = len(words)
                    n_words.append(n)
                    found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    top = steepest(runs)
                    best.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                    collapsed.append(" ".join(words))
                new = [pa.array(n_words, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(names, kinds, strict=True))])
    return docs.mapInArrow(search, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which documents chosen by the crc32 of their id repeat a stretch of theirs to the end, as the query's contract says."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(NO_SPACE), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.array_join(F.transform(place, lambda i: F.get(w, i.cast("int"))), " ")

    chosen = (F.pmod(h, F.lit(10)) == 0) & text.rlike(NO_SPACE)
    return F.when(chosen, let(words, repeated)).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.col("__steepest")
    lines = F.array_join(F.transform("__runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    every = F.when(F.size("__runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return periodic_runs(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("__runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * __steepest.length div __steepest.period").alias("exponent_milli"),
        F.sha2(every, 256).alias("runs_sha256"),
        F.sha2("__collapsed", 256).alias("collapsed_sha256"),
    )
