"""Numpy views of a batch of texts: bytes, documents, words and window hashes without Python loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

U64 = np.uint64
_rng = np.random.default_rng(20240229)
#: A random value for each byte and an odd base: the hash of bytes b_i..b_j is sum TABLE[b_k] * BASE^(k-i) mod 2^64.
TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = int(_rng.integers(0, 2**63, dtype=np.int64)) * 2 + 1
INVERSE = pow(BASE, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place where it can)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    if n:
        out[0] = 1
        out[1:] = U64(base)
        np.multiply.accumulate(out, out=out)
    return out


class Texts:
    """The bytes of a column of texts (null: none), one after the other."""

    def __init__(self, column: pa.Array, lower: bool = False):
        filled = column.cast(pa.large_string()).fill_null("")
        if isinstance(filled, pa.ChunkedArray):
            filled = filled.combine_chunks()
        n, at = len(filled), filled.offset
        off = np.frombuffer(filled.buffers()[1], np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
        whole = filled.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[off[0] : off[-1]] if whole is not None and n else np.zeros(0, np.uint8)
        self.offsets = (off - off[0]).astype(np.int64)
        self.data = LOWER[data] if lower else data
        self.n = n

    def prefix(self) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of the window hash and the powers that shift a window to its start."""
        m = len(self.data)
        total = np.zeros(m + 1, U64)
        terms = TABLE[self.data]
        terms *= powers(BASE, m)
        np.cumsum(terms, out=total[1:])
        return total, powers(INVERSE, m + 1)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the number of words in each text."""
        m = len(self.data)
        word = np.zeros(m + 2, bool)
        word[1:-1] = ~SPACE[self.data]
        first = np.zeros(m + 2, bool)
        first[self.offsets + 1] = True
        begins = np.flatnonzero(word[1:-1] & (~word[:-2] | first[1:-1]))
        ends = np.flatnonzero(word[1:-1] & (~word[2:] | first[2:])) + 1
        per = np.diff(np.searchsorted(begins, self.offsets))
        return begins, ends, per


def halves(batch: pa.RecordBatch, column: int, most: int) -> list[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of the column (a longer text is a part of its own)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    parts, start, total = [], 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            parts.append(batch.slice(start, i - start))
            start, total = i, 0
        total += s
    if start < batch.num_rows:
        parts.append(batch.slice(start))
    return parts
