"""Plain Python versions of the corpus operators, for small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def near_components(docs, size, share):
    sets = {i: shingle_set(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(docs, length=50):
    """(n_bytes, n_removed, n_spans, sha256) of each document."""
    holders = defaultdict(set)
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for p in range(len(b) - length + 1):
            holders[b[p : p + length]].add(i)
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if min(holders[b[p : p + length]]) < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def kept_lines(docs, min_docs):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (t or "").split("\n")]
    n = Counter(k for _, t in docs for k in set(keys(t)))
    return {i: "\n".join(x for x, k in zip((t or "").split("\n"), keys(t)) if not (k and n[k] >= min_docs)) for i, t in docs}


def quality_kept(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n, chars = len(w), sum(map(len, w))
    return not (
        n < 50
        or 100 * len(covered) > 50 * n
        or not 2 * n <= chars <= 15 * n
        or 10 * len(re.findall(r"[#*$%&|<>]", text or "")) > n
        or 100 * (len(lines) - len(set(lines))) > 40 * len(lines)
        or 100 * sum(any(c.isalpha() for c in x) for x in w) < 80 * n
    )
