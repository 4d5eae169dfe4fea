"""Haplotype origins and breakpoints against plain Python."""

import random

from helixframe.operators import composites

PARENTS = {"F1": "Father", "F2": "Father", "M1": "Mother", "M2": "Mother"}


def plain(bins):
    """bins: {bin: {label: identity}} in order."""
    four, last = [], "Unknown"
    for b in sorted(bins):
        v = {x: bins[b].get(x, 0.0) for x in PARENTS}
        best = max(v.values())
        near = [x for x in PARENTS if abs(v[x] - best) <= 1e-6]
        last = near[0] if best > 0 and len(near) == 1 else last
        four.append(last)
    n = {s: sum(PARENTS.get(f) == s for f in four) for s in ("Father", "Mother")}
    parent = "Unknown" if n["Father"] == n["Mother"] else max(n, key=n.get)
    out, carried = [], "Unknown"
    for b, f in zip(sorted(bins), four):
        own = [x for x in PARENTS if PARENTS[x] == parent]
        two = "Unknown"
        if own:
            one, other = (bins[b].get(x, 0.0) for x in own)
            two = "Unknown" if abs(one - other) <= 1e-6 else own[0] if one > other else own[1]
        carried = carried if two == "Unknown" else two
        out.append((b, f, n["Father"], n["Mother"], parent, two, carried))
    return out


def test_trio_origins(spark):
    rng = random.Random(8)
    haps = {}
    for h in range(30):
        lean = rng.choice(["F", "M", ""])
        haps[h] = {b: {x: rng.choice([0.0, 0.9, 0.95, 0.99, 0.99 + 5e-7]) + (0.5 if x.startswith(lean) and lean and rng.random() < 0.3 else 0) for x in PARENTS if rng.random() < 0.8} for b in range(0, 400, 10)}
    haps[30] = {b: {"F1": 0.0} for b in range(3)}
    rows = [(h, b, x, v) for h, bins in haps.items() for b, cells in bins.items() for x, v in cells.items()]
    rows += [(h, b, x, v / 2) for h, b, x, v in rows[:200]]  # the best of several hits counts
    df = spark.createDataFrame(rows, "hap int, bin int, label string, identity double").repartition(4)
    got = {}
    for r in composites.trio_origins(df, ["hap"], "bin", "label", "identity", PARENTS).collect():
        got.setdefault(r["hap"], []).append((r["bin"], r["four_way"], r["Father_bins"], r["Mother_bins"], r["parent"], r["constrained"], r["constrained_carried"]))
    for h, bins in haps.items():
        assert sorted(got[h]) == plain({b: c for b, c in bins.items() if c})
    assert {r[4] for rs in got.values() for r in rs} == {"Father", "Mother", "Unknown"}
