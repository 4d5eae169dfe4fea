"""Report rules, nearest boundaries and count models on small tables with known answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import numeric
from helixframe.operators import models, ordered, rules


def test_rearrangement_qc(spark):
    rows = [("a", "target", "PGA"), ("a", "anchor", "VPS"), ("a", "non_target", "vps"), ("a", "non_target", "X1"), ("a", "non_target", "X2"), ("b", "target", "PGA"), ("c", "non_target", "Z")]
    units = spark.createDataFrame([("a", "complete"), ("a", "weak"), ("z", "weak")], "asm string, st string")
    out = rules.rearrangement_qc(spark.createDataFrame(rows, "asm string, kind string, label string"), units, "asm", "kind", "label", "st", ["complete", "weak"], least_labels=2, least_share=0.7)
    got = {r["asm"]: tuple(r)[1:] for r in out.collect()}
    assert got == {
        "a": (5, 1, 1, 3, 0.6, 2, "X1;X2", True, "labels>=2", 2, 1, 1),
        "b": (1, 1, 0, 0, 0.0, 0, "NA", False, "NA", 0, 0, 0),
        "c": (1, 0, 0, 1, 1.0, 1, "Z", True, "share>=0.7", 0, 0, 0),
    }


def test_endpoints_and_populations(spark):
    e = spark.createDataFrame([("h", "Alu", "Alu"), ("h", "Alu", None), ("h", None, "L1"), ("m", "L1", "Alu")], "s string, a string, b string")
    got = {r["s"]: tuple(r)[1:] for r in rules.endpoint_summary(e, ["s"], "a", "b", "Alu").collect()}
    assert got == {"h": (3, 1, 1 / 3, 2, 2 / 3, 1, 1 / 3), "m": (1, 0, 0.0, 1, 1.0, 0, 0.0)}
    assert {tuple(r) for r in rules.endpoint_configurations(e, [], "a", "b").collect()} == {("Alu", "Alu", 1), ("Alu", "none", 1), ("none", "L1", 1), ("L1", "Alu", 1)}
    p = spark.createDataFrame([(x,) for x in ("AFR", "AFR-W", "AFRO", "EUR-N", "EUR", "", None)], "p string")
    pick = lambda w: [r["p"] for r in p.filter(rules.in_population(F.col("p"), w)).collect()]
    assert (pick("AFR"), pick("EUR"), pick("")) == (["AFR", "AFR-W"], ["EUR"], [])


def test_track_rows(spark):
    order = spark.createDataFrame([("h1", 1), ("h2", 2)], "hap string, ordinal int")
    f = spark.createDataFrame([("h1", 10, 30, "SINE/Alu"), ("h1", 50, 90, "x"), ("h2", 0, 5, "LINE/L1"), ("h9", 0, 5, "x")], "hap string, s int, e int, fam string")
    got = sorted(tuple(r) for r in rules.track_rows(f, order, "hap", "s", "e", [("Alu", "Alu"), ("L1", "L1")], "fam", 0.22).select("hap", "s", "y", "mid", "kind", "label_at").collect())
    assert got == [("h1", 10, 2.22, 20.0, "Alu", 90), ("h1", 50, 2.22, 70.0, "Other", 90), ("h2", 0, 1.22, 2.5, "L1", 5)]


def test_recombinant_candidates(spark):
    rng = random.Random(3)
    labels = ["A", "B", "C", "NA", None, " A "]
    clean = lambda x: "" if x is None or x.strip() in ("", "NA") else x.strip()
    one = {f"h{k}": (rng.choice("xyz"), rng.choice(labels)) for k in range(60)}
    other = {f"h{k}": (rng.choice("pq"), rng.choice(labels)) for k in range(5, 70)}
    major1, major2 = {"x": "A", "y": "B", "z": "A"}, {"p": "B", "q": "C"}
    frame = lambda d, m: spark.createDataFrame([(h, g, m[g], x) for h, (g, x) in d.items()], "hap string, g string, major string, member string")
    want = {}
    for h in one.keys() & other.keys():
        (u, mu), (v, mv) = one[h], other[h]
        seen = clean(mu) or clean(mv)
        if seen not in (major1[u], major2[v]):
            both = sorted(one.keys() & other.keys())
            left = [k for k in both if k != h and one[k][0] == u and clean(one[k][1]) == major1[u] and other[k][0] != v]
            right = [k for k in both if k != h and other[k][0] == v and clean(other[k][1]) == major2[v] and one[k][0] != u]
            want[h] = (seen, u, v, left, right)
    got = {r["hap"]: (r["observed"], r["g1"], r["g2"], r["left"], r["right"]) for r in rules.recombinant_candidates(frame(one, major1), frame(other, major2), "hap", "g", "major", "member").collect()}
    assert got == want and len(want) > 5


def test_nearest_boundary(spark):
    rng = random.Random(6)
    points = [(rng.choice("ab"), rng.randint(0, 5000), k) for k in range(600)] + [("none", 3, 999)]
    bounds = [(rng.choice("ab"), rng.randint(0, 5000)) for _ in range(150)] + [("a", 10), ("a", 10), ("a", 20)]
    points += [("a", 15, 1000), ("a", 10, 1001)]
    near = {}
    for key, p, k in points:
        own = sorted(b for c, b in bounds if c == key)
        if own:
            best = min(own, key=lambda b: (abs(b - p), b))
            near[k] = (best, abs(best - p))
    a, b = spark.createDataFrame(points, "key string, p int, id int"), spark.createDataFrame(bounds, "key string, p int")
    pick = lambda df: {r["id"]: (r["boundary"], r["distance"]) for r in df.collect()}
    assert pick(ordered.nearest_boundary(a, b, ["key"], "p")) == near
    assert pick(ordered.nearest_boundary(a, b, ["key"], "p", 5)) == {k: v for k, v in near.items() if v[1] <= 5}


def test_count_models(spark):
    rng = np.random.default_rng(2)
    n = 400
    x, t = rng.normal(size=(n, 2)), rng.uniform(1, 5, n)
    y = rng.negative_binomial(1.7, 1.7 / (1.7 + t * np.exp(0.4 + 0.6 * x[:, 0] - 0.3 * x[:, 1])))
    df = spark.createDataFrame([(int(a), float(b), *map(float, c)) for a, b, c in zip(y, t, x)] + [(None, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 1.0)], "y int, t double, a double, b double")
    fit = models.CountModel(df, "y", "t", ["a", "b"])
    for got, want in ((fit.poisson(), numeric.count_model(x, y, t)), (fit.chosen(), numeric.chosen_count_model(x, y, t))):
        assert np.allclose(got["beta"], want["beta"], atol=1e-5) and np.allclose(got["se"], want["se"], rtol=1e-4)
        assert got["loglik"] == pytest.approx(want["loglik"], abs=1e-6) and got["aic"] == pytest.approx(want["aic"], abs=1e-5)
        assert got["family"] == want.get("family", "Poisson")
    assert fit.chosen()["theta"] == pytest.approx(numeric.chosen_count_model(x, y, t)["theta"], rel=1e-4)
    assert np.allclose(numeric.polygamma(np.array([1.0, 0.5, 30.0]), 0), [-0.5772156649015329, -1.9635100260214235, 3.384438142108418], atol=1e-13)
    assert np.allclose(numeric.polygamma(np.array([1.0, 0.5]), 1), [np.pi**2 / 6, np.pi**2 / 2], atol=1e-13)
    with pytest.raises(ValueError):
        models.CountModel(df.limit(0), "y", "t", [])
