"""Rooted trees as edge tables (child, parent, length, label), and their small-matrix models.

Trees have at most a few thousand nodes; closures run as joins so that the rows they are joined with may be large.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_NODES = 20_000


def parse_newick(text: str) -> list[tuple[int, int | None, float, str]]:
    """(node, parent, length, label) of every node, parents first."""
    rows: list[list] = [[0, None, 0.0, ""]]
    at, i = 0, 0
    while i < len(text) and text[i] != ";":
        c = text[i]
        if c in "(,":
            parent = at if c == "(" else rows[at][1]
            rows.append([len(rows), parent, 0.0, ""])
            at, i = len(rows) - 1, i + 1
        elif c == ")":
            at, i = rows[at][1], i + 1
        elif c == "'":
            end = text.index("'", i + 1)
            rows[at][3], i = text[i + 1 : end], end + 1
        elif c == ":":
            end = i + 1
            while text[end] not in "(),;":
                end += 1
            rows[at][2], i = float(text[i + 1 : end]), end
        elif c.isspace():
            i += 1
        else:
            end = i
            while text[end] not in "(),:;":
                end += 1
            rows[at][3], i = text[i:end].strip(), end
    return [tuple(r) for r in rows]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """The tree of a file of at most MAX_NODES lines; a longer one is an error."""
    lines = spark.read.text(path).limit(MAX_NODES + 1).collect()
    if len(lines) > MAX_NODES:
        raise ValueError(f"{path} has more than {MAX_NODES} lines")
    text = "".join(r[0] for r in lines)
    return spark.createDataFrame(parse_newick(text), "node int, parent int, length double, label string")


def pruned(rows: list[tuple], tips: set[str]) -> list[tuple[int, int | None, float, str]]:
    """The tree of the given tips: nodes with one child are taken out and their lengths added."""
    children: dict[int | None, list[tuple]] = {}
    for r in rows:
        children.setdefault(r[1], []).append(r)
    out: list[tuple] = []

    def keep(row: tuple, parent: int | None, length: float) -> None:
        below = [c for c in children.get(row[0], []) if holds(c)]
        if len(below) == 1:
            keep(below[0], parent, length + below[0][2])
            return
        node = len(out)
        out.append((node, parent, length, row[3]))
        for c in below:
            keep(c, node, c[2])

    def holds(row: tuple) -> bool:
        kids = children.get(row[0], [])
        return any(map(holds, kids)) if kids else row[3] in tips

    keep(children[None][0], None, 0.0)
    return out


def ancestors(edges: DataFrame, child: str = "node", parent: str = "parent") -> DataFrame:
    """(node, ancestor, steps) for every node and each ancestor, itself at 0 steps; doubling keeps it to log(depth) joins
    and ends when no node has an ancestor further up. A cycle raises ValueError."""
    up = edges.filter(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("steps"))
    nodes = edges.select(F.col(child).alias("node")).union(edges.filter(F.col(parent).isNotNull()).select(parent)).distinct()
    known = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps"))
    durable = edges.sparkSession.sparkContext.getCheckpointDir() or edges.sparkSession.conf.get("spark.checkpoint.dir", None)
    keep = (lambda df: df.checkpoint()) if durable else (lambda df: df.persist())
    jump, reach, size = keep(up), 1, nodes.count()
    while not jump.isEmpty():
        if reach >= size:
            raise ValueError("the tree has a cycle")
        more = known.join(jump.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("__a"), F.col("steps").alias("__s")), "ancestor")
        known = known.unionByName(more.select("node", F.col("__a").alias("ancestor"), (F.col("steps") + F.col("__s")).alias("steps"))).distinct()
        jump = keep(jump.join(jump.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("__a"), F.col("steps").alias("__s")), "ancestor").select("node", F.col("__a").alias("ancestor"), (F.col("steps") + F.col("__s")).alias("steps")))
        reach *= 2
    return known


def nearest_ancestor(closure: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, nearest): the nearest proper ancestor in `marked` (node), null without one."""
    hits = closure.filter("steps > 0").join(marked.select(F.col("node").alias("ancestor")), "ancestor")
    best = hits.groupBy("node").agg(F.min_by("ancestor", "steps").alias("nearest"))
    return closure.filter("steps = 0").select("node").join(best, "node", "left")


def node_orders(closure: DataFrame, tips: DataFrame) -> DataFrame:
    """node, order, order_set: the order of the tips (node, order) below a node; Mixed if they have several, Unknown if none is known."""
    own = closure.join(tips.select("node", "order"), "node").groupBy("ancestor").agg(F.array_sort(F.collect_set("order")).alias("o"))
    known = closure.filter("steps = 0").select("node").join(own.withColumnRenamed("ancestor", "node"), "node", "left").withColumn("o", F.coalesce("o", F.array().cast("array<string>")))
    one = F.when(F.size("o") == 0, "Unknown").when(F.size("o") == 1, F.get("o", F.lit(0)))
    return known.select("node", one.otherwise("Mixed").alias("order"), F.when(F.size("o") == 0, "Unknown").otherwise(F.array_join("o", ",")).alias("order_set"))


def episodes(branches: DataFrame, closure: DataFrame, tips: DataFrame) -> DataFrame:
    """Independent episodes of the branches (node, gain, ...) with a gain: a branch belongs to its nearest ancestor with a gain, or is a
    root itself. root, branches, total_gain, most_gain, order, order_set, tips, member_orders."""
    gains = branches.filter("gain > 0").select("node", "gain")
    above = nearest_ancestor(closure, gains.select("node")).join(gains, "node")
    orders = node_orders(closure, tips)
    members = above.select(F.coalesce("nearest", "node").alias("root"), "node", "gain").join(orders.select("node", "order"), "node")
    summed = members.groupBy("root").agg(F.count("*").alias("branches"), F.sum("gain").alias("total_gain"), F.max("gain").alias("most_gain"), F.array_join(F.array_sort(F.collect_set("order")), ",").alias("member_orders"))
    below = clade_members(closure, tips).groupBy("ancestor").agg(F.count("*").alias("tips"))
    return summed.join(orders.withColumnRenamed("node", "root"), "root").join(below.withColumnRenamed("ancestor", "root"), "root")


def clade_members(closure: DataFrame, tips: DataFrame) -> DataFrame:
    """(ancestor, tip) for the tips (node) below each node."""
    return closure.join(tips.select("node"), "node").select("ancestor", F.col("node").alias("tip"))


def monophyletic(closure: DataFrame, members: DataFrame) -> DataFrame:
    """members (node, cluster) -> cluster, size, clade_size, monophyletic: whether the smallest clade that holds a cluster holds nothing else."""
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    shared = members.join(closure, "node").groupBy("cluster", "ancestor").agg(F.count("*").alias("n")).join(size, "cluster").filter("n = size")
    clades = clade_members(closure, members).groupBy("ancestor").agg(F.count("*").alias("clade_size"))
    best = shared.join(clades, "ancestor").groupBy("cluster", "size").agg(F.min("clade_size").alias("clade_size"))
    return best.withColumn("monophyletic", F.col("size") == F.col("clade_size"))


def patristic(closure: DataFrame, depth: DataFrame, tips: DataFrame) -> DataFrame:
    """(a, b, distance) of tips: depth(a) + depth(b) - 2 * the depth of their deepest common ancestor."""
    up = clade_members(closure, tips).join(depth.select(F.col("node").alias("ancestor"), F.col("depth").alias("d")), "ancestor")
    a, b = up.select(F.col("tip").alias("a"), "ancestor", "d"), up.select(F.col("tip").alias("b"), "ancestor")
    lca = a.join(b, "ancestor").filter("a < b").groupBy("a", "b").agg(F.max("d").alias("lca"))
    d = depth.select("node", "depth")
    out = lca.join(d.select(F.col("node").alias("a"), F.col("depth").alias("da")), "a").join(d.select(F.col("node").alias("b"), F.col("depth").alias("db")), "b")
    return out.select("a", "b", (F.col("da") + F.col("db") - 2 * F.col("lca")).alias("distance"))


def brownian_states(rows: list[tuple], values: dict[str, float]) -> dict[int, float]:
    """Most likely values of all nodes under Brownian motion: the weighted-Laplacian solution with tips fixed."""
    tips = {r[0]: float(values[r[3]]) for r in rows if r[3] in values}
    inner = [r[0] for r in rows if r[0] not in tips]
    spot = {n: k for k, n in enumerate(inner)}
    a, b = np.zeros((len(inner), len(inner))), np.zeros(len(inner))
    for node, parent, length, _ in rows:
        if parent is None:
            continue
        w = 1.0 / max(length, 1e-12)
        for u, v in ((node, parent), (parent, node)):
            if u in spot:
                a[spot[u], spot[u]] += w
                if v in spot:
                    a[spot[u], spot[v]] -= w
                else:
                    b[spot[u]] += w * tips[v]
    return tips | dict(zip(inner, np.linalg.solve(a, b).tolist(), strict=True))


def equal_rates_states(rows: list[tuple], values: dict[str, str]) -> tuple[float, dict[int, str]]:
    """Rate and most probable states of all nodes under one rate between any two states (marginal, flat root)."""
    states = sorted(set(values.values()))
    k = len(states)
    kids: dict[int, list[tuple]] = {}
    for r in rows:
        if r[1] is not None:
            kids.setdefault(r[1], []).append(r)
    order = [r[0] for r in rows]

    def move(rate: float, t: float) -> np.ndarray:
        stay = math.exp(-k * rate * t)
        return np.full((k, k), (1 - stay) / k) + np.eye(k) * stay

    def down(rate: float) -> tuple[float, dict[int, np.ndarray]]:
        part, log = {}, 0.0
        label = {r[0]: r[3] for r in rows}
        for node in reversed(order):
            if node in kids:
                p = np.ones(k)
                for c in kids[node]:
                    p = p * (move(rate, c[2]) @ part[c[0]])
            else:
                p = np.array([1.0 if s == values.get(label[node]) else 0.0 for s in states]) if label[node] in values else np.ones(k)
            total = p.sum()
            part[node], log = p / total, log + math.log(total)
        return log, part

    low, high, golden = math.log(1e-6), math.log(1e3), (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if down(math.exp(a))[0] > down(math.exp(b))[0] else (a, high)
    rate = math.exp((low + high) / 2)
    _, part = down(rate)
    up = {rows[0][0]: np.ones(k)}
    for node in order:
        for c in kids.get(node, []):
            outside = up[node].copy()
            for other in kids[node]:
                if other[0] != c[0]:
                    outside = outside * (move(rate, other[2]) @ part[other[0]])
            v = move(rate, c[2]).T @ outside
            up[c[0]] = v / v.sum()
    return rate, {n: states[int((part[n] * up[n]).argmax())] for n in order}


def phylogenetic_covariance(rows: list[tuple], tips: list[str]) -> np.ndarray:
    """Shared path length from the root for each pair of tips."""
    parent, length = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    node = {r[3]: r[0] for r in rows if r[3]}
    paths = []
    for t in tips:
        path, n = [], node[t]
        while n is not None:
            path.append(n)
            n = parent[n]
        paths.append(set(path))
    return np.array([[sum(length[n] for n in a & b) for b in paths] for a in paths])


def phylogenetic_regression(rows: list[tuple], tips: list[str], x: np.ndarray, y: np.ndarray) -> dict:
    """Generalised least squares with Pagel's lambda by maximum likelihood: lambda, coefficients, t and AIC."""
    full = phylogenetic_covariance(rows, tips)
    design, n = np.column_stack([np.ones(len(y)), x]), len(y)

    def fit(lam: float):
        v = full * lam
        np.fill_diagonal(v, np.diag(full))
        c = np.linalg.cholesky(v)
        a, b = np.linalg.solve(c, design), np.linalg.solve(c, y)
        beta, *_ = np.linalg.lstsq(a, b, rcond=None)
        rss = float(((b - a @ beta) ** 2).sum())
        return -0.5 * (n * math.log(2 * math.pi * rss / n) + n) - np.log(np.diag(c)).sum(), beta, a, rss

    low, high, golden = 0.0, 1.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if fit(a)[0] > fit(b)[0] else (a, high)
    lam = (low + high) / 2
    loglik, beta, a, rss = fit(lam)
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * rss / (n - design.shape[1]))
    return {"lambda": lam, "beta": beta, "se": se, "t": beta / se, "aic": 2 * design.shape[1] - 2 * float(loglik)}
