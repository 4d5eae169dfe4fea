"""Dosage tables (one row for each call: site, sample, dosage): linkage pruning, principal components, association.

Missing calls are rows with a null dosage or no rows. Sites and samples may number millions: work is dealt by blocks of sites and samples
whose size is a parameter, and only matrices of components by components reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric
from .ordered import cumulative
from .rounds import settled


def site_ordinals(dosages: DataFrame, group: list[str], site: str) -> DataFrame:
    """(group, site, ordinal): the places of the sites of a group, from 0, by ranges of sites."""
    sites = dosages.select(*group, site).distinct()
    return cumulative(sites, group, site, [], F.lit(1).cast("long")).select(*group, site, (F.col("total") - 1).alias("ordinal"))


#: Cells of a block's matrix of sites by samples, unless one window has more.
BLOCK_CELLS = 2_000_000


def site_calls(dosages: DataFrame, group: list[str], site: str, sample: str, dosage: str) -> DataFrame:
    """(group, site, calls): a row for each site with its calls, none of them missing."""
    call = F.when(F.col(dosage).isNotNull(), F.struct(F.xxhash64(sample).alias("s"), F.col(dosage).cast("double").alias("g")))
    return settled(dosages.groupBy(*group, site).agg(F.collect_list(call).alias("calls")))


def linked_sites(dosages: DataFrame, group: list[str], site: str, sample: str, dosage: str, window: int = 50, step: int = 5, r2: float = 0.2) -> DataFrame:
    """(group, a, b, r2): ordinals a < b of sites that some window of `window` sites, moved by `step`, holds together and whose squared
    correlation over samples called at both is above r2. Sites without variation are linked with none."""
    calls = site_calls(dosages, group, site, sample, dosage)
    return linked_calls(calls, site_ordinals(calls, group, site), group, site, window, step, r2)


def linked_calls(calls: DataFrame, sites: DataFrame, group: list[str], site: str, window: int = 50, step: int = 5, r2: float = 0.2) -> DataFrame:
    """linked_sites of calls (see site_calls) and sites (see site_ordinals)."""
    most = calls.agg(F.max(F.size("calls"))).first()[0] or 1
    size = window * max(1, min(8, BLOCK_CELLS // (window * most)))
    rows = calls.filter(F.size("calls") > 0).join(sites, [*group, site]).select(*group, "ordinal", F.col("calls.s").alias("s"), F.col("calls.g").alias("g"))
    own = F.expr(f"ordinal div {size}")
    # A site is compared in its own block, and the first window of a block with the block before.
    blocks = rows.withColumn("block", F.explode(F.when((own > 0) & (F.col("ordinal") % size < window), F.array(own, own - 1)).otherwise(F.array(own))))

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ordinal")
        at = p["ordinal"].to_numpy(np.int64)
        samples, place = np.unique(np.concatenate(p["s"].to_list()), return_inverse=True)
        x, there = np.zeros((len(p), len(samples))), np.zeros((len(p), len(samples)))
        row = np.repeat(np.arange(len(p)), p["s"].map(len))
        x[row, place], there[row, place] = np.concatenate(p["g"].to_list()), 1.0
        n, sx, sxx, sxy = there @ there.T, x @ there.T, (x * x) @ there.T, x @ x.T
        cov, var = n * sxy - sx * sx.T, n * sxx - sx * sx
        both = var * var.T
        block = int(p["block"].iloc[0])
        near = (at[None, :] - at[:, None] // step * step < window) & (at[:, None] < at[None, :]) & (at[:, None] // size == block)
        i, j = np.nonzero(near & (both > 0) & (cov * cov > r2 * both))
        out = pd.DataFrame({"a": at[i], "b": at[j], "r2": cov[i, j] ** 2 / both[i, j]})
        for c in group:
            out[c] = p[c].iloc[0]
        return out[[*group, "a", "b", "r2"]]

    keys = ", ".join(f"`{c}` {calls.schema[c].dataType.simpleString()}" for c in group)
    return blocks.groupBy(*group, "block").applyInPandas(compare, f"{keys}, a long, b long, r2 double")


CHUNK = 4096


def first_kept(sites: DataFrame, links: DataFrame, group: list[str], reach: int, chunk: int = CHUNK) -> DataFrame:
    """sites (group, ordinal, ...) with kept: in order, a site goes if a kept earlier one is linked with it (links: group, a < b < a + reach).

    Chunks of sites settle side by side what doesn't hang on undecided sites of the chunk before; rounds go on until no site is
    undecided. Their number is that of the chunks which the longest chain of links runs through, as a chunk settles whole once the one before it has.
    """
    if reach > chunk:
        raise ValueError("links must not reach over a whole chunk")
    earlier = links.groupBy(*group, F.col("b").alias("ordinal")).agg(F.collect_set("a").alias("__earlier"))
    joined = sites.select(*group, "ordinal").join(earlier, [*group, "ordinal"], "left").withColumn("chunk", F.expr(f"ordinal div {chunk}"))
    held = F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("__earlier", F.array().cast("array<bigint>")).alias("e"))))
    rows = joined.groupBy(*group, "chunk").agg(held.alias("sites"))
    rows = rows.select(*group, "chunk", F.col("sites.ordinal").alias("at"), F.col("sites.e").alias("earlier"), F.expr("transform(sites, x -> -1)").alias("state"))
    rows = settled(rows)
    schema = rows.schema

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            states = []
            for at, earlier, state, before_at, before in zip(p["at"], p["earlier"], p["state"], p["before_at"], p["before"], strict=True):
                known = dict(zip(before_at, before, strict=True)) if before_at is not None else {}
                now = []
                for o, e, s in zip(at, earlier, state, strict=True):
                    if s < 0:
                        seen = [known[a] for a in e]
                        s = 0 if 1 in seen else -1 if -1 in seen else 1
                    known[o] = s
                    now.append(int(s))
                states.append(now)
            yield p[schema.names[: len(group) + 3]].assign(state=states)

    w = Window.partitionBy(*group).orderBy("chunk")  # one row for each chunk
    while True:
        there = F.lag("chunk").over(w) == F.col("chunk") - 1
        tail = lambda c: F.when(there, F.lag(F.slice(c, -F.least(F.size(c), F.lit(reach)), F.lit(reach))).over(w))
        rows = settled(rows.withColumns({"before_at": tail("at"), "before": tail("state")}).mapInPandas(settle, schema))
        if rows.filter(F.array_contains("state", -1)).isEmpty():
            break
    flat = rows.select(*group, F.explode(F.arrays_zip("at", "state")).alias("x")).select(*group, F.col("x.at").alias("ordinal"), (F.col("x.state") == 1).alias("kept"))
    return sites.join(flat, [*group, "ordinal"])


def linkage_pruned(dosages: DataFrame, group: list[str], site: str, sample: str, dosage: str, window: int = 50, step: int = 5, r2: float = 0.2) -> DataFrame:
    """(group, site, ordinal, kept): of the sites of a window whose squared correlation is above r2, the first in order stays."""
    calls = site_calls(dosages, group, site, sample, dosage)
    sites = settled(site_ordinals(calls, group, site))
    links = settled(linked_calls(calls, sites, group, site, window, step, r2))
    return first_kept(sites, links, group, window)


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, width)


def _product(tiles: DataFrame, blocks: DataFrame, key: str, to: str, turned: bool, width: int, held: int = 256) -> DataFrame:
    """(to, m): the sum over `key` of the tiles' products with the blocks (key, m) of `width` columns; summed inside tasks first."""

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        out = lambda: pd.DataFrame({to: list(sums), "m": [m.tobytes() for m in sums.values()]})
        for p in frames:
            for k, wide, tile, m in zip(p[to], p["wide"], p["tile"], p["m"], strict=True):
                z = _matrix(tile, wide)
                part = (z.T if turned else z) @ _matrix(m, width)
                sums[k] = sums[k] + part if k in sums else part
                if len(sums) > held:
                    yield out()
                    sums.clear()
        yield out()

    def total(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({to: [p[to].iloc[0]], "m": [sum(np.frombuffer(x) for x in p["m"]).tobytes()]})

    schema = f"{to} long, m binary"
    return tiles.join(blocks, key).mapInPandas(multiply, schema).groupBy(to).applyInPandas(total, schema)


def _gram(blocks: DataFrame, width: int, other: str = "m") -> np.ndarray:
    """The matrix of `width` squared that the blocks' products with the column `other` sum to."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((width, width))
        for p in frames:
            for a, b in zip(p["m"], p[other], strict=True):
                g += _matrix(a, width).T @ _matrix(b, width)
        yield pd.DataFrame({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "v": g.ravel()})

    out = np.zeros((width, width))
    for i, j, v in blocks.mapInPandas(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = v
    return out


def _times(blocks: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    width = by.shape[0]

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            yield p[[key]].assign(m=[(_matrix(m, width) @ by).tobytes() for m in p["m"]])

    return blocks.mapInPandas(turn, f"{key} long, m binary")


def _orthonormal(blocks: DataFrame, key: str, width: int) -> tuple[DataFrame, int]:
    """Blocks of an orthonormal basis of the columns, and how many it has; twice, as one pass loses half of the digits."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(_gram(blocks, width))
        good = values > values.max() * 1e-14
        blocks, width = settled(_times(blocks, key, vectors[:, good] / np.sqrt(values[good]))), int(good.sum())
    return blocks, width


def principal_components(dosages: DataFrame, site: str, sample: str, dosage: str, k: int = 10, extra: int = 20, block: int = 512, tolerance: float = 1e-7, rounds: int = 100, seed: int = 7) -> tuple[DataFrame, list[float]]:
    """(sample, pc1 .. pck) and the eigenvalues, largest first, of the relationship matrix Z'Z / sites, where Z has (dosage - 2p) / sqrt(2p(1 - p)) of
    each varying site, 0 for missing calls.

    Subspace iteration: k + extra directions are multiplied by Z and by Z' as products of tiles of `block` sites by `block` samples and made
    orthonormal, until each of the first k has a residual below tolerance times the largest eigenvalue; ArithmeticError after `rounds`. Vectors have length 1;
    their largest entry (the first of them by sample) is positive. Fewer than k components come back if the matrix has fewer.
    """
    dosages = settled(dosages.select(site, sample, F.col(dosage).cast("double").alias("__g")))
    called = dosages.filter("__g is not null")
    p = settled(called.groupBy(site).agg((F.avg("__g") / 2).alias("__p")).filter("__p > 0 and __p < 1"))
    number = lambda df, c: settled(cumulative(df.select(c).distinct().withColumn("__h", F.xxhash64(c)), [], "__h", [F.col(c)], F.lit(1).cast("long")).select(c, (F.col("total") - 1).alias("__at")))
    sites, samples = number(p, site), number(dosages, sample)
    n_sites, n_samples = sites.count(), samples.count()
    z = (F.col("__g") - 2 * F.col("__p")) / F.sqrt(2 * F.col("__p") * (1 - F.col("__p")))
    cells = called.join(p.join(sites, site).withColumnRenamed("__at", "__r"), site).join(samples.withColumnRenamed("__at", "__c"), sample)
    cells = cells.select(F.expr(f"__r div {block}").alias("rb"), F.expr(f"__c div {block}").alias("cb"), F.expr(f"__r % {block}").alias("r"), F.expr(f"__c % {block}").alias("c"), z.alias("z"))

    def tile(x: pd.DataFrame) -> pd.DataFrame:
        rb, cb = int(x["rb"].iloc[0]), int(x["cb"].iloc[0])
        m = np.zeros((min(block, n_sites - rb * block), min(block, n_samples - cb * block)))
        m[x["r"], x["c"]] = x["z"]
        return pd.DataFrame({"rb": [rb], "cb": [cb], "wide": [m.shape[1]], "tile": [m.tobytes()]})

    tiles = settled(cells.groupBy("rb", "cb").applyInPandas(tile, "rb long, cb long, wide int, tile binary"))
    width = min(k + extra, n_samples)

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"cb": f["id"], "m": [np.random.default_rng([seed, int(b)]).normal(size=(min(block, n_samples - int(b) * block), width)).tobytes() for b in f["id"]]})

    spark = dosages.sparkSession
    basis, width = _orthonormal(settled(spark.range(-(-n_samples // block)).mapInPandas(start, "cb long, m binary")), "cb", width) if n_sites else (None, 0)
    for _ in range(rounds if n_sites else 0):
        image = settled(_product(tiles, settled(_product(tiles, basis, "cb", "rb", False, width)), "rb", "cb", True, width))
        both = basis.join(image.withColumnRenamed("m", "image"), "cb")
        projected, squared = _gram(both, width, "image") / n_sites, _gram(image, width) / n_sites**2
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        residual = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, squared, turn) - values**2, 0))
        if (residual[:k] <= tolerance * values[0]).all() or width == n_samples:
            break
        basis, width = _orthonormal(image, "cb", width)
    else:
        if n_sites:
            raise ArithmeticError(f"the components have not settled in {rounds} rounds")
    found = min(k, int((values > values[0] * 1e-10).sum())) if n_sites else 0
    if not found:
        return samples.select(sample), []
    vectors = _times(basis, "cb", turn[:, :found])

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cb, m in zip(f["cb"], f["m"], strict=True):
                m = _matrix(m, found)
                yield pd.DataFrame({"__at": cb * block + np.arange(len(m)), "__v": list(m)})

    named = settled(vectors.mapInPandas(rows, "__at long, __v array<double>").join(samples, "__at").select(sample, "__v"))
    size = lambda i: F.round(F.abs(F.col("__v")[i]), 9)
    signs = named.agg(*(F.signum(F.min_by(F.col("__v")[i], F.struct((-size(i)).alias("x"), F.col(sample).alias("y")))).alias(f"s{i}") for i in range(found))).first()
    return named.select(sample, *((F.col("__v")[i] * float(signs[i])).alias(f"pc{i + 1}") for i in range(found))), [float(v) for v in values[:found]]


def _eliminated(sums: list[list[Column]], pivots: int, n: Column) -> Column:
    """The matrix of sums after elimination of its first `pivots` rows; null if one of them hangs on those before it."""
    matrix = F.array(*(F.array(*row) for row in sums))

    def step(m: Column, k: Column) -> Column:
        top = F.element_at(m, k + 1)
        pivot = F.element_at(top, k + 1)
        below = F.transform(m, lambda row, i: F.when(i <= k, row).otherwise(F.zip_with(row, top, lambda x, y: x - F.element_at(row, k + 1) * y / pivot)))
        return F.when(pivot > 1e-9 * n, below)

    return F.aggregate(F.sequence(F.lit(0), F.lit(pivots - 1)), matrix, step)


@F.pandas_udf(T.DoubleType())
def _p_of_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(numeric.t_two_sided_many(t.fillna(0.0).to_numpy(float), df.clip(lower=1).to_numpy(float)))


def linear_associations(dosages: DataFrame, people: DataFrame, group: list[str], sample: str, dosage: str, outcome: str, covariates: list[str]) -> DataFrame:
    """(group, n, beta, se, t, p) of the dosage in the least-squares fit of the outcome on an intercept, the dosage and the covariates, for every
    site (group), over people with all of them. people: one row for each sample.

    All sites are one aggregation of products; the systems are solved in the same stage, row by row. Outcome and covariates are centred and scaled over all people
    first, which changes no result but keeps digits. Null where a covariate or the dosage hangs on the others, or too few people are left.
    """
    columns = [outcome, *covariates]
    moments = people.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    scales = [moments[f"s{i}"] or 1.0 for i in range(len(columns))]
    scaled = people.select(sample, *(((F.col(c) - F.lit(moments[f"m{i}"])) / F.lit(scales[i])).alias(f"__v{i}") for i, c in enumerate(columns)))
    calls = dosages.select(*group, sample, F.col(dosage).cast("double").alias("__g")).join(scaled, sample).dropna()
    # Intercept and covariates first, then the dosage, then the outcome: what is left of the last two is the fit.
    terms = [F.lit(1.0), *(F.col(f"__v{i}") for i in range(1, len(columns))), F.col("__g"), F.col("__v0")]
    size = len(terms)
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    sums = calls.groupBy(*group).agg(*(F.sum(terms[i] * terms[j]).alias(f"__s{i}_{j}") for i, j in upper))
    n = F.col("__s0_0")
    solved = sums.withColumn("__m", _eliminated([[F.col(f"__s{min(i, j)}_{max(i, j)}") for j in range(size)] for i in range(size)], size - 2, n))
    at = lambda i, j: F.col("__m")[i][j]
    d, r, left = at(size - 2, size - 2), at(size - 2, size - 1), n - (size - 1)
    good = (d > 1e-9 * n) & (left > 0)
    rest = F.greatest(at(size - 1, size - 1) - r * r / d, F.lit(0.0))
    fit = solved.select(*group, n.cast("long").alias("n"), left.alias("__df"), F.when(good, r / d).alias("__b"), F.when(good, F.sqrt(rest / left / d)).alias("__e"))
    t = F.when(F.col("__e") > 0, F.col("__b") / F.col("__e"))
    out = fit.select(*group, "n", "__df", (F.col("__b") * scales[0]).alias("beta"), (F.col("__e") * scales[0]).alias("se"), t.alias("t"))
    return out.withColumn("p", F.when(F.col("t").isNotNull(), _p_of_t("t", "__df"))).drop("__df")
