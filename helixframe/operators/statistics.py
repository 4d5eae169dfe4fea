"""Statistics as aggregations and windows; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import cumulative
from .rounds import settled


def weighted_mean(v: Column, w: Column) -> Column:
    """Aggregate: mean of finite v by finite positive weights."""
    good = v.isNotNull() & w.isNotNull() & ~F.isnan(v) & ~F.isnan(w) & (F.abs(v) < float("inf")) & (F.abs(w) < float("inf")) & (w > 0)
    return F.try_divide(F.sum(F.when(good, v * w)), F.sum(F.when(good, w)))


def pair_differentiation(df: DataFrame, unit: str, group: str, value: str) -> DataFrame:
    """unit, a, b, vst, diff for every pair of groups of a unit: the share of the pooled variance (over all values of
    both) that isn't within the groups. Null for fewer than two values on a side, constant values or a negative share.
    A share that rounding alone tells from 0 is 0, so the order in which rows were added up doesn't decide."""
    stats = df.groupBy(unit, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    a = stats.select(unit, F.col(group).alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"), F.col("v").alias("va"))
    b = stats.select(unit, F.col(group).alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("v").alias("vb"))
    pairs = a.join(b, unit).filter("a < b and na >= 2 and nb >= 2")
    n = F.col("na") + F.col("nb")
    squares = (F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb") + F.col("na") * F.col("nb") / n * (F.col("ma") - F.col("mb")) * (F.col("ma") - F.col("mb"))
    total, within = squares / (n - 1), (F.col("na") * F.col("va") + F.col("nb") * F.col("vb")) / n
    share = (total - within) / F.when(total > 0, total)
    vst = F.when(total > 0, F.when(F.abs(share) < 1e-13, 0.0).otherwise(share))
    return pairs.select(unit, "a", "b", F.when(vst >= 0, vst).alias("vst"), (F.col("ma") - F.col("mb")).alias("diff"))


def ranked_differentiation(pairs: DataFrame, unit: str) -> DataFrame:
    """Pairs with a vst and a difference, by vst * |diff|: rank and percentile."""
    # Saved once: the cuts, the sums and the ranks read it.
    kept = settled(pairs.filter(F.col("vst").isNotNull() & (F.col("diff") != 0)).withColumn("metric", F.round(F.col("vst") * F.abs("diff"), 9)))
    # Ranks within ranges of the metric, after the counts of the ranges above: a task gets one range of a pair.
    n = kept.groupBy("a", "b").agg(F.count("*").alias("__n"))  # pairs of groups are few
    placed = cumulative(kept, ["a", "b"], "metric", [F.asc(unit)], F.lit(1), descending=True).join(F.broadcast(n), ["a", "b"])
    return placed.withColumn("rank", F.col("total").cast("int")).withColumn("percentile", F.col("rank") / F.col("__n")).drop("total", "__n")


def diversity(alt: Column, n: Column) -> Column:
    """2p(1-p) * n/(n-1) of a site, null for n < 2."""
    p = alt / F.when(n > 0, n)
    return F.when(n >= 2, 2 * p * (1 - p) * n / F.when(n >= 2, n - 1))


def haploid_diversity(k: Column, n: Column) -> Column:
    return F.when(n >= 2, 2.0 * k * (n - k) / F.when(n >= 2, n * (n - 1)))


def tajima_d(pi: Column, s: Column, n: Column) -> Column:
    """Tajima's D from the summed diversity, the number of segregating sites (2 or more) and the sample size (4 or more)."""
    a1 = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0.0), lambda acc, i: acc + 1.0 / i)
    a2 = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(0.0), lambda acc, i: acc + 1.0 / (i * i))
    b1, b2 = (n + 1) / (3.0 * (n - 1)), 2.0 * (n * n + n + 3) / (9.0 * n * (n - 1))
    c1 = b1 - 1.0 / a1
    c2 = b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)
    e1, e2 = c1 / a1, c2 / (a1 * a1 + a2)
    variance = e1 * s + e2 * s * (s - 1)
    return F.when((s >= 2) & (n >= 4), (pi - s / a1) / F.when((s >= 2) & (n >= 4), F.sqrt(variance)))


def tail_share(null_value: Column, observed: Column, lower: bool = False) -> Column:
    """Aggregate: share of null values on the side of the observed one."""
    return F.avg(F.when(null_value <= observed if lower else null_value >= observed, 1.0).otherwise(0.0))


def plus_one_p(null_value: Column, observed: Column) -> Column:
    return (F.count_if(null_value >= observed) + 1) / (F.count(null_value) + 1)


def bonferroni(p: Column, over: Window | None = None) -> Column:
    return F.least(F.lit(1.0), p * F.count(p).over(over or Window.partitionBy()))


def haldane_ratio(a: Column, ta: Column, b: Column, tb: Column) -> Column:
    return ((a + 0.5) / ta) / ((b + 0.5) / tb)


def zero_filled_pivot(df: DataFrame, row: str, column: str, levels: list) -> DataFrame:
    return df.groupBy(row).pivot(column, levels).count().na.fill(0)


def silhouette(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Mean distance to the own and to the nearest other cluster of every row, and the score (null in a cluster of one).

    Squared Euclidean distances to a whole cluster follow from the cluster's sums, so no pairs are formed.
    """
    norm = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    base = df.select(key, label, vector, norm.alias("__q"))
    dims = base.select(label, "__q", F.posexplode(vector).alias("__i", "__x"))
    sums = dims.groupBy(label, "__i").agg(F.sum(F.col("__x").cast("double")).alias("__s"))
    centre = sums.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__s"))), lambda r: r["__s"]).alias("__sum"))
    size = base.groupBy(label).agg(F.count("*").alias("__n"), F.sum("__q").alias("__total"))
    clusters = centre.join(size, label).select(F.col(label).alias("__c"), "__sum", "__n", "__total")
    pairs = base.crossJoin(F.broadcast(clusters))
    dot = F.aggregate(F.zip_with(vector, "__sum", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    total = F.col("__n") * F.col("__q") - 2 * dot + F.col("__total")
    own = F.col("__c") == F.col(label)
    mean = F.when(own, F.try_divide(total, F.col("__n") - 1)).otherwise(total / F.col("__n"))
    out = pairs.select(key, label, own.alias("__own"), mean.alias("__mean")).groupBy(key, label).agg(F.max(F.when(F.col("__own"), F.col("__mean"))).alias("a"), F.min(F.when(~F.col("__own"), F.col("__mean"))).alias("b"))
    return out.withColumn("score", (F.col("b") - F.col("a")) / F.greatest("a", "b"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings, from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    two = lambda c: c * (c - 1) / 2.0
    both = cells.agg(F.sum(two(F.col("n"))).alias("ab"), F.sum("n").alias("n"))
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    one = both.crossJoin(left).crossJoin(right)
    expected = F.col("sa") * F.col("sb") / two(F.col("n"))
    most = (F.col("sa") + F.col("sb")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("ab") - expected) / (most - expected)).alias("adjusted_rand"))
