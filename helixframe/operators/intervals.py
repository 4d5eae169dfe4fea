"""Interval operators. Names tell the convention: half_open is [start, end), closed is [start, end]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import dealt


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_join_half_open(a: DataFrame, b: DataFrame, bounds_a: tuple[str, str], bounds_b: tuple[str, str], keys: list[str], bin_size: int) -> DataFrame:
    """Pairs of overlapping intervals with equal keys. Both sides are dealt into bins of bin_size, so
    the join is an equi-join on (keys, bin); a pair is kept in the first bin the two share."""
    (s1, e1), (s2, e2) = bounds_a, bounds_b

    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        last = F.greatest(F.ceil(F.col(e) / bin_size) - 1, F.floor(F.col(s) / bin_size))
        return df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(s) / bin_size), last)))

    pairs = binned(a, s1, e1).join(binned(b, s2, e2), [*keys, "__bin"])
    first = F.floor(F.greatest(F.col(s1), F.col(s2)) / bin_size)
    kept = pairs.filter((F.col(s1) < F.col(e2)) & (F.col(s2) < F.col(e1)) & (F.col("__bin") == first))
    return kept.withColumn("overlap", overlap_length(F.col(s1), F.col(e1), F.col(s2), F.col(e2))).drop("__bin")


def self_overlaps_half_open(df: DataFrame, bounds: tuple[str, str], keys: list[str], order: list[str], bin_size: int) -> DataFrame:
    """Unordered pairs of overlapping intervals of one table with equal keys, once each: the columns of the one that starts first (ties: `order`;
    rows that are equal in it too are no pair), those of the other with the suffix 2, and the overlap. Only the first side is dealt into bins; the other is in that of its start."""
    s, e = bounds
    last = F.greatest(F.ceil(F.col(e) / bin_size) - 1, F.floor(F.col(s) / bin_size))
    first = df.filter(F.col(s) < F.col(e)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(s) / bin_size), last)))
    later = df.filter(F.col(s) < F.col(e)).select(*keys, *(F.col(c).alias(f"{c}2") for c in df.columns if c not in keys), F.floor(F.col(s) / bin_size).alias("__bin"))
    place = lambda end: F.struct(F.col(f"{s}{end}"), *(F.col(f"{c}{end}") for c in order))
    pairs = first.join(later, [*keys, "__bin"]).filter((F.col(f"{s}2") < F.col(e)) & (F.col(f"{s}2") >= F.col(s)) & (place("") < place("2")))
    return pairs.withColumn("overlap", F.least(e, f"{e}2") - F.col(f"{s}2")).drop("__bin")


def point_join_closed(points: DataFrame, intervals: DataFrame, point: str, bounds: tuple[str, str], keys: list[str], tolerance: int, bin_size: int) -> DataFrame:
    """Points with every interval that holds them or ends within the tolerance, and the distance (0 inside);
    points without one stay, with nulls."""
    s, e = bounds
    low, high = F.floor((F.col(s) - tolerance) / bin_size), F.floor((F.col(e) + tolerance) / bin_size)
    side = intervals.withColumn("__bin", F.explode(F.sequence(low, high)))
    p = points.withColumn("__bin", F.floor(F.col(point) / bin_size))
    same = [p[k] == side[k] for k in [*keys, "__bin"]]
    near = p[point].between(side[s] - tolerance, side[e] + tolerance)
    condition = near
    for c in same:
        condition = condition & c
    joined = p.join(side, condition, "left")
    distance = F.greatest(side[s] - p[point], p[point] - side[e], F.lit(0))
    return joined.select(*[p[c] for c in points.columns], *[side[c] for c in intervals.columns if c not in keys], F.when(side[s].isNotNull(), distance).alias("distance"))


def islands_by_running_end(df: DataFrame, group: list[str], start: str, end: str, tie: str, gap: int) -> DataFrame:
    """Adds island: a row begins a new one if its start lies gap or more beyond every end before it
    (a contained interval doesn't shorten the reach)."""
    w = Window.partitionBy(*group).orderBy(start, tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) - reach >= gap), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w)).drop("__new")


def union_touching(df: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Union of intervals; touching ones (start = end of the one before) are merged."""
    w = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn("island", F.sum("__new").over(w))
    return marked.groupBy(*group, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts"))


def point_clusters(df: DataFrame, group: list[str], point: str, tolerance: int) -> DataFrame:
    """Clusters of points with gaps of at most the tolerance: the smallest point and the size of each.

    One sort: a cluster is its first row, and its size the distance to the first row of the next.
    """
    w = Window.partitionBy(*group).orderBy(point)
    gap = F.col(point) - F.lag(point).over(w)
    numbered = {"cluster": F.sum("__new").over(w), "__at": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.count("*").over(Window.partitionBy(*group))}
    marked = dealt(df, group).withColumn("__new", F.when(gap.isNull() | (gap > tolerance), 1).otherwise(0)).withColumns(numbered)
    first = marked.withColumn("__was", F.lag("cluster").over(w)).filter("__was is null or __was <> cluster")
    size = F.coalesce(F.lead("__at").over(w), F.col("__n") + 1) - F.col("__at")
    return first.select(*group, "cluster", point, size.alias("size"))


def sliding_windows(df: DataFrame, position: str, size: int, step: int, first: int = 0) -> DataFrame:
    """One row for each window [start, start + size) that holds the row; starts are first + k * step, k >= 0."""
    p = F.col(position) - first
    low = F.greatest(F.lit(0), F.floor((p - size) / step) + 1)
    return df.withColumn("window_start", F.explode(F.transform(F.sequence(low, F.floor(p / step)), lambda k: k * step + first)))


def tiles_closed(df: DataFrame, start: str, end: str, size: int) -> DataFrame:
    """1-based closed tiles of an interval; the last one may be shorter."""
    out = df.withColumn("tile_start", F.explode(F.sequence(F.col(start), F.col(end), F.lit(size).cast("long"))))
    return out.withColumn("tile_end", F.least(F.col("tile_start") + size - 1, F.col(end)))
