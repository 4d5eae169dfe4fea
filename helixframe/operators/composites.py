"""Composite operators: sequential rules per natural group, and rule tables built from the basic operators."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import dealt, settled


def greedy_assignment(pairs: DataFrame, group: list[str], left: str, right: str, order: list[str], score: list[str]) -> DataFrame:
    """One-to-one assignment within each group: left items in coordinate order each take the unused right item of the
    best score (columns of `score`, larger first; the right item's name settles ties). Groups are one file's or species' items."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        own = [*order, left]
        p = p.dropna(subset=own).sort_values([*own, *score, right], ascending=[True] * len(own) + [False] * len(score) + [True], kind="stable")
        used, kept, settled_item = set(), [], None
        for k, (item, other) in enumerate(zip(zip(*(p[c].tolist() for c in own), strict=True), p[right].tolist(), strict=True)):
            if item != settled_item and other not in used:
                used.add(other)
                kept.append(k)
                settled_item = item
        return p.iloc[kept]

    return pairs.groupBy(*group).applyInPandas(run, pairs.schema)


def merged_to_fixpoint(blocks: DataFrame, group: list[str], gap: int, offset: int) -> DataFrame:
    """Collinear blocks (qs, qe, ts, te) of a group, merged while two lie within `gap` on the query and their diagonals
    within `offset`; a block inside another is left out. The first pair in query order goes first, until nothing changes."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(map(tuple, p[["qs", "qe", "ts", "te"]].itertuples(index=False)))
        changed = True
        while changed:
            changed = False
            for i in range(len(rows)):
                for j in range(i + 1, len(rows)):
                    a, b = rows[i], rows[j]
                    inside = b[0] >= a[0] and b[1] <= a[1]
                    close = abs(b[0] - a[1]) <= gap and abs((b[0] - b[2]) - (a[1] - a[3])) <= offset
                    if inside or close:
                        rows[i] = a if inside else (a[0], max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]))
                        del rows[j]
                        changed = True
                        break
                if changed:
                    break
        out = pd.DataFrame(rows, columns=["qs", "qe", "ts", "te"])
        for k, g in enumerate(group):
            out.insert(k, g, p[g].iloc[0])
        return out

    fields = ", ".join(f"`{g}` {blocks.schema[g].dataType.simpleString()}" for g in group)
    return blocks.select(*group, *[F.col(c).cast("long").alias(c) for c in ("qs", "qe", "ts", "te")]).groupBy(*group).applyInPandas(run, f"{fields}, qs long, qe long, ts long, te long")


def disjoint_clades(clades: DataFrame, group: str, clade: str, member: str, min_size: int) -> DataFrame:
    """Clades chosen by size, largest first (the name settles ties), without shared members."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        sets = p.groupby(clade)[member].agg(set)
        taken: set = set()
        rows = []
        for name in sorted(sets.index, key=lambda c: (-len(sets[c]), c)):
            if len(sets[name]) >= min_size and not sets[name] & taken:
                taken |= sets[name]
                rows.append((p[group].iloc[0], name, len(sets[name])))
        return pd.DataFrame(rows, columns=[group, clade, "size"])

    kind = lambda c: clades.schema[c].dataType.simpleString()
    return clades.groupBy(group).applyInPandas(run, f"`{group}` {kind(group)}, `{clade}` {kind(clade)}, size long")


def origin_by_bins(bins: DataFrame, group: list[str], order: str, label: str, identity: str, tolerance: float = 1e-6) -> DataFrame:
    """Origin of each bin: the label of the best identity; ties (within the tolerance) and bins without identity keep the
    origin before them, `Unknown` at the start."""
    best = bins.groupBy(*group, order).agg(F.max(identity).alias("__best"))
    joined = bins.join(best, [*group, order])
    winners = joined.groupBy(*group, order).agg(F.max("__best").alias("__best"), F.collect_set(F.when(F.col(identity) >= F.col("__best") - tolerance, F.col(label))).alias("__w"))
    single = F.when((F.size("__w") == 1) & (F.col("__best") > 0), F.col("__w")[0])
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return winners.select(*group, order, F.coalesce(F.last(single, ignorenulls=True).over(w), F.lit("Unknown")).alias("origin"))


def trio_origins(bins: DataFrame, group: list[str], order: str, label: str, identity: str, parents: dict[str, str], tolerance: float = 1e-6) -> DataFrame:
    """Origin of each bin of a haplotype (group), the parent that transmitted the haplotype, and the origin within that parent.

    parents names the parent of each label (parental haplotype). four_way: as in origin_by_bins. <parent>_bins: bins whose four-way origin is
    the parent's; parent: the one with most of them, Unknown on a tie or without any. constrained: the label of that parent with the
    best identity, Unknown on a tie within the tolerance or without a parent; constrained_carried keeps the last one before a tie instead.
    A label without an identity in a bin has 0. One aggregation for the identities; a haplotype's bins are ordered in one task.
    """
    labels, sides = list(parents), sorted(set(parents.values()))
    wide = bins.groupBy(*group, order).agg(*(F.coalesce(F.max(F.when(F.col(label) == x, F.col(identity))), F.lit(0.0)).alias(f"__i{k}") for k, x in enumerate(labels)))

    def winner(among: list[int], above: float | None) -> Column:
        best = F.greatest(*(F.col(f"__i{k}") for k in among)) if len(among) > 1 else F.col(f"__i{among[0]}")
        near = F.array_compact(F.array(*(F.when(F.col(f"__i{k}") >= best - tolerance, labels[k]) for k in among)))
        single = F.size(near) == 1
        return F.when(single & (best > above) if above is not None else single, near[0])

    whole = Window.partitionBy(*group)
    so_far = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit("Unknown"))
    called = wide.withColumn("four_way", carried(winner(list(range(len(labels))), 0.0)))
    of = {s: [x for x in labels if parents[x] == s] for s in sides}
    called = called.withColumns({f"{s}_bins": F.count_if(F.col("four_way").isin(of[s])).over(whole) for s in sides})
    most = F.greatest(*(F.col(f"{s}_bins") for s in sides)) if len(sides) > 1 else F.col(f"{sides[0]}_bins")
    ahead = F.array_compact(F.array(*(F.when((F.col(f"{s}_bins") == most) & (most > 0), s) for s in sides)))
    called = called.withColumn("parent", F.when(F.size(ahead) == 1, ahead[0]).otherwise("Unknown"))
    own = F.coalesce(*(F.when(F.col("parent") == s, winner([labels.index(x) for x in of[s]], None)) for s in sides))
    called = called.withColumn("__own", own)
    return called.select(*group, order, "four_way", *(f"{s}_bins" for s in sides), "parent", F.coalesce("__own", F.lit("Unknown")).alias("constrained"), carried(F.col("__own")).alias("constrained_carried"))


def blocks_of_runs(df: DataFrame, group: list[str], order: list[str], unit: Column) -> DataFrame:
    """Adds block: consecutive rows that are units share one, every other row has one of its own."""
    w = Window.partitionBy(*group).orderBy(*order)
    marked = df.withColumn("__u", unit)
    new = F.when(F.col("__u") & F.coalesce(F.lag("__u").over(w), F.lit(False)), 0).otherwise(1)
    return marked.withColumn("__n", new).withColumn("block", F.sum("__n").over(w)).drop("__u", "__n")


#: Columns of all parents up to which they are broadcast.
BROADCAST_COLUMNS = 1_000_000


def paired_blocks(letters: DataFrame, pairs: DataFrame) -> DataFrame:
    """child, parent, kind, block, parent_blocks, child_blocks, sites: for each pair of haplotypes and kind of block with two parent blocks
    or more, a row for each block of the child with its informative sites, where all parent blocks are aligned without gaps, differ, and
    one has the child's base. letters (block, hap, kind, pos, base) are aligned; pairs (child, parent).

    A block is one row with its letters, and meets the informative columns of each parent as one row: letters are never multiplied by pairs.
    """
    gap = F.col("base").isin("-", "N")
    blocks = settled(dealt(letters, ["hap", "kind", "block"]).groupBy("hap", "kind", "block").agg(F.collect_list(F.struct("pos", "base")).alias("letters")))
    number = blocks.groupBy("hap", "kind").agg(F.count("*").alias("n"))
    columns = letters.groupBy("hap", "kind", "pos").agg(F.count("*").alias("k"), F.collect_set("base").alias("bases"), F.max(gap).alias("gap"))
    columns = settled(columns.join(number, ["hap", "kind"]).filter("k = n and size(bases) > 1 and not gap").select("hap", "kind", "pos", "bases"))
    held = columns.groupBy("hap", "kind").agg(F.map_from_entries(F.collect_list(F.struct("pos", "bases"))).alias("columns"))
    parents = number.filter("n >= 2").join(held, ["hap", "kind"], "left").withColumnsRenamed({"hap": "parent", "n": "parent_blocks"})
    children = pairs.join(number.withColumnsRenamed({"hap": "child", "n": "child_blocks"}), "child")
    if columns.count() <= BROADCAST_COLUMNS and children.count() <= BROADCAST_COLUMNS:
        parents, children = F.broadcast(parents), F.broadcast(children)
    met = blocks.withColumnRenamed("hap", "child").join(children, ["child", "kind"]).join(parents, ["parent", "kind"])
    known = F.filter("letters", lambda x: F.array_contains(F.try_element_at("columns", x["pos"]), x["base"]))
    sites = F.when(F.col("columns").isNull(), 0).otherwise(F.size(known))
    return met.select("child", "parent", "kind", "block", "parent_blocks", "child_blocks", sites.cast("long").alias("sites"))


def stable_seed(text: str) -> int:
    """A seed below 2^31 - 1 that depends on the text alone."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") % (2**31 - 1)


def short_number(x: float | None) -> str:
    """%.6g as text; NA for what is missing."""
    return "NA" if x is None or math.isnan(x) else f"{x:.6g}"
