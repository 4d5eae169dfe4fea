"""Rules of the reports: each takes tables and column names and gives one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = ("", "NA", "nan", "None", "-1")


def _clean(c: Column) -> Column:
    """Trimmed text; null and the marks of a missing value are empty."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(text.isin(*BLANKS), "").otherwise(text)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def rearrangement_qc(models: DataFrame, units: DataFrame, group: str, kind: str, label: str, status: str, statuses: list[str], least_labels: int = 3, least_share: float = 0.5) -> DataFrame:
    """One row for each group of gene models: how many are target, anchor and non_target (kind), the share and labels of the last, whether
    that points to a rearrangement and why, and how many local units have each status.

    Labels that anchors have (case ignored) don't count as non-target ones. Flagged: least_labels labels or more, or a share of least_share or more; all
    reasons are listed, NA if none. Groups without units have 0.
    """
    lower = F.lower(label)
    counts = models.groupBy(group).agg(
        F.count("*").alias("models"),
        *(F.count_if(F.col(kind) == k).alias(f"{k}_models") for k in ("target", "anchor", "non_target")),
        F.collect_set(F.when(F.col(kind) == "anchor", lower)).alias("__a"),
        F.collect_set(F.when(F.col(kind) == "non_target", F.col(label))).alias("__l"),
    )
    labels = F.array_sort(F.filter("__l", lambda x: ~F.array_contains(F.col("__a"), F.lower(x))))
    counts = counts.withColumns({"non_target_share": F.col("non_target_models") / F.greatest("models", F.lit(1)), "__l": labels})
    many, large = F.size("__l") >= least_labels, F.col("non_target_share") >= least_share
    reasons = F.concat_ws(";", F.when(many, f"labels>={least_labels}"), F.when(large, f"share>={least_share}"))
    found = units.groupBy(group).agg(F.count("*").alias("units"), *(F.count_if(F.col(status) == s).alias(f"{s}_units") for s in statuses))
    tallies = [F.coalesce(c, F.lit(0)).alias(c) for c in ("units", *(f"{s}_units" for s in statuses))]
    shown = F.when(F.size("__l") > 0, F.array_join("__l", ";")).otherwise("NA")
    return counts.join(found, group, "left").select(
        group, "models", "target_models", "anchor_models", "non_target_models", "non_target_share", F.size("__l").alias("n_labels"), shown.alias("labels"),
        (many | large).alias("flag"), F.when(reasons == "", "NA").otherwise(reasons).alias("reason"), *tallies,
    )


def endpoint_summary(endpoints: DataFrame, group: list[str], start: str, end: str, wanted: str) -> DataFrame:
    """endpoints: a row for each duplicon with the repeat group at its start and end (null: none) -> for each group: n, and how many
    and what share have the wanted repeat at both ends, at one at least, at none."""
    at = F.coalesce(F.col(start) == wanted, F.lit(False)).cast("int") + F.coalesce(F.col(end) == wanted, F.lit(False)).cast("int")
    g = endpoints.withColumn("__at", at).groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col("__at") == 2).alias("both_n"), F.count_if(F.col("__at") >= 1).alias("any_n"), F.count_if(F.col("__at") == 0).alias("none_n"))
    return g.select(*group, "n", *(x for c in ("both", "any", "none") for x in (f"{c}_n", _share(F.col(f"{c}_n"), F.col("n")).alias(f"{c}_share"))))


def endpoint_configurations(endpoints: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """How often each pair of repeat groups (start, end; none where null) occurs."""
    none = F.lit("none")
    return endpoints.groupBy(*group, F.coalesce(start, none).alias("start_group"), F.coalesce(end, none).alias("end_group")).agg(F.count("*").alias("n"))


def in_population(population: Column, wanted: str, parents: tuple[str, ...] = ("AFR",)) -> Column:
    """Whether a sample's population is the wanted one; a parent also takes its parts (AFR takes AFR-...). Null and empty: no."""
    exact = population == wanted
    return F.coalesce(exact | population.startswith(f"{wanted}-") if wanted in parents else exact, F.lit(False)) & (population != "")


def track_rows(features: DataFrame, order: DataFrame, track: str, start: str, end: str, kinds: list[tuple[str, str]], label: str, offset: float) -> DataFrame:
    """Features of the tracks in `order` (track, ordinal; the first is drawn on top), ready to be drawn: y, mid, kind, label_at.

    y: the track's place from below plus the offset; kind: the name of the first pattern that the label matches, Other if none; label_at: the
    greatest end on the track.
    """
    last = order.agg(F.max("ordinal").alias("__last"))
    placed = features.join(order.join(last), track)
    kind = F.coalesce(*(F.when(F.col(label).rlike(pattern), name) for name, pattern in kinds), F.lit("Other"))
    rows = placed.withColumns({"y": F.col("__last") - F.col("ordinal") + 1 + offset, "mid": (F.col(start) + F.col(end)) / 2, "kind": kind})
    return rows.join(features.groupBy(track).agg(F.max(end).alias("label_at")), track).drop("ordinal", "__last")


def recombinant_candidates(one: DataFrame, other: DataFrame, hap: str, group: str, major: str, member: str) -> DataFrame:
    """Haplotypes placed by the trees of both flanks (one row each: hap, its group, the group's major label, its own label) whose own
    label is the major label of neither group, with the haplotypes to compare them with.

    left: others of the first flank's group that have its major label but another group on the second flank; right: the same the other way
    round. The lists hang on the pair of groups only, so each is built once for a pair and no haplotypes are paired with each other.
    """
    side = lambda df, k: df.select(hap, F.col(group).alias(f"g{k}"), F.col(major).alias(f"__m{k}"), _clean(F.col(member)).alias(f"__l{k}"))
    both = side(one, 1).join(side(other, 2), hap)
    own = F.when(F.col("__l1") != "", F.col("__l1")).otherwise(F.col("__l2"))
    rows = both.withColumn("observed", own)
    chosen = rows.filter((F.col("observed") != _clean(F.col("__m1"))) & (F.col("observed") != _clean(F.col("__m2"))))

    def beside(k: int, j: int, name: str) -> DataFrame:
        good = rows.filter(F.col(f"__l{k}") == _clean(F.col(f"__m{k}"))).groupBy(f"g{k}").agg(F.collect_list(F.struct(f"g{j}", hap)).alias("__c"))
        pairs = chosen.select("g1", "g2").distinct().join(good, f"g{k}")
        # Structs name their fields by the columns they come from.
        return pairs.select("g1", "g2", F.array_sort(F.transform(F.filter("__c", lambda x: x[f"g{j}"] != F.col(f"g{j}")), lambda x: x[hap])).alias(name))

    out = chosen.join(beside(1, 2, "left"), ["g1", "g2"], "left").join(beside(2, 1, "right"), ["g1", "g2"], "left")
    empty = F.array().cast(f"array<{one.schema[hap].dataType.simpleString()}>")
    return out.select(hap, "observed", "g1", F.col("__m1").alias("major1"), "g2", F.col("__m2").alias("major2"), F.coalesce("left", empty).alias("left"), F.coalesce("right", empty).alias("right"))
