"""Scalar rules as column expressions: guards, rounding, text codes, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = ("NA", "nan", "None", "-1", "")


def guarded_ratio(n: Column, d: Column) -> Column:
    """n / d where d > 0, else null."""
    return F.when(d > 0, n / d)


def infinite_ratio(n: Column, d: Column) -> Column:
    """n / d, positive infinity for a positive n over 0, null for 0 over 0."""
    return F.when(d != 0, n / F.when(d != 0, d)).when(n > 0, F.lit(float("inf")))


def finite(c: Column) -> Column:
    """c, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def half_even(c: Column, places: int = 0) -> Column:
    return F.bround(c, places)


def sum_skipping_nulls(*cols: Column) -> Column:
    out = F.lit(0.0)
    for c in cols:
        out = out + F.coalesce(c, F.lit(0.0))
    return out


def blank_to_null(c: Column, blanks: tuple[str, ...] = BLANKS) -> Column:
    return F.when(~c.isin(*blanks), c)


def number_or_null(c: Column, sentinels: tuple[str, ...] = ("..", "")) -> Column:
    return F.when(~c.isin(*sentinels), c).try_cast("double")


def keep_unless_equal(c: Column, value) -> Column:
    """The filter x != value that also keeps nulls."""
    return ~c.eqNullSafe(F.lit(value))


def first_reason(rules: list[tuple[str, Column]], otherwise: str = "included") -> Column:
    out = None
    for name, failed in rules:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out.otherwise(otherwise)


def all_reasons(rules: list[tuple[str, Column]], otherwise: str = "PASS") -> Column:
    named = F.array_compact(F.array(*[F.when(failed, name) for name, failed in rules]))
    return F.when(F.size(named) == 0, otherwise).otherwise(F.array_join(named, ","))


def stars(p: Column) -> Column:
    return F.when(p <= 0.01, "***").when(p <= 0.05, "**").when(p <= 0.10, "*").otherwise("")


def lookup_code(c: Column, codes: dict[str, str], strict: bool = False) -> Column:
    """The code of a value; a value without one stays as it is, or is an error if strict."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    missing = F.raise_error(F.concat(F.lit("no code for "), c)) if strict else c
    return F.coalesce(F.try_element_at(table, c), missing)


def dotted_code(c: Column) -> Column:
    """A diagnosis code without dots, with one after the third character."""
    bare = F.replace(c, F.lit("."), F.lit(""))
    return F.when(F.length(bare) > 3, F.concat(F.left(bare, F.lit(3)), F.lit("."), F.substring(bare, F.lit(4), F.length(bare)))).otherwise(bare)


def attributes(c: Column, pair: str = ";", key: str = "=") -> Column:
    """k=v;k=v as a map: fields without a key sign are left out, the last of equal keys wins, values may hold the key sign."""
    fields = F.filter(F.split(c, pair), lambda x: F.instr(x, key) > 0)
    pairs = F.transform(fields, lambda x: F.struct(F.trim(F.substring_index(x, key, 1)).alias("k"), F.substring(x, F.instr(x, key) + len(key), F.length(x)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def canonical_name(c: Column) -> Column:
    """Underscores as spaces, runs of white space (non-breaking too) as one, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, "_ ", "  "), "\\s+", " ")))


def sanitised(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_")


def copy_label(counts: dict[str, Column]) -> Column:
    """A2B1...: the names and numbers of what isn't zero."""
    return F.concat(*[F.when(n > 0, F.concat(F.lit(k), n.cast("string"))).otherwise("") for k, n in counts.items()])


def natural_key(c: Column, width: int = 20) -> Column:
    """Text ordered with digits as numbers, for texts with at most one run of digits."""
    digits = F.regexp_extract(c, "(\\d+)", 1)
    return F.concat(F.regexp_extract(c, "^(\\D*)", 1), F.lpad(digits, width, "0"), F.regexp_extract(c, "^\\D*\\d*(.*)$", 1))


def allele_dosage(gt: Column) -> Column:
    """0, 1 or 2 alternate alleles of a diploid biallelic call; anything else is null."""
    return F.when(gt.rlike("^[01][/|][01]$"), F.left(gt, F.lit(1)).cast("int") + F.right(gt, F.lit(1)).cast("int"))


def phased_or_missing(gt: Column) -> Column:
    return F.when(gt.rlike("^[01]\\|[01]$"), gt).otherwise(".|.")


def flipped(gt: Column) -> Column:
    return F.translate(gt, "01", "10")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def oriented(pos: Column, length: Column, strand: Column) -> Column:
    """A position as seen along the strand: unchanged on +, length - pos on - (-pos without a length)."""
    return F.when(strand == "-", F.coalesce(length - pos, -pos)).otherwise(pos)
