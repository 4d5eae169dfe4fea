"""Checks on schemas, keys and cardinalities. Schema checks run no job; key checks run one aggregation."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SchemaError(ValueError):
    """A column is missing, or a name fits no column or several."""


class CardinalityError(ValueError):
    """A key that should be unique, or a match that should be single, isn't."""


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise SchemaError(f"{what} lacks {', '.join(missing)}")
    return df


def collected(df: DataFrame, most: int):
    """The rows as a pandas frame on the driver; more than `most` rows are an error."""
    out = df.limit(most + 1).toPandas()
    if len(out) > most:
        raise CardinalityError(f"more than {most} rows for the driver")
    return out


def _plain(name: str) -> str:
    return re.sub(r"[\s ]+", " ", name).strip().lower()


def resolve_column(df: DataFrame, exact: Iterable[str] = (), prefix: str | None = None, contains: Iterable[str] = ()) -> str:
    """The one column that fits, by exact name, else by prefix, else by all parts; white space and case are ignored."""
    wanted = {_plain(x) for x in exact}
    parts = [_plain(x) for x in contains]
    rules = (
        lambda c: c in wanted,
        lambda c: prefix is not None and c.startswith(_plain(prefix)),
        lambda c: bool(parts) and all(p in c for p in parts),
    )
    for rule in rules:
        found = [c for c in df.columns if rule(_plain(c))]
        if len(found) == 1:
            return found[0]
        if found:
            raise SchemaError(f"{found} all fit")
    raise SchemaError(f"no column of {df.columns} fits")


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    repeated = df.groupBy(*keys).count().filter("count > 1").limit(3).collect()
    if repeated:
        raise CardinalityError(f"{what}: {keys} repeat, as in {[tuple(r)[:-1] for r in repeated]}")
    return df


def exactly_one(df: DataFrame, what: str = "lookup"):
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise CardinalityError(f"{what}: {'no row' if not rows else 'several rows'}")
    return rows[0]


def require_complete(df: DataFrame, names: list[str], what: str = "table") -> DataFrame:
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first()
    bad = {c: nulls[c] for c in names if nulls[c]}
    if bad:
        raise CardinalityError(f"{what} has nulls: {bad}")
    return df


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns that are not there."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def reordered(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns first, as far as they are there, then the rest in place."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])
