"""Writers of text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str, missing: str = "NA", header: bool = True, fields: list[str] | None = None) -> None:
    """Tab-separated text; `fields` picks and orders columns, those that are absent are missing throughout."""
    if fields:
        df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in df.columns]).write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "\u0000").csv(path)


def bed(df: DataFrame, path: str, columns: list[str]) -> None:
    tsv(df.select(*columns), path, missing=".", header=False)


def lines(df: DataFrame, path: str, value: str) -> None:
    """One id a line, missing ones left out."""
    df.filter(F.col(value).isNotNull() & ~F.col(value).isin("NA", "")).select(F.col(value).cast("string")).write.mode("overwrite").text(path)


def vcf_lines(df: DataFrame, samples: list[str], info: Column, form: Column) -> DataFrame:
    """VCF lines of sites with one genotype column for each sample (missing: ./.)."""
    fixed = ["chrom", "pos", "id", "ref", "alt"]
    cells = [F.coalesce(F.col(s), F.lit("./.")) for s in samples]
    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in fixed], F.lit("."), F.lit("PASS"), info, form, *cells).alias("value"))


def colour_strip(df: DataFrame, name: str, colours: dict[str, str], label: str) -> DataFrame:
    """Lines of a colour-strip annotation: name, colour, label."""
    table = F.create_map(*[F.lit(x) for kv in colours.items() for x in kv])
    return df.select(F.concat_ws("\t", F.col(name), F.coalesce(F.try_element_at(table, F.col(label)), F.lit("#cccccc")), F.col(label)).alias("value"))


def json_summary(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def fan_out(df: DataFrame, sinks: dict[str, tuple[Column, str]]) -> None:
    """Several outputs of one scan: each row is written under the sinks whose filter it passes."""
    tags = F.array_compact(F.array(*[F.when(keep, F.lit(name)) for name, (keep, _) in sinks.items()]))
    tagged = df.withColumn("__sink", F.explode(tags)).persist()
    try:
        for name, (_, path) in sinks.items():
            tagged.filter(F.col("__sink") == name).drop("__sink").write.mode("overwrite").parquet(path)
    finally:
        tagged.unpersist()
