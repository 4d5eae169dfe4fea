"""Readers of tabular and genomic text formats as DataFrames. Compressed files are read by their suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..functions import expressions as X

BED3 = "chrom string, start long, end long"
BED4 = BED3 + ", name string"
BED12 = BED4 + ", score string, strand string, thick_start long, thick_end long, rgb string, block_count int, block_sizes string, block_starts string"
PAF = "query string, query_length long, query_start long, query_end long, strand string, target string, target_length long, target_start long, target_end long, matches long, block long, quality int"


def delimited(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, sep: str | None = None, required: list[str] = ()) -> DataFrame:
    """CSV or TSV; the separator follows the suffix unless it is given."""
    bare = path.removesuffix(".gz").removesuffix(".bz2")
    reader = spark.read.option("header", header).option("sep", sep or ("," if bare.endswith(".csv") else "\t"))
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return C.require_columns(df, required, path)


def strings(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Every column as text, with empty text for what is missing."""
    return spark.read.option("header", True).option("sep", sep).csv(path).na.fill("")


def projected(spark: SparkSession, path: str, wanted: list[str], sep: str = "\t") -> DataFrame:
    """Only the wanted columns, after a check of the header alone."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return C.require_columns(df, wanted, path).select(*wanted)


def whitespace(spark: SparkSession, path: str, names: list[str], skip_header: bool = False) -> DataFrame:
    """Fields split on runs of white space."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), "\\s+").alias("p")).filter(F.size("p") >= len(names))
    if skip_header:
        rows = rows.filter(F.col("p")[0] != names[0])
    return rows.select(*[F.col("p")[k].alias(n) for k, n in enumerate(names)])


def listed(spark: SparkSession, path: str, unique: bool = True) -> DataFrame:
    """One value a line; blank lines and comments are skipped, repeated values are an error."""
    values = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' and not startswith(value, '#')")
    return C.require_unique(values, ["value"], path) if unique else values.distinct()


def whitelist(spark: SparkSession, lists: list[str] = (), tables: dict[str, list[str]] | None = None, anchors: Column | None = None) -> DataFrame:
    """Distinct values of list files and of named table columns, anchor rows left out."""
    out = None
    for path in lists:
        part = listed(spark, path, unique=False)
        out = part if out is None else out.unionByName(part)
    for path, columns in (tables or {}).items():
        df = strings(spark, path)
        there = [c for c in columns if c in df.columns]
        if not there:
            raise C.SchemaError(f"{path} has none of {columns}")
        df = df if anchors is None else df.filter(~anchors)
        part = df.select(F.explode(F.array(*there)).alias("value")).filter("value <> ''")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def bed(spark: SparkSession, path: str, schema: str = BED4) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)


def bed12(spark: SparkSession, path: str) -> DataFrame:
    """BED12 with exons as sorted (s, e); lines that don't parse are left out."""
    df = spark.read.schema(BED12).option("sep", "\t").option("mode", "DROPMALFORMED").csv(path).filter("block_starts is not null and start is not null")
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.try_cast("long"))
    exons = F.zip_with(numbers("block_starts"), numbers("block_sizes"), lambda s, n: F.struct((F.col("start") + s).alias("s"), (F.col("start") + s + n).alias("e")))
    return df.withColumn("exons", F.sort_array(exons))


def gff3(spark: SparkSession, path: str, feature: str | None = "gene") -> DataFrame:
    """Features as 0-based half-open intervals with their attributes as a map."""
    p = spark.read.text(path).filter("value <> '' and not startswith(value, '#')").select(F.split("value", "\t").alias("p")).filter(F.size("p") == 9)
    df = p.select(F.col("p")[0].alias("chrom"), F.col("p")[2].alias("feature"), (F.col("p")[3].cast("long") - 1).alias("start"), F.col("p")[4].cast("long").alias("end"), F.col("p")[6].alias("strand"), X.attributes(F.col("p")[8]).alias("attributes"))
    return df.filter(F.col("feature") == feature) if feature else df


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, header, seq, length of each record; a record is one element of the text split at line starts with '>'."""
    whole = spark.read.option("lineSep", "\n>").text(path)
    record = F.ltrim(F.regexp_replace("value", "^>", ""))
    parts = whole.select(F.split(record, "\n", 2).alias("p")).filter("p[0] <> ''")
    seq = F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), "\\s", "")
    return parts.select(F.split(F.col("p")[0], "\\s+")[0].alias("id"), F.col("p")[0].alias("header"), seq.alias("seq"), F.length(seq).cast("long").alias("length"))


def aligned_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of one length, as id and seq; other lengths are an error."""
    df = fasta(spark, path)
    C.exactly_one(df.select("length").distinct(), "alignment length")
    return df.select("id", "seq")


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt, info (map), sample, call (map of FORMAT fields): one row for each site and sample."""
    text = spark.read.text(path)
    header = C.exactly_one(text.filter("startswith(value, '#CHROM')"), "VCF header")["value"].split("\t")
    p = text.filter("value <> '' and not startswith(value, '#')").select(F.split("value", "\t").alias("p"))
    site = p.select(F.col("p")[0].alias("chrom"), F.col("p")[1].cast("long").alias("pos"), F.col("p")[2].alias("id"), F.col("p")[3].alias("ref"), F.col("p")[4].alias("alt"), X.attributes(F.col("p")[7]).alias("info"), F.split(F.get("p", F.lit(8)), ":").alias("__format"), F.slice("p", 10, 1_000_000).alias("__calls"))
    calls = F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in header[9:]]).alias("s"), F.col("__calls").alias("c")))
    long = site.select("chrom", "pos", "id", "ref", "alt", "info", "__format", calls.alias("x"))
    return long.select("chrom", "pos", "id", "ref", "alt", "info", F.col("x.s").alias("sample"), F.map_from_arrays("__format", F.split("x.c", ":")).alias("call"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and row (from 1) of a text file's lines: the place in the part of the file, after the lines of the parts before it."""
    lines = spark.read.text(path).withColumn("__i", F.monotonically_increasing_id())
    part = F.shiftright("__i", 33)
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a part of the file
    before = lines.groupBy(part.alias("__p")).agg(F.count("*").alias("n")).select("__p", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"))
    place = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    return lines.join(F.broadcast(before), part == F.col("__p")).select("value", (F.col("__before") + place + 1).alias("row"))


def eigenstrat(spark: SparkSession, geno: str, snp: str, ind: str) -> DataFrame:
    """snp, sample, dosage of the reference-counting codes 2, 1, 0 as 0, 0.5 and 1; 9 is missing, other codes are an error."""
    sites = numbered_lines(spark, snp).select("row", F.split(F.trim("value"), "\\s+")[0].alias("snp"))
    samples = numbered_lines(spark, ind).select(F.col("row").alias("col"), F.split(F.trim("value"), "\\s+")[0].alias("sample"))
    cells = numbered_lines(spark, geno).select("row", F.posexplode(F.split("value", "")).alias("c", "code")).filter("code <> ''")
    dosage = F.when(F.col("code") == "9", F.lit(None).cast("double")).when(F.col("code").isin("0", "1", "2"), (2 - F.col("code").try_cast("int")) / 2.0).otherwise(F.raise_error(F.concat(F.lit("bad genotype code "), F.col("code"))).cast("double"))
    return cells.join(sites, "row").join(samples, F.col("c") + 1 == F.col("col")).select("snp", "sample", dosage.alias("dosage"))


def paf(spark: SparkSession, path: str, self_only: bool = False) -> DataFrame:
    """PAF with endpoints in rising order."""
    df = spark.read.schema(PAF).option("sep", "\t").csv(path)
    for side in ("query", "target"):
        s, e = F.col(f"{side}_start"), F.col(f"{side}_end")
        df = df.withColumns({f"{side}_start": F.least(s, e), f"{side}_end": F.greatest(s, e)})
    return df.filter("query = target") if self_only else df


def repeatmasker(spark: SparkSession, path: str) -> DataFrame:
    """Repeats as 0-based half-open intervals; header lines and short lines are left out."""
    p = spark.read.text(path).select(F.split(F.trim("value"), "\\s+").alias("p")).filter("size(p) >= 14 and try_cast(p[0] as int) is not null")
    return p.select(F.col("p")[4].alias("chrom"), (F.col("p")[5].cast("long") - 1).alias("start"), F.col("p")[6].cast("long").alias("end"), F.when(F.col("p")[8] == "C", "-").otherwise("+").alias("strand"), F.col("p")[9].alias("repeat"), F.col("p")[10].alias("class"))


def untangle(spark: SparkSession, path: str, species: list[str] | None = None) -> DataFrame:
    """Graph-untangle rows with numbers that parse, and the file's base name."""
    names = ["query", "query_start", "query_end", "ref", "ref_start", "ref_end", "score", "inv", "self_cov", "nth"]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).option("sep", "\t").option("comment", "#").csv(path)
    numbers = ["query_start", "query_end", "ref_start", "ref_end"]
    df = raw.withColumns({n: F.col(n).try_cast("long") for n in numbers}).withColumns({"score": F.col("score").try_cast("double"), "file": F.regexp_extract(F.input_file_name(), "([^/]+?)(?:\\.tsv)?$", 1)}).na.drop(subset=numbers)
    return df.filter(F.split("query", "#")[0].isin(*species)) if species else df


def fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chrom string, length long, offset long, line_bases int, line_width int").option("sep", "\t").csv(path).select("chrom", "length")


def eigenvec(spark: SparkSession, path: str, axes: int) -> DataFrame:
    """fid, iid and PCs, with or without a header."""
    names = ["FID", "IID", *[f"PC{k + 1}" for k in range(axes)]]
    rows = whitespace(spark, path, names).filter(~F.col("FID").isin("FID", "#FID"))
    return rows.select("FID", "IID", *[F.col(n).cast("double").alias(n) for n in names[2:]])


def association(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Additive tests of per-population result files, with the file they come from; a missing file is an error."""
    names = ["CHR", "SNP", "BP", "A1", "TEST", "NMISS", "BETA", "STAT", "P"]
    df = spark.read.text(paths).select(F.input_file_name().alias("file"), F.split(F.trim("value"), "\\s+").alias("p")).filter("size(p) >= 9 and p[0] <> 'CHR'")
    return df.select("file", *[F.col("p")[k].alias(n) for k, n in enumerate(names)]).filter("TEST = 'ADD'").withColumns({"BETA": F.col("BETA").try_cast("double"), "P": F.col("P").try_cast("double")})


def from_manifest(spark: SparkSession, manifest: DataFrame, path: str, key: str, schema: str, sep: str = "\t") -> DataFrame:
    """Rows of all files of a manifest with its key: one read, joined on the file name."""
    files = manifest.select(F.col(path).alias("__path"), key)
    paths = [r["__path"] for r in files.collect()]  # a list of file names
    rows = spark.read.schema(schema).option("sep", sep).csv(paths).withColumn("__name", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))
    return rows.join(F.broadcast(files.withColumn("__name", F.regexp_extract("__path", "([^/]+)$", 1))), "__name").drop("__name", "__path")


def log_total(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Sum of the numbers that a pattern's first group finds in a log; none is an error."""
    found = spark.read.text(path).select(F.regexp_extract("value", pattern, 1).alias("x")).filter("x <> ''")
    total = found.agg(F.sum(F.replace("x", F.lit(","), F.lit("")).cast("long")).alias("total"))
    return total.select(F.coalesce("total", F.raise_error(F.lit("the log has no such number")).cast("long")).alias("total"))


def demography(df: DataFrame, time: str = "gens_ago", size: str = "population_size", region: str = "region") -> DataFrame:
    """region, gens_ago, size of a table in long, wide or single-value form; repeated times are averaged."""
    if size in df.columns:
        long = df if region in df.columns else df.withColumn(region, F.lit("all"))
        long = long.select(region, time, F.col(size).alias("size"))
    else:
        others = [c for c in df.columns if c != time]
        long = df.select(time, *[F.col(c).cast("double").alias(c) for c in others]).unpivot([time], others, region, "size")
    return long.groupBy(region, time).agg(F.avg("size").alias("size"))


def families(df: DataFrame, family: str, members: str) -> DataFrame:
    """gene -> representative, the first member of its family; a gene of two families is an error."""
    rows = df.select(family, F.split(members, ",").alias("m")).select(F.trim(F.get("m", F.lit(0))).alias("representative"), F.explode("m").alias("gene")).select("representative", F.trim("gene").alias("gene"))
    both = rows.groupBy("gene").agg(F.count_distinct("representative").alias("n"), F.min("representative").alias("representative"))
    ok = F.when(F.col("n") == 1, F.col("representative")).otherwise(F.raise_error(F.concat(F.lit("in two families: "), F.col("gene"))).cast("string"))
    return both.select("gene", ok.alias("representative"))


def site_manifest(df: DataFrame, target: str) -> DataFrame:
    """chrom, pos, state, weight, shared of informative sites: rows whose label list holds the target and whose leading state is 0 or 1;
    the last row of a site wins."""
    labels = F.filter(F.transform(F.split(F.translate("SPECIFIC", "|", ","), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = df.withColumn("__line", F.monotonically_increasing_id()).withColumn("labels", labels).withColumn("state", F.split_part(target, F.lit(":"), F.lit(1)))
    good = rows.filter(F.array_contains("labels", target) & F.col("state").isin("0", "1"))
    last = good.groupBy("CHROM", "POS").agg(F.max_by(F.struct("state", "GF_SPECIFICITY", F.size("labels").alias("shared")), "__line").alias("x"))
    return last.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("x.state").cast("int").alias("state"), F.col("x.GF_SPECIFICITY").alias("weight"), F.col("x.shared").alias("shared"))


def copy_table(df: DataFrame, key: str, parts: dict[str, list[str]], total: list[str]) -> DataFrame:
    """A copy-number table under canonical names, whatever generation its columns are from: parts must add up to the total."""
    lower = {c.lower(): c for c in df.columns}

    def find(names: list[str]) -> Column:
        for n in names:
            if n.lower() in lower:
                return F.col(lower[n.lower()]).cast("long")
        raise C.SchemaError(f"none of {names} in {df.columns}")

    out = df.select(key, *[find(names).alias(part) for part, names in parts.items()], find(total).alias("total"))
    added = sum((F.col(p) for p in parts), F.lit(0))
    checked = F.when(F.col("total") == added, F.col("total")).otherwise(F.raise_error(F.concat(F.lit("parts don't add up for "), F.col(key).cast("string"))).cast("long"))
    return C.require_unique(out.withColumn("total", checked), [key])


def truth(df: DataFrame, sample: str, counts: list[str]) -> DataFrame:
    """Diploid counts: tables with two rows a sample are summed and samples with another number of rows dropped."""
    g = df.groupBy(sample).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in counts])
    haploid = g.agg(F.max("n").alias("most"))
    return g.crossJoin(F.broadcast(haploid)).filter((F.col("most") == 1) | (F.col("n") == 2)).select(sample, *counts, sum((F.col(c) for c in counts), F.lit(0)).alias("total"))
