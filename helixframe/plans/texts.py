"""String, map, array and JSON functions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..session import table
from .registry import query


@query("x01_split_limit", "SELECT s_suppkey, p[1] AS chrom, p[2]::BIGINT AS pos, p[3] AS ref, p[4] AS alt FROM (SELECT s_suppkey, string_split('chr' || s_nationkey || ':' || s_suppkey || ':A:' || s_name, ':') AS p FROM supplier) WHERE len(p) = 4")
def split_limit(spark, d):
    site = F.concat(F.lit("chr"), F.col("s_nationkey").cast("string"), F.lit(":"), F.col("s_suppkey").cast("string"), F.lit(":A:"), F.col("s_name"))
    p = table(spark, d, "supplier").select("s_suppkey", F.split(site, ":", 4).alias("p")).filter(F.size("p") == 4)
    return p.select("s_suppkey", F.col("p")[0].alias("chrom"), F.col("p")[1].cast("long").alias("pos"), F.col("p")[2].alias("ref"), F.col("p")[3].alias("alt"))


@query("x02_split_part", "SELECT p_partkey, split_part(p_type, ' ', 1) AS first_part, string_split(p_type, ' ')[-1] AS last_part FROM part")
def split_part(spark, d):
    return table(spark, d, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("first_part"), F.element_at(F.split("p_type", " "), -1).alias("last_part"))


@query("x03_canonical_name", "SELECT page_id, lower(trim(regexp_replace(replace(url, '_', ' '), '\\s+', ' ', 'g'))) AS name FROM pages")
def canonical(spark, d):
    return table(spark, d, "pages").select("page_id", X.canonical_name(F.col("url")).alias("name"))


@query("x04_sanitise", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS label FROM pages")
def sanitise(spark, d):
    return table(spark, d, "pages").select("page_id", X.sanitised(F.col("url")).alias("label"))


@query("x05_attributes", "SELECT p_partkey, 'x=' || p_size AS b, p_type AS name FROM part")
def attributes(spark, d):
    col9 = F.concat(F.lit("name=old;junk;b=x="), F.col("p_size").cast("string"), F.lit(";name="), F.col("p_type"))
    m = table(spark, d, "part").select("p_partkey", X.attributes(col9).alias("m"))
    return m.select("p_partkey", F.col("m")["b"].alias("b"), F.col("m")["name"].alias("name"))


@query("x06_code_normalise", "SELECT p_partkey, CASE WHEN length(c) > 3 THEN left(c, 3) || '.' || substr(c, 4) ELSE c END AS code FROM (SELECT p_partkey, replace('E' || p_partkey || '.' || p_size, '.', '') AS c FROM part)")
def code_normalise(spark, d):
    c = F.concat(F.lit("E"), F.col("p_partkey").cast("string"), F.lit("."), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", X.dotted_code(c).alias("code"))


@query("x07_explode_codes", "SELECT p_partkey, trim(c) AS code, 'part' AS kind FROM (SELECT p_partkey, unnest(string_split(replace(p_type, ' ', ' | ') || '| ', '|')) AS c FROM part) WHERE trim(c) <> ''")
def explode_codes(spark, d):
    cell = F.concat(F.replace("p_type", F.lit(" "), F.lit(" | ")), F.lit("| "))
    rows = table(spark, d, "part").select("p_partkey", F.explode(F.transform(F.split(cell, "\\|"), lambda x: F.trim(x))).alias("code"), F.lit("part").alias("kind"))
    return rows.filter("code <> ''")


GT = "CASE l_linenumber % 5 WHEN 0 THEN '0/1' WHEN 1 THEN '1|1' WHEN 2 THEN './.' WHEN 3 THEN '0|2' ELSE '.' END"


def genotypes(spark, d):
    n = F.col("l_linenumber") % 5
    gt = F.when(n == 0, "0/1").when(n == 1, "1|1").when(n == 2, "./.").when(n == 3, "0|2").otherwise(".")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", gt.alias("gt"))


@query("x08_x09_x10_genotypes", f"SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(gt, '^[01][/|][01]$') THEN left(gt, 1)::INT + right(gt, 1)::INT END AS dosage, CASE WHEN regexp_matches(gt, '^[01]\\|[01]$') THEN gt ELSE '.|.' END AS phased, translate(gt, '01', '10') AS flipped FROM (SELECT *, {GT} AS gt FROM lineitem)")
def genotype_codes(spark, d):
    gt = F.col("gt")
    return genotypes(spark, d).select("l_orderkey", "l_linenumber", X.allele_dosage(gt).alias("dosage"), X.phased_or_missing(gt).alias("phased"), X.flipped(gt).alias("flipped"))


@query("x11_trailing_number", "SELECT c_custkey, nullif(regexp_extract('s.' || c_custkey || '.' || c_custkey % 4, '\\.([12])$', 1), '') AS hap FROM customer")
def trailing_number(spark, d):
    name = F.concat_ws(".", F.lit("s"), F.col("c_custkey").cast("string"), (F.col("c_custkey") % 4).cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.nullif(F.regexp_extract(name, "\\.([12])$", 1), F.lit("")).alias("hap"))


@query("x12_x13_counts_label", "SELECT doc_id, CASE WHEN a > 0 THEN 'T' || a ELSE '' END || CASE WHEN b > 0 THEN 'N' || b ELSE '' END AS label FROM (SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS a, (length(text) - length(replace(text, 'ana', ''))) // 3 AS b FROM documents)")
def counts_label(spark, d):
    n = lambda s: F.regexp_count("text", F.lit(s))
    c = table(spark, d, "documents").select("doc_id", n("the").alias("a"), n("ana").alias("b"))
    return c.select("doc_id", X.copy_label({"T": F.col("a"), "N": F.col("b")}).alias("label"))


@query("x14_region_parse", "SELECT s_suppkey, 'chr' || s_nationkey AS chrom, 1000000 + s_suppkey AS s, 2000000 + s_suppkey AS e FROM supplier")
def region_parse(spark, d):
    with_commas = lambda base: F.format_number(F.lit(base) + F.col("s_suppkey"), 0)
    text = F.concat(F.lit("chr"), F.col("s_nationkey").cast("string"), F.lit(":"), with_commas(1000000), F.lit("-"), with_commas(2000000))
    part = lambda k: F.regexp_extract(text, "^([^:]+):([\\d,]+)-([\\d,]+)$", k)
    number = lambda k: F.replace(part(k), F.lit(","), F.lit("")).cast("long")
    return table(spark, d, "supplier").select("s_suppkey", part(1).alias("chrom"), number(2).alias("s"), number(3).alias("e"))


@query("x15_header_token", "SELECT p_partkey, string_split(p_type, ' ')[1] AS token FROM part")
def header_token(spark, d):
    header = F.concat(F.lit(">"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.split(F.substring(header, F.lit(2), F.length(header)), "\\s+")[0].alias("token"))


@query("x16_canonical_kmers", "WITH s AS (SELECT item_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'etaoinshrdlucmfwypvbgkjqxz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM benchmark), k AS (SELECT item_id, unnest(list_transform(range(1, length(seq) - 9), lambda i: substr(seq, i, 11))) AS k FROM s) SELECT item_id, count(DISTINCT least(k, reverse(translate(k, 'ACGT', 'TGCA')))) AS kmers FROM k GROUP BY 1")
def canonical_kmers(spark, d):
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    seq = F.translate(letters, "etaoinshrdlucmfwypvbgkjqxz", "ACGTACGTACGTACGTACGTACGTAC")
    from ..operators.sequence import canonical_kmers as kmers

    s = table(spark, d, "benchmark").select("item_id", seq.alias("seq"))
    return kmers(s, "item_id", "seq", 11).groupBy("item_id").agg(F.count_distinct("kmer").alias("kmers"))


@query("x17_upper_filter", "SELECT n_nationkey, regexp_replace(upper(n_name), '[^A-Z]', '', 'g') AS name FROM nation")
def upper_filter(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.regexp_replace(F.upper("n_name"), "[^A-Z]", "").alias("name"))


@query("x18_formatted_ids", "SELECT s_suppkey, printf('S%05d', s_suppkey) || '|' || s_nationkey AS id FROM supplier")
def formatted_ids(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.concat_ws("|", F.format_string("S%05d", "s_suppkey"), F.col("s_nationkey").cast("string")).alias("id"))


@query("x19_slice_interval", "SELECT doc_id, substr(text, 11, 20) AS piece FROM documents")
def slice_interval(spark, d):
    start, end = 10, 30
    return table(spark, d, "documents").select("doc_id", F.substring("text", start + 1, end - start).alias("piece"))


@query("x20_patch_positions", "SELECT n_nationkey, string_agg(CASE WHEN i = 3 THEN 'X' ELSE substr(n_name, i, 1) END, '' ORDER BY i) AS patched FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) + 1)) AS i FROM nation) GROUP BY 1")
def patch_positions(spark, d):
    from ..operators.sequence import patched

    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    patches = n.select("n_nationkey", F.lit(3).alias("pos"), F.lit("X").alias("base")).filter(F.length("n_name") >= 3)
    return patched(n, patches, "n_nationkey", "n_name", "pos", "base").select("n_nationkey", "patched")


@query("x21_basename", "SELECT page_id, regexp_extract(url, '([^/]+?)(?:\\.[a-z]+)?$', 1) AS base FROM pages")
def basename(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "([^/]+?)(?:\\.[a-z]+)?$", 1).alias("base"))


@query("x22_x26_set_cells", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(lower(p_type), ' '), lambda x: trim(x)))), ',') AS cells, len(list_filter(list_distinct(string_split(lower(p_type), ' ')), lambda x: x NOT IN ('steel', 'tin'))) AS rest FROM part")
def set_cells(spark, d):
    cells = F.array_distinct(F.transform(F.split(F.lower("p_type"), " "), lambda x: F.trim(x)))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(cells), ",").alias("cells"), F.size(F.array_except(cells, F.array(F.lit("steel"), F.lit("tin")))).cast("long").alias("rest"))


@query("x23_blank_markers", "SELECT event_id, CASE WHEN x IN ('NA', 'nan', 'None', '-1', '') THEN NULL ELSE x END AS x FROM (SELECT event_id, ['NA', 'nan', 'None', '-1', '', 'ok', event_type][event_id % 7 + 1] AS x FROM events)")
def blank_markers(spark, d):
    x = F.get(F.array(F.lit("NA"), F.lit("nan"), F.lit("None"), F.lit("-1"), F.lit(""), F.lit("ok"), F.col("event_type")), (F.col("event_id") % 7).cast("int"))
    return table(spark, d, "events").select("event_id", X.blank_to_null(x).alias("x"))


@query("x25_json_props", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("x27_path_join", "SELECT l_orderkey, l_linenumber, string_agg(l_suppkey::VARCHAR, '+') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS path FROM lineitem")
def path_join(spark, d):
    li = table(spark, d, "lineitem")
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    paths = li.groupBy("l_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["l_suppkey"].cast("string")), "+").alias("path"))
    return li.select("l_orderkey", "l_linenumber").join(paths, "l_orderkey")



@query("x29_date_functions", "SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, strftime(o_orderdate, '%Y-%m') AS m, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS days FROM orders")
def dates(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(t).alias("y"), F.quarter(t).alias("q"), F.date_format(t, "yyyy-MM").alias("m"), F.datediff(F.to_date(t), F.lit("1992-01-01").cast("date")).alias("days"))


@query("x30_source_names", "SELECT p_partkey, split_part(split_part(n, '.', 2), '#', 1) AS transcript, CASE WHEN contains(n, '#') THEN split_part(n, '#', 2) ELSE 'none' END AS gene FROM (SELECT p_partkey, 'ref.' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '#' || p_size ELSE '' END AS n FROM part)")
def source_names(spark, d):
    name = F.concat(F.lit("ref."), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("#"), F.col("p_size").cast("string"))).otherwise(""))
    after = F.split_part(name, F.lit("."), F.lit(2))
    return table(spark, d, "part").select("p_partkey", F.split_part(after, F.lit("#"), F.lit(1)).alias("transcript"), F.when(F.contains(name, F.lit("#")), F.split_part(name, F.lit("#"), F.lit(2))).otherwise("none").alias("gene"))


@query("x31_motif", "SELECT doc_id, len(list_filter(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS motifs FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def motif(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    spots = F.when(F.size("w") > 2, F.sequence(F.lit(1), F.size("w") - 2)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(spots, lambda i: F.slice("w", i, 2) == F.array(F.lit("of"), F.lit("the")))
    return w.select("doc_id", F.size(hits).cast("long").alias("motifs"))


@query("x32_safe_numbers", "SELECT event_id, coalesce(try_cast(x AS DOUBLE), -1.0) AS v FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE event_id::VARCHAR END AS x FROM events)")
def safe_numbers(spark, d):
    x = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", F.coalesce(x.try_cast("double"), F.lit(-1.0)).alias("v"))
