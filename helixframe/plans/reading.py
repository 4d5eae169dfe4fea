"""Text formats: rows of the test tables are written in a format and read back by its reader."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources import readers as R
from ..sources import writers as W
from .registry import query


def place(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, or in a temporary one where none is set and Spark runs in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="helixframe-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> str:
    """Path of one text file with the frame's lines (small tables, in the order of the lines)."""
    path = place(df.sparkSession, name)
    df.coalesce(1).write.text(path)
    return path


@query("s01_s06_k01_tsv", "SELECT n_nationkey, n_name FROM nation")
def tsv(spark, d):
    path = place(spark, "tsv")
    W.tsv(table(spark, d, "nation"), path)
    return R.projected(spark, path, ["n_nationkey", "n_name"]).select(F.col("n_nationkey").cast("int"), "n_name")


@query("s02_s03_csv", "SELECT r_regionkey, r_name FROM region")
def csv(spark, d):
    path = place(spark, "regions") + ".csv"
    table(spark, d, "region").write.option("header", True).csv(path)
    return R.delimited(spark, path, "r_regionkey int, r_name string", required=["r_name"])


@query("s04_whitespace", "SELECT s_suppkey, s_name FROM supplier")
def whitespace(spark, d):
    path = written(table(spark, d, "supplier").select(F.concat(F.lit("  "), F.col("s_suppkey").cast("string"), F.lit("   \t"), F.replace("s_name", F.lit(" "), F.lit("_"))).alias("value")), "white")
    return R.whitespace(spark, path, ["s_suppkey", "s_name"]).select(F.col("s_suppkey").cast("long"), "s_name")


@query("s05_k02_bed", "SELECT 'chr' || s_nationkey AS chrom, s_suppkey AS s, s_suppkey + 100 AS e, s_name AS name FROM supplier")
def bed(spark, d):
    rows = table(spark, d, "supplier").select(F.concat(F.lit("chr"), F.col("s_nationkey").cast("string")).alias("chrom"), F.col("s_suppkey").alias("start"), (F.col("s_suppkey") + 100).alias("end"), F.col("s_name").alias("name"))
    path = place(spark, "bed")
    W.bed(rows, path, ["chrom", "start", "end", "name"])
    return R.bed(spark, path).select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), "name")


@query("s07_k03_missing_text", "SELECT c_custkey::VARCHAR AS c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS seg FROM customer")
def missing_text(spark, d):
    path = place(spark, "strings")
    W.tsv(table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg")), path, missing="", fields=["c_custkey", "seg", "absent"])
    return R.strings(spark, path).select("c_custkey", "seg")


@query("s08_k04_list", "SELECT n_name AS value FROM nation")
def listed(spark, d):
    path = place(spark, "list")
    W.lines(table(spark, d, "nation").select("n_name").unionByName(spark.createDataFrame([("# note",), ("NA",)], "n_name string")), path, "n_name")
    return R.listed(spark, path)


@query("s10_bed12", "SELECT 't' || p_partkey AS name, p_partkey AS s1, p_partkey + 10 AS e1, p_partkey + 20 AS s2, p_partkey + 25 AS e2 FROM part")
def bed12(spark, d):
    k = F.col("p_partkey").cast("string")
    line = F.concat_ws("\t", F.lit("chr1"), k, (F.col("p_partkey") + 25).cast("string"), F.concat(F.lit("t"), k), F.lit("0"), F.lit("+"), k, k, F.lit("0"), F.lit("2"), F.lit("10,5,"), F.lit("0,20,"))
    path = written(table(spark, d, "part").select(line.alias("value")).unionByName(spark.createDataFrame([("chr1\t5\tshort",)], "value string")), "bed12")
    e = F.col("exons")
    return R.bed12(spark, path).select("name", e[0]["s"].alias("s1"), e[0]["e"].alias("e1"), e[1]["s"].alias("s2"), e[1]["e"].alias("e2"))



@query("s11_gff3", "SELECT 'chr' || p_size AS chrom, p_partkey - 1 AS s, p_partkey + 9 AS e, p_name AS gene, 'a=b' AS note FROM part WHERE p_partkey > 0")
def gff3(spark, d):
    k = F.col("p_partkey")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("p_size").cast("string")), F.lit("src"), F.lit("gene"), k.cast("string"), (k + 9).cast("string"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("gene_name=old;junk;note=a=b;gene_name="), F.col("p_name")))
    path = written(table(spark, d, "part").filter("p_partkey > 0").select(line.alias("value")).unionByName(spark.createDataFrame([("##gff-version 3",)], "value string")), "gff3")
    return R.gff3(spark, path).select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), F.col("attributes")["gene_name"].alias("gene"), F.col("attributes")["note"].alias("note"))


@query("s12_s20_fasta", "SELECT 'n' || n_nationkey AS id, upper(n_name) || upper(n_name) AS seq, 2 * length(n_name) AS length FROM nation")
def fasta(spark, d):
    name = F.upper("n_name")
    path = place(spark, "fasta")
    records = table(spark, d, "nation").select(F.concat(F.lit(">n"), F.col("n_nationkey").cast("string"), F.lit(" some words\n"), name, F.lit("\n"), name).alias("value"))
    records.coalesce(1).write.text(path)
    return R.fasta(spark, path).select("id", "seq", "length")


@query("s14_s15_k05_vcf", "SELECT s_suppkey AS pos, unnest(['s1', 's2']) AS sample, unnest([CASE WHEN s_suppkey % 2 = 0 THEN '0|1' ELSE '1/1' END, './.']) AS gt, s_nationkey::VARCHAR AS dp FROM supplier")
def vcf(spark, d):
    s = table(spark, d, "supplier").select(F.lit("chr1").alias("chrom"), F.col("s_suppkey").alias("pos"), F.lit(".").alias("id"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.when(F.col("s_suppkey") % 2 == 0, "0|1").otherwise("1/1").alias("s1"), F.lit(None).cast("string").alias("s2"), F.col("s_nationkey").cast("string").alias("dp"))
    body = W.vcf_lines(s, ["s1", "s2"], F.concat(F.lit("DB;DP="), F.col("dp")), F.lit("GT"))
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",)], "value string")
    return R.vcf(spark, written(head.unionByName(body), "vcf")).select("pos", "sample", F.col("call")["GT"].alias("gt"), F.col("info")["DP"].alias("dp"))


@query("s17_paf", "SELECT 'q' || s_suppkey AS query, least(s_suppkey, 50) AS a, greatest(s_suppkey, 50) AS b FROM supplier")
def paf(spark, d):
    k = F.col("s_suppkey").cast("string")
    line = F.concat_ws("\t", F.concat(F.lit("q"), k), F.lit("1000"), k, F.lit("50"), F.lit("-"), F.concat(F.lit("q"), k), F.lit("1000"), F.lit("1"), F.lit("2"), F.lit("9"), F.lit("10"), F.lit("60"))
    path = written(table(spark, d, "supplier").select(line.alias("value")), "paf")
    return R.paf(spark, path, self_only=True).select("query", F.col("query_start").alias("a"), F.col("query_end").alias("b"))


@query("s18_repeatmasker", "SELECT 'chr' || s_nationkey AS chrom, s_suppkey AS s, s_suppkey + 50 AS e, CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE '+' END AS strand, 'SINE/Alu' AS class FROM supplier")
def repeatmasker(spark, d):
    k = F.col("s_suppkey")
    line = F.concat_ws("  ", F.lit(" 463"), F.lit("1.3"), F.lit("0.6"), F.lit("1.7"), F.concat(F.lit("chr"), F.col("s_nationkey").cast("string")), (k + 1).cast("string"), (k + 50).cast("string"), F.lit("(9)"), F.when(k % 2 == 0, "C").otherwise("+"), F.lit("AluY"), F.lit("SINE/Alu"), F.lit("1"), F.lit("50"), F.lit("(0)"), F.lit("1"))
    head = spark.createDataFrame([("   SW  perc perc",), ("score div. del.",)], "value string")
    path = written(head.unionByName(table(spark, d, "supplier").select(line.alias("value"))), "rm")
    return R.repeatmasker(spark, path).select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), "strand", "class")


@query("s21_eigenvec", "SELECT 'f' || s_nationkey AS fid, s_name AS iid, round(s_acctbal, 2) AS pc1 FROM supplier")
def eigenvec(spark, d):
    line = F.concat_ws(" ", F.concat(F.lit("f"), F.col("s_nationkey").cast("string")), F.replace("s_name", F.lit(" "), F.lit("_")), F.round("s_acctbal", 2).cast("string"))
    path = written(spark.createDataFrame([("#FID IID PC1",)], "value string").unionByName(table(spark, d, "supplier").select(line.alias("value"))), "eigenvec")
    return R.eigenvec(spark, path, 1).select(F.col("FID").alias("fid"), F.col("IID").alias("iid"), F.col("PC1").alias("pc1"))


@query("s25_log_total", "SELECT sum(s_suppkey * 1000)::BIGINT AS total FROM supplier")
def log_total(spark, d):
    line = F.concat(F.lit("[M] read "), F.format_number(F.col("s_suppkey") * 1000, 0), F.lit(" bases"))
    return R.log_total(spark, written(table(spark, d, "supplier").select(line.alias("value")), "log"), "read ([\\d,]+) bases")


@query("s27_demography", "SELECT 'A' AS region, p_size AS gens_ago, round(avg(p_retailprice), 6) AS size FROM part GROUP BY 2 UNION ALL SELECT 'B', p_size, round(avg(p_partkey), 6) FROM part GROUP BY 2")
def demography(spark, d):
    wide = table(spark, d, "part").select(F.col("p_size").alias("gens_ago"), F.col("p_retailprice").alias("A"), F.col("p_partkey").cast("double").alias("B"))
    return R.demography(wide).select("region", "gens_ago", F.round("size", 6).alias("size"))


@query("s32_families", "SELECT n_name AS gene, min(n_name) OVER (PARTITION BY n_regionkey) AS representative FROM nation")
def families(spark, d):
    f = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("members"))
    return R.families(f, "n_regionkey", "members")


@query("s35_copy_table", "SELECT p_partkey, p_size::BIGINT AS x, (p_size * 2)::BIGINT AS y, (p_size * 3)::BIGINT AS total FROM part")
def copy_table(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("New_X"), (F.col("p_size") * 2).alias("new_y"), (F.col("p_size") * 3).alias("All"))
    return R.copy_table(t, "p_partkey", {"x": ["x", "new_x"], "y": ["new_y"]}, ["all"])


@query("s36_truth", "SELECT l_orderkey, sum(l_quantity)::BIGINT AS q, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY 1 HAVING count(*) = 2")
def truth(spark, d):
    return R.truth(table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q")), "l_orderkey", ["q"])


@query("k07_colour_strip", "SELECT n_name || chr(9) || CASE n_regionkey WHEN 0 THEN '#ff0000' WHEN 1 THEN '#00ff00' ELSE '#cccccc' END || chr(9) || n_regionkey AS value FROM nation")
def colour_strip(spark, d):
    n = table(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("r"))
    return W.colour_strip(n, "n_name", {"0": "#ff0000", "1": "#00ff00"}, "r")


@query("k11_fan_out", "SELECT 'kept' AS sink, count(*) AS n FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 'rejected', count(*) FROM orders WHERE o_totalprice <= 100000")
def fan_out(spark, d):
    base = place(spark, "fan")
    big = F.col("o_totalprice") > 100000
    W.fan_out(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), {"kept": (big, f"{base}/kept"), "rejected": (~big, f"{base}/rejected")})
    parts = [spark.read.parquet(f"{base}/{s}").select(F.lit(s).alias("sink")) for s in ("kept", "rejected")]
    return parts[0].unionByName(parts[1]).groupBy("sink").agg(F.count("*").alias("n"))


@query("s13_aligned_fasta", "SELECT i::INT AS pos, count(DISTINCT b) AS bases FROM (SELECT unnest(range(1, 9)) AS i, unnest(list_transform(range(1, 9), lambda i: substr(rpad(upper(n_name), 8, 'X'), i, 1))) AS b FROM nation) GROUP BY 1")
def aligned_fasta(spark, d):
    records = table(spark, d, "nation").select(F.concat(F.lit(">g#"), F.col("n_nationkey").cast("string"), F.lit("\n"), F.rpad(F.upper("n_name"), 8, "X")).alias("value"))
    seqs = R.aligned_fasta(spark, written(records, "aligned"))
    cells = seqs.select(F.posexplode(F.split("seq", "")).alias("p", "b")).filter("b <> ''")
    return cells.groupBy((F.col("p") + 1).alias("pos")).agg(F.count_distinct("b").alias("bases"))


@query("s16_eigenstrat", "SELECT 'rs' || s_suppkey AS snp, unnest(['x', 'y']) AS sample, unnest([CASE s_suppkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 END, 0.5]) AS dosage FROM supplier")
def eigenstrat(spark, d):
    s = table(spark, d, "supplier").orderBy("s_suppkey").coalesce(1)
    code = F.when(F.col("s_suppkey") % 4 == 3, "9").otherwise((F.col("s_suppkey") % 4).cast("string"))
    geno, snp = place(spark, "geno"), place(spark, "snp")
    s.select(F.concat(code, F.lit("1"))).write.text(geno)
    s.select(F.concat(F.lit("rs"), F.col("s_suppkey").cast("string"), F.lit(" 1 0 1 A C"))).write.text(snp)
    ind = written(spark.createDataFrame([("x U p",), ("y U p",)], "value string").coalesce(1), "ind")
    return R.eigenstrat(spark, geno, snp, ind)


@query("s19_untangle", "SELECT 'sp#' || s_suppkey AS query, s_suppkey + 1 AS ref_start, round(s_acctbal, 2) AS score FROM supplier WHERE s_suppkey % 3 <> 0")
def untangle(spark, d):
    k = F.col("s_suppkey")
    end = F.when(k % 3 == 0, "bad").otherwise((k + 9).cast("string"))
    line = F.concat_ws("\t", F.concat(F.lit("sp#"), k.cast("string")), k.cast("string"), end, F.lit("ref"), (k + 1).cast("string"), (k + 10).cast("string"), F.round("s_acctbal", 2).cast("string"), F.lit("+"), F.lit("1"), F.lit("1"))
    other = spark.createDataFrame([("xx#1\t1\t2\tref\t1\t2\t0.5\t+\t1\t1",)], "value string")
    path = written(table(spark, d, "supplier").select(line.alias("value")).unionByName(other), "untangle")
    return R.untangle(spark, path, species=["sp"]).select("query", "ref_start", "score")


@query("s22_association", "SELECT p_partkey::VARCHAR AS snp, round(p_retailprice, 2) AS beta, CASE WHEN p_partkey % 5 <> 0 THEN p_size / 100.0 END AS p FROM part WHERE p_partkey % 2 = 0")
def association(spark, d):
    k = F.col("p_partkey")
    p = F.when(k % 5 == 0, "NA").otherwise((F.col("p_size") / 100).cast("string"))
    test = F.when(k % 2 == 0, "ADD").otherwise("COV1")
    line = F.concat_ws("  ", F.lit("1"), k.cast("string"), F.lit("10"), F.lit("A"), test, F.lit("99"), F.round("p_retailprice", 2).cast("string"), F.lit("1.0"), p)
    head = spark.createDataFrame([("CHR SNP BP A1 TEST NMISS BETA STAT P",)], "value string")
    path = written(head.unionByName(table(spark, d, "part").select(line.alias("value"))), "assoc")
    return R.association(spark, [path]).select(F.col("SNP").alias("snp"), F.col("BETA").alias("beta"), F.col("P").alias("p"))


@query("s24_s29_manifest", "SELECT 'h' || n_regionkey AS hap, n_name AS gene, n_nationkey::BIGINT AS cn FROM nation WHERE n_regionkey < 2")
def manifest(spark, d):
    base = place(spark, "haps")
    rows = []
    for r in (0, 1):
        table(spark, d, "nation").filter(F.col("n_regionkey") == r).select("n_name", "n_nationkey").coalesce(1).write.option("sep", "\t").csv(f"{base}/{r}")
        found = spark.read.option("pathGlobFilter", "part-*").text(f"{base}/{r}").select(F.input_file_name().alias("f")).distinct().first()["f"]
        rows.append((f"h{r}", found))
    listed_ = spark.createDataFrame(rows, "hap string, path string")
    return R.from_manifest(spark, listed_, "path", "hap", "gene string, cn long").select("hap", "gene", "cn")


@query("s26_single_metadata", "SELECT s_name, round(s_acctbal, 2) AS base_count FROM supplier WHERE s_suppkey = 7")
def single_metadata(spark, d):
    from ..functions import contracts as C

    s = table(spark, d, "supplier").filter("s_suppkey = 7").select("s_name", F.round("s_acctbal", 2).alias("base_count"))
    C.exactly_one(s, "metadata")
    return s


@query("s31_whitelist", "SELECT DISTINCT n_name AS value FROM nation WHERE n_nationkey < 5 UNION SELECT r_name FROM region")
def whitelist_files(spark, d):
    ids, regions = place(spark, "ids"), place(spark, "tab")
    W.lines(table(spark, d, "nation").filter("n_nationkey < 5"), ids, "n_name")
    W.tsv(table(spark, d, "region"), regions)
    return R.whitelist(spark, [ids], {regions: ["gene_label", "r_name"]})


@query("s33_site_manifest", "SELECT 'chr' || p_size AS chrom, p_partkey AS pos, (p_partkey % 2)::INT AS state, 0.8 AS weight, 2 AS shared FROM part WHERE p_partkey % 3 = 0")
def site_manifest(spark, d):
    k = F.col("p_partkey")
    m = table(spark, d, "part").select(F.concat(F.lit("chr"), F.col("p_size").cast("string")).alias("CHROM"), k.alias("POS"), F.when(k % 3 == 0, "X|Y").when(k % 3 == 1, "Y").otherwise("X,Y").alias("SPECIFIC"), F.lit(0.8).alias("GF_SPECIFICITY"), F.concat(F.when(k % 3 == 2, ".").otherwise((k % 2).cast("string")), F.lit(":0.9")).alias("X"))
    return R.site_manifest(m, "X")


@query("s34_cohort_loader", "SELECT c_custkey, trim(c_mktsegment) AS panel FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT starts_with(c_name, 'Customer#0000000')")
def cohort_loader(spark, d):
    from ..functions import contracts as C

    c = table(spark, d, "customer").filter((F.trim("c_mktsegment") == "BUILDING") & ~F.startswith("c_name", F.lit("Customer#0000000")))
    return C.require_unique(c, ["c_custkey"], "cohort").select("c_custkey", F.trim("c_mktsegment").alias("panel"))
