import pytest

from helixframe.llm import registry

from ..oracle import agree, duck
from . import brute

SF = "/root/testdata/sf0.001"


def test_registered_near_dedup_and_repeats(spark):
    """The queries themselves against plain Python, over the whole table."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in registry.QUERIES["op1_near_dedup"](spark, SF).collect()}
    assert got == brute.near_components(docs, 3, 85)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in registry.QUERIES["op3_suffix_dedup"](spark, SF).collect()}
    assert got == brute.repeats(docs)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    agree(spark, duck(SF), SF, registry.QUERIES[name], registry.SQL[name])


def test_pipeline(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    import public_tokenizers as P
    from helixframe.llm import registry as R

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = [(i, t) for i, t in docs if brute.quality_kept(t)]
    docs = sorted(brute.kept_lines(docs, 10).items())
    links = brute.near_components(docs, 5, 80)
    docs = [(i, t) for i, t in docs if links[i][1] == i]
    from helixframe.llm import decontamination

    frame = spark.createDataFrame(docs, "doc_id long, text string")
    con = duck(SF)
    con.register("d", frame.toPandas())
    leaks = {r[0] for r in con.execute(f"WITH {decontamination.contaminated_sql('d')} SELECT doc_id FROM leaks").fetchall()}
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs if i not in leaks}
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert out.groupby("doc_id")["length"].sum().to_dict() == want
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024
    assert len(corpus_pipeline.STAGES) == 5 and R.QUERIES
