"""Token files: exact round trips, random access, and the query against plain Python."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from helixframe.llm import packing, registry, token_files
from helixframe.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def reader(data):
    return token_files.TokenFile(lambda n, at: data[at : at + n])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40).map(lambda b: (1 << b) - 1 if b <= 32 else b * 997), min_size=1, max_size=1200))
def test_round_trip(values):
    ids = np.array(values, "<u4")
    data = token_files.encode_file([None, 5], [0, len(ids)], ids)
    one = reader(data)
    one.verify(len(data))
    assert one.ids().tolist() == values and [one.token(k) for k in range(len(values))] == values
    names, starts = one.documents()
    assert names == [None, 5] and starts.tolist() == [0, 0, len(ids)]


def test_codes_are_levelled_and_checked():
    ids = (np.random.default_rng(2).zipf(1.4, 9000) % 50257).astype("<u4")
    data = token_files.encode_file([1], [len(ids)], ids)
    one = reader(data)
    assert len(one.levels) > 2 and len(data) < 2 * len(ids)
    reads = []
    small = token_files.TokenFile(lambda n, at: reads.append(n) or data[at : at + n])
    reads.clear()
    assert small.token(8999) == ids[8999] and sum(reads) < 100 * len(one.levels)  # no block is decoded
    with pytest.raises(IndexError):
        one.token(9000)
    with pytest.raises(ValueError):
        reader(data[:-1] + bytes([data[-1] ^ 1])).verify(len(data))
    with pytest.raises(ValueError):
        reader(b"something else, of some length")


def want(rows, end=0):
    """rows in the order of the files -> (doc_id, start, n_tokens, crc32), and all ids."""
    tokenizer, out, every = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, len(every), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        every += ids
    return out, every


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = registry.QUERIES["op11_token_files"](spark, SF).orderBy("start").collect()
    assert [tuple(r) for r in got] == want(docs)[0]


def test_random_access_over_many_files(spark, frame, corpus):
    scratch = Scratch(spark, "test")
    root = scratch.path("files")
    manifest = token_files.write(frame, root, scratch, shard_ids=700, parts=3)
    assert manifest.count() > 5
    rows, every = want(sorted(corpus))
    assert [tuple(r) for r in token_files.read(manifest, root).orderBy("start").collect()] == rows
    places = [0, 1, 699, 700, 701, len(every) - 1, len(every), -1, None, 5, 5, *range(1500, 1600)]
    asked = spark.createDataFrame([(p,) for p in places], "at long")
    got = sorted(tuple(r) for r in token_files.tokens_at(manifest, root, asked, shard_ids=700).collect())
    assert got == sorted((p, every[p]) for p in places if p is not None and 0 <= p < len(every))


def test_odd_tables(spark, empty, with_null_ids, corpus):
    scratch = Scratch(spark, "test")
    assert token_files.read(token_files.write(empty, scratch.path("none"), scratch), scratch.path("none")).count() == 0
    both = with_null_ids.unionByName(with_null_ids).withColumn("start", F.lit("clash")).withColumn("file", F.lit(1))
    root = scratch.path("files")
    got = token_files.read(token_files.write(both, root, scratch, parts=4), root, keep_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 4 + sorted(2 * [i for i, _ in corpus])
    ends = np.cumsum([r["n_tokens"] for r in got])
    assert [r["start"] for r in got] == [0, *ends[:-1]] and all(len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 0 for r in got)


def test_ids_of_a_megabyte_and_of_special_text(spark):
    texts = ["word " * 220_000, "x" * 3000, "<|endoftext|> in a text", "é 漢字 \U0001f600\r\n\t" * 50, " " * 2000 + "\n" * 2000, "1234567890" * 300]
    tokenizer, files = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.tokenizer_files()
    for t in texts:
        assert packing.encoder(*files).ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    scratch = Scratch(spark, "test")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    manifest = token_files.write(frame, scratch.path("files"), scratch, shard_ids=1000, parts=2)
    assert [tuple(r) for r in token_files.read(manifest, scratch.path("files")).orderBy("start").collect()] == want(list(enumerate(texts)))[0]
