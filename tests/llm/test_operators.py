import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import chat_format, components, decontamination, line_dedup, near_dedup, packing, quality_rules, sharding, suffix_dedup, toxicity
from helixframe.llm.common import Scratch

from . import brute


def test_near_duplicates(frame, corpus):
    for size, share in ((3, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame, size, share).collect()}
        assert got == brute.near_components(corpus, size, share)


def test_near_duplicates_odd_tables(empty, with_null_ids, frame):
    assert near_dedup.near_duplicates(empty, 3, 85).count() == 0
    got = near_dedup.near_duplicates(with_null_ids, 3, 85).collect()
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    twice = near_dedup.near_duplicates(frame.unionByName(frame), 3, 85)
    once = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame, 3, 85).collect()}
    assert {r["doc_id"]: r["component_id"] for r in twice.collect()} == once


def test_signature_guarantee():
    chunks = near_dedup.chunks_for(85)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, (200, near_dedup.VALUES)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.VALUES, 2 * chunks - 1, replace=False)] ^= 1
    assert (near_dedup.keys(a, chunks) == near_dedup.keys(b, chunks)).any(1).all()


def test_components_of_odd_graphs(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1, 300).select(F.lit(1000).cast("long").alias("a"), (F.col("id") + 1000).alias("b"))
    got = components.components(path.unionByName(star), Scratch(spark, "test")).groupBy("component").count().collect()
    assert {(r["component"], r["count"]) for r in got} == {(0, 201), (1000, 300)}
    assert components.components(path.limit(0), Scratch(spark, "test")).count() == 0


def test_line_dedup(frame, corpus, empty, with_null_ids):
    out = line_dedup.drop_frequent_lines(frame, min_docs=10).collect()
    want = brute.kept_lines(corpus, 10)
    assert {r["doc_id"]: r["__kept"] for r in out} == want
    assert all(r["__n_lines"] - r["__n_dropped"] == 0 or r["__n_lines"] - r["__n_dropped"] == want[r["doc_id"]].count("\n") + 1 for r in out)
    assert out[0]["__th"] == "clash"
    assert line_dedup.drop_frequent_lines(empty).count() == 0
    assert line_dedup.drop_frequent_lines(with_null_ids).filter("doc_id is null").count() == 2
    # Repeated rows are documents of their own: five of one text twice make ten.
    rows = [(i, f"line {i}\nshared") for i in range(5)]
    five = frame.sparkSession.createDataFrame(rows, "doc_id long, text string")
    assert {r["__kept"] for r in line_dedup.drop_frequent_lines(five).collect()} == {t for _, t in rows}
    assert {r["__kept"] for r in line_dedup.drop_frequent_lines(five.unionByName(five)).collect()} == {f"line {i}" for i in range(5)}


def test_line_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(Scratch(spark, "test"), min_docs=3, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(1, 1, 1), (2, 2, 1 if b < 2 else 0), (100 + b, 0, 1)], "__h1 long, __h2 long, __n long").filter("__n > 0"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {tuple(r)[:2] for r in runs.settled().select("__h1", "__h2").collect()} == {(1, 1)}


def test_quality_rules(frame, corpus, empty, with_null_ids):
    got = {r["doc_id"]: r["__rejected_by"] is None for r in quality_rules.cascade(frame).collect()}
    assert got == {i: brute.quality_kept(t) for i, t in corpus}
    assert {r["doc_id"]: r["__rejected_by"] is None for r in quality_rules.cascade(frame, report=quality_rules.REPORT).collect()} == got
    assert quality_rules.cascade(empty).count() == 0
    assert quality_rules.cascade(with_null_ids).filter("doc_id is null").count() == 2
    twice = quality_rules.cascade(frame.unionByName(frame)).groupBy("doc_id").agg(F.count("*").alias("n"), F.count("__rejected_by").alias("bad")).collect()
    assert {r["doc_id"]: (r["n"], r["bad"]) for r in twice} == {i: (2, 0 if kept else 2) for i, kept in got.items()}
    order = [r.name for r, _, _ in quality_rules.plan(frame)]
    assert sorted(order) == sorted(r.name for r in quality_rules.RULES)


def test_quality_splits_each_text_once(frame):
    for df in (quality_rules.cascade(frame).filter("__rejected_by is null").select(*frame.columns), quality_rules.cascade(frame, report=quality_rules.REPORT)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("split(trim") == 1 or plan.count("[\\x20\\x09-\\x0D]+") == 1


def test_quality_later_rules_are_not_evaluated(spark):
    """A rule that fails when it is evaluated does no harm to texts that an earlier rule rejects."""
    bad = quality_rules.Rule("fails", lambda m: F.raise_error(F.concat(F.lit("evaluated"), m["n_words"].cast("string"))).cast("string") == "x")
    df = spark.createDataFrame([("short text",)], "text string")
    verdict = quality_rules.verdict([quality_rules.RULES[0], bad], quality_rules.Measures(F.col("text"), quality_rules.words(F.col("text"))))
    assert df.select(verdict).first()[0] == "too_short"


def test_output_names_that_are_taken(spark, frame):
    df = frame.withColumn("__kept", F.lit(1)).withColumn("__rejected_by", F.lit(2)).withColumn("__judged", F.lit(3)).withColumn("__n_lines", F.lit(4))
    out = quality_rules.cascade(df)
    assert out.columns == [*df.columns, "__rejected_by_"] and out.filter("__rejected_by = 2 and __rejected_by_ is null").count() > 0
    out = line_dedup.drop_frequent_lines(df)
    assert out.columns == [*df.columns, "__n_lines_", "__n_dropped", "__kept_"] and out.filter("__kept = 1 and __kept_ <> ''").count() > 0


def test_repeated_windows_by_both_ways(spark):
    text = " ".join(f"w{k % 40}" for k in range(300))
    rows = spark.createDataFrame([("a b c a b c",), (text,), ("a a a a",), ("a b",), (None,)], "text string")
    got = [r[0] for r in rows.select(quality_rules.repeat_words(quality_rules.words(F.col("text")))).collect()]
    assert got == [6, 300, 4, 0, 0]


def test_sharding(frame, corpus, empty):
    out = sharding.shard(frame, n_shards=7).toPandas()
    assert sorted(out["doc_id"]) == sorted(i for i, _ in corpus)
    text = dict(corpus)
    for r in out.itertuples():
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    total, most = out["size"].sum(), out["size"].max()
    assert (out.groupby("shard")["size"].sum() - total / 7).abs().max() <= 2 * most
    assert sharding.shard(empty, n_shards=3).count() == 0
    assert sharding.shard(frame, target_bytes=total // 4).select("shard").distinct().count() >= 4


def test_write_shards(frame, tmp_path, spark):
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(frame.drop("key"), path, n_shards=3)
    assert spark.read.parquet(path).count() == frame.count()


def test_packing(frame, corpus, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = packing.packed(frame, keep_ids=True).toPandas()
    for doc, text in corpus:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = out[out["doc_id"] == doc].sort_values("piece")
        assert [x for part in own["ids"] for x in part] == ids
        assert all(n == 1024 for n in own["length"].iloc[1:]) and own["start"].tolist() == [0, *np.cumsum(own["length"])[:-1]]
        for r in own.itertuples():
            assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 1024
    assert packing.packed(empty).count() == 0


def test_plan_places_everything():
    rng = np.random.default_rng(2)
    counts = Counter(rng.integers(1, 101, 5000).tolist())
    bins = packing.plan_bins(dict(counts), 100)
    placed = Counter()
    for n, items in bins:
        assert sum(items) <= 100 and sum(1 for x in items if 3 * x > 100) <= 2
        for x in items:
            placed[x] += n
    assert placed == counts
    assert sum(n for n, _ in bins) <= math.ceil(sum(k * v for k, v in counts.items()) / 100) * 1.03


def test_encoder_equals_the_tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    e = packing.encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in ["", " ", "a  b\n\nc ", "it's <|endoftext|> here", "漢字 é x", "\x1c\x00", "x" * 3000]:
        assert e.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<<SYS>>a<</SYS>>", "\\", "\\\\[INST]", " ends in space ", "[ROLE:x]", "<s></s>", "a]b", "[/INST", "\n", "é漢"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool]", "", "[ROLE:", "\\"])
def test_turns_read_back(role):
    for text in TEXTS:
        s, level = chat_format.render_turn(role, text)
        assert chat_format.parse_turn(s) == (role, text, len(s))
        if text == "plain" and role in chat_format.MARKS:
            assert level == 0


def test_chat_digests(spark):
    turns = [(1, 1, "assistant", "</s>[INST] x", 0), (1, 0, "user", None, 0), (None, 0, "user", "hi", 0), (2, 5, None, "odd", 0), (1, 1, "assistant", "</s>[INST] x", 0)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_turns(df)).collect()}
    own = "".join(f"{r}\n{t}\n" for r, t in [("user", ""), ("assistant", "</s>[INST] x"), ("assistant", "</s>[INST] x")])
    assert got[1]["turns_sha256"] == hashlib.sha256(own.encode()).hexdigest() and got[1]["n_turns"] == 3
    assert got[1]["loss_sha256"] == hashlib.sha256(("</s>[INST] x" * 2).encode()).hexdigest() and got[1]["loss_chars"] == 24
    assert set(got) == {1, 2, None} and chat_format.digests(chat_format.format_turns(df.limit(0))).count() == 0


def test_chat_order_of_equal_turns(spark):
    """Turn, role, text: not the order of the formatted turns, in which escapes and closing marks count."""
    rows = [(1, 3, "user", "ab X"), (1, 3, "user", "ab"), (1, 3, "tool", "z"), (1, 3, "assistant", "<s>"), (1, 3, "assistant", "Z"), (1, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = [("user", "first"), ("assistant", "<s>"), ("assistant", "Z"), ("tool", "z"), ("user", "ab"), ("user", "ab X")]
    got = chat_format.digests(chat_format.format_turns(df)).first()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256(b"<s>Z").hexdigest()
    assert got["formatted_chars"] == len(chat_format.render(want))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "]", ""]), st.text("<>/s[]INSTOYR: \\a\n", max_size=20)), max_size=6), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_whole_conversations_read_back(turns, step):
    whole = chat_format.render(turns)
    assert chat_format.parse(whole) == turns
    reader, got = chat_format.Reader(), []
    for at in range(0, len(whole), step):
        got += [x[:2] for x in reader.feed(whole[at : at + step])]
    reader.close()
    assert got == turns and reader.chars == len(whole)


@pytest.mark.parametrize("broken", ["", "[INST] a [/INST]", "<s>[INST] a", "<s>text", "<s> a</s>[INST]", "<s> a<s></s>"])
def test_broken_conversations_are_errors(broken):
    with pytest.raises(chat_format.Malformed):
        chat_format.parse(broken)


def test_suffix_dedup(frame, corpus, empty, with_null_ids):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame).collect()}
    assert got == brute.repeats(corpus)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeats(with_null_ids).filter("doc_id is null").count() == 2


@pytest.mark.parametrize("most", [0, 3])
def test_suffix_dedup_of_hot_groups(spark, frame, corpus, monkeypatch, most):
    """Groups are refined, with 0 down to single windows; shared cores have varied surroundings, so that every level splits some."""
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", most)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 4)
    rng, docs = random.Random(7), list(corpus)
    core = "".join(rng.choices("abcdefghij", k=120))
    for k in range(60):
        a = rng.randrange(70)
        b = min(120, a + rng.randint(16, 60))
        docs.append((1000 + k, "".join(rng.choices("xyz", k=rng.randint(0, 40))) + core[a:b] + "".join(rng.choices("xyz", k=rng.randint(0, 40))) + (core[a:b] if k % 5 == 0 else "")))
    every = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(every).collect()}
    assert got == brute.repeats(docs)


QUESTION = "A train leaves the northern station at 9 km from the old bridge and meets young Alice after 15 minutes of slow riding along the river"


def test_decontamination_finds_other_numbers_and_names(spark):
    changed = QUESTION.replace("9 km", "27 miles".replace("miles", "km")).replace("Alice", "Robert").replace("15 minutes", "48 minutes")
    twisted = "We saw 5 birds " + QUESTION.replace("Alice", "Bob")
    clean = "A train is a long thing that moves on rails and nothing here is like the question at all, not even in part, so it stays"
    docs = spark.createDataFrame([(1, "Intro words here. " + QUESTION + " and then more."), (2, changed), (3, twisted), (4, clean), (5, None), (6, ""), (None, QUESTION)], "doc_id long, text string")
    items = spark.createDataFrame([(10, QUESTION), (11, None), (12, "tiny one")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 10), (2, 10), (3, 10), (None, 10)}
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), items).count() == 0


ITEM = "first take 7 apples then give 7 pears then sell 7 plums then lose 7 figs then find 7 nuts then end"


def leaks(spark, docs, items, **how):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("__t", F.lit("clash")).withColumn("item_id", F.lit(5)).withColumn("w", F.lit(1))
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("__n", F.lit(0)).withColumn("doc_id", F.lit(0))
    return {(r["doc_id"], r["item_id"]): (r["matched_windows"], r["item_windows"]) for r in decontamination.contaminated(docs, items, **how).collect()}


def test_decontamination_needs_consistent_slots(spark):
    steady, wild = ITEM.replace("7", "31"), ITEM
    for n in ("3", "41", "5", "66", "8"):
        wild = wild.replace(" 7 ", f" {n} ", 1)
    assert leaks(spark, [(1, steady), (2, wild)], [(1, ITEM)]) == {(1, 1): (15, 15)}


@pytest.mark.parametrize("most", [decontamination.BROADCAST_WINDOWS, 0])
def test_decontamination_drops_only_windows_that_contradict(spark, monkeypatch, most):
    """A verbatim copy with one edited number, and a question in which two slots merely shared a value; by broadcast and by shuffle."""
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", most)
    one = ITEM[::-1].replace("7", "9", 1)[::-1]
    two = ITEM.replace("7 apples", "31 apples").replace("7 pears", "31 pears").replace(" 7 ", " 44 ")
    got = leaks(spark, [(1, one), (2, two), (2, two), (None, ITEM)], [(1, ITEM), (None, ITEM)])
    assert set(got) == {(d, i) for d in (1, 2, None) for i in (1, None)}
    words = one.split()
    assert got[1, 1] == (sum("9" not in words[k : k + 8] for k in range(15)), 15) and got[None, None] == (15, 15)


def test_decontamination_of_slots_in_rows(spark):
    """Tables of numbers and lists of names match by value."""
    rng = np.random.default_rng(5)
    table, other = (" ".join(map(str, rng.integers(100, 999, 40))) for _ in range(2))
    names = "we met Alice Brown Carol Dave Edith Frank Grace Heidi Ivan Judy Mallory Niaj Olivia Peggy Rupert"
    people = "we met " + " ".join(w[::-1].capitalize() for w in names.split()[2:])
    got = leaks(spark, [(1, "x " + table), (2, other), (3, "so " + names), (4, people)], [(1, table), (2, names)])
    assert {k: v[0] >= 0.8 * v[1] for k, v in got.items()} == {(1, 1): True, (3, 2): True}


def test_decontamination_of_short_and_repeated_items(spark):
    items = [(1, "Three small words"), (2, "4 km of road"), (3, None), (4, QUESTION), (4, QUESTION), (4, ITEM), (5, "42"), (6, "4 km")]
    got = leaks(spark, [(1, "see three (small) words here"), (2, "about 5 km of road, 42"), (3, QUESTION + " " + ITEM), (4, "nothing")], items)
    assert got[1, 1] == (1, 1) and got[2, 2] == (1, 1) and set(got) == {(1, 1), (2, 2), (3, 4)}


def test_toxicity(spark):
    import random

    rng = random.Random(3)
    from .conftest import prose

    rows = []
    for k in range(400):
        bad = k % 5 == 0
        text = prose(rng, 80)
        rows.append((k, text + " you worthless clown " + text[:40] if bad else text, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.filter("doc_id < 300"))
    odd = spark.createDataFrame([(1000, None), (1001, ""), (None, "plain words")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df.select("doc_id", "text").unionByName(odd), model).collect()}
    held = [(got[k], y) for k, _, y in rows if k >= 300]
    assert np.mean([(s >= toxicity.CUTOFF) == bool(y) for s, y in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    buckets, weights, intercept = toxicity.train(df.limit(0))
    assert len(buckets) == 0 and toxicity.score(df.select("doc_id", "text").limit(2), (buckets, weights, intercept)).count() == 2
