"""Stateful streams in three triggers, with late rows, against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import ordered as batch
from helixframe.streaming import ordered, windows


@pytest.fixture(scope="module")
def events(spark):
    """Three parts; a third of the rows come one part later than their time, and the last part holds a row that closes the stream."""
    rng = random.Random(5)
    parts = [[], [], []]
    for k in range(400):
        at = k // 134
        late = rng.random() < 0.3 and k % 134 > 100  # within the delay
        row = (k, f"u{rng.randrange(6)}", 1_700_000_000 + 60 * k + rng.choice([0, 0, 60]), None if rng.random() < 0.4 else rng.choice(["x", "y", "z"]), float(rng.randrange(100)), rng.choice("+-."))
        parts[min(2, at + late)].append(row)
    parts[2].append((10_000, "close", 1_800_000_000, "x", 0.0, "+"))
    schema = "id long, user string, at long, tag string, value double, dir string"
    return [spark.createDataFrame(p, schema).withColumn("ts", F.timestamp_seconds("at")).drop("at") for p in parts]


def streamed(spark, events, folder, make):
    """The sink's rows after one trigger for each part."""
    ordered.state_store(spark)
    (folder / "in").mkdir()
    source = spark.readStream.schema(events[0].schema).parquet(f"{folder}/in")
    name = f"sink_{abs(hash(str(folder)))}"
    for p in events:
        p.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        q = make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def whole(events):
    return events[0].union(events[1]).union(events[2])


def test_carried_forward(spark, events, tmp_path):
    got = streamed(spark, events, tmp_path, lambda s: ordered.carried_forward(s, "user", "ts", ["id"], "tag", "last", "Unknown", "50 minutes"))
    want = batch.locf(whole(events), ["user"], ["ts", "id"], F.col("tag"), "last", "Unknown")
    pick = lambda df: sorted((r["id"], r["ts"], r["last"]) for r in df.filter("id < 10000").collect())
    assert pick(got) == pick(want)


def test_backtrack_chunks(spark, events, tmp_path):
    got = streamed(spark, events, tmp_path, lambda s: ordered.backtrack_chunks(s, "user", "ts", ["id"], "value", "dir", 10.0, "50 minutes"))
    want = batch.chunks_on_backtrack(whole(events), ["user"], ["ts", "id"], "value", "dir", 10.0)
    pick = lambda df: sorted((r["id"], r["chunk"]) for r in df.filter("id < 10000").collect())
    assert pick(got) == pick(want) and len({c for _, c in pick(got)}) > 3


def test_sessions(spark, events, tmp_path):
    got = streamed(spark, events, tmp_path, lambda s: windows.sessions(s, "ts", "user", "5 minutes", "50 minutes"))
    want = windows.sessions(whole(events), "ts", "user", "5 minutes")
    pick = lambda df: sorted(tuple(r) for r in df.select("user", "start", "end", "n").filter("user <> 'close'").collect())
    assert pick(got) == pick(want)
