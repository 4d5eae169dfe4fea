"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed 4-, 5- and 6-byte windows of the A-Z lower-cased text.
Training takes at most TRAIN_ROWS labelled rows (those of the smallest hash of their id),
the only bound in the operator: it counts in how many toxic and clean texts each window
occurs, keeps the FEATURES windows that tell most, scales each by its log-count ratio and fits
a logistic regression. Scoring reads every whole text.

Cases: null and empty texts have no windows and get the score of the intercept; rows
without a label are not trained on; conflicting labels of one id count as toxic, and of several texts of one id the smallest is learnt from; with no
labelled rows of both kinds every score is the smoothed share of toxic rows; repeated rows and
null ids are scored like others; a very long text is scored whole, in parts of its batch; features that tell equally much are taken in the order of their bucket; only
the named columns are read, so others can't clash, and none is returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import U64, Texts, halves, mix
from .common import documents

SIZES = (4, 5, 6)
TRAIN_ROWS = 8_000
FEATURES = 20_000
MIN_DOCS = 4
BITS = 24
CUTOFF = 0.3
PART_BYTES = 1 << 20


def _windows(texts: Texts) -> Iterator[tuple[int, np.ndarray]]:
    """Text number and the buckets of all its windows."""
    total, back = texts.prefix()
    per_size = []
    for n in SIZES:
        h = (total[n:] - total[:-n]) * back[: len(total) - n] if len(total) > n else np.zeros(0, U64)
        per_size.append((mix(h + U64(n)) >> U64(64 - BITS)).astype(np.int32))
    for i in range(texts.n):
        lo, hi = texts.offsets[i], texts.offsets[i + 1]
        yield i, np.concatenate([b[lo : max(lo, hi - n + 1)] for n, b in zip(SIZES, per_size, strict=True)])


def _logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_features: int, l2: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2 logistic regression, by Nesterov's accelerated gradient."""
    n = len(y)
    w, look, b, look_b = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    x = np.random.default_rng(0).normal(size=n_features)
    for _ in range(12):  # the largest curvature, by power iteration
        x /= np.linalg.norm(x) or 1.0
        x = np.bincount(cols, values * np.bincount(rows, values * x[cols], n)[rows], n_features)
    rate = 1.0 / (0.25 * (np.linalg.norm(x) / n + 1.0) * 1.2 + l2)
    for t in range(steps):
        z = np.bincount(rows, values * look[cols], n) + look_b
        error = 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))) - y
        w_new = look - rate * (np.bincount(cols, values * error[rows], n_features) / n + l2 * look)
        b_new = look_b - rate * error.mean()
        m = t / (t + 3.0)
        look, look_b = w_new + m * (w_new - w), b_new + m * (b_new - b)
        w, b = w_new, b_new
    return w, b


def fit(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights (ratios included) and the intercept."""
    y = labels.astype(np.float64)
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return np.zeros(0, np.int32), np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5)))
    counts = np.zeros((2, 1 << BITS), np.int32)

    def each() -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(texts), 64):
            for i, buckets in _windows(Texts(pa.array(texts[at : at + 64], pa.string()), lower=True)):
                yield at + i, buckets

    for i, buckets in each():
        counts[int(y[i]), np.unique(buckets)] += 1
    found = np.flatnonzero(counts[0] + counts[1] >= MIN_DOCS)
    p, q = (counts[1, found] + 1.0) / (n1 + 2.0), (counts[0, found] + 1.0) / (n0 + 2.0)
    ratio = np.log(p / q)
    told = np.abs(ratio) * np.sqrt((counts[0, found] + counts[1, found]) / len(y))
    keep = np.argsort(-told, kind="stable")[:FEATURES]
    found, ratio = found[keep].astype(np.int32), ratio[keep]
    del counts
    table = np.zeros(1 << BITS, np.uint16)
    table[found] = np.arange(1, len(found) + 1)
    rows, cols = [], []
    for i, buckets in each():
        f = np.unique(table[buckets])
        f = f[f > 0].astype(np.int64) - 1
        rows.append(np.full(len(f), i))
        cols.append(f)
    rows_, cols_ = np.concatenate(rows), np.concatenate(cols)
    w, b = _logistic(rows_, cols_, ratio[cols_], y, len(found))
    return found, w * ratio, b


MODEL = "bucket int, weight double"


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """labelled: doc_id, text, toxic. One task fits the model on `rows` rows; the model has FEATURES weights at most."""
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for b in batches:
            texts += [t or "" for t in b.column(0).to_pylist()]
            labels += b.column(1).to_pylist()
        found, weights, intercept = fit(texts, np.array(labels, int))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(weights, intercept))], names=["bucket", "weight"])

    got = sample.repartition(1).mapInArrow(run, MODEL).toPandas()
    last = got["bucket"] == -1
    intercept = float(got["weight"][last].iloc[0]) if last.any() else 0.0
    return got["bucket"][~last].to_numpy(np.int32), got["weight"][~last].to_numpy(float), intercept


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    buckets, weights, intercept = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.uint16)
        table[buckets] = np.arange(1, len(buckets) + 1)
        seen = np.zeros(len(buckets) + 1, bool)
        w = np.append(0.0, weights)
        for whole in batches:
            for b in halves(whole, 1, PART_BYTES):
                z = np.full(b.num_rows, intercept)
                for i, found in _windows(Texts(b.column(1), lower=True)):
                    f = table[found]
                    f = f[f > 0]
                    seen[f] = True
                    z[i] += w[np.flatnonzero(seen)].sum()
                    seen[f] = False
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The sample is chosen among the labels, so only its texts are joined.
    chosen = labels.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    # Of rows that share an id the smallest text is learnt from.
    one = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    model = train(one)
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
