"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded sample of labelled rows (``TRAIN_ROWS``, the ones with
the smallest hash of their id, one row for an id; a documented parameter), none
of them held out.
An n-gram counts once per document. The ``FEATURES`` n-grams whose presence
tells most about the label (by G^2) are kept, each scaled by its log-count
ratio, and a logistic regression with an L2 penalty is fitted to the scaled
presence by Newton steps. The model is ``FEATURES`` numbers, whatever the
corpus; every document is scored over its whole text in one pass.

Defined results: null and empty texts have no features and get the score of the
intercept; repeated rows score alike; labels without a document or with a null
toxic are not used; without any label, or with one class only, all score the
class's share (0 without labels). Only doc_id and text are read for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import codepoints, release, sorted_distinct, tidy

TRAIN_ROWS = 6000
ORDERS = (3, 4, 5, 6)
FEATURES = 2000
BUCKET_BITS = 22
LEAST_DOCS = 4
RIDGE = 0.3
SMOOTH = 1.0
BLOCK_CHARS = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        """Feature number + 1 by bucket, 0 where there is none."""
        out = np.zeros(1 << BUCKET_BITS, np.uint16)
        out[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about BLOCK_CHARS, and the first one's place."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bucket of the n-gram that starts at each place, and the ends of the texts' parts. Texts are lower-cased and set off by spaces; no n-gram spans two."""
    chars, ends = codepoints([t.lower() + " " for t in texts], 1, 32)
    wide = chars.astype(np.uint64)
    h = np.zeros(len(wide), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(wide) - n + 1] * np.uint64(0x100000001B3) + wide[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            yield n, (h * MIX >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), ends


def present(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the features that occur, each once, in order."""
    found = [np.zeros(0, np.int64)]
    for n, bucket, ends in grams(texts):
        feature = table[bucket]
        at = np.flatnonzero(feature)
        doc = np.searchsorted(ends, at, "right") - 1
        inside = at + n <= ends[doc + 1]
        found.append((doc[inside] << 20) + feature[at[inside]] - 1)
    pairs = sorted_distinct(np.concatenate(found))
    return pairs >> 20, pairs & (1 << 20) - 1


def document_counts(texts: list[str]) -> np.ndarray:
    """How many of the texts hold each bucket's n-grams."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for _, part in blocks(texts):
        for n, bucket, ends in grams(part):
            doc = np.repeat(np.arange(len(part)), np.diff(ends))[: len(bucket)]
            inside = np.arange(len(bucket)) + n <= ends[doc + 1]
            pairs = sorted_distinct((doc[inside] << BUCKET_BITS) + bucket[inside])
            counts += np.bincount(pairs & (1 << BUCKET_BITS) - 1, minlength=len(counts))
    return counts


def g_squared(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Twice the log-likelihood ratio of a of n_a and b of n_b documents against a common share."""
    share = (a + b) / (n_a + n_b)
    term = lambda k, n, p: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(n * p, 1e-9)), 0)
    return 2 * (term(a, n_a, share) + term(b, n_b, share) + term(n_a - a, n_a, 1 - share) + term(n_b - b, n_b, 1 - share))


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    if not n.all():
        share = 0.0 if not n.sum() else float(n[1] > 0)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    clean, bad = (document_counts([t for t, y in zip(texts, toxic, strict=True) if y == k]) for k in (0, 1))
    often = np.flatnonzero(clean + bad >= min(LEAST_DOCS, max(1, int(n[1]) // 3)))
    a, b = clean[often].astype(float), bad[often].astype(float)
    best = np.argsort(-g_squared(a, b, *n), kind="stable")[:FEATURES]
    buckets = often[np.sort(best)]
    p, q = bad[buckets] + SMOOTH, clean[buckets] + SMOOTH
    ratio = np.log((p / (n[1] + 2 * SMOOTH)) / (q / (n[0] + 2 * SMOOTH)))
    table = Model(buckets, ratio, 0.0).table()
    x = np.zeros((len(texts), len(buckets) + 1), np.float32)
    x[:, -1] = 1
    for first, part in blocks(texts):
        doc, feature = present(part, table)
        x[first + doc, feature] = ratio[feature]
    w = newton(x, toxic.astype(float))
    return Model(buckets, w[:-1] * ratio, float(w[-1]))


def newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """L2-penalised logistic regression (the last column's weight is free), by Newton steps with halving."""
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    loss = lambda w: float(np.logaddexp(0, z := x @ w.astype(np.float32)).sum() - y @ z + (penalty * w * w).sum() / 2)
    now = loss(w)
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ w.astype(np.float32)).astype(float)))
        slope = x.T @ (p - y).astype(np.float32) + penalty * w
        curve = (x.T * (p * (1 - p)).astype(np.float32)) @ x
        step = np.linalg.solve(curve.astype(float) + np.diag(penalty), slope)
        size = 1.0
        while size > 1e-3 and (then := loss(w - size * step)) > now:
            size /= 2
        w, gain, now = w - size * step, now - then, then
        if gain < 1e-4 * abs(now) + 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``rows`` labelled documents, in one task of the cluster; only the model comes to the driver."""
    usable = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` rows: of rows that repeat a doc_id, one.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"])
        m = fit(frame["text"].tolist(), frame["toxic"].to_numpy())
        release()
        return pd.DataFrame({"bucket": np.append(m.buckets, -1), "weight": np.append(m.weights, m.intercept)})

    got = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "bucket long, weight double").toPandas()
    if not len(got):
        return fit([], np.zeros(0, int))
    got = got.sort_values("bucket")
    return Model(got["bucket"].to_numpy()[1:], got["weight"].to_numpy()[1:], float(got["weight"].iloc[0]))


def scores(model: Model, table: np.ndarray, texts: list[str]) -> np.ndarray:
    z = np.full(len(texts), model.intercept)
    for first, part in blocks(texts):
        doc, feature = present(part, table)
        z[first : first + len(part)] += np.bincount(doc, model.weights[feature], len(part))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = model.table()
        for frame in frames:
            score = scores(model, table, [t or "" for t in frame["text"]])
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": score, "predicted": (score >= 0.5).astype("int32")})

    return docs.select("doc_id", "text").mapInPandas(tidy(run), "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores under ``threshold``."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(scores(model, table, texts) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
