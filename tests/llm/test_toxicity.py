"""Held-out accuracy on labelled documents, and what the classifier does at the edges."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from millrace.llm import toxicity as tx
from tests.llm.conftest import ODD_TEXTS

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


@pytest.fixture
def corpus(spark, documents, prose):
    rows = [(i, f"{prose(30, i)} {'you IDIOT' if i % 5 == 2 else 'friend'} {prose(30, i + 1000)}") for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 2)) for i in range(300)] + [(7777, 1, 1), (4, 1, None)], LABELS)
    return documents(rows), labels


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    model = tx.train(docs, labels)
    got = {r.doc_id: r for r in tx.score_documents(docs, model).collect()}
    test = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(test) > 30 and sum(got[i].predicted == (i % 5 == 2) for i in test) >= 0.97 * len(test)
    kept = tx.keep_clean(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}


def test_training_ignores_held_out_labels_and_other_columns(spark, corpus):
    docs, labels = corpus
    held = tx.held_out(labels["doc_id"])
    flipped = labels.selectExpr("doc_id", "0 as quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = tx.train(docs, labels), tx.train(docs.selectExpr("doc_id", "text", "'zz' as lang", "'s' as source"), flipped.selectExpr("doc_id", "cast(quality as int) quality", "cast(toxic as int) toxic"))
    assert labels.filter(held).count() > 0
    assert a.buckets.tolist() == b.buckets.tolist() and np.allclose(a.weights, b.weights) and a.intercept == pytest.approx(b.intercept)


def plain_features(text):
    """Buckets of a text's character n-grams, by the definition, in whole numbers."""
    t, out, wrap = f" {text.lower()} ", set(), (1 << 64) - 1
    for n in tx.ORDERS:
        for i in range(len(t) - n + 1):
            h = 0
            for k, c in enumerate(t[i : i + n], 1):
                h = (h * 0x100000001B3 + ord(c) + k) & wrap
            out.add((h * int(tx.MIX) & wrap) >> 64 - tx.BUCKET_BITS)
    return out


def test_model_against_plain_python(monkeypatch, prose):
    """Counts, choice of features, ratios, the optimum of the fit, and scores, all from the definitions."""
    monkeypatch.setattr(tx, "FEATURES", 40)
    rng = random.Random(1)
    toxic = np.array([int(rng.random() < 0.4) for _ in range(60)])
    texts = [f"{prose(12, i)} {rng.choice(['vile fool', 'you IDIOT é']) if y and rng.random() < 0.8 else 'dear friend'} {prose(5, 900 + i)}" for i, y in enumerate(toxic)]
    model = tx.fit(texts, toxic)
    sets = [plain_features(t) for t in texts]
    n = [int((toxic == k).sum()) for k in (0, 1)]
    held = {b: [sum(b in s for s, y in zip(sets, toxic) if y == k) for k in (0, 1)] for b in set().union(*sets)}

    def g2(a, b):
        share, total = (a + b) / sum(n), 0.0
        for k, m in ((a, n[0]), (b, n[1])):
            for x, p in ((k, share), (m - k, 1 - share)):
                total += x * math.log(x / (m * p)) if x else 0
        return 2 * total

    often = {b: g2(*c) for b, c in held.items() if sum(c) >= min(tx.LEAST_DOCS, max(1, n[1] // 3))}
    limit = sorted(often.values(), reverse=True)[39]
    assert {b for b, g in often.items() if g > limit + 1e-9} <= set(model.buckets.tolist()) <= {b for b, g in often.items() if g >= limit - 1e-9}
    ratio = {b: math.log((held[b][1] + 1) / (n[1] + 2)) - math.log((held[b][0] + 1) / (n[0] + 2)) for b in model.buckets.tolist()}
    w = dict(zip(model.buckets.tolist(), model.weights / [ratio[b] for b in model.buckets.tolist()], strict=True))
    score = [1 / (1 + math.exp(-model.intercept - sum(w[b] * ratio[b] for b in w if b in s))) for s in sets]
    for b in w:  # the slope of the penalised loss is 0
        assert sum((p - y) * ratio[b] for p, y, s in zip(score, toxic, sets) if b in s) + tx.RIDGE * w[b] == pytest.approx(0, abs=5e-3)
    assert sum(score) - sum(toxic) == pytest.approx(0, abs=5e-3)
    assert tx.scores(model, model.table(), texts) == pytest.approx(score)


def test_training_rows_are_bounded(documents, spark):
    rows = [(i % 7, f"text {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(7)], LABELS)
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tx, "fit", lambda texts, toxic: tx.Model(np.array([len(texts)]), np.array([0.5]), 0.0))
        seen = tx.train(documents(rows), labels, rows=4).buckets.tolist()
    assert seen == [4]


def test_presence_counts_once_and_blocks_do_not_matter(monkeypatch, prose):
    texts = [prose(50, i) for i in range(20)] + [t or "" for t in ODD_TEXTS]
    toxic = np.arange(len(texts)) % 2
    model = tx.fit(texts, toxic)
    one = tx.scores(model, model.table(), texts)
    monkeypatch.setattr(tx, "BLOCK_CHARS", 500)
    assert np.allclose(one, tx.scores(model, model.table(), texts))
    again = tx.scores(model, model.table(), [f"{t} {t}" for t in texts[:1]])
    assert 0 <= again[0] <= 1


def test_odd_rows_and_missing_labels(spark, corpus, documents):
    docs, labels = corpus
    model = tx.train(docs, labels)
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "you idiot"), (1, "a")]
    got = tx.score_documents(documents(rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert tx.score_documents(documents([]), model).count() == 0
    none = tx.train(docs, spark.createDataFrame([], LABELS))
    assert {r.predicted for r in tx.score_documents(docs, none).collect()} == {0}
    ones = tx.train(docs, spark.createDataFrame([(i, 1, 1) for i in range(20)], LABELS))
    assert {r.predicted for r in tx.score_documents(docs, ones).collect()} == {1}


def test_supplied_labels(spark):
    """Accuracy on the held-out rows of the supplied documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = tx.score_documents(docs, tx.train(docs, labels)).join(labels, "doc_id").filter(tx.held_out(labels["doc_id"])).collect()
    right = sum(r.predicted == r.toxic for r in scored)
    caught = sum(r.predicted for r in scored if r.toxic)
    assert right >= 0.985 * len(scored) and caught >= 0.9 * sum(r.toxic for r in scored)
