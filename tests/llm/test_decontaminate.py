"""Contamination against a search of every window in every document."""

import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from millrace.llm import decontaminate as dc
from tests.llm.conftest import ODD_TEXTS

BENCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("words", T.StringType())])


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench):
    out = []
    for doc_id, text in docs:
        d, hit, items = words(text), set(), set()
        for item_id, item in bench:
            w = words(item)
            span = min(13, len(w))
            for s in range(len(w) - span + 1 if w else 0):
                for p in range(len(d) - span + 1):
                    if d[p : p + span] == w[s : s + span]:
                        hit |= set(range(p, p + span))
                        items |= {item_id} - {None}
        ids = ",".join(sorted(map(str, items)))
        out.append((doc_id, len(d), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(d)))
    return sorted(out, key=repr)


@pytest.fixture
def run(spark, documents):
    def go(docs, bench):
        table = spark.createDataFrame([(*b, "w") for b in bench], BENCH)
        return sorted(map(tuple, dc.contamination(documents(docs), table).drop("_hash", "_whole").collect()), key=repr)

    return go


def test_windows_short_items_edges_and_repeats(run, prose):
    item = prose(40, 1)
    w = item.split()
    bench = [(1, item), (2, prose(20, 2)), (3, "Tiny item"), (4, None), (5, "?! ..."), (6, item), (None, prose(15, 3)), (10, "one")]
    docs = [
        (1, prose(100, 10) + " " + " ".join(w[5:18]) + " " + prose(20, 11)),  # one window
        (2, prose(30, 10) + " " + " ".join(w[5:17]) + " " + prose(20, 11)),  # one word short of a window
        (3, " ".join(w[-13:]) + " " + " ".join(w[:13])),  # the item's ends at the document's ends, in the wrong order
        (4, ", ".join(w).upper()),
        (5, item + " " + item),
        (6, "a TINY, item! and tiny item"),
        (7, prose(15, 3)),
        (7, prose(15, 3)),
        (7, item),
        (None, item),
        (8, "ONE é two " * 50),
        *((20 + i, t) for i, t in enumerate(ODD_TEXTS)),
    ]
    assert run(docs, bench) == brute(docs, bench)


def test_common_words_only(run):
    """Windows of one repeated word align everywhere."""
    bench = [(1, "the " * 14), (2, "the of " * 10)]
    docs = [(1, "the " * 13), (2, "the " * 12), (3, "of the " * 30), (4, "the of the the of")]
    assert run(docs, bench) == brute(docs, bench)


@pytest.mark.parametrize("n", [20000, 100000])
def test_long_text_of_one_word(run, n):
    bench = [(1, "the " * 14), (2, "the " * 12 + "end the"), (3, "of " * 14)]
    ids = [hashlib.sha256(x.encode()).hexdigest() for x in ("1", "")]
    got = run([(1, "the " * n), (2, "of the " * (n // 2)), (3, "the " * (n // 2) + "of " + "the " * 12)], bench)
    assert got == [(1, n, n, 1, ids[0], True), (2, n, 0, 0, ids[1], False), (3, n // 2 + 13, n // 2, 1, ids[0], True)]


def test_empty_tables(run, prose):
    assert run([], [(1, prose(20, 1))]) == []
    docs = [(1, prose(20, 1))]
    assert run(docs, []) == brute(docs, [])


def test_proximity_finds_terms_in_any_order_within_reach(spark, documents):
    docs = documents([(1, "x c y b z a q"), (2, "a q q q q q q q q q q b c"), (3, "a b"), (4, "c b a")])
    items = dc.test_items(spark.createDataFrame([(7, "a b c", "")], BENCH))
    index = dc.build_index(docs)
    got = {r.doc_id for r in dc.proximity_matches(index, items, slack=2).collect()}
    assert got == {1, 4}
    assert index.count() == 7 + 13 + 2 + 3  # every word is in the index


@pytest.mark.parametrize("slack", [0, 3])
def test_proximity_against_every_stretch(spark, documents, slack):
    rng = random.Random(slack)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    bench = [(1, "a b c d"), (2, "h h a"), (3, "e f g h a b"), (4, "zz a"), (5, "c")]
    docs = [(i, t) for i, t in enumerate(texts)] + [(40, None), (None, "h a h"), (3, texts[3])]
    items = dc.test_items(spark.createDataFrame([(*b, "") for b in bench], BENCH))
    got = {(r.doc_id, r.item_id) for r in dc.proximity_matches(dc.build_index(documents(docs)), items, slack).collect()}
    want = set()
    for i, t in docs:
        for j, item in bench:
            d, w = words(t), words(item)
            if any(set(w) <= set(d[p : p + len(w) + slack]) for p in range(len(d))):
                want.add((i, j))
    assert got == want and len(want) > 20


def test_a_long_document_with_one_passage_goes(spark, documents, prose):
    passage = prose(20, 1)
    bench = spark.createDataFrame([(1, passage, ""), (2, "short item", "")], BENCH)
    rows = [(1, f"{prose(2500, 2)} {passage} {prose(2500, 3)}"), (2, prose(5000, 4)), (3, f"{prose(100, 5)} short item {prose(100, 6)}"), (4, "a short item"), (5, f"{prose(2500, 2)} {' '.join(passage.split()[:12])}")]
    share = {r.doc_id for r in dc.contamination(documents(rows), bench).collect() if r.contaminated}
    assert share == {4}
    assert {r.doc_id for r in dc.keep_uncontaminated(documents(rows), bench).collect()} == {2, 3, 5}


def test_filter_keeps_columns(spark, documents, prose):
    docs = documents([(1, prose(30, 1)), (2, prose(30, 2)), (None, prose(30, 1)), (4, None)])
    kept = dc.keep_uncontaminated(docs, spark.createDataFrame([(1, prose(30, 1), "")], BENCH))
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [2, 4]


def test_native(spark, documents, prose):
    plan = dc.contamination(documents([(1, prose(30, 1))]), spark.createDataFrame([(1, prose(30, 1), "")], BENCH))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)
