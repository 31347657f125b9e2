"""Near-duplicate groups against all pairs of full sets."""

import re
from itertools import combinations

import numpy as np
import pytest

from millrace.llm import near_dedup as nd
from tests.llm.conftest import ODD_TEXTS


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        common = len(x & y)
        if common and 100 * common >= 75 * len(x | y):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def edited(text, rng, share):
    words = text.split()
    for k in range(len(words)):
        if rng.random() < share:
            words[k] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


def test_groups_equal_brute_force(spark, documents, prose):
    import random

    rng, rows = random.Random(5), []
    for base in range(6):
        text = prose(rng.choice([30, 80, 300]), base)
        rows += [text] + [edited(text, rng, rng.choice([0.0, 0.01, 0.03, 0.05, 0.08])) for _ in range(12)]
    rows += ["two words", "two  WORDS", "words two", "one", *ODD_TEXTS]
    rows = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    rng.shuffle(rows)
    got = sorted(map(tuple, nd.near_duplicates(documents(rows)).collect()))
    assert got == brute(rows)


@pytest.mark.parametrize(("salt_members", "crowd", "forest_links"), [(3, 8, 1 << 20), (3, 2, 5), (512, 1000, 1 << 20)])
def test_groups_whatever_the_splits(spark, documents, prose, monkeypatch, salt_members, crowd, forest_links):
    """Hot buckets over many tasks, crowds dealt by prefixes or not, one forest or several."""
    import random

    for name, value in (("SALT_MEMBERS", salt_members), ("CROWD", crowd), ("FOREST_LINKS", forest_links)):
        monkeypatch.setattr(nd, name, value)
    rng, passage = random.Random(2), prose(90, 50)
    rows = [(i, edited(prose(100, 3), rng, 0.04)) for i in range(40)] + [(100 + i, f"{prose(40, 60 + i)} {passage}") for i in range(25)] + [(200 + i, prose(60, 80 + i // 2)) for i in range(10)]
    got = sorted(map(tuple, nd.near_duplicates(documents(rows)).collect()))
    assert got == brute(rows)


def test_hot_buckets_are_split_and_few(spark, monkeypatch):
    monkeypatch.setattr(nd, "SALT_MEMBERS", 10)
    monkeypatch.setattr(nd, "MOST_HOT", 8)
    sizes = spark.createDataFrame([(k, 12) for k in range(30)] + [(99, 400)], "bucket long, size long")
    assert [tuple(r) for r in nd.hot_buckets(sizes).collect()] == [(99, 5)]
    rows = spark.createDataFrame([(99, i) for i in range(400)] + [(3, i) for i in range(12)], "bucket long, id long")
    assert nd.salted(rows, nd.hot_buckets(sizes)).groupBy("bucket", "salt").count().count() == 6
    met = nd.meet(rows, sizes)
    assert met.count() == 412 and met.columns == ["bucket", "id", "size"]


def test_large_group_of_near_copies_whose_centre_has_a_high_id(spark, documents, prose):
    """Copies of one text, each linked to it and rarely to each other, and one exact group."""
    import random

    rng = random.Random(1)
    base = prose(120, 99)
    rows = [(i, edited(base, rng, 0.035)) for i in range(80)] + [(1000, base)] + [(2000 + i, prose(50, 7)) for i in range(60)]
    got = sorted(map(tuple, nd.near_duplicates(documents(rows)).collect()))
    assert got == brute(rows)


def test_signature_estimates_similarity_and_stops_early():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    errors = []
    for share in (0.2, 0.5, 0.8):
        k = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:k], rng.integers(0, 2**63, len(a) - k).astype(np.uint64)]))
        both = nd.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(abs((both[0] == both[1]).mean() - true))
    assert max(errors) < 0.12
    assert (nd.signatures(a, np.array([0, len(a)])) >> np.uint64(32)).max() <= 4  # few levels fill all slots
    one = nd.signatures(a[:1], np.array([0, 1]))[0]
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(nd.SLOTS))  # a lone element ranks every slot once


def test_empty_and_degenerate_tables(spark, documents, prose):
    assert nd.near_duplicates(documents([])).count() == 0
    rows = [(None, prose(20, 1)), (None, prose(20, 1)), (5, prose(20, 1)), (5, prose(20, 2)), (9, prose(20, 2)), (7, None)]
    got = sorted((tuple(r) for r in nd.near_duplicates(documents(rows)).collect()), key=repr)
    assert got == sorted([(None, 16, None, True), (None, 16, None, True), (5, 16, 5, True), (5, 16, 5, True), (9, 16, 5, False), (7, 0, 7, True)], key=repr)


def test_filter_keeps_columns_and_one_of_each_group(spark, documents, prose):
    docs = documents([(3, prose(40, 1)), (1, prose(40, 1)), (2, prose(40, 2)), (None, prose(40, 1)), (8, None)])
    kept = nd.keep_first(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, 8, None]
