"""Fingerprints: the edited texts against plain Python, anchors against the definition."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import syncmers as sy
from tests.llm.conftest import ODD_TEXTS


def in_order(spark, rows):
    """doc_id descending, nulls last, ties by the text's hash."""
    frame = spark.createDataFrame([(k, t or "") for k, (_, t) in enumerate(rows)], "k long, t string")
    hashes = {r.k: r.h for r in frame.select("k", F.xxhash64("t").alias("h")).collect()}
    return [rows[k] for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, -(rows[k][0] or 0), hashes[k]))]


def edited(order):
    texts = [t or "" for _, t in order]
    out = []
    for k, (i, _) in enumerate(order):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        m = len(t) // 3
        out.append((i, len(t), hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("run", [1, 3, 16384])
def test_edited_texts_follow_descending_ids(spark, documents, prose, monkeypatch, run):
    monkeypatch.setattr(sy, "RUN", run)
    rows = [(i * i, prose(30 + i, i)) for i in range(20)] + [(5000, "é" * 7), (7, "tie a"), (7, "tie b"), (7, "tie b"), (None, "no id"), (None, "none either"), (-3, "negative ñ")] + [(300 + i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(6 * 10**18, "far up " * 9), (-6 * 10**18, "far down " * 9), (2**63 - 1, "the most"), (-(2**63), "the least")]
    got = sorted((tuple(r)[:3] for r in sy.fingerprints(documents(rows)).collect()), key=repr)
    assert got == edited(in_order(spark, rows))


def test_one_id_for_most_rows_is_spread(documents, monkeypatch):
    monkeypatch.setattr(sy, "RUN", 20)
    docs = documents([(7, f"text {i}") for i in range(400)] + [(i, f"other {i}") for i in range(200)]).select("doc_id", "text")
    starts = sy.run_starts(docs)
    assert len(starts) > 15
    placed = docs.withColumn("at", sy.position()).withColumn("run", F.lit(0)).collect()
    sizes = [0] * len(starts)
    for r in placed:
        sizes[sum(s <= tuple(r["at"]) for s in starts) - 1] += 1
    assert max(sizes) < 120


def plain_anchors(rows, text):
    """Anchors by the definition, from the session's hashes of words, characters and stretches of them."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    kinds = [(words, sy.K, sy.S, 1)] + ([(list(text), sy.SHORT_K, sy.SHORT_S, 2)] if len(words) < sy.SHORT else [])
    out = []
    for tokens, k, s, seed in kinds:
        inner = [rows["inner", tuple(tokens[i : i + s])] for i in range(len(tokens) - s + 1)]
        for i in range(len(tokens) - k + 1):
            own = inner[i : i + k - s + 1]
            if min(own) in (own[0], own[-1]):
                h = (rows["kmer", seed, tuple(tokens[i : i + k])] & (1 << 64) - 1) >> 65 - sy.HASH_BITS
                out.append((h if seed == 1 else h | sy.CHARS, i))
    if not out and text:
        h = (rows["whole", text] & (1 << 64) - 1) >> 65 - sy.HASH_BITS
        out.append((h | sy.CHARS, 0))
    return out


def test_results_against_plain_python(spark, documents, prose):
    """Printed fingerprints and both likenesses of every row."""
    rows = [(i, prose(20 + 6 * i, i // 2)) for i in range(14)] + [(50, "ab"), (51, ""), (52, None), (53, "one two three"), (54, "same same same same same same same")]
    order = [(i, t or "") for i, t in in_order(spark, rows)]
    full = []
    for k, (i, t) in enumerate(order):
        m = len(t) // 3
        full.append((i, t, t[: len(t) - m] + order[(k + 1) % len(order)][1][:m], order[(k + 1) % len(order)][1]))
    stretches, texts = set(), {x for r in full for x in r[1:]}
    for t in texts:
        for tokens, k, s, seed in ((re.findall(r"[^\x20\x09-\x0D]+", t), sy.K, sy.S, 1), (list(t), sy.SHORT_K, sy.SHORT_S, 2)):
            stretches |= {("inner", 0, tuple(tokens[i : i + s])) for i in range(len(tokens) - s + 1)} | {("kmer", seed, tuple(tokens[i : i + k])) for i in range(len(tokens) - k + 1)}
    frame = spark.createDataFrame([(kind, seed, list(x)) for kind, seed, x in stretches], "kind string, seed int, x array<string>")
    tokens = F.transform("x", lambda w: F.xxhash64(w))
    known = {}
    for r in frame.select("kind", "seed", "x", F.xxhash64(tokens).alias("inner"), F.xxhash64("seed", tokens).alias("kmer")).collect():
        known[("inner", tuple(r.x)) if r.kind == "inner" else ("kmer", r.seed, tuple(r.x))] = r.inner if r.kind == "inner" else r.kmer
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64(F.lit(3), "t").alias("h")).collect():
        known["whole", r.t] = r.h

    def like(a, b):
        x, y = ({h for h, _ in plain_anchors(known, t)} for t in (a, b))
        has = [any(h >= sy.CHARS for h in z) for z in (x, y)]
        if not x and not y:
            return 1.0
        if has[0] != has[1]:
            x, y = ({h for h in z if h < sy.CHARS} for z in (x, y))
        return len(x & y) / max(len(x | y), 1)

    got = {r.doc_id: r for r in sy.fingerprints(documents(rows)).collect()}
    for i, t, changed, after in full:
        text = lambda z: " ".join(f"{h:012x}:{p}" for h, p in plain_anchors(known, z))
        assert got[i].fingerprint == text(t) and got[i].edited_fingerprint == text(changed)
        assert got[i].near_edited == pytest.approx(like(t, changed)) and got[i].near_next == pytest.approx(like(t, after))


def test_one_document_and_none(documents):
    r = sy.fingerprints(documents([(4, "alone it is")])).first()
    assert r.edited_sha256 == hashlib.sha256(b"alone italo").hexdigest() and r.near_next == 1.0
    assert sy.fingerprints(documents([])).count() == 0


def test_anchors_are_the_closed_syncmers(documents, prose):
    text = prose(200, 1)
    rows = sy.with_anchors(documents([(1, text)]).select(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("t")), "t", "found", sy.K, sy.S, 1)
    inner = sy.sliding_hash(F.col("t"), sy.S)
    r = rows.select("found", inner.alias("inner"), F.size("t").alias("n")).first()
    want = [i for i in range(r.n - sy.K + 1) if min(r.inner[i : i + sy.K - sy.S + 1]) in (r.inner[i], r.inner[i + sy.K - sy.S])]
    assert [x.pos for x in r.found] == want
    assert len(want) > r.n / 4


def test_context_free_likeness_and_positions(documents, prose):
    a, b = prose(150, 1), prose(150, 2)
    docs = documents([(1, a), (2, f"{b} {a}"), (3, b), (4, a), (5, ""), (6, None)])
    rows = sy.with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "print")
    x = rows.select(F.col("doc_id").alias("i"), F.col("print").alias("p"), sy.hashes("print").alias("a"))
    y = rows.select(F.col("doc_id").alias("j"), F.col("print").alias("q"), sy.hashes("print").alias("b"))
    got = {(r.i, r.j): r for r in x.join(y, F.col("i") <= F.col("j")).select("i", "j", sy.likeness("a", "b").alias("s"), sy.aligned("p", "q").alias("run")).collect()}
    assert got[1, 4].s == 1 and got[1, 3].s == 0 and 0.3 < got[1, 2].s < 0.7 and got[5, 6].s == 1 and got[1, 5].s == 0
    run = got[1, 2].run
    assert len(run) >= 10 and {p.pos_b - p.pos_a for p in run} == {150}


def test_equal_texts_have_equal_fingerprints_and_edits_stay_near(documents, prose):
    rows = [(i, prose(60 + 7 * (i % 9), i // 2)) for i in range(40)] + [(90, "few words"), (91, "few words")]
    got = {r.doc_id: r for r in sy.fingerprints(documents(rows)).collect()}
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(p) == 1 for p in by_text.values())
    assert sum(r.near_edited > 0.25 for r in got.values()) >= 38
    assert all(0 <= v <= 1 for r in got.values() for v in (r.near_edited, r.near_next))


def test_long_texts_keep_all_anchors_and_short_shared_passages(documents, prose):
    passage = prose(50, 9)
    a, b = f"{prose(1500, 1)} {passage} {prose(1500, 2)}", f"{prose(1000, 3)} {passage} {prose(1700, 4)}"
    rows = sy.with_fingerprint(documents([(1, a), (2, b)]).select("doc_id", "text"), "text", "print").select("doc_id", "print")
    x, y = rows.filter("doc_id = 1").select(F.col("print").alias("p")), rows.filter("doc_id = 2").select(F.col("print").alias("q"))
    r = x.crossJoin(y).select("p", sy.aligned("p", "q").alias("run")).first()
    assert len(r.p) > 750 and len(r.run) >= 8 and {z.pos_b - z.pos_a for z in r.run} == {-500}


def test_likeness_across_the_bound_of_short_texts(documents, prose):
    text = prose(sy.SHORT, 1)
    docs = documents([(1, text), (2, " ".join(text.split()[:-1])), (3, "few words")]).select("doc_id", "text")
    rows = sy.with_fingerprint(docs, "text", "print").select("doc_id", sy.hashes("print").alias("a"))
    other = rows.select(F.col("doc_id").alias("j"), F.col("a").alias("b"))
    got = {(r.doc_id, r.j): r.s for r in rows.crossJoin(other).select("doc_id", "j", sy.likeness("a", "b").alias("s")).collect()}
    assert got[1, 2] == got[2, 1] > 0.9 and got[1, 3] == 0 and got[2, 2] == got[3, 3] == 1


def test_native(documents):
    plan = sy.fingerprints(documents([(1, "a b c")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)
