"""Document fingerprints from closed syncmers.

A text's words are hashed; a k-mer of K words is a closed syncmer if the
smallest hash among its inner substrings of S words is that of its first or
its last one. Whether a k-mer is chosen depends on its own words alone, so the
same passage yields the same anchors wherever it stands. The fingerprint lists
all anchors in the order of the text, each with its word position.

Likeness is the share of common anchors in the union of both sets. Texts of
fewer than ``SHORT`` words also give the k-mers of ``SHORT_K`` characters as
anchors of their own kind, told by the highest bit, so that a change of one
word in a few does not change everything; a text shorter than any k-mer is one
anchor as a whole, of the same kind. Where only one of two texts has that kind,
words alone are compared. Anchors at agreeing distances tell which passage is
shared (:func:`aligned`).

All of it is DataFrame operations.

Defined results: null and empty texts have an empty fingerprint; the likeness
of two empty fingerprints is 1, of one to another 0. The order of documents is
by doc_id descending, nulls last, ties by the text's 64-bit hash (then by text);
the document after the last one is the first. Rows that share an id are spread
by that hash; rows that share id and text stay together. Other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 5, 2
SHORT, SHORT_K, SHORT_S = 48, 4, 2
HASH_BITS = 48
#: The bit that anchors of characters have.
CHARS = 1 << HASH_BITS - 1
#: Documents of a run that is put in order together, on average; sampled positions for each run; and the most runs whose bounds the driver holds, three numbers each.
RUN, PER_RUN, MOST_RUNS = 1024, 16, 1 << 15


def sliding_min(df: DataFrame, column: str, n: int) -> DataFrame:
    """Replaces an array by the least of each n neighbours, doubling the reach; a column at each step, so that no step is worked out twice."""
    reach = 1
    while reach < n:
        hop = min(reach, n - reach)
        size = F.greatest(F.size(column) - hop, F.lit(0))
        df = df.withColumn(column, F.zip_with(F.slice(column, F.lit(1), size), F.slice(column, F.lit(hop + 1), size), lambda a, b: F.least(a, b)))
        reach += hop
    return df


def tagged(seed: int, *of: Column) -> Column:
    """Hash of HASH_BITS bits, the highest of which tells the kind: 0 for words (seed 1)."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 65 - HASH_BITS)
    return h if seed == 1 else h.bitwiseOR(F.lit(CHARS))


def sliding_hash(tokens: Column, n: int) -> Column:
    """Hash of each n neighbours."""
    return F.transform(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(0))), lambda _, i: F.xxhash64(F.slice(tokens, i + 1, F.lit(n))))


def with_anchors(df: DataFrame, tokens: str, out: str, k: int, s: int, seed: int) -> DataFrame:
    """Adds the closed syncmers of an array of token hashes: array<struct<hash, pos>>."""
    df = df.withColumn("_inner", sliding_hash(F.col(tokens), s)).withColumn("_least", F.col("_inner"))
    df = sliding_min(df, "_least", k - s + 1)
    inner = lambda i: F.get("_inner", i)
    at_edge = lambda x, i: (x == inner(i)) | (x == inner(i + (k - s)))
    anchor = lambda i: F.struct(tagged(seed, F.slice(tokens, i + 1, F.lit(k))).alias("hash"), i.alias("pos"))
    return df.withColumn(out, F.array_compact(F.transform("_least", lambda x, i: F.when(at_edge(x, i), anchor(i))))).drop("_inner", "_least")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds all of ``text``'s anchors, those of words first: array<struct<hash, pos>>."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    few = F.size("_words") < SHORT
    df = df.withColumn("_chars", F.when(few, F.transform(F.array_remove(F.split(text, ""), ""), lambda c: F.xxhash64(c))).otherwise(F.array().cast("array<bigint>")))
    df = with_anchors(df, "_words", "_anchors", K, S, 1)
    df = with_anchors(df, "_chars", "_short", SHORT_K, SHORT_S, 2)
    whole = F.array(F.struct(tagged(3, F.col(text)).alias("hash"), F.lit(0).alias("pos")))
    df = df.withColumn("_all", F.when(F.size("_words") >= SHORT, F.col("_anchors")).otherwise(F.concat("_anchors", "_short")))
    none = (F.size("_all") == 0) & (F.length(text) > 0)
    return df.withColumn(out, F.when(none, whole).otherwise(F.col("_all"))).drop("_words", "_chars", "_anchors", "_short", "_all")


def hashes(fingerprint: str) -> Column:
    return F.transform(fingerprint, lambda x: x["hash"])


def places(fingerprint: str) -> Column:
    return F.transform(fingerprint, lambda x: x["pos"])


def likeness(a: str, b: str) -> Column:
    """Share of common anchors, from two columns of hashes; of words alone unless both have anchors of characters, which stand last."""
    has = lambda x: F.coalesce(F.get(x, F.size(x) - 1) >= CHARS, F.lit(False))
    own = lambda x, y: F.when(has(x) & ~has(y), F.filter(x, lambda h: h < CHARS)).otherwise(F.col(x))
    x, y = own(a, b), own(b, a)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)))


def aligned(a: str, b: str) -> Column:
    """Of two fingerprints' common anchors, the most that lie at one distance: array<struct<pos_a, pos_b>> of them."""
    common = F.array_intersect(hashes(a), hashes(b))
    shared = lambda x: F.filter(x, lambda h: F.array_contains(common, h["hash"]))
    pairs = F.flatten(F.transform(shared(a), lambda x: F.transform(F.filter(b, lambda y: y["hash"] == x["hash"]), lambda y: F.struct(x["pos"].alias("pos_a"), y["pos"].alias("pos_b")))))
    gaps = F.array_distinct(F.transform(pairs, lambda p: p["pos_b"] - p["pos_a"]))
    runs = F.transform(gaps, lambda g: F.filter(pairs, lambda p: p["pos_b"] - p["pos_a"] == g))
    return F.aggregate(runs, F.array().cast("array<struct<pos_a:int,pos_b:int>>"), lambda best, r: F.when(F.size(r) > F.size(best), r).otherwise(best))


def printed(anchors: str, at: str) -> Column:
    """The fingerprint as text, from its hashes and positions."""
    return F.array_join(F.zip_with(anchors, at, lambda h, p: F.concat(F.lower(F.lpad(F.hex(h), HASH_BITS // 4, "0")), F.lit(":"), p.cast("string"))), " ")


def position() -> Column:
    """A document's place as a struct that sorts by doc_id descending, nulls last, ties by the text's hash. Negation would overflow; the complement can't."""
    return F.struct(F.col("doc_id").isNull().alias("absent"), F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).alias("id"), F.xxhash64("text").alias("hash"))


def run_starts(rows: DataFrame) -> list[tuple]:
    """The first position of all, then those at which runs of about RUN documents begin: every PER_RUN-th of a sample of positions by hash, MOST_RUNS of them at most."""
    places = rows.select(position().alias("at"))
    n, first = places.agg(F.count("*"), F.min("at")).first()
    if not n:
        return []
    runs = min(MOST_RUNS, max(1, n // RUN))
    one_in = max(1, n // (runs * PER_RUN))
    sample = places.filter(F.pmod(F.xxhash64("at", F.lit(7)), F.lit(one_in)) == 0).distinct() if runs > 1 else None
    found = sorted(tuple(r["at"]) for r in sample.collect()) if runs > 1 else []
    return [tuple(first), *(x for x in found[:: max(1, len(found) // runs)] if x > tuple(first))]


def before_or_at(starts: Column, at: Column, n: int) -> Column:
    """How many of n ascending ``starts`` are not after ``at``, by bisection."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda low, hop: F.when(F.get(starts, low + hop - 1) <= at, low + hop).otherwise(low))


def with_next(rows: DataFrame, carried: list[str], ahead: list[str]) -> DataFrame:
    """doc_id, the carried columns, and next: the columns ``ahead`` of the document that follows; the first one's to the last.

    Rows are dealt to runs that lie side by side. The first row of a run is known from the run's bound and also goes to the run before it, so one exchange of the rows is enough.
    """
    starts = run_starts(rows)
    n = len(starts)
    if not n:
        return rows.select("doc_id", *carried, F.struct(*ahead).alias("next"))
    table = F.from_json(F.lit(json.dumps([dict(zip(("absent", "id", "hash"), x, strict=True)) for x in starts])), "array<struct<absent:boolean,id:bigint,hash:bigint>>")
    placed = rows.withColumn("_at", position())
    placed = placed.withColumn("_run", before_or_at(table, F.col("_at"), n) - 1)
    own = F.struct(F.col("_run").alias("run"), F.lit(False).alias("copy"))
    ending = F.struct(F.pmod(F.col("_run") - 1, F.lit(n)).alias("run"), F.lit(True).alias("copy"))
    dealt = placed.withColumn("_place", F.explode(F.when(F.get(table, F.col("_run")) == F.col("_at"), F.array(own, ending)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", *carried, "_at", "_place.run", "_place.copy")
    within = Window.partitionBy("run").orderBy("copy", "_at", "text")
    return dealt.withColumn("next", F.lead(F.struct(*ahead)).over(within)).filter("NOT copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"], ["text"])
    n, m = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", F.col("next.text").alias("after"), F.concat(F.substring("text", F.lit(1), n - m), F.substring("next.text", F.lit(1), m)).alias("edited"))
    # Anchors are made after the exchange, those of the next text a second time: all of them would weigh more than the texts on the way.
    rows = with_fingerprint(rows, "text", "print")
    rows = rows.withColumns({"a": hashes("print"), "at": places("print")}).drop("text", "print")
    rows = with_fingerprint(rows, "after", "print")
    rows = rows.withColumn("c", hashes("print")).drop("after", "print")
    rows = with_fingerprint(rows, "edited", "print")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", "at", "c", hashes("print").alias("b"), places("print").alias("edited_at"))
    return rows.select("doc_id", "n_chars", "edited_sha256", printed("a", "at").alias("fingerprint"), printed("b", "edited_at").alias("edited_fingerprint"), likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"))
