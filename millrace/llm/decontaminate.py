"""Benchmark decontamination by a distributed positional inverted index.

The index is a written table of postings (term, document, position), cut by
document into shards and ordered by term within each, so a search reads the
pages of its terms only. Terms are 64-bit hashes of words. A search counts the
postings of each test term, starts from the two rarest terms of every window,
adjusts their lists by their offsets in the item, and keeps the alignments
(document, item, document position - item offset) that both lists agree on. An
alignment is then compared word by word, which decides; hash collisions can
only cost a comparison. Windows with a term that no document has are dropped.

A document's alignments meet its words in one row, which holds each item's
words once. An alignment costs the item's length and leaves the stretches of
agreeing words, and the hit words are the union of these intervals; neither
words nor positions are copied for each alignment, so a long text of one
repeated word, which aligns everywhere, stays within a few numbers for each of
its words.

All of it is DataFrame operations. The terms that lists are asked for are
broadcast after a count has shown them to be within a bound; other joins are
left to Spark's own measure. An index may be built for the terms of a test set
only, as no other term's list can be asked for; without ``terms`` it holds
every word.

The filter drops what is contaminated by share, and any document that holds a
whole window of ``WINDOW`` words, however long it is. Items shorter than that
count by share alone, or a benchmark's single word would empty a corpus.

Defined results: null and empty texts have no words, are not contaminated and
list no items; items without words have no windows; items of fewer than
``WINDOW`` words are one window; items that repeat another's text occur where it
does; an item without an id counts for hits but is not listed; repeated
documents each get their result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ITEM_GAP, Workspace, ascii_lower, bounded, written

#: What writes an intermediate table.
Store = Callable[[DataFrame, str], DataFrame]

WINDOW = 13
#: A document is contaminated if hit words are at least one in so many.
SHARE = 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ITEM_GAP), "")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and _hash, which with doc_id tells rows apart that share an id."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, store: Store = written) -> DataFrame:
    """The postings (term, doc_id, _hash, pos) of ``docs``, as a table; of the given terms (a table) only, if there are any."""
    postings = keyed(docs).select("doc_id", "_hash", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    postings = postings.select(F.xxhash64("word").alias("term"), "doc_id", "_hash", "pos")
    if terms is not None:
        postings = postings.join(bounded(terms.select("term")), "term", "left_semi")
    return store(postings.sortWithinPartitions("term"), "postings")


def test_items(benchmark: DataFrame, window: int = WINDOW, store: Store = written) -> DataFrame:
    """item (a key), item_id, words, span (words in a window) of each item with words, as a table."""
    rows = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    return store(rows.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.least(F.size("words"), F.lit(window)).alias("span")), "items")


def item_terms(items: DataFrame) -> DataFrame:
    """item, span, off, term of every word of every item."""
    return items.select("item", "span", F.size("words").alias("n"), F.posexplode("words").alias("off", "word")).withColumn("term", F.xxhash64("word")).drop("word")


def alignments(index: DataFrame, items: DataFrame, store: Store = written) -> DataFrame:
    """(doc_id, _hash, item, diag): where the two rarest terms of one of an item's windows stand as in the item. diag: document position of the item's first word."""
    places = item_terms(items)
    counts = store(index.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    places = places.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # each word belongs to the windows that start up to span - 1 words before it
    starts = F.sequence(F.greatest(F.lit(0), F.col("off") - F.col("span") + 1), F.least("off", F.col("n") - F.col("span")))
    windows = places.withColumn("start", F.explode(starts)).groupBy("item", "start").agg(F.min("df").alias("least"), F.sort_array(F.collect_list(F.struct("df", "off", "term"))).alias("terms"))
    windows = windows.filter("least > 0").select("item", F.col("terms")[0].alias("first"), F.element_at("terms", F.least(F.lit(2), F.size("terms"))).alias("second"))
    pairs = store(windows.select("item", F.col("first.off").alias("off_1"), F.col("first.term").alias("term_1"), F.col("second.off").alias("off_2"), F.col("second.term").alias("term_2")).distinct(), "anchors")
    rare = store(pairs.select("item", F.col("off_1").alias("off"), F.col("term_1").alias("term")).union(pairs.select("item", "off_2", "term_2")).distinct(), "rare")
    lists = index.join(bounded(rare), "term").select("doc_id", "_hash", "item", (F.col("pos") - F.col("off")).alias("diag"), "off")
    met = lists.groupBy("doc_id", "_hash", "item", "diag").agg(F.collect_set("off").alias("offs"))
    agreed = pairs.groupBy("item").agg(F.collect_set(F.struct("off_1", "off_2")).alias("pairs"))
    both = F.exists("pairs", lambda p: F.array_contains("offs", p["off_1"]) & F.array_contains("offs", p["off_2"]))
    return met.join(agreed, "item").filter(both).select("doc_id", "_hash", "item", "diag")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, inside a higher-order function too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def agreeing(own: str, item: Column, diag: Column, span: Column) -> Column:
    """Stretches [a, e) of the words ``own`` that are those of the item at the alignment, of at least span words: array<struct<a, e>>."""
    lo, hi = F.greatest(F.lit(0), -diag), F.least(F.size(item), F.size(own) - diag)
    # Beyond either end there is no word, which is a break too.
    broken = F.filter(F.sequence(lo - 1, F.greatest(lo - 1, hi)), lambda j: F.coalesce(F.get(own, diag + j) != F.get(item, j), F.lit(True)))
    between = bind(broken, lambda b: F.transform(b, lambda j, k: F.struct((diag + j + 1).alias("a"), (diag + F.get(b, k + 1)).alias("e"))))
    return F.filter(between, lambda r: r["e"] - r["a"] >= span)


def phrase_matches(docs: DataFrame, found: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, _hash, matches: array<struct<item_id, span, runs>>): the stretches of document words inside windows that occur, compared word by word; none where alignments fail."""
    own = found.groupBy("doc_id", "_hash", "item").agg(F.collect_list("diag").alias("diags")).join(items, "item")
    cands = own.groupBy("doc_id", "_hash").agg(F.collect_list(F.struct("item_id", "span", F.col("words").alias("iwords"), "diags")).alias("cands"))
    cands = cands.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), "cands")
    rows = keyed(docs)
    rows = rows.join(cands, rows["doc_id"].eqNullSafe(cands["_id"]) & (rows["_hash"] == cands["_h"])).dropDuplicates(["doc_id", "_hash"])
    rows = rows.select("doc_id", "_hash", words(F.col("text")).alias("words"), "cands")
    runs = lambda c: F.flatten(F.transform(c["diags"], lambda d: agreeing("words", c["iwords"], d, c["span"])))
    matches = F.transform("cands", lambda c: F.struct(c["item_id"].alias("item_id"), c["span"].alias("span"), runs(c).alias("runs")))
    # Rows without a match stay: a filter here would be pushed below, and the words taken apart again at each step of it.
    return rows.select("doc_id", "_hash", F.filter(matches, lambda m: F.size(m["runs"]) > 0).alias("matches"))


def covered(runs: Column) -> Column:
    """How many positions lie in at least one of the intervals array<struct<a, e>>."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    more = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(r["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], r["e"]).alias("upto"))
    return F.aggregate(F.sort_array(runs), start, more, lambda s: s["n"])


def proximity_matches(index: DataFrame, items: DataFrame, slack: int) -> DataFrame:
    """(doc_id, _hash, item_id): documents in which all of an item's distinct terms stand, in any order, within its number of words plus ``slack``.

    From each posting of the item's rarest term the other lists are read within reach, so a group holds at most twice that many postings.
    """
    terms = item_terms(items).groupBy("item", "term").agg(F.max("n").alias("n"))
    terms = terms.join(index.groupBy("term").agg(F.count("*").alias("df")), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = terms.groupBy("item").agg(F.min(F.struct("df", "term")).alias("r"), F.count("*").alias("distinct_terms"), (F.max("n") + slack).alias("reach")).filter("r.df > 0")
    anchors = index.join(rarest.select("item", "distinct_terms", "reach", F.col("r.term").alias("term")), "term").select("doc_id", "_hash", "item", "distinct_terms", "reach", F.col("pos").alias("anchor"))
    others = index.join(terms.select("item", "term"), "term").select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), F.col("item").alias("_item"), "term", "pos")
    near = anchors.join(others, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")) & (F.col("item") == F.col("_item")) & (F.abs(F.col("pos") - F.col("anchor")) < F.col("reach")))
    groups = near.groupBy("doc_id", "_hash", "item", "anchor", "reach", "distinct_terms").agg(F.collect_set(F.struct("pos", "term")).alias("p"))
    full = F.exists("p", lambda x: F.size(F.array_distinct(F.transform(F.filter("p", lambda y: (y["pos"] >= x["pos"]) & (y["pos"] < x["pos"] + F.col("reach"))), lambda y: y["term"]))) == F.col("distinct_terms"))
    return groups.filter(full).select("doc_id", "_hash", "item").distinct().join(items.select("item", "item_id"), "item").select("doc_id", "_hash", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; and _hash, and _whole: a window of full length occurs."""
    with Workspace(docs.sparkSession) as work:
        items = test_items(benchmark, window, work.written)
        terms = work.written(item_terms(items).select("term").distinct(), "terms")
        index = build_index(docs, terms, work.written)
        matches = phrase_matches(docs, alignments(index, items, work.written), items)
        ids = F.filter(F.transform("matches", lambda m: m["item_id"].cast("string")), lambda i: i.isNotNull())
        hits = written(matches.select(
            F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"),
            covered(F.flatten(F.transform("matches", lambda m: m["runs"]))).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(ids)).alias("found"), F.exists("matches", lambda m: m["span"] >= window).alias("whole"),
        ), "hits")
    own = keyed(docs).select("doc_id", "_hash", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = own.join(hits, own["doc_id"].eqNullSafe(hits["_id"]) & (own["_hash"] == hits["_h"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "_hash", "n_words", n_hit.alias("n_hit"), F.greatest(F.size("found"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("found", F.array().cast("array<string>"))), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("whole", F.lit(False)).alias("_whole"),
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no whole window of ``WINDOW`` words and are not contaminated by share."""
    gone = contamination(docs, benchmark).filter("_whole OR contaminated").select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_h"]), "left_anti")
