"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

A document is the set of its distinct shingles of five words. In a SuperMinHash
signature each element ranks all slots by a random permutation of its own, slot
after slot, and a slot keeps its smallest (rank, random) pair; as an element
gives every slot another rank, the slots are correlated and vary less than
independent ones. Ranks are worked off level by level for all elements of a
block of texts at once, and a document is done as soon as every slot has a
value of an earlier level.

Equal sets become one class, by a 128-bit digest. Classes that share a band of
``ROWS`` slots are candidates; a link at the threshold escapes all ``BANDS``
with probability (1 - 0.75^4)^40 < 3e-7. A bucket is never paired off as a
whole: in each round a few of its members, those that meet most others, are
pivots, and only pairs of a pivot and a member of another component are
verified, on full sets. Verified links merge components; pivots leave the
bucket; buckets within one component are done. Rounds go on until no bucket is
open, with more pivots each, so every candidate pair is either verified, ruled
out by its sizes, or within one component. The members of a hot bucket are dealt
to salts, and its pivots are sent to each of them, so no task gets a bucket as a
whole.

Buckets that the first round leaves open with more than ``CROWD`` members are
such as many documents with a passage in common fill without being alike. Their
members are dealt anew, by prefixes: linked sets share 75 % of either's
shingles, so under any one order of all shingles the first 25 % and one more of
both have a shingle in common. The order is from rare to common ones, so a
shared passage comes last and the new buckets are small. There a shingle that
only one of the crowd has can't be common to two, and of those in one of
``GROUPS`` groups by hash two sets share no more than the smaller number; what
these numbers add up to bounds a pair's similarity and rules out nearly all
pairs in a group of loose copies of one text. Partitions reduce their links by union-find; the
forests are merged by moving links to the smallest neighbour until stars remain.
Nothing of all this is collected. The tables on the way are deleted when the
groups are written.

Defined results: null, empty and blank texts have an empty set and stay alone;
rows that repeat a doc_id are one document with any of their texts; a row with
a null doc_id takes no part (component null, kept); only doc_id and text are
read, other columns are passed through by the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace, bounded, discard, sorted_distinct, tidy, written

#: What writes an intermediate table.
Store = Callable[[DataFrame, str], DataFrame]
SHINGLE = 5
BANDS, ROWS = 40, 4
SLOTS = BANDS * ROWS
SHARE = 75
BLOCK_BYTES = 1 << 21
#: Pivots of a bucket in the first round, and times as many in each round after it.
FIRST_PIVOTS, MORE_PIVOTS = 2, 32
CROWD = 8
#: Members of a bucket that one task takes at least, and the most buckets that are split.
SALT_MEMBERS, MOST_HOT = 512, 1 << 14
#: Shingles of a prefix that its rows carry, to tell in which bucket a pair meets first.
CARRIED = 16
GROUPS = 64
#: Links that one partition's union-find takes, on average.
FOREST_LINKS = 1 << 20
GOLD, MA, MB = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x2545F4914F6CDD1D


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * MA
    x = (x ^ x >> np.uint64(27)) * MB
    return x ^ x >> np.uint64(31)


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, sorted and distinct within each text, and where each text's begin (and the end)."""
    raw = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begin = ~gap
    begin[1:] &= gap[:-1]
    word = np.flatnonzero(begin)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    end = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    inside = np.arange(len(raw)) - np.repeat(np.append(0, word), np.diff(np.concatenate([[0], word, [len(raw)]])))
    inside[gap] = 0
    value = (raw.astype(np.uint64) + np.uint64(1)) * powers(int((end - word).max()) + 1)[inside]
    value[gap] = 0
    words = mix(np.add.reduceat(value, word) + (end - word).astype(np.uint64) * GOLD)
    first = np.searchsorted(word, np.append(0, text_end))
    n_words = np.diff(first)
    n = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    at = np.repeat(first[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    size = np.repeat(np.minimum(n_words, SHINGLE), n)
    padded = np.append(words, np.zeros(SHINGLE, np.uint64))
    h = size.astype(np.uint64) * GOLD
    for j in range(SHINGLE):
        h = mix(h + np.where(j < size, padded[at + j], np.uint64(0)) * np.uint64(2 * j + 1)) + np.uint64(j)
    ends = np.append(0, np.cumsum(n))
    parts = [sorted_distinct(h[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))


def signatures(hashes: np.ndarray, ends: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A row of ``slots`` numbers, rank << 32 | random, for each set."""
    sets = len(ends) - 1
    out = np.full(sets * slots, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(ends))
    perm = None
    for level in range(slots):
        if not len(hashes):
            break
        u = mix(hashes + np.uint64((level + 1) * int(GOLD) % (1 << 64)))
        swap = level + ((u & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            slot = swap
        else:
            if perm is None:  # the state after level 0
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(hashes), 1))
                perm[np.arange(len(hashes)), first] = 0
            row = np.arange(len(hashes))
            slot = perm[row, swap].astype(np.int64)
            perm[row, swap] = perm[:, level]
        np.minimum.at(out, owner * slots + slot, np.uint64(level) << np.uint64(32) | u >> np.uint64(32))
        # a set whose slots all have a value of this level or an earlier one can't be bettered
        full = (out.reshape(sets, slots) != np.iinfo(np.uint64).max).all(1)
        left = ~full[owner]
        first = swap[left] if level == 0 else None
        if not left.all():
            hashes, owner = hashes[left], owner[left]
            perm = perm[left] if perm is not None else None
    return out.reshape(sets, slots)


def blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), a 128-bit digest of the set (a, b), and the band hashes (none for an empty set)."""
    schema = "doc_id long, n long, a long, b long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = batch.column(0), [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            at = 0
            for block in blocks(texts):
                hashes, ends = shingles(block)
                n = np.diff(ends)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ seed), dtype=np.uint64)]) for seed in (MA, MB)]
                a, b = ((s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums)
                sig = signatures(hashes, ends).reshape(len(block), BANDS, ROWS)
                band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * GOLD, (len(block), BANDS))
                for k in range(ROWS):
                    band = mix(band ^ sig[:, :, k]) + np.uint64(k)
                some = n > 0
                offsets = np.append(0, np.cumsum(np.where(some, BANDS, 0))).astype(np.int32)
                bands = pa.ListArray.from_arrays(offsets, pa.array(band[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(block)), pa.array(n), pa.array(a), pa.array(b), bands], names=["doc_id", "n", "a", "b", "bands"])
                at += len(block)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), schema)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets share at least SHARE percent of their union. Of a batch, each text is taken apart once."""
    left = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([t or "" for t in batch.column(k).to_pylist()] for k in (2, 3))
            sets: dict[str, np.ndarray] = {}
            distinct = list(dict.fromkeys([*one, *two]))
            at = 0
            for block in blocks([t.encode("utf-8", "surrogatepass") for t in distinct]):
                hashes, ends = shingles(block)
                sets |= {t: hashes[ends[k] : ends[k + 1]] for k, t in enumerate(distinct[at : at + len(block)])}
                at += len(block)
            common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(one, two, strict=True)])
            sizes = np.array([len(sets[x]) + len(sets[y]) for x, y in zip(one, two, strict=True)])
            yield batch.select([0, 1]).filter(pa.array(100 * common >= SHARE * (sizes - common), pa.bool_()))

    return pairs.join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long")


def hot_buckets(sizes: DataFrame) -> DataFrame:
    """(bucket, salts) of the buckets, of a written table with their sizes, that more than one task should take.

    Broadcast: a listed bucket has more than SALT_MEMBERS and more than one in MOST_HOT of all members, so there are never more than MOST_HOT rows.
    """
    total = sizes.agg(F.sum("size")).first()[0] or 0
    least = max(SALT_MEMBERS, total // MOST_HOT)
    return F.broadcast(sizes.filter(F.col("size") > least).select("bucket", F.ceil(F.col("size") / least).cast("long").alias("salts")))


def salted(members: DataFrame, hot: DataFrame) -> DataFrame:
    """Deals the members (id) of hot buckets to their salts."""
    return members.join(hot, "bucket", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)))).drop("salts")


def on_every_salt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Repeats what a bucket's members are to meet for each of its salts."""
    return rows.join(hot, "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def meet(members: DataFrame, sizes: DataFrame, how: str = "inner") -> DataFrame:
    """Members joined with a row for each bucket, of a written table (bucket, size, ...), no bucket in one task as a whole."""
    hot = hot_buckets(sizes)
    return salted(members, hot).join(on_every_salt(sizes, hot), ["bucket", "salt"], how).drop("salt")


def prefixes(texts: DataFrame, crowd: DataFrame, store: Store = written) -> DataFrame:
    """(bucket, id, n, degree, c, first, groups): the prefixes of the crowd's sets (id, n, degree), shingles that two of them have at least; c: how many such a set has; first: the rarest of its prefix; groups: the shareable ones' numbers by hash.

    Those that only one has come first in a prefix and meet nothing, so they are counted but not kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]):
                hashes, ends = shingles(block)
                owner = np.repeat(batch.column(0).to_numpy()[at : at + len(block)], np.diff(ends))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(owner)], names=["bucket", "id"])
                at += len(block)

    rows = store(texts.join(crowd.select("id"), "id", "left_semi").select("id", "text").mapInArrow(tidy(run), "bucket long, id long"), "shingles")
    df = store(rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "shingle-counts")
    own = meet(rows, df).withColumnRenamed("size", "df").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("df", "bucket"))).alias("own"))
    length = F.col("n") - F.ceil(SHARE * F.col("n") / 100) + 1
    own = own.join(crowd, "id").withColumn("c", F.size("own").cast("long"))
    own = own.withColumn("groups", F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.size(F.filter("own", lambda x: F.pmod(x["bucket"], F.lit(GROUPS)) == g))))
    own = own.withColumn("own", F.transform(F.slice("own", F.lit(1), F.greatest(length - (F.col("n") - F.col("c")), F.lit(0)).cast("int")), lambda x: x["bucket"]))
    own = store(own, "prefixes")
    dealt = own.select(F.explode("own").alias("bucket"), "id", "n", "degree", "c", F.slice("own", 1, CARRIED).alias("first"), "groups")
    least = store(dealt.groupBy("bucket").agg(F.min("n").alias("n_lo"), F.count("*").alias("size")).filter("size > 1"), "prefix-counts")
    return meet(dealt, least).filter(alike("n", F.greatest("n_lo", F.ceil(SHARE * F.col("n") / 100)), "c")).select("bucket", "id", "n", "degree", "c", "first", "groups")


def alike(n: str, other: Column | str, shareable: Column | str) -> Column:
    """Whether sets of these sizes, with so many shingles in common at most, can reach the threshold."""
    n, other, shareable = (F.col(x) if isinstance(x, str) else x for x in (n, other, shareable))
    return (100 + SHARE) * F.least(shareable, n, other) >= SHARE * (n + other)


def forest(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Each node's smallest connected node, by union-find with path halving."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest node that each linked node reaches, itself left out if it is that node. ``links`` is a written table."""

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, int] = {}
        for frame in frames:  # a forest of what came before goes into the next, so memory follows the nodes and not the links
            a, b = (np.concatenate([frame[c].to_numpy(), np.fromiter(x, np.int64, len(found))]) for c, x in (("a", found.keys()), ("b", found.values())))
            found = forest(a, b)
        rows = [(x, r) for x, r in found.items() if x != r]
        yield pd.DataFrame(rows, columns=["node", "up"], dtype="int64")

    parts = -(-links.count() // FOREST_LINKS)
    edges, before = written(links.select("a", "b").coalesce(max(1, parts)).mapInPandas(reduce, "node long, up long"), "forest"), None
    if parts <= 1:
        return edges.select(F.col("node").alias("id"), F.col("up").alias("component"))
    while True:
        least = edges.groupBy("node").agg(F.min("up").alias("least"))
        top = least.select(F.col("node").alias("least"), F.col("least").alias("above"))
        moved = edges.join(least, "node").join(top, "least", "left").withColumn("to", F.coalesce("above", "least"))
        ends = F.array(F.struct("node", F.col("to").alias("up")), F.struct(F.col("up").alias("node"), F.col("to").alias("up")), F.struct(F.col("least").alias("node"), F.col("to").alias("up")))
        moved = moved.select(F.explode(ends).alias("e")).select("e.node", "e.up").filter("node <> up").distinct()
        now = written(moved, "stars")
        if before is not None:
            discard(now.sparkSession, before)
        before, edges = edges, now
        # stars: no node with two ups, no up that is a node
        nodes = edges.groupBy("node").agg(F.count("*").alias("n"))
        ups = edges.select(F.col("up").alias("node")).distinct()
        if nodes.filter("n > 1").select("node").union(nodes.select("node").join(ups, "node", "left_semi")).isEmpty():
            discard(now.sparkSession, before)
            return edges.select(F.col("node").alias("id"), F.col("up").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    with Workspace(docs.sparkSession) as work:
        return written(grouped(docs, work.written), "groups")


def grouped(docs: DataFrame, store: Store) -> DataFrame:
    sets = store(sketch(docs), "sketches")
    some = sets.filter("n > 0 AND doc_id IS NOT NULL")
    classes = store(some.groupBy("a", "b", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "classes")
    # a class's bands are its first document's
    firsts = some.join(classes.select("a", "b", "n", F.col("id").alias("doc_id")), ["a", "b", "n", "doc_id"], "left_semi")
    rows = firsts.select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("bucket"))
    shared = store(rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("bucket", "size"), "shared")
    members = store(meet(rows, shared).select("bucket", "id", "n", "size").distinct(), "buckets")
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    members = store(members.join(degree, "id").select("bucket", "id", "n", "degree", F.col("n").alias("c"), F.array().cast("array<bigint>").alias("first"), F.array().cast("array<int>").alias("groups")), "members")
    wanted = bounded(store(members.select("id").distinct(), "wanted"))
    texts = store(docs.select(F.col("doc_id").alias("id"), "text").filter("id IS NOT NULL").join(wanted, "id", "left_semi"), "texts")
    # rows that repeat a doc_id link the classes that they are in
    repeats = some.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    same = some.join(repeats, "doc_id", "left_semi").join(classes, ["a", "b", "n"]).filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    label = components(store(same.distinct(), "repeats"))
    tested, pivots = None, FIRST_PIVOTS
    while True:
        placed = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        ends = [F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")]
        open_ = store(placed.groupBy("bucket").agg(*ends).filter("lo < hi").select("bucket", "size"), "open-buckets")
        if open_.isEmpty():
            break
        hot = hot_buckets(open_)
        placed = store(salted(placed, hot).join(on_every_salt(open_.select("bucket"), hot), ["bucket", "salt"], "left_semi"), "open")
        cell = F.pmod(F.xxhash64("id", F.lit(pivots)), F.lit(pivots))
        best = placed.groupBy("bucket", cell.alias("cell")).agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), "n", "c", "component", "first", "groups")).alias("p"))
        chosen = store(best.select("bucket", (-F.col("p.minus")).alias("a"), F.col("p.n").alias("n_a"), F.col("p.c").alias("c_a"), F.col("p.first").alias("first_a"), F.col("p.groups").alias("groups_a"), F.col("p.component").alias("component_a")), "pivots")
        met = F.get(F.array_intersect("first", "first_a"), F.lit(0))  # a pair is one of the first bucket that it shares
        pairs = placed.join(on_every_salt(chosen, hot), ["bucket", "salt"]).filter(F.coalesce(met == F.col("bucket"), F.lit(True))).filter((F.col("component") != F.col("component_a")) & (F.col("id") != F.col("a")))
        pairs = pairs.filter(alike("n", "n_a", F.least("c", "c_a")))
        both = F.aggregate(F.zip_with("groups", "groups_a", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
        pairs = pairs.filter(F.when((F.size("groups") > 0) & (F.size("groups_a") > 0), alike("n", "n_a", both)).otherwise(True))
        # one row for a pair, whatever buckets it meets in and if both are pivots
        pairs = pairs.groupBy(F.least("a", "id").alias("lo"), F.greatest("a", "id").alias("hi")).agg(F.max("a").alias("a"))
        if tested is not None:
            pairs = pairs.join(tested, ["lo", "hi"], "left_anti")
        pairs = store(pairs, "pairs")
        new = store(verified(pairs.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")), texts), "verified")
        tested = pairs.select("lo", "hi") if tested is None else tested.unionByName(pairs.select("lo", "hi"))
        label = components(store(new.unionByName(label.select(F.col("id").alias("a"), F.col("component").alias("b"))), "links"))
        members = placed.join(chosen.select("bucket", F.col("a").alias("id")), ["bucket", "id"], "left_anti").select("bucket", "salt", "id", "n", "degree", "c", "first", "groups")
        if pivots == FIRST_PIVOTS:
            members = store(members, "rest")
            crowded = store(members.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > CROWD).select("bucket"), "crowded")
            if not crowded.isEmpty():
                of_crowd = on_every_salt(crowded, hot)
                crowd = store(members.join(of_crowd, ["bucket", "salt"], "left_semi").select("id", "n", "degree").distinct(), "crowd")
                calm = members.join(of_crowd, ["bucket", "salt"], "left_anti").drop("salt")
                members = store(calm.unionByName(prefixes(texts, crowd, store)), "dealt").withColumn("salt", F.lit(0))
        members = members.drop("salt")
        pivots *= MORE_PIVOTS
    many = classes.filter("copies > 1").select("a", "b", "n", "id")
    out = sets.select("doc_id", "n", "a", "b").join(many, ["a", "b", "n"], "left").withColumn("id", F.coalesce("id", "doc_id"))
    out = out.join(label, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs``, all columns as they are, with one document of each group: the one with the smallest doc_id."""
    gone = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
