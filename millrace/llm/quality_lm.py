"""Quality classifier: interpolated modified Kneser-Ney over character n-grams.

The model is trained, language by language, on all trusted documents (those
labelled of good quality, but for a fifth kept for calibration). Tasks count
the highest order's n-grams of their batches; one shuffle adds the counts up by
n-gram, and the lower orders' continuation counts, the discounts and the
back-off weights follow by grouping the n-gram types.

The model stays a table. Documents are dealt to blocks of one language and about
``BLOCK_CHARS`` characters; each block's distinct n-grams, a percent of its
places, are joined with the model on the n-gram, and what the join finds is
brought together with the block's documents, which are scored there over their
whole texts. Documents travel to their block as compressed batches. Nothing
that grows with the corpus is broadcast or collected.

A document's log-perplexity less ``SHORT`` by the root of its length (few
characters tell little) is held against its language's cut, and beyond it
rejected. The cut is the quantile of the calibration documents that tells them
best from the documents labelled of bad quality, none of which the model has
seen: the share of the good beyond it and of the bad within it is least. Where
nothing lies between the two kinds it is half way. A language with fewer than
``LEAST_CALIBRATION`` documents of either kind takes the cut over all languages;
with no bad ones at all it is the ``QUANTILE`` of the good.

Defined results: null and empty texts have no perplexity and are kept; a null
language is one of its own; a language without trusted text is not judged: its
documents have no perplexity and are kept; repeated rows are scored alike, each
row once; other columns are passed through.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace, bounded, codepoints, discard, release, scratch, tidy, written

ORDER = 5
PAD = 2
BLOCK_CHARS = 40 << 20
CHUNK_CHARS = 1 << 19
#: Documents are packed once, so many at most together, and cross one shuffle.
PACK_ROWS, PACK_LEVEL = 1024, 9
QUANTILE, SHORT, LEAST_CALIBRATION = 0.98, 4.0, 20
#: Steps of the quantiles of each kind that a cut is looked for among.
STEPS = 1000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def language_seed(lang: str | None) -> np.uint64:
    return np.uint64((zlib.crc32((lang or "").encode()) + 1) * int(M2) % (1 << 64))


def step(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
    h = (h ^ chars * M1) * M2
    return h ^ h >> np.uint64(29)


def span_hash(chars: np.ndarray, at: np.ndarray, a: int, b: int, seed: np.uint64) -> np.ndarray:
    """Hash of characters a to b (not included) of the windows at ``at``; of the language alone if there are none."""
    h = np.full(len(at), seed)
    for j in range(a, b):
        h = step(h, chars[at + j])
    return h ^ np.uint64(b - a)


#: What a key stands for is mixed into it: an n-gram, a context, the root context.
SHARE, WEIGHT, ROOT = np.uint64(0), np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def windows(texts: list[str], lang: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters, padded in front of each text; the hash of the window that ends at each of them; each text's length."""
    chars, ends = codepoints(texts, ORDER - 1, PAD)
    chars = chars.astype(np.uint64)
    size = np.diff(ends) - (ORDER - 1)
    inside = np.ones(len(chars), bool)
    inside[(ends[:-1][:, None] + np.arange(ORDER - 1)).ravel()] = False
    at = np.flatnonzero(inside) - (ORDER - 1)
    return chars, at, size


def keys_of(chars: np.ndarray, at: np.ndarray, lang: str | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the n-grams of order ORDER to 1 that end at the windows' last characters, and of their contexts."""
    seed = language_seed(lang)
    return [span_hash(chars, at, k, ORDER, seed) for k in range(ORDER)], [span_hash(chars, at, k, ORDER - 1, seed) for k in range(ORDER)]


def distinct(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place where each distinct value first stands, and every value's number among the distinct ones; by hash, not by sorting."""
    number, values = pd.factorize(window)
    first = np.empty(len(values), np.int64)
    first[number[::-1]] = np.arange(len(window))[::-1]
    return first, number


def chunks(frame: pd.DataFrame) -> Iterator[tuple[str | None, np.ndarray]]:
    """The rows' places, by language, in runs of about CHUNK_CHARS."""
    size = np.array([len(t or "") for t in frame["text"]], np.int64)
    for lang, places in frame.reset_index(drop=True).groupby(frame["lang"].fillna("").to_numpy(), sort=True).indices.items():
        cuts = np.cumsum(size[places]) // CHUNK_CHARS
        for part in np.split(places, np.flatnonzero(np.diff(cuts)) + 1):
            yield lang, part


NAMES = [f"g{k}" for k in range(ORDER, 0, -1)] + [f"c{k}" for k in range(ORDER, 0, -1)]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, hashes of the n-gram, its suffixes and their contexts, n: for each of the highest order.

    Tasks count by chunk and send an n-gram as its characters; the hashes follow when counts are added up.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].to_numpy()
            for lang, part in chunks(frame):
                chars, at, _ = windows([texts[i] or "" for i in part], lang)
                first, number = distinct(span_hash(chars, at, 0, ORDER, language_seed(lang)))
                n = np.bincount(number, minlength=len(first))
                grams = chars[at[first][:, None] + np.arange(ORDER)].astype(np.uint32)
                yield pd.DataFrame({"lang": lang, "gram": np.ascontiguousarray(grams).view(f"<U{ORDER}").ravel().astype(object), "n": n})

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, own in frame.groupby("lang"):
                chars = np.array(own["gram"].tolist(), dtype=f"<U{ORDER}").view(np.uint32).astype(np.uint64)  # ends cut off at NUL come back
                grams, contexts = keys_of(chars, np.arange(0, len(chars), ORDER), lang)
                yield pd.DataFrame({"lang": lang, "n": own["n"].to_numpy()} | {k: v.view(np.int64) for k, v in zip(NAMES, grams + contexts, strict=True)})

    counted = docs.select("lang", "text").mapInPandas(tidy(run), "lang string, gram string, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return summed.mapInPandas(tidy(hashed), "lang string, n long, " + ", ".join(f"{k} long" for k in NAMES))


def train(trusted: DataFrame) -> DataFrame:
    """The model, a written table: (key, value), an n-gram's discounted share of its context, or the weight that a context leaves to the next lower order.

    Each order is a table of its own, counted from the one above it, and adds its part to the model; a table goes when the next is there.
    """
    spark, path, upper = trusted.sparkSession, scratch(trusted.sparkSession, "kneser-ney"), None
    with Workspace(spark) as work:
        for k in range(ORDER, 0, -1):
            if upper is None:
                types = count_ngrams(trusted)
            else:
                rest = [x for x in NAMES if int(x[1:]) <= k and x != f"g{k}"]
                types = upper.groupBy("lang", f"g{k}").agg(F.count("*").alias("n"), *(F.first(x).alias(x) for x in rest))
            types = work.written(types, f"ngrams-{k}")
            if upper is not None:
                discard(spark, upper)
            shares, weights = estimate(types, k, work)
            shares.unionByName(weights).write.mode("append").parquet(path)
            upper = types
    return spark.read.schema("key long, value double").parquet(path)


def estimate(types: DataFrame, k: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The model's two parts of order ``k``: shares of its n-grams and weights of their contexts."""
    of = [F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> Column:
        """By the counts of counts, within (0, i); half below i where they are too few to tell."""
        share = F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        told = F.least(F.greatest(i - (i + 1) * y * share, F.lit(0.05)), F.lit(i - 0.05))
        return F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0) & y.isNotNull(), told).otherwise(F.lit(i - 0.5))

    # A row for each language, and a language may be most of the corpus: broadcast as long as the languages are within the bound.
    discounts = bounded(work.written(types.groupBy("lang").agg(*of).select("lang", *(discount(i).alias(f"d{i}") for i in (1, 2, 3))), "discounts"))
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    cut = types.select("lang", "n", f"g{k}", f"c{k}").join(discounts, "lang").withColumn("d", d)
    contexts = cut.groupBy(f"c{k}").agg(F.sum("n").alias("total"), F.sum("d").alias("left"), F.count("*").alias("types"))
    shares = cut.join(contexts.select(f"c{k}", "total"), f"c{k}").select(F.col(f"g{k}").alias("key"), ((F.col("n") - F.col("d")) / F.col("total")).alias("value"))
    weight = F.col("left") / F.col("total") if k > 1 else F.col("left") / F.col("total") / (F.col("types") + 1)
    return shares, contexts.select(F.col(f"c{k}").bitwiseXOR(F.lit(int(WEIGHT if k > 1 else ROOT))).alias("key"), weight.alias("value"))


def blocked(docs: DataFrame) -> DataFrame:
    """``docs`` (with lang and text) with a block number; each language has as many blocks as its characters ask for."""
    lang = F.coalesce("lang", F.lit(""))
    # A row for each language, of those that need several blocks.
    large = docs.groupBy(lang.alias("lang")).agg((F.sum(F.char_length("text")) / BLOCK_CHARS).alias("n")).filter("n > 1").collect()
    several = F.create_map(*(F.lit(x) for r in large for x in (r["lang"], math.ceil(r["n"])))) if large else None
    blocks = F.coalesce(F.try_element_at(several, lang), F.lit(1)) if large else F.lit(1)
    # Small numbers, as every key that crosses a shuffle carries one. Languages whose hashes agree share blocks, which are taken apart by language.
    return docs.withColumn("_block", F.pmod(F.xxhash64(lang), F.lit(256)) + 256 * F.pmod(F.xxhash64("doc_id", "text_hash"), blocks))


class Lookup:
    """From n-gram hashes to numbers: tables in which of all keys that share a slot one is kept, the others going on to the next table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        while len(keys):
            shift = np.uint64(64 - max(4, int(len(keys) * 2).bit_length()))
            mult = M1 + np.uint64(2 * len(self.tables))
            slot = (keys * mult >> shift).astype(np.int64)
            n = 1 << int(np.uint64(64) - shift)
            at = np.full(n, -1, np.int64)
            at[slot] = np.arange(len(keys))
            own = np.where(at >= 0, keys[at], np.uint64(0))
            self.tables.append((shift, mult, own, np.where(at >= 0, values[at], np.nan)))
            left = at[slot] != np.arange(len(keys))
            keys, values = keys[left], values[left]

    def __call__(self, keys: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(keys), default)
        todo = np.arange(len(keys))
        for shift, mult, own, values in self.tables:
            slot = (keys[todo] * mult >> shift).astype(np.int64)
            value = values[slot]
            hit = (own[slot] == keys[todo]) & ~np.isnan(value)
            out[todo[hit]] = value[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


class Scorer:
    """Mean log probability of each text's characters, from a block's part of the model; nan for empty texts."""

    def __init__(self, entries: pd.DataFrame):
        self.model = Lookup(entries["key"].to_numpy().astype(np.int64).view(np.uint64), entries["value"].to_numpy(dtype=float))

    def __call__(self, frame: pd.DataFrame) -> np.ndarray:
        texts, out = frame["text"].to_numpy(), np.full(len(frame), np.nan)
        for lang, part in chunks(frame):
            chars, at, size = windows([texts[i] or "" for i in part], lang)
            if not len(at):
                continue
            first, number = distinct(span_hash(chars, at, 0, ORDER, language_seed(lang)))
            grams, contexts = keys_of(chars, at[first], lang)
            p = self.model(contexts[-1] ^ ROOT, np.nan)  # nan, too, for a language without trusted text
            for g, c, k in zip(grams[::-1], contexts[::-1], range(1, ORDER + 1), strict=True):
                p = self.model(g ^ SHARE, 0.0) + (self.model(c ^ WEIGHT, 1.0) if k > 1 else 1.0) * p
            logs = np.log(p)[number]  # p > 0: the root gives every character the unseen ones' weight
            ends = np.cumsum(size)
            sums = np.concatenate([[0.0], np.cumsum(logs)])
            out[part] = np.where(size > 0, (sums[ends] - sums[ends - size]) / np.maximum(size, 1), np.nan)
        return out


def needed(frame: pd.DataFrame) -> np.ndarray:
    """The keys that scoring these texts looks up."""
    texts, found = frame["text"].to_numpy(), [np.zeros(0, np.uint64)]
    for lang, part in chunks(frame):
        chars, at, _ = windows([texts[i] or "" for i in part], lang)
        first, _ = distinct(span_hash(chars, at, 0, ORDER, language_seed(lang)))
        grams, contexts = keys_of(chars, at[first], lang)
        found += [g ^ SHARE for g in grams] + [c ^ WEIGHT for c in contexts[:-1]] + [contexts[-1][:1] ^ ROOT]
    return pd.unique(np.concatenate(found))


def pack(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", PACK_LEVEL))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_all().to_pandas()


def score(docs: DataFrame, model: DataFrame, id_columns: list[str]) -> DataFrame:
    """``id_columns`` (strings) and log_perplexity of every document; docs must hold text, lang and _block."""
    columns = list(dict.fromkeys([*id_columns, "lang", "text"]))

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, own in frame.groupby("_block"):
                parts = [pack(own[columns].iloc[k : k + PACK_ROWS]) for k in range(0, len(own), PACK_ROWS)]
                yield pd.DataFrame({"_block": block, "rows": parts})

    def needs(parts: pd.DataFrame) -> pd.DataFrame:
        keys = np.zeros(0, np.uint64)
        for blob in parts["rows"]:
            keys = pd.unique(np.concatenate([keys, needed(unpack(blob))]))
        release()
        return pd.DataFrame({"_block": parts["_block"].iloc[0], "key": keys.view(np.int64)})

    def run(parts: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        scorer, out = Scorer(entries), [pd.DataFrame({c: [] for c in id_columns})]
        for blob in parts["rows"]:
            frame = unpack(blob)
            out.append(frame[id_columns].assign(log_perplexity=-scorer(frame)))
        del scorer, entries, parts
        release()
        return pd.concat(out)

    # One exchange of the packed documents serves both the keys and the scores.
    sent = docs.select("_block", *columns).mapInPandas(tidy(packed), "_block long, rows binary").repartition("_block")
    found = sent.groupBy("_block").applyInPandas(needs, "_block long, key long").join(model, "key")
    schema = ", ".join(f"`{c}` string" for c in id_columns) + ", log_perplexity double"
    out = sent.groupBy("_block").cogroup(found.groupBy("_block")).applyInPandas(run, schema)
    return out.withColumn("log_perplexity", F.nanvl("log_perplexity", F.lit(None).cast("double")))


def calibrating(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1


def fitted(good: list[float] | None, bad: list[float] | None) -> float | None:
    """The cut, from the quantiles in STEPS steps of documents of either kind."""
    if not good:
        return None
    if not bad:
        return good[round(QUANTILE * STEPS)]
    good, bad = np.sort(good), np.sort(bad)
    at = np.unique(np.concatenate([good, bad]))
    lost = 1 - np.searchsorted(good, at, "right") / len(good)
    passed = np.searchsorted(bad, at, "right") / len(bad)
    k = int(np.argmin(lost + passed))
    return float(at[k : k + 2].mean())


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_hash, lang, chars, log_perplexity, surprise, cut, rejected of every document; the scores are a written table."""
    good = bounded(written(labels.filter("quality = 1").select("doc_id").distinct(), "trusted"))
    poor = bounded(written(labels.filter("quality = 0").select("doc_id").distinct(), "poor"))
    own = docs.select("doc_id", "lang", "text")
    model = train(own.filter(F.col("doc_id").isNotNull() & ~calibrating(F.col("doc_id"))).join(good, "doc_id", "left_semi"))
    rows = blocked(own.select(F.col("doc_id").cast("string").alias("doc_id"), text_hash().cast("string").alias("text_hash"), "lang", F.char_length("text").cast("string").alias("chars"), F.coalesce("text", F.lit("")).alias("text")))
    scored = written(score(rows, model, ["doc_id", "text_hash", "lang", "chars"]).withColumns({c: F.col(c).cast("long") for c in ("doc_id", "text_hash", "chars")}), "perplexities")
    discard(docs.sparkSession, model)
    scored = scored.withColumn("surprise", F.col("log_perplexity") - SHORT / F.sqrt(F.greatest("chars", F.lit(1))))
    held = scored.filter("surprise IS NOT NULL")
    steps = F.percentile_approx("surprise", [k / STEPS for k in range(STEPS + 1)], 10000).alias("steps")
    # A row, and a row for each language, of either kind: looked up, not joined, so no language is a hot key.
    overall, by_lang = [], []
    for rows in (held.filter(calibrating(F.col("doc_id"))).join(good, "doc_id", "left_semi"), held.join(poor, "doc_id", "left_semi")):
        overall.append(rows.agg(steps).first()["steps"])
        counted = rows.groupBy(F.coalesce("lang", F.lit("")).alias("_lang")).agg(steps, F.count("*").alias("n")).filter(F.col("n") >= LEAST_CALIBRATION)
        by_lang.append({r["_lang"]: r["steps"] for r in counted.collect()})
    cuts = {x: fitted(by_lang[0][x], by_lang[1][x]) for x in by_lang[0].keys() & by_lang[1].keys()}
    if not overall[1]:
        cuts = {x: fitted(q, None) for x, q in by_lang[0].items()}
    overall = fitted(*overall)
    own_cut = F.lit(overall).cast("double")
    if cuts:
        table = F.create_map(*(F.lit(x) for pair in cuts.items() for x in pair))
        own_cut = F.coalesce(F.try_element_at(table, F.coalesce("lang", F.lit(""))), own_cut)
    return scored.withColumn("cut", own_cut).withColumn("rejected", F.coalesce(F.col("surprise") > F.col("cut"), F.lit(False)))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")))


def keep_fluent(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are not rejected. A repeated row goes with all its copies."""
    out = classify(docs, labels).filter("rejected").select(F.col("doc_id").alias("_rejected_id"), F.col("text_hash").alias("_rejected_text")).distinct()
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")), F.coalesce(docs["lang"], F.lit("")))
    return docs.join(out, docs["doc_id"].eqNullSafe(out["_rejected_id"]) & (own == out["_rejected_text"]), "left_anti")
