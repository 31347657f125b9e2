"""Token ids in grammar-compressed binary files, read back by document.

Documents are range-partitioned and sorted by doc_id, nulls first, then by the text's hash,
encoded, closed by an end id and written as shards of some two million ids.
Within a shard frequent pairs of ids give way to nonterminals, round after
round, each round taking all pairs that are frequent enough at once; no pair
spans two documents. A shard keeps its rules, the length of each rule's
expansion and where each document begins, in symbols and in ids, so a document
or a stretch of it is decoded without the rest.

Every attempt of a task writes under names of its own. The manifest, itself a
written table, holds the names of the attempt that Spark has accepted, and only
it says what is read; no file is renamed or written twice.

Defined results: null and empty texts are the end id alone; a null doc_id
sorts first and comes back null; repeated doc_ids are documents of their own;
an empty table has no shards; other columns are not read.

Shard, little-endian: magic, then nine u64 (first nonterminal, rules, documents,
symbols, ids, symbol width, 3 spare), rules u32 x 2, rule lengths u32, doc_ids
i64, null flags u8, first symbol of each document and the end u64, first id of
each document and the end u64, symbols u16 or u32.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import filesystem, scratch, written

MAGIC = b"MILLRPR1"
SHARD_IDS = 1 << 21
#: A rule takes RULE_BYTES in the file and saves a symbol's bytes each time it is used, so a pair must occur often enough
#: to repay that twice over (overlapping pairs lose places to each other). A round keeps at most so many of the most
#: frequent pairs; those that miss out meet the next round.
PAIRS_A_ROUND, RULE_BYTES = 4096, 12
#: Rounds end when one saves less than this share of the symbols' bytes, or when the symbols of the narrower width are used up, as the wider one would cost more than any rule saves.
LEAST_GAIN = 0.002


#: ASCII white space, and other characters that some call space, or that join or mark: texts that hold those are encoded whole.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
ODD = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f\\u2060\\u3000\\ufeff]")
BLOCK_CHARS, KNOWN_PIECES, KNOWN_BYTES, RUN_PIECES = 1 << 22, 1 << 20, 1 << 25, 256
#: Letters, digits and other characters of ASCII; bytes beyond ASCII may be any of them.
KIND = np.array([0 if b > 127 or BLANK[b] else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
#: Whether a piece is cut between two bytes, by the first one * 256 + the second: where white space begins, and where the kind changes, though not after an apostrophe, which may begin 's or 'll.
CUT = (~BLANK[:, None] & BLANK | (KIND[:, None] > 0) & (KIND > 0) & (KIND[:, None] != KIND) & (np.arange(256) != 39)[:, None]).ravel()
BYTE_HASH = np.random.default_rng(12).integers(0, 1 << 64, 256, np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: The low n bytes of a word of eight. Pieces of more than LANES words are hashed and compared one by one.
LOW_BYTES, LANES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64), 8


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of runs of n, one run after the other."""
    ends = np.cumsum(n)
    return np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``raw`` on as one number; raw ends with eight bytes more."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


class Encoder:
    """Ids of the tokenizers library, which is asked for each distinct piece of the texts.

    A piece is a run of ASCII white space and what follows it, up to the next one or to where ASCII letters, digits and
    other characters meet. A byte-level pre-tokeniser with the usual pattern always cuts there (but for an apostrophe and
    letters after it), so the pieces' ids, one after the other, are the text's. Pieces are encoded in joined runs, those that
    begin with no space after a line feed whose id is dropped, and the ids dealt back by the bytes that they stand for.
    Pieces are told apart by a hash and compared with the known piece byte by byte, eight at a time; texts with a piece that
    differs go to the library whole, as do texts that hold an added token or space beyond ASCII, and all texts where the
    file's settings are others.
    """

    def __init__(self, vocab_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        with open(vocab_json, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = tokenizers.Tokenizer.from_str(json.dumps(spec))
        pre = spec.get("pre_tokenizer") or {}
        by_bytes = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.in_pieces = bool(by_bytes and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding"))
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.whole = re.compile("|".join([ODD.pattern, *map(re.escape, added)]))
        self.marks = [c for c in map(chr, range(256)) if ODD.match(c)] + added
        vocab = self.library.get_vocab()
        self.first = max(vocab.values()) + 1
        self.n_bytes = np.zeros(self.first, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # a character for each byte
        self.powers = np.cumprod(np.append(np.uint64(1), np.full(8 * LANES, STEP)), dtype=np.uint64)
        two = np.arange(1 << 16)
        self.two_bytes = [BYTE_HASH[two & 255] * self.powers[k] + BYTE_HASH[two >> 8] * self.powers[k + 1] for k in (0, 2, 4, 6)]
        self.forget()

    def forget(self) -> None:
        """What is known is a cache of KNOWN_PIECES, of KNOWN_BYTES in all, and what one block adds. Piece 0 is none; slots hold pieces by hash, 0 in free ones."""
        self.slots, self.hashes = np.zeros(1 << 16, np.int32), np.zeros(1, np.uint64)
        self.raw, self.at, self.size = np.zeros(8, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids, self.begin, self.width = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The known pieces of these hashes, or 0."""
        slot = self.slot(hashes)
        number = self.slots[slot]
        todo = np.flatnonzero((number > 0) & (self.hashes[number] != hashes))
        while len(todo):
            slot[todo] = slot[todo] + 1 & len(self.slots) - 1
            number[todo] = self.slots[slot[todo]]
            todo = todo[(number[todo] > 0) & (self.hashes[number[todo]] != hashes[todo])]
        return number

    def file(self, hashes: np.ndarray) -> None:
        """Gives slots to new pieces."""
        number = np.arange(len(self.hashes), len(self.hashes) + len(hashes), dtype=np.int32)
        self.hashes = np.concatenate([self.hashes, hashes])
        if 2 * len(self.hashes) > len(self.slots):
            self.slots = np.zeros(1 << (4 * len(self.hashes)).bit_length() - 1, np.int32)
            number, hashes = np.arange(1, len(self.hashes), dtype=np.int32), self.hashes[1:]
        slot, todo = self.slot(hashes), np.arange(len(hashes))
        while len(todo):
            free = todo[self.slots[slot[todo]] == 0]
            self.slots[slot[free]] = number[free]
            todo = todo[self.slots[slot[todo]] != number[todo]]
            slot[todo] = slot[todo] + 1 & len(self.slots) - 1

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, raw: np.ndarray, size: np.ndarray) -> None:
        """Adds pieces, given by their bytes one after the other."""
        at = np.cumsum(size) - size
        joins = ~BLANK[raw[at + size - 1]]
        order = np.argsort(~joins, kind="stable")
        n, at, size = int(joins.sum()), at[order], size[order]
        raw, at = raw[spread(at, size)], np.cumsum(size) - size
        fed = (~BLANK[raw[at[:n]]]).astype(np.int64)
        ends = np.cumsum(size[:n] + fed)
        joined = np.full(ends[-1] if n else 0, 10, np.uint8)
        joined[spread(ends - size[:n], size[:n])] = raw[: size[:n].sum()]
        cuts = [0, *ends[RUN_PIECES - 1 : n - 1 : RUN_PIECES].tolist(), len(joined)]
        joined, data = joined.tobytes(), raw.tobytes()
        runs = self.encoded([joined[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a])
        alone = self.encoded([data[a:b].decode() for a, b in zip(at[n:].tolist(), (at + size)[n:].tolist(), strict=True)])
        ids = np.concatenate([np.zeros(0, np.int32), *runs])
        width = np.diff(np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, "right"), prepend=0)
        own = np.ones(len(ids), bool)
        own[(np.cumsum(width) - width)[fed > 0]] = False
        width = np.concatenate([width - fed, np.array([len(a) for a in alone], np.int64)])
        self.file(hashes[order])
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(width) - width])
        self.at = np.concatenate([self.at, len(self.raw) - 8 + at])
        self.ids = np.concatenate([self.ids, ids[own], *alone])
        self.width = np.concatenate([self.width, width])
        self.raw = np.concatenate([self.raw[:-8], raw, np.zeros(8, np.uint8)])
        self.size = np.concatenate([self.size, size])

    def goes_whole(self, text: str) -> bool:
        if not self.in_pieces:
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return bool(self.whole.search(text))
        return any(mark in text for mark in self.marks)  # faster than the pattern

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        whole = [k for k, t in enumerate(texts) if self.goes_whole(t)]
        block, size, left = [], 0, [k for k in sorted(set(range(len(texts))).difference(whole)) if texts[k]]
        for k in left:
            block.append(k)
            size += len(texts[k])
            if size >= BLOCK_CHARS or k == left[-1]:
                for at, ids in zip(block, self.block([texts[b] for b in block]), strict=True):
                    if ids is None:
                        whole.append(at)
                    else:
                        out[at] = ids
                block, size = [], 0
        for k, ids in zip(whole, self.encoded([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out

    def block(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts that are not empty; None where a piece's hash is another piece's."""
        if len(self.hashes) > KNOWN_PIECES or len(self.raw) > KNOWN_BYTES:
            self.forget()
        parts = [t.encode() for t in texts]
        ends = np.cumsum([len(d) for d in parts])
        data = b"".join([*parts, bytes(8)])
        raw = np.frombuffer(data, np.uint8)
        cut = np.empty(ends[-1], bool)
        cut[1:] = CUT[raw[: ends[-1] - 1].astype(np.uint16) << 8 | raw[1 : ends[-1]]]
        cut[np.append(0, ends[:-1])] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, ends[-1]))
        hashes, lanes, text_words = size.astype(np.uint64) * STEP, [], words(raw)
        among = np.arange(len(start))
        for lane in range(LANES):
            among = among[size[among] > 8 * lane]
            if not len(among):
                break
            word = text_words[start[among] + 8 * lane] & LOW_BYTES[np.minimum(size[among] - 8 * lane, 8)]
            two = word.astype("<u8", copy=False).view("<u2")
            hashes[among] += sum(table.take(two[k::4]) for k, table in enumerate(self.two_bytes)) * self.powers[8 * lane]
            lanes.append((among, word))
        long = np.flatnonzero(size > 8 * LANES)
        for k in long.tolist():
            hashes[k] = int.from_bytes(hashlib.blake2b(data[start[k] : start[k] + size[k]], digest_size=8).digest())
        code, distinct = pd.factorize(hashes)
        number = self.find(distinct)
        new = np.flatnonzero(number == 0)
        if len(new):
            first = np.empty(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            own = first[new]
            self.learn(distinct[new], raw[spread(start[own], size[own])], size[own])
            number[new] = self.find(distinct[new])
        known_at, known_size, known_words = self.at[number], self.size[number], words(self.raw)
        wrong = known_size[code] != size
        for lane, (among, word) in enumerate(lanes):
            known = known_words[np.minimum(known_at + 8 * lane, len(known_words) - 1)] & LOW_BYTES[np.clip(known_size - 8 * lane, 0, 8)]
            wrong[among] |= known[code[among]] != word
        for k in long.tolist():
            wrong[k] = wrong[k] or self.raw[known_at[code[k]] :][: size[k]].tobytes() != data[start[k] : start[k] + size[k]]
        n = self.width[number][code]
        last = np.searchsorted(start, ends)
        ids = np.split(self.ids[spread(self.begin[number][code], n)], np.cumsum(n)[last[:-1] - 1])
        if wrong.any():
            for k in np.unique(np.searchsorted(last, np.flatnonzero(wrong), "right")):
                ids[k] = None
        return ids


@functools.lru_cache(maxsize=2)
def encoder(vocab_json: str) -> Encoder:
    return Encoder(vocab_json)


def encode(vocab_json: str, text: str) -> np.ndarray:
    return encoder(vocab_json)([text])[0].astype(np.int64)


def frequent(keys: np.ndarray, most: int, least: int) -> np.ndarray:
    """The ``most`` most frequent pairs that occur ``least`` times, most frequent first, ties by the smaller pair."""
    order = np.sort(keys)
    often = order[: max(0, len(order) - least + 1)]
    often = often[often == order[least - 1 :]]
    pairs = often[np.append(True, often[1:] != often[:-1])] if len(often) else often
    counts = np.searchsorted(order, pairs, "right") - np.searchsorted(order, pairs)
    return pairs[np.argsort(-counts, kind="stable")[:most]]


def repair(ids: np.ndarray, starts: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, their starts by document, rules as pairs) for ids whose documents begin at starts[:-1]."""
    width = 2 if first < 1 << 16 else 4
    symbol, pair = (np.uint16, np.uint32) if width == 2 else (np.uint32, np.uint64)
    bits, spreads = pair(8 * width), (pair(0x9E3779B1) if width == 2 else pair(0x9E3779B97F4A7C15), pair(16 * width - 16))
    seq, last = ids.astype(symbol), np.zeros(len(ids), bool)
    last[starts[1:] - 1] = True
    rules: list[np.ndarray] = []
    n_rules, gain, room = 0, len(seq), (1 << 8 * width) - first
    slot = lambda k: (k * spreads[0] >> spreads[1]).astype(np.uint16)
    while gain >= LEAST_GAIN * width * len(seq) and len(seq) > 1 and room > n_rules:
        inner = ~last[:-1]  # no pair across the end of a document
        keys = seq[:-1].astype(pair) << bits | seq[1:]
        pairs = frequent(keys[inner], min(PAIRS_A_ROUND, room - n_rules), 2 * RULE_BYTES // width)
        if not len(pairs):
            break
        which = np.full(1 << 16, -1, np.int32)
        which[slot(pairs[::-1])] = np.arange(len(pairs))[::-1]  # of two in a slot the more frequent one is kept, the other waits
        pairs = pairs[np.sort(which[which >= 0])]
        which[slot(pairs)] = np.arange(len(pairs))
        held = np.zeros(1 << 16, pair)  # a free slot holds a pair that belongs to another one
        held[slot(np.zeros(1, pair))] = 1
        held[slot(pairs)] = pairs
        slots = slot(keys)
        at = np.flatnonzero((held.take(slots) == keys) & inner)
        run = np.concatenate([[True], np.diff(at) > 1])  # neighbouring hits overlap: every other one from the left counts
        offset = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[offset % 2 == 0]
        seq[at] = first + n_rules + which[slots[at]]
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        gain = width * len(at) - RULE_BYTES * len(pairs)
        seq, last = seq[keep], last[keep]
        rules.append(np.stack([pairs >> bits, pairs & pair((1 << 8 * width) - 1)], 1).astype(np.int64))
        n_rules += len(pairs)
    return seq, np.concatenate([[0], np.flatnonzero(last) + 1]), np.concatenate([np.zeros((0, 2), np.int64), *rules])


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule expands to. A rule uses earlier ones only, so rounds over all rules settle in order of depth."""
    out = np.ones(len(rules), np.int64)
    while len(rules):
        part = np.where(rules >= first, out[np.clip(rules - first, 0, None)], 1).sum(1)
        if (part == out).all():
            break
        out = part
    return out


class Shard:
    """A written shard; ``ids(k)`` and ``slice(k, a, b)`` decode a document or part of it."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.first, n_rules, n_docs, n_symbols, self.n_ids, width, *_ = struct.unpack_from("<9Q", blob, 8)
        at = 80

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.rules, self.length = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64), take("<u4", n_rules).astype(np.int64)
        self.doc_id, self.null = take("<i8", n_docs), take("u1", n_docs).astype(bool)
        self.symbol_start, self.id_start = take("<u8", n_docs + 1).astype(np.int64), take("<u8", n_docs + 1).astype(np.int64)
        self.symbols = take(f"<u{width}", n_symbols).astype(np.int64)
        self._flatten()

    def _flatten(self) -> None:
        """Every symbol's expansion, one after the other; in rounds, of the rules whose parts are known."""
        self.width = np.concatenate([np.ones(self.first, np.int64), self.length])
        self.offset = np.cumsum(self.width) - self.width
        self.flat = np.empty(int(self.width.sum()), np.int32)
        self.flat[: self.first] = np.arange(self.first)
        known, left = np.arange(len(self.width)) < self.first, np.arange(len(self.rules))
        while len(left):
            ready = known[self.rules[left]].all(1)
            if not ready.any():
                raise ValueError("a rule needs itself")
            now, left = left[ready], left[~ready]
            to = self.offset[self.first + now]
            for part in self.rules[now].T:
                self.flat[spread(to, self.width[part])] = self.flat[spread(self.offset[part], self.width[part])]
                to = to + self.width[part]
            known[self.first + now] = True

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.offset[symbols], self.width[symbols])]

    def ids(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.symbol_start[k] : self.symbol_start[k + 1]])

    def slice(self, k: int, a: int, b: int) -> np.ndarray:
        """Ids a to b (not included) of document k, from the symbols that cover them."""
        own = self.symbols[self.symbol_start[k] : self.symbol_start[k + 1]]
        ends = np.cumsum(self.width[own])
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left") + 1
        skip = a - (ends[lo - 1] if lo else 0)
        return self.expand(own[lo:hi])[skip : skip + b - a]


def pack(doc_ids: list[int | None], parts: list[np.ndarray], first: int) -> bytes:
    id_start = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    symbols, symbol_start, rules = repair(np.concatenate(parts), id_start, first)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    head = struct.pack("<9Q", first, len(rules), len(parts), len(symbols), id_start[-1], width, 0, 0, 0)
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, head, rules.astype("<u4").tobytes(), lengths(rules, first).astype("<u4").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), symbol_start.astype("<u8").tobytes(), id_start.astype("<u8").tobytes(), symbols.astype(f"<u{width}").tobytes()])


def write_shards(docs: DataFrame, vocab_json: str, end_id: int, folder: str) -> DataFrame:
    """Encodes and writes all documents below ``folder``; the manifest: a row per shard."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        part, k = TaskContext.get().partitionId(), 0
        first = encoder(vocab_json).first
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            nonlocal k, doc_ids, parts
            name = f"{base}/tokens-{part:06d}-{k:06d}-{uuid.uuid4().hex}.bin"
            blob = pack(doc_ids, parts, first)
            with fs.open_output_stream(name, compression=None) as f:
                f.write(blob)
            row = {"part": part, "shard": k, "path": f"{folder}/{name.rsplit('/', 1)[1]}", "n_docs": len(doc_ids), "n_ids": sum(map(len, parts)), "n_bytes": len(blob)}
            k, doc_ids, parts = k + 1, [], []
            return pd.DataFrame([row])

        held = 0
        for frame in frames:
            encoded = encoder(vocab_json)([t or "" for t in frame["text"]])
            for doc_id, null, ids in zip(frame["doc_id"], frame["absent"], encoded, strict=True):
                doc_ids.append(None if null else int(doc_id))
                parts.append(np.append(ids, np.int32(end_id)))
                held += len(parts[-1])
                if held >= SHARD_IDS:
                    yield flush()
                    held = 0
        if doc_ids:
            yield flush()

    rows = docs.select("doc_id", "text").repartitionByRange(max(1, docs.rdd.getNumPartitions()), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("absent"), "text")
    return written(rows.mapInPandas(run, "part long, shard long, path string, n_docs long, n_ids long, n_bytes long"), "manifest")


def read_shards(manifest: DataFrame, tasks: int) -> DataFrame:
    """A row per document, in file order by (part, shard, place): doc_id, its ids, and start, the ids of all documents before it.

    Shards' first ids come from two prefix sums, one within each part and one over the parts' totals, a row for each task that wrote.
    """
    return map_shards(manifest, tasks, lambda ids: {"ids": ids.astype(np.int32)}, "ids array<int>")


def map_shards(manifest: DataFrame, tasks: int, derive, schema: str) -> DataFrame:
    """As read_shards, with what ``derive`` makes of a document's ids in place of them."""
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = manifest.withColumn("inner", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(totals, "part").select("path", (F.col("base") + F.col("inner")).alias("first"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, first in zip(frame["path"], frame["first"], strict=True):
                fs, name = filesystem(path)
                with fs.open_input_stream(name, compression=None) as f:
                    shard = Shard(f.read())
                decoded = np.split(shard.expand(shard.symbols), shard.id_start[1:-1])
                rows = [derive(own) for own in decoded[: len(shard.doc_id)]]
                ids = pd.array(shard.doc_id, "Int64")
                ids[shard.null] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": first + shard.id_start[:-1], "n_tokens": np.diff(shard.id_start)} | {c: [r[c] for r in rows] for c in (rows[0] if rows else [])})

    return placed.repartition(tasks, "path").mapInPandas(run, f"doc_id long, start long, n_tokens long, {schema}")


def digest(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def file_digests(docs: DataFrame, vocab_json: str, end_id: int = 2) -> DataFrame:
    """Writes all documents' ids, reads the files back and gives each document's place, length and checksum."""
    folder = scratch(docs.sparkSession, "tokens")
    manifest = write_shards(docs, vocab_json, end_id, folder)
    return map_shards(manifest, max(1, docs.rdd.getNumPartitions()), digest, "ids_crc32 long")
