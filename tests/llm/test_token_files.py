"""Grammar-compressed shards: exact round trips, random access, the library's ids."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from millrace.llm import token_files as tf
from tests.llm.conftest import ODD_TEXTS

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCAB)


def test_ids_are_the_librarys(library, prose):
    for text in [*ODD_TEXTS, "<|endoftext|> a<|endoftext|>", "it's 12 o'clock\n\n  x\t", "ünï 日本   z", prose(300, 4)]:
        assert tf.encode(VOCAB, text or "").tolist() == library.encode(text or "", add_special_tokens=False).ids


SPACES = [" ", "  ", "\n", " \n", "\t ", "\x0b", "\x0c", "\r\n", "\x1c", "\x1f ", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u3000", "\ufeff", "<|endoftext|>", "'s", "'", "!", "12", "½", "é", "e\u0301", "日本", "😀", "\x00", "ab", "Zz"]


def test_pieces_give_the_librarys_ids_whatever_stands_side_by_side(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(SPACES) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    got = tf.Encoder(VOCAB)(texts)
    assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_all_supplied_documents_and_a_forgetful_encoder(library, monkeypatch):
    texts = [t or "" for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in tf.Encoder(VOCAB)(texts)] == want
    monkeypatch.setattr(tf, "KNOWN_PIECES", 100)
    monkeypatch.setattr(tf, "BLOCK_CHARS", 1000)
    assert [g.tolist() for g in tf.Encoder(VOCAB)(texts[:200])] == want[:200]


def test_pieces_of_one_hash_are_told_apart(library, monkeypatch):
    monkeypatch.setattr(tf, "BYTE_HASH", np.arange(256, dtype=np.uint64) % np.uint64(3))
    monkeypatch.setattr(tf, "STEP", np.uint64(1))
    texts = ["abc cba bac abd", "one two three four", "x", " y  z ", "the the the", "eht het"]
    assert [g.tolist() for g in tf.Encoder(VOCAB)(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_word_is_asked_for_once_whatever_stands_after_it(library, monkeypatch):
    words, marks = ["alpha", "beta", "gamma", "delta", "omega"], ["", ",", ".", "!", "?", ";", ":", "***", "12", "7", ").", '"']
    texts = [" ".join(w + m for w in words for m in marks) for _ in range(3)]
    asked, encoded = [], tf.Encoder.encoded
    monkeypatch.setattr(tf.Encoder, "encoded", lambda self, given: asked.extend(given) or encoded(self, given))
    got = tf.Encoder(VOCAB)(texts)
    assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sum(len(t) for t in asked) < len(texts[0]) / 3


KINDS = ["'", "'s", "'ll", "'S", "s", "ll", "x", "1", "23", "_", "!", "''", "é", "日", "½", "\x00", "\x7f", "\n", " ", "  ", "\t", "<|"]


def test_letters_digits_and_marks_meet_as_the_library_cuts_them(library):
    rng = random.Random(8)
    texts = ["".join(rng.choice(KINDS) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    got = tf.Encoder(VOCAB)(texts)
    assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("collide", [False, True])
def test_long_pieces(library, monkeypatch, collide):
    if collide:
        monkeypatch.setattr(tf, "BYTE_HASH", np.arange(256, dtype=np.uint64) % np.uint64(3))
        monkeypatch.setattr(tf, "STEP", np.uint64(1))
        monkeypatch.setattr(tf.hashlib, "blake2b", lambda data, digest_size, real=tf.hashlib.blake2b: real(b"", digest_size=digest_size))
    sizes = [7, 8, 9, 15, 16, 17, 63, 64, 65, 66, 127, 128, 129, 5000]
    texts = [f"{'ab' * n}"[:n] + f" {'ba' * n}"[: n + 1] + " c" for n in sizes] + [f"{'ba' * n}"[:n] + "," + "é" * n for n in sizes] + ["a\0", "a", "a\0\0"]
    encoder = tf.Encoder(VOCAB)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in encoder(texts)] == want
    assert [g.tolist() for g in encoder(texts[::-1])] == want[::-1]


def test_other_settings_of_the_file_are_kept(tmp_path):
    import json

    spec = json.loads(open(VOCAB, encoding="utf-8").read())
    spec["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "lower.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert tf.Encoder(str(path))(["Some TEXT here"])[0].tolist() == tf.encode(VOCAB, "some text here").tolist()


def test_shards_shrink_and_stay_narrow(library):
    texts = [t or "" for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()]
    parts = [np.append(x, 2) for x in tf.Encoder(VOCAB)(texts)]
    blob = tf.pack(list(range(len(parts))), parts, 50257)
    assert len(blob) < 0.75 * 2 * sum(map(len, parts))
    shard = tf.Shard(blob)
    assert shard.first + len(shard.rules) <= 1 << 16
    assert all((shard.ids(k) == p).all() for k, p in enumerate(parts))


@pytest.mark.parametrize("kind", ["prose", "constant", "alternating", "random", "tiny"])
def test_shard_round_trip_and_slices(kind):
    rng = np.random.default_rng(3)
    parts = {
        "prose": [rng.choice([5, 9, 5, 5, 7, 50000], rng.integers(1, 3000)) for _ in range(12)],
        "constant": [np.full(5001, 4)],
        "alternating": [np.tile([1, 2], 900), np.tile([2, 1], 901)],
        "random": [rng.integers(0, 50257, 4000)],
        "tiny": [np.array([2])],
    }[kind]
    parts = [np.asarray(p, np.int64) for p in parts]
    blob = tf.pack([None if k == 1 else k for k in range(len(parts))], parts, 50257)
    shard = tf.Shard(blob)
    assert all((shard.ids(k) == p).all() and len(shard.ids(k)) == len(p) for k, p in enumerate(parts))
    assert shard.null.tolist() == [k == 1 for k in range(len(parts))]
    for k, p in enumerate(parts):
        for a, b in [(0, len(p)), (len(p) // 3, len(p) // 2), (len(p) - 1, len(p))]:
            assert (shard.slice(k, a, b) == p[a:b]).all()
    if kind in ("prose", "constant", "alternating"):
        assert len(shard.rules) and len(shard.symbols) < sum(map(len, parts)) / 2
        assert shard.length.tolist() == [len(shard.expand(np.array([shard.first + r]))) for r in range(len(shard.rules))]


def test_known_pieces_are_bounded_by_bytes(library, monkeypatch):
    monkeypatch.setattr(tf, "KNOWN_BYTES", 5000)
    encoder, texts = tf.Encoder(VOCAB), ["日本" * 100 + str(k) for k in range(60)]
    for text in texts:
        assert encoder([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.raw) <= 5000 + 700


def test_ids_beyond_16_bits():
    rng = np.random.default_rng(4)
    parts = [rng.choice([5, 65535, 65536, 69999, 5, 5], rng.integers(1, 3000)) for _ in range(12)] + [np.full(2001, 69999)]
    shard = tf.Shard(tf.pack(list(range(13)), parts, 70000))
    assert all((shard.ids(k) == p).all() and len(shard.ids(k)) == len(p) for k, p in enumerate(parts))
    assert len(shard.rules) and len(shard.symbols) < sum(map(len, parts)) / 2


def test_a_rule_that_needs_itself_is_an_error():
    blob = bytearray(tf.pack([1], [np.tile([1, 2], 900)], 50257))
    blob[80:84] = (50257).to_bytes(4, "little")
    with pytest.raises(ValueError):
        tf.Shard(bytes(blob))


def test_files_hold_documents_in_order(spark, documents, library, prose):
    rows = [(9, prose(40, 1)), (2, None), (-5, "x"), (None, "no id"), (7, "b"), (7, "a"), (7, "a"), *((100 + i, t) for i, t in enumerate(ODD_TEXTS))]
    got = [tuple(r) for r in tf.file_digests(documents(rows), VOCAB).orderBy("start").collect()]
    want, start = [], 0
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k long, t string")
    hashes = {r.k: r.h for r in frame.select("k", F.xxhash64("t").alias("h")).collect()}
    for _, (i, t) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, hashes[r[0]])):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert tf.file_digests(documents([]), VOCAB).count() == 0
