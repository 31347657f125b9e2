"""Encoding against the library; alignment against its own normaliser and spans."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from millrace.llm import piece_codec as pc
from tests.llm.conftest import ODD_TEXTS

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [t or "" for t in ODD_TEXTS] + ["a  b c ", "héllo ▁ wörld\n\tx 😀", "<s> </s> <unk>", "ﬁ½ Ａ  é ㌀", "日本語 テキスト"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("text", TEXTS)
def test_ids_spans_and_decoding_are_the_librarys(library, text):
    c = pc.codec(MODEL)
    got, want = c.encode(text), library.encode(text, return_type="proto").pieces
    assert got.ids.tolist() == [p.id for p in want] == library.encode(text)
    assert list(zip(got.begin.tolist(), got.end.tolist(), strict=True)) == [(p.begin, p.end) for p in want]
    assert c.decode(got.ids) == library.decode(library.encode(text))


@pytest.mark.parametrize("text", ["ﬁ½ Ａ  é ㌀ x", "  lead  trail  ", "ｶﾞ 　z", "", "   ", "éä", "​q­"])
def test_longest_prefix_normalisation_through_a_compiled_map(text):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = next(dict(pc.proto_fields(v)) for k, v in pc.proto_fields(theirs.serialized_model_proto()) if k == 3)
    own = pc.Normalizer(spec)
    norm, back = own.align(text.encode())
    assert norm.decode() == theirs.normalize(text)
    assert len(back) == len(norm) + 1 and (np.diff(back) >= 0).all()


def test_alignment_in_stretches_equals_the_walk():
    theirs = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    entries = next(dict(pc.proto_fields(v)) for k, v in pc.proto_fields(theirs.serialized_model_proto()) if k == 3)
    for prefix in (0, 1):
        mapped = pc.Normalizer({**entries, 3: prefix, 4: 0, 5: 1})
        assert mapped.map.begins.sum() > 20
        for n in (mapped, pc.codec(MODEL).normalizer):
            for text in [*TEXTS, "ﬁ½ Ａ  é ㌀ x", "ｶﾞ 　z", "  lead  trail  ", "éä" * 50, "\u00ad", "\u200bq", "x\u3000"]:
                if text:
                    (a, x), (b, y) = n.align(text.encode()), n._walk(text.encode())
                    assert a == b and x.tolist() == y.tolist(), text


def test_span_digests_are_those_of_the_librarys_spans(documents, library):
    rows = list(enumerate(TEXTS))
    for r in pc.round_trip(documents(rows), MODEL).collect():
        pieces = library.encode(TEXTS[r.doc_id], return_type="proto").pieces
        spans = [p.begin for p in pieces] + [p.end for p in pieces]
        assert r.spans_sha256 == hashlib.sha256(np.array(spans, "<i8").tobytes()).hexdigest()


def test_round_trip_table(documents, library):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, "twice"), (3, "twice"), (None, "null id")]
    got = sorted((tuple(r)[:4] for r in pc.round_trip(documents(rows), MODEL).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert pc.round_trip(documents([]), MODEL).count() == 0


def test_spans_tile_the_text(documents):
    r = pc.encode_documents(documents([(1, "héllo wörld  😀 end")]), MODEL).first()
    assert r.begin[0] == 0 and r.end[-1] == len("héllo wörld  😀 end".encode()) and r.begin[1:] == r.end[:-1]
