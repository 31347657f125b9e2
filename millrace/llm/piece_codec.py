"""SentencePiece encoding with byte offsets, and decoding.

Normalisation walks the text by longest prefixes of the model's compiled
character map and notes for each normalised byte the original byte it came
from; the pieces, which tile the normalised text, are projected through that
alignment to spans of the original bytes. The ids are the library's own.

Defined results: null and empty texts give no ids and decode to "". Rows are
encoded independently, so ties and repeated rows give repeated results; only
the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame

SPACE = "▁".encode()
BYTE_PIECE, UNKNOWN_PIECE = 6, 2


@dataclass(frozen=True)
class Encoding:
    """ids; begin and end of each piece in the text's UTF-8 bytes."""

    text: str
    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def proto_fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (buf[i] & 127) << shift
            if buf[i] < 128:
                return value, i + 1
            i, shift = i + 1, shift + 7

    i = 0
    while i < len(buf):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = buf[i : i + n], i + n
        yield key >> 3, value


class CharacterMap:
    """A compiled map: a double-array trie over byte strings and the replacements its leaves point to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.replacements = blob[4 + size :]
        root = self._child(self.units[0]) if self.units else 0
        #: Which bytes an entry may begin with.
        self.begins = np.array([bool(self.units) and (root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b for b in range(256)])

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix of data[at:]."""
        if not self.units:
            return None
        found, node = None, self._child(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return found and (found[0], self.replacements[found[1] : self.replacements.index(b"\0", found[1])])

    @staticmethod
    def _child(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


class Normalizer:
    def __init__(self, spec: dict[int, int | bytes]):
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))

    def align(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes; for each of them, and the end, the original byte where its character begins.

        The walk by longest prefixes stops only at characters whose first byte begins an entry of the map; what lies between two entries is taken over in one go.
        """
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.squeeze or not self.escape:
            return self._walk(data)
        raw = np.frombuffer(data, np.uint8)
        start = np.maximum.accumulate(np.where(raw & 0xC0 == 0x80, 0, np.arange(len(raw), dtype=np.int64)))
        parts, back, done = [], [], 0
        for at in np.flatnonzero(self.map.begins[raw] & (raw & 0xC0 != 0x80)).tolist():
            if at >= done and (found := self.map.longest(data, at)) and found[0]:
                parts += [data[done:at], found[1]]
                back += [start[done:at], np.full(len(found[1]), at, np.int64)]
                done = at + found[0]
        new, origin = b"".join([*parts, data[done:]]), np.concatenate([*back, start[done:]])
        origin = np.repeat(origin, np.where(np.frombuffer(new, np.uint8) == 32, len(SPACE), 1))
        lead = len(SPACE) * bool(self.dummy_prefix and new)
        first = origin[:1].repeat(lead)
        return SPACE * bool(lead) + new.replace(b" ", SPACE), np.concatenate([first, origin, [len(raw)]])

    def _walk(self, data: bytes) -> tuple[bytes, np.ndarray]:
        chunks: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(data):
            step, new = self.map.longest(data, at) or (0, b"")
            if not step:
                lead = data[at]
                step = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
                new = data[at : at + step]
            chunks.append((new, at, at + step))
            at += step
        out, back, last = bytearray(), [], b" " if self.squeeze else b""
        stop = len(data)
        if self.squeeze:
            while chunks and not chunks[-1][0].strip(b" "):
                stop = chunks.pop()[1]
        space = SPACE if self.escape else b" "
        first = True
        for new, begin, _ in chunks:
            if self.squeeze and last.endswith(b" "):
                new = new.lstrip(b" ")
            if not new:
                continue
            if first and self.dummy_prefix:
                out += space
                back += [begin] * len(space)
            first, last = False, new
            put = new.replace(b" ", space)
            out += put
            back += [begin] * len(put)
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                stop = back[-len(space)]
                del back[-len(space) :]
        return bytes(out), np.array([*back, stop], np.int64)


class PieceCodec:
    def __init__(self, model_path: str):
        with open(model_path, "rb") as f:
            proto = f.read()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.normalizer = Normalizer(next((dict(proto_fields(v)) for k, v in proto_fields(proto) if k == 3), {}))
        pieces = [dict(proto_fields(v)) for k, v in proto_fields(proto) if k == 1]
        self.width = np.array([1 if p.get(3) == BYTE_PIECE else len(p[1]) for p in pieces], np.int64)
        self.unknown = np.array([p.get(3) == UNKNOWN_PIECE for p in pieces])

    def encode(self, text: str) -> Encoding:
        ids = np.array(self.sp.encode(text), np.int32)
        norm, back = self.normalizer.align(text.encode("utf-8", "surrogatepass"))
        width = self.width[ids]
        if self.unknown[ids].any():
            width = np.array([len(p.encode()) for p in self.sp.encode(text, out_type=str)], np.int64)
        ends = np.cumsum(width)
        if len(ids) and ends[-1] != len(norm):
            raise ValueError(f"pieces cover {ends[-1]} of {len(norm)} normalised bytes")
        return Encoding(text, ids, back[ends - width], back[ends])

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


@functools.lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def map_encodings(docs: DataFrame, model_path: str, derive: Callable[[PieceCodec, Encoding], dict], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the columns that ``derive`` makes of its encoding, inside the task that encoded it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model_path)
        for frame in frames:
            rows = [derive(c, c.encode(t or "")) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64")} | {k: [r[k] for r in rows] for k in (rows[0] if rows else [])})

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInPandas(run, f"doc_id long, {schema}")


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, and each piece's begin and end in the text's UTF-8 bytes, as arrays."""
    return map_encodings(docs, model_path, lambda _, e: {"ids": e.ids, "begin": e.begin, "end": e.end}, "ids array<int>, begin array<long>, `end` array<long>")


def digest(c: PieceCodec, e: Encoding) -> dict:
    ids = e.ids.tolist()
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(c.decode(e.ids).encode("utf-8", "surrogatepass")).hexdigest(),
        "n_bytes_covered": int((e.end - e.begin).sum()) if ids else 0,
        "spans_sha256": hashlib.sha256(np.stack([e.begin, e.end]).astype("<i8").tobytes()).hexdigest(),
    }


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Digests of every document's ids, of the text they decode to and of its pieces' spans (all begins, then all ends, as 64-bit little-endian); n_bytes_covered counts the original bytes that the spans cover."""
    return map_encodings(docs, model_path, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes_covered long, spans_sha256 string")
