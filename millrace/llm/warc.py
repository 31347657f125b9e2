"""WARC archives: a deduplicating writer and a splittable reader.

The writer puts one gzip member per record. Of equal payloads of at least
``least`` bytes the one with the largest page_id is a response record, the
others are revisit records that refer to it and keep only the HTTP headers,
whose Content-Length still tells the payload's size.

The reader needs no index: a task gets a byte range of a file, scans it for the
gzip magic, takes a candidate for a member only if it inflates to a WARC
header, and owns the records whose members start inside its range, reading on
beyond its end for the last of them. Payloads are digested as they are read, and
one that differs from its header fails the round trip.

Defined results: a null html is an empty payload; a null page_id is written as
an empty field and read back as null, and never is what others refer to unless
it is alone; rows that repeat the largest page_id of a group are all responses;
an empty table has no archives; other columns are not read. A url's control
characters are percent-encoded and a null url has no field.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Workspace, bounded, filesystem, scratch, written

#: What writes an intermediate table.
Store = Callable[[DataFrame, str], DataFrame]

MAGIC = b"\x1f\x8b\x08"
LEAST_PAYLOAD = 1000
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20
#: What a reading task gets, in splits.
TASK_BYTES = 64 << 20
STEP = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:millrace:page:"


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes = b""
    start: int = 0
    http: dict[str, str] = field(default_factory=dict)

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def member(fields: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: str, url: str | None, html: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{ID}{page_id}>", "WARC-Date": date}
    if url is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{ID}{refers_to}>"}
    return member(fields, http + (html if refers_to is None else b""))


def headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def plan_records(pages: DataFrame, least: int = LEAST_PAYLOAD, store: Store = written) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to (null: a response).

    Only digests are grouped. Payloads that occur once need no entry, and the others' heads are broadcast if their count is within the bound, so pages are not dealt anew.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"), F.octet_length(html).alias("n"))
    heads = rows.filter(F.col("n") >= least).groupBy("payload_digest", "n").agg(F.max("page_id").alias("head"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    heads = bounded(store(heads, "heads"))
    other = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return rows.join(heads, ["payload_digest", "n"], "left").select("page_id", "url", "html", "payload_digest", F.when(other, F.col("head")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives of plan_records' rows below ``folder``; the manifest (path, n_bytes). Every attempt of a task writes under names of its own, and the manifest holds those of the accepted one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        part, k, size, out, name = TaskContext.get().partitionId(), 0, 0, None, ""
        info = member({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:millrace:part:{part}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")

        def close() -> pd.DataFrame:
            out.close()
            return pd.DataFrame({"path": [f"{folder}/{name}"], "n_bytes": [size]})

        for frame in frames:
            for page_id, url, html, digest, refers_to in frame.itertuples(index=False):
                if out is None:
                    name = f"pages-{part:06d}-{k:06d}-{uuid.uuid4().hex}.warc.gz"
                    out, size = fs.open_output_stream(f"{base}/{name}", compression=None), len(info)
                    out.write(info)
                data = page_record(page_id, url, html.encode(), digest, refers_to, date)
                out.write(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out, k = None, k + 1
        if out is not None:
            yield close()

    rows = records.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_id"), "url", "html", "payload_digest", F.col("refers_to").cast("string").alias("refers_to"))
    return written(rows.mapInPandas(run, "path string, n_bytes long"), "archives")


class Range:
    """The bytes of a file from ``start`` on, fetched in steps as they are asked for."""

    def __init__(self, file, start: int, size: int):
        self.file, self.base, self.size, self.data = file, start, size, bytearray()
        file.seek(start)

    def need(self, upto: int) -> bool:
        """Whether bytes before ``upto`` (in the file) are there, after reading them if they exist."""
        while self.base + len(self.data) < min(upto, self.size):
            if not (more := self.file.read(STEP)):
                raise EOFError(f"file ends at {self.base + len(self.data)} of {self.size} bytes")
            self.data += more
        return upto <= self.size

    def drop(self, before: int) -> None:
        if before > self.base:
            del self.data[: before - self.base]
            self.base = before

    def find(self, at: int, end: int) -> int:
        """The first gzip magic that begins in [at, end), or -1."""
        while at < end:
            self.need(min(at + STEP, end) + 2)
            found = self.data.find(MAGIC, at - self.base, min(at + STEP, end) + 2 - self.base)
            if found >= 0:
                return found + self.base
            at += STEP
            self.drop(min(at, end))
        return -1

    def inflate(self, at: int) -> tuple[Record, int] | None:
        """The record of a member at ``at`` and where the member ends; None if none begins there."""
        z, out, pos = zlib.decompressobj(31), bytearray(), at
        try:
            while not z.eof:
                self.need(pos + STEP)
                chunk = self.data[pos - self.base : pos - self.base + STEP]
                if not chunk:
                    return None
                out += z.decompress(chunk)
                pos += len(chunk)
                if len(out) >= 7 and not out.startswith(b"WARC/1."):
                    return None
        except zlib.error:
            return None
        head, blank, rest = bytes(out).partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/1.") or not blank:
            return None
        fields = headers(head)
        length = fields.get("content-length", "")
        if not length.isdigit() or int(length) > len(rest) or "warc-type" not in fields:
            return None
        block = rest[: int(length)]
        http = headers(block.partition(b"\r\n\r\n")[0]) if fields.get("content-type", "").startswith("application/http") else {}
        return Record(fields, block, at, http), pos - len(z.unused_data)


def read_range(file, size: int, start: int, end: int) -> Iterator[Record]:
    """The records whose members start in [start, end)."""
    source, at = Range(file, start, size), start
    while (at := source.find(at, end)) >= 0:
        if got := source.inflate(at):
            record, at = got
            yield record
        else:
            at += 1
        source.drop(at)


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row per response or revisit record: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, verified.

    A response's length and digest are those of the payload that was read, and verified tells whether its header agrees; a revisit has only its header's.
    """
    splits = manifest.select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))

    def number(uri: str | None) -> int | None:
        tail = (uri or "").strip("<>").removeprefix(ID)
        return int(tail) if tail.lstrip("-").isdigit() else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, size, start in frame.itertuples(index=False):
                fs, name = filesystem(path)
                rows = []
                with fs.open_input_file(name) as f:
                    for r in read_range(f, size, start, min(start + split_bytes, size)):
                        kind = r.fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        stated = r.fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "response":
                            n, digest = len(r.payload), hashlib.sha1(r.payload).hexdigest()
                        else:
                            n, digest = int(r.http.get("content-length", 0)), stated
                        rows.append((number(r.fields.get("warc-record-id")), n, digest, kind, number(r.fields.get("warc-refers-to")), r.fields.get("warc-target-uri"), digest == stated))
                frame_out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "verified"])
                yield frame_out.astype({"page_id": "Int64", "refers_to": "Int64"})

    n_bytes = manifest.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, verified boolean"
    return splits.repartition(tasks, "path", "start").mapInPandas(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages as archives and reads them back; a record whose payload is not what its header says fails the job."""
    with Workspace(pages.sparkSession) as work:
        manifest = write_archives(plan_records(pages, store=work.written), scratch(pages.sparkSession, "warc"))
    damaged = F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    read = read_archives(manifest).withColumn("payload_digest", F.when(F.col("verified"), F.col("payload_digest")).otherwise(damaged))
    return read.drop("target_uri", "verified")
