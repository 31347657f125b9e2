"""Archives: what is read back is what was written, wherever the splits fall."""

import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import types as T

from millrace.llm import runtime, warc
from millrace.llm.runtime import scratch

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("n", T.LongType())])


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(2)


def brute(rows):
    out = []
    for i, _, h in rows:
        payload = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        head = max(same, default=None) if len(payload) >= 1000 else None
        other = head is not None and head != i
        out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if other else "response", head if other else None))
    return sorted(out, key=repr)


def test_round_trip_with_revisits(pages):
    big, odd = "<p>é " * 400, "q" * 999
    rows = [(1, "http://a/", big), (5, "http://b/", big), (3, None, big), (None, "http://c/", big), (7, "bad\r\nurl x", odd), (8, "", odd), (9, "u", None), (10, "u", ""), (11, "u", "z" * 1000), (12, "v", "WARC/1.1\r\n\r\n" * 300), (5, "http://b/", big)]
    got = sorted((tuple(r) for r in warc.round_trip(pages(rows)).collect()), key=repr)
    assert got == brute(rows)
    assert warc.round_trip(pages([])).count() == 0


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
def test_every_record_is_owned_once_whatever_the_splits(spark, pages, split):
    rows = [(i, f"http://h/{i}", f"<p>{i} " * (i * 37 % 400)) for i in range(60)]
    manifest = warc.write_archives(warc.plan_records(pages(rows)), scratch(spark, "warc-test"))
    got = warc.read_archives(manifest, split).collect()
    assert sorted(r.page_id for r in got) == list(range(60)) and all(r.verified for r in got)


def test_damage_is_seen(spark, pages, monkeypatch):
    fields = {"WARC-Type": "response", "WARC-Record-ID": f"<{warc.ID}4>", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{hashlib.sha1(b'x').hexdigest()}"}
    folder = scratch(spark, "warc-test").removeprefix("file://")
    os.makedirs(folder)
    data = warc.member(fields, b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\ny")
    with open(f"{folder}/a.warc.gz", "wb") as f:
        f.write(data)
    manifest = spark.createDataFrame([(f"file://{folder}/a.warc.gz", len(data))], "path string, n_bytes long")
    [r] = warc.read_archives(manifest).collect()
    assert not r.verified and r.payload_digest == hashlib.sha1(b"y").hexdigest()
    monkeypatch.setattr(warc, "write_archives", lambda *_: manifest)
    with pytest.raises(Exception, match="damaged record of page 4"):
        warc.round_trip(pages([(1, "u", "x")])).collect()


def test_heads_beyond_the_bound_are_joined(pages, monkeypatch):
    monkeypatch.setattr(warc, "bounded", lambda df: runtime.bounded(df, 0))
    rows = [(i, "u", "z" * (1000 + i % 3)) for i in range(12)]
    assert sorted((tuple(r) for r in warc.round_trip(pages(rows)).collect()), key=repr) == brute(rows)


def test_reader_rejects_false_magic_and_reads_plain_gzip(tmp_path):
    junk = warc.MAGIC + b"\x00" * 40 + warc.MAGIC
    records = [warc.page_record(str(i), f"http://x/{i}", b"<b>%d</b>" % i, hashlib.sha1(b"<b>%d</b>" % i).hexdigest(), None, "2024-01-01T00:00:00Z") for i in range(3)]
    data = junk + records[0] + gzip.compress(b"not a record") + records[1] + junk + records[2]
    got = list(warc.read_range(io.BytesIO(data), len(data), 0, len(data)))
    assert [r.payload for r in got] == [b"<b>0</b>", b"<b>1</b>", b"<b>2</b>"]
    assert gzip.decompress(records[0]).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    cut = data[: len(data) - 5]
    assert len(list(warc.read_range(io.BytesIO(cut), len(cut), 0, len(cut)))) == 2  # a member that is cut short is no record
