"""What the corpus operators share: tables, shared folders, words.

Executors can be lost and do not share local folders, so whatever one job
leaves for another goes below the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_FOLD = str.maketrans(UPPER, LOWER)
#: A word is a run of ASCII letters, digits and anything beyond ASCII ...
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ITEM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ... or a run of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


#: Bytes that are broadcast at most, counted as BYTES_A_FIELD for each field and the length of each string.
BROADCAST_BYTES, BYTES_A_FIELD = 32 << 20, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session in one JVM may do without the setting; it gets a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/millrace/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: ``df`` as a Parquet table in the shared folder."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table of numbers and strings, hinted for broadcast if its size is within the bound; else joined as Spark sees fit."""
    strings = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    rows, *lengths = df.agg(F.count("*"), *strings).first()
    return F.broadcast(df) if rows * BYTES_A_FIELD * len(df.columns) + sum(lengths) <= most else df


def discard(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Deletes a table that :func:`written` made, once nothing will read it again."""
    paths = [df_or_path] if isinstance(df_or_path, str) else {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Workspace:
    """Tables written on the way to a result; all go when it is left. As a context manager around the job that reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        path = scratch(self.spark, tag)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            discard(self.spark, path)


def release() -> None:
    """Gives freed memory back to the system. Workers are kept from task to task, and what their allocators hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function over batches that leaves no freed memory behind."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI, and the path in it; for tasks that write or seek in files."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; JVM-side. Pure ASCII takes the fast byte path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting."""
    out = np.sort(values)
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    return out[new]


def codepoints(texts: Iterable[str], pad: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, each text after ``pad`` fillers; and where each text's part begins (and the end)."""
    lead = chr(fill) * pad
    parts = [lead + t for t in texts]
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), ends
