"""The pricing summary against DuckDB, as a batch and as a stream."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import PRICING_SQL, SHIPPED_UNTIL, pricing
from millrace.streaming import pricing_summary_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def expected():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    return sorted(con.sql(PRICING_SQL).fetchall())


def test_pricing_summary_matches_sql(spark, expected):
    assert sorted(map(tuple, pricing(spark, SF).collect())) == expected


def test_scan_reads_seven_columns_and_pushes_the_filter_down(spark):
    plan = pricing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x)
    assert "l_shipdate" in scan.split("PushedFilters")[1] and "l_partkey" not in scan


def test_stream_ends_with_the_batch_result(spark, expected, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.repartition(3).write.parquet(str(tmp_path / "lines"))
    query = pricing_summary_stream(spark, str(tmp_path / "lines"), SHIPPED_UNTIL).writeStream.outputMode("complete").format("memory").queryName("pricing_stream").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        assert sorted(map(tuple, spark.table("pricing_stream").collect())) == expected
    finally:
        query.stop()


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["ahocorasick", "millrace.llm", "corpus_pipeline"])
def test_entry_imports_without_the_corpus_operators_or_a_library_of_theirs(missing):
    """A missing library costs the queries that need it and no others."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; assert list(e.queries()) == ['pricing_summary'] == list(e.oracle_sql())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
