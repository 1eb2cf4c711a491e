"""Queries against their SQL on events that happen at the same instant."""

import __spark_entry__ as driver
from pyspark.sql import functions as F

import pytest

SF_DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Every event three times, with ids of its own and the time it had."""
    folder = str(tmp_path_factory.mktemp("tied"))
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    copies = events.crossJoin(spark.range(3).withColumnRenamed("id", "__copy"))
    copies.withColumn("event_id", F.col("event_id") + 100_000 * F.col("__copy")).drop("__copy").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def test_rolling_gate_counts_break_ties_by_id(spark, tied):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tied}/events.parquet/*.parquet'")
    result = con.execute(driver.oracle_sql()["rolling_gate_counts"])
    names = [d[0] for d in result.description]
    got = driver.queries()["rolling_gate_counts"](spark, tied).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())
