"""What the operators of this package share: tables, texts, the shared folder, splits of work."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.operators.scan import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
TASK_ROWS = 1 << 16  # of a narrow table
PORTION = 1 << 20  # characters or bytes that a Python worker works on at once


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no earlier step."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def sized(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` in as many tasks as ``n_rows`` narrow rows are worth, never in more than it has.

    A shuffle leaves files for each of its tasks, so steps over little data that run in many tasks cost
    disk and time that no row accounts for.
    """
    return df.coalesce(max(1, math.ceil(n_rows / TASK_ROWS)))


def give_back() -> None:
    """What a Python worker no longer uses goes back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def portions(batch: pa.Array) -> Iterator[pa.Array]:
    """Neighbours of together about PORTION bytes, or one longer value by itself."""
    start = total = 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(batch), 0).to_pylist()):
        if k > start and total + size > PORTION:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += size
    if len(batch):
        yield batch.slice(start)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over the batches of a task, after which its memory is given back."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


def numbered(df: DataFrame, *order: Column, into: str = "rank") -> DataFrame:
    """Adds the place of each row in a global order, from 0, without bringing the rows together.

    Rows are dealt by ranges of the order; only the row count of each range meets in one task.
    """
    from pyspark.sql import Window

    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(starts, "_range").withColumn(into, F.col("_start") + place).drop("_range", "_start")


def blocks_for(texts: DataFrame, text: str = "text", block_bytes: int = 16 << 20) -> int:
    """How many blocks of about ``block_bytes`` the texts make; a single sum over the column."""
    total = texts.agg(F.sum(F.octet_length(text))).head()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def set_aside(docs: DataFrame, replaced: str) -> tuple[list[Column], list[Column]]:
    """Columns of ``docs`` under names that clash with nothing, and how to name them back.

    The column called ``replaced`` is left out.
    """
    kept = [c for c in docs.columns if c != replaced]
    away = [F.col(f"`{c}`").alias(f"_own{k}") for k, c in enumerate(kept)]
    return away, [F.col(f"_own{k}").alias(c) for k, c in enumerate(kept)]


def with_both(docs: DataFrame, both: Column, into: str, back: str) -> DataFrame:
    """``docs`` with the fields of ``both`` (ids, back) as the columns ``into`` and ``back``, which are replaced if there."""
    name = "_both"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (into, back)]
    return docs.withColumn(name, both).select(*kept, F.col(f"{name}.ids").alias(into), F.col(f"{name}.back").alias(back))
