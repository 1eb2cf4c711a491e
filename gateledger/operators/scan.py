"""Ordered running values that survive a hot key.

A plain window sorts each key in one task. That is the best plan while every key is small:
all running values of a step share one shuffle and one sort. A key that holds a large share
of the rows would leave one task with all of them, so keys above ``HOT_ROWS`` take a second
plan: rows are windowed per (key, bucket), where the bucket grows with the order; each
bucket's total is computed with map-side combine; totals are windowed per key (one row per
bucket); and each row adds the total of the buckets before its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000  # rows of one key that a single task sorts comfortably
BUCKET = "__bucket"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir or the context names; there is no other."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder so that several readers do not recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same as a table in the checkpoint folder. Unlike a checkpoint, which keeps the size that its plan
    was estimated at, it has the size it has: estimates do not grow from round to round of a loop."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Running:
    """A running value: ``sum``, ``count``, ``min``, ``max`` or ``last`` (non-null) of a column,
    or ``text``, the strings so far joined by a blank line."""

    kind: str
    value: Column
    before: bool = False  # leave out the current row

    def over(self, window) -> Column:
        if self.kind == "last":
            return F.last(self.value, ignorenulls=True).over(window)
        if self.kind == "text":
            return F.nullif(F.array_join(F.collect_list(self.value).over(window), "\n\n"), F.lit(""))
        return getattr(F, self.kind)(self.value).over(window)

    def total(self, order: Sequence[str]) -> Column:
        place = F.struct(*order)
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), place))
        if self.kind == "text":
            rows = F.array_sort(F.collect_list(F.struct(*order, self.value.alias("__text"))))
            return F.nullif(F.array_join(F.transform(rows, lambda r: r["__text"]), "\n\n"), F.lit(""))
        return getattr(F, self.kind)(self.value)

    def carried(self, total: Column, window) -> Column:
        """Prefix over bucket totals: counts add up, the rest combine as they are."""
        kind = "sum" if self.kind == "count" else self.kind
        return Running(kind, total).over(window)

    def join(self, prefix: Column, local: Column) -> Column:
        if self.kind in ("sum", "count"):
            zero = F.lit(0)
            both = F.coalesce(prefix, zero) + F.coalesce(local, zero)
            return both if self.kind == "count" else F.when(prefix.isNotNull() | local.isNotNull(), both)
        if self.kind == "min":
            return F.least(prefix, local)
        if self.kind == "max":
            return F.greatest(prefix, local)
        if self.kind == "text":
            return F.nullif(F.concat_ws("\n\n", prefix, local), F.lit(""))
        return F.coalesce(local, prefix)


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, null being equal to null; the columns of ``on`` come from ``left``."""
    renamed = right.withColumnsRenamed({c: f"__on_{c}" for c in on})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on))
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"__on_{c}" for c in on))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Running],
    bucket: Column | None = None,
    materialize: bool = True,
) -> DataFrame:
    """Add running ``values`` per ``keys`` in ``order`` (a total order of ROWS, no peers).

    With ``bucket`` (any column that never falls as the order rises) no task ever holds more
    than one bucket of a key. Null keys are one key, a null bucket comes first as a null order does.
    ``materialize=False`` skips the
    checkpoint where ``df`` is a bare scan that is cheap to read twice.
    """

    def frames(part: Sequence[str]):
        w = Window.partitionBy(*part).orderBy(*order)
        return (
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow),
            w.rowsBetween(Window.unboundedPreceding, -1),
        )

    if bucket is None:
        upto, before = frames(keys)
        return df.withColumns({n: v.over(before if v.before else upto) for n, v in values.items()})

    df = df.withColumn(BUCKET, bucket)
    if materialize:
        df = cut(df)
    part = [*keys, BUCKET]
    totals = df.groupBy(*part).agg(*(v.total(order).alias(f"__total_{n}") for n, v in values.items()))
    ahead = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(
        *part,
        *(v.carried(F.col(f"__total_{n}"), ahead).alias(f"__ahead_{n}") for n, v in values.items()),
    )
    upto, before = frames(part)
    local = df.withColumns(
        {f"__local_{n}": v.over(before if v.before else upto) for n, v in values.items()}
    )
    joined = join_null_safe(local, prefix, part)
    drop = [BUCKET, *(f"__{side}_{n}" for side in ("local", "ahead") for n in values)]
    return joined.withColumns(
        {n: v.join(F.col(f"__ahead_{n}"), F.col(f"__local_{n}")) for n, v in values.items()}
    ).drop(*drop)


Run = Callable[[DataFrame, bool], DataFrame]


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, or None, as usual.

    Counted with map-side combine over the key columns alone; at most ``rows / hot_rows`` keys.
    """
    hot = cut(df.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys))
    return None if hot.isEmpty() else hot


def run_split(df: DataFrame, keys: Sequence[str], hot: DataFrame | None, run: Run) -> DataFrame:
    """``run(rows of other keys, False)`` together with ``run(rows of hot keys, True)``."""
    if hot is None:
        return run(df, False)
    cold_part = run(join_null_safe(df, hot, keys, "left_anti"), False)
    return cold_part.unionByName(run(join_null_safe(df, hot, keys, "left_semi"), True))


def split_hot(df: DataFrame, keys: Sequence[str], run: Run, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``run_split`` with the hot keys of ``df`` itself."""
    return run_split(df, keys, hot_keys(df, keys, hot_rows), run)


def hour_of(ts: str) -> Column:
    """Default bucket for rows ordered by a timestamp."""
    return F.date_trunc("hour", F.col(ts))


def running_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Running],
    bucket: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``running`` with hot keys split off; the first order column is a timestamp unless ``bucket`` is given."""
    bucket = hour_of(order[0]) if bucket is None else bucket
    return split_hot(
        df,
        keys,
        lambda part, hot: running(part, keys, order, values, bucket if hot else None),
        hot_rows,
    )


def pick_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key. Spark limits each key to one row before the shuffle, so a hot key
    sends at most one row per task."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


SALTS = 64


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows per key.

    Spark cuts each key to ``n`` rows before the shuffle while ``n`` is under its own threshold;
    beyond that, rows are first cut per (key, salt) so that a hot key is never in one task.
    """

    def cut_to(rows: DataFrame, part: Sequence[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        return rows.withColumn("__n", place).filter(F.col("__n") <= n).drop("__n")

    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        df = cut_to(salted, [*keys, "__salt"]).drop("__salt")
    return cut_to(df, keys)
