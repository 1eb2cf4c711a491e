"""Per-key order: latest and open gates, attempt ranks, cumulative text, runs, trailing counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger.operators.scan import (
    HOT_ROWS,
    Running,
    hour_of,
    pick_per_key,
    running,
    running_by_key,
    split_hot,
)

PR = ["repo_id", "pr_number"]
ATTEMPT_ORDER = ["created_at", "id"]


def latest_gate(gates: DataFrame) -> DataFrame:
    """Newest gate of each pull request, whatever its status."""
    return pick_per_key(gates, PR, [F.desc("created_at"), F.desc("id")])


def open_gate(gates: DataFrame) -> DataFrame:
    """Newest pending gate of each pull request."""
    return latest_gate(gates.filter(F.col("status") == "pending"))


def attempt_rank(
    attempts: DataFrame, bucket: Column | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Number each gate's attempts and mark the first pass.

    ``passed_so_far`` counts passes up to and including the row.
    """
    passed = F.coalesce(F.col("grade_pass"), F.lit(False)).cast("bigint")
    ranked = running_by_key(
        attempts,
        ["checkpoint_id"],
        ATTEMPT_ORDER,
        {"attempt_no": Running("count", F.lit(1)), "passed_so_far": Running("sum", passed)},
        bucket,
        hot_rows,
    )
    first = F.coalesce(F.col("grade_pass"), F.lit(False)) & (F.col("passed_so_far") == 1)
    return ranked.withColumn("first_pass", first)


def explanations_in_order(
    attempts: DataFrame, bucket: Column | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Explanations of each gate, oldest first, by every reviewer: one row per position.

    A row set, not an array: one gate's explanations never have to fit in one row.
    """
    narrow = attempts.select("checkpoint_id", "created_at", "id", "explanation")
    placed = running_by_key(
        narrow,
        ["checkpoint_id"],
        ATTEMPT_ORDER,
        {"position": Running("count", F.lit(1))},
        bucket,
        hot_rows,
    )
    return placed.select("checkpoint_id", "position", "explanation")


def explanation_places(attempts: DataFrame, bucket: Column | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``position``: what an attempt was graded on are the explanations of its gate up to this place.

    Texts are stored once, by :func:`explanations_in_order`, and an attempt refers to (gate, position), so
    memory and disk grow with the texts of a gate, not with their square.
    """
    narrow = attempts.drop("explanation")
    return running_by_key(narrow, ["checkpoint_id"], ATTEMPT_ORDER, {"position": Running("count", F.lit(1))}, bucket, hot_rows)


def told_at(requested: DataFrame, texts: DataFrame) -> DataFrame:
    """Add ``cumulative`` to references (checkpoint_id, position, ...), the text told up to each of them.

    ``texts``: checkpoint_id, position, explanation. Only texts of requested gates, up to the last place
    asked for, are shuffled; equal references are built once. Null if nothing was told.
    """
    place = ["checkpoint_id", "position"]
    asked = requested.select(*place).dropna().distinct()
    upto = asked.groupBy("checkpoint_id").agg(F.max("position").alias("__upto"))
    needed = texts.join(upto, "checkpoint_id").filter("position <= __upto AND explanation IS NOT NULL")
    pieces = needed.select("checkpoint_id", F.col("position").alias("__at"), "explanation")
    listed = F.array_sort(F.collect_list(F.struct("__at", "explanation")))
    told = F.array_join(F.transform(listed, lambda r: r["explanation"]), "\n\n")
    built = asked.join(pieces, "checkpoint_id").filter("__at <= position").groupBy(*place).agg(F.nullif(told, F.lit("")).alias("cumulative"))
    return requested.join(built, place, "left").select(*requested.columns, "cumulative")


def cumulative_explanation(
    attempts: DataFrame,
    bucket: Column | None = None,
    hot_rows: int = HOT_ROWS,
    by_reviewer: bool = False,
) -> DataFrame:
    """Add ``cumulative``, the text graded at each attempt: all earlier explanations and this one.

    On a hot gate, earlier buckets arrive as one ready-made prefix per bucket.
    """
    keys = ["checkpoint_id", "reviewer_id"] if by_reviewer else ["checkpoint_id"]
    return running_by_key(
        attempts, keys, ATTEMPT_ORDER, {"cumulative": Running("text", F.col("explanation"))}, bucket, hot_rows
    )


def gate_islands(pushes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number the runs of equal ``decisions_hash`` among a pull request's pushes (``island`` from 1)."""

    def run(part: DataFrame, hot: bool) -> DataFrame:
        bucket = hour_of("ts") if hot else None
        seen = running(
            part,
            PR,
            ["ts", "delivery_id"],
            {"__previous": Running("last", F.col("decisions_hash"), before=True)},
            bucket,
        )
        starts = (~F.col("__previous").eqNullSafe(F.col("decisions_hash"))).cast("bigint")
        return running(
            seen, PR, ["ts", "delivery_id"], {"island": Running("sum", starts)}, bucket
        ).drop("__previous")

    return split_hot(pushes, PR, run, hot_rows)


def rolling_gate_counts(
    gates: DataFrame, hours: int = 24, hot_rows: int = HOT_ROWS, bucket_unit: str = "hour"
) -> DataFrame:
    """How many earlier gates fell in the trailing window, per installation and in all.

    Of gates of the same instant, those with a smaller id are the earlier ones. Each gate adds
    one at its time and takes one away just after it leaves the window (a gate exactly ``hours``
    old still counts), so both counts are running sums. The count over all gates has no key; it is
    bucketed by time and never gathers in one task.
    """
    steps = gates.select(
        "id",
        "installation_id",
        F.explode(
            F.array(
                F.struct(
                    F.col("created_at").alias("at"), F.lit(0).alias("leaves"), F.lit(1).alias("step")
                ),
                F.struct(
                    (F.col("created_at") + F.expr(f"INTERVAL {hours} HOURS")).alias("at"),
                    F.lit(1).alias("leaves"),
                    F.lit(-1).alias("step"),
                ),
            )
        ).alias("s"),
    ).select("id", "installation_id", "s.*", F.lit(0).alias("__all"))
    order = ["at", "leaves", "id"]
    values = {"installation_before": Running("sum", F.col("step"), before=True)}
    per_install = running_by_key(steps, ["installation_id"], order, values, None, hot_rows)
    both = running(
        per_install,
        ["__all"],
        order,
        {"global_before": Running("sum", F.col("step"), before=True)},
        F.date_trunc(bucket_unit, F.col("at")),
    )
    return both.filter("leaves = 0").select(
        "id",
        "installation_id",
        F.col("at").alias("created_at"),
        F.coalesce("installation_before", F.lit(0)).cast("bigint").alias("installation_before"),
        F.coalesce("global_before", F.lit(0)).cast("bigint").alias("global_before"),
    )


def newest_gate(gates: DataFrame) -> DataFrame:
    """The one newest gate of all; each task keeps only its own newest."""
    return gates.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def attempts_oldest_first(attempts: DataFrame) -> DataFrame:
    """Attempts in time order, range-partitioned."""
    return attempts.orderBy(*ATTEMPT_ORDER)
