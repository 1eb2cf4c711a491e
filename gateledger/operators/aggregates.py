"""Counts and summaries. Every grouping here combines before its shuffle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger.functions.answers import VERDICTS
from gateledger.operators.scan import HOT_ROWS
from gateledger.operators.windows import attempt_rank


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def attempt_counts(gates: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts per gate, 0 when none. Counted first, so the join is one row to one row."""
    counted = attempts.groupBy(F.col("checkpoint_id").alias("id")).agg(F.count("*").alias("n"))
    return (
        gates.select("id")
        .join(counted, "id", "left")
        .select("id", F.coalesce("n", F.lit(0)).alias("attempts"))
    )


def gates_since(gates: DataFrame, since: datetime | str) -> DataFrame:
    """All gates created at or after ``since``."""
    recent = gates.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return recent.agg(F.count("*").alias("gates"))


def gates_since_by_install(
    installations: DataFrame, repos: DataFrame, gates: DataFrame, since: datetime | str
) -> DataFrame:
    """The same per installation; one without repositories or gates counts 0."""
    per_repo = (
        gates.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
        .groupBy("repo_id")
        .agg(F.count("*").alias("n"))
    )
    owned = repos.select(F.col("id").alias("repo_id"), F.col("installation_id").alias("id"))
    per_install = per_repo.join(owned, "repo_id").groupBy("id").agg(F.sum("n").alias("n"))
    return (
        installations.select("id")
        .join(per_install, "id", "left")
        .select(F.col("id").alias("installation_id"), F.coalesce("n", F.lit(0)).alias("gates"))
    )


def gate_pass(
    attempts: DataFrame, bucket: Column | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Who cleared each gate: any one pass is enough, the first one counts.

    Gates without a pass are absent. ``attempts_to_pass`` includes the passing one.
    """
    ranked = attempt_rank(attempts, bucket, hot_rows)
    return ranked.filter("first_pass").select(
        "checkpoint_id",
        F.col("id").alias("attempt_id"),
        F.col("reviewer_login").alias("passed_by"),
        F.col("reviewer_id").alias("passed_by_id"),
        F.col("created_at").alias("passed_at"),
        F.col("attempt_no").alias("attempts_to_pass"),
    )


def grader_eval(grades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Grader confusion: an ungraded answer is never correct; a false pass is the costly error."""
    ok = F.col("pass").eqNullSafe(F.col("expected")) & ~_flag("ungraded")
    counts = grades.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("correct"),
        F.count_if(_flag("pass") & ~_flag("expected")).alias("false_pass"),
        F.count_if(~_flag("pass") & _flag("expected")).alias("false_fail"),
    )
    share = F.round(F.col("correct") * 100 / F.nullif(F.col("total"), F.lit(0)))
    return counts.withColumn("accuracy_pct", share.cast("bigint"))


def grader_kappa(grades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa of the grader against human labels; null when chance agreement is total."""
    p, e = _flag("pass"), _flag("expected")
    counts = grades.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.count_if(p & e).alias("both"),
        F.count_if(p).alias("passes"),
        F.count_if(e).alias("expects"),
    )
    n = F.col("n").cast("double")
    neither = F.col("n") - F.col("passes") - F.col("expects") + F.col("both")
    observed = (F.col("both") + neither) / n
    chance = (
        F.col("passes").cast("double") * F.col("expects")
        + (F.col("n") - F.col("passes")).cast("double") * (F.col("n") - F.col("expects"))
    ) / (n * n)
    kappa = F.when(chance < 1, (observed - chance) / (1 - chance))
    return counts.select(*(by or []), "n", F.round(kappa, 6).alias("kappa"))


def topic_record(gates: DataFrame) -> DataFrame:
    """Per person and concept: how often each verdict appeared in the closes of passed gates."""
    topics = gates.select("passed_by_id", F.explode("closeout.topics").alias("topic")).filter(
        F.col("passed_by_id").isNotNull()
    )
    return topics.groupBy("passed_by_id", F.col("topic.concept").alias("concept")).agg(
        *(F.count_if(F.col("topic.verdict") == v).alias(v) for v in VERDICTS)
    )


def subsystem_summary(local_events: DataFrame, rollup: bool = False) -> DataFrame:
    """Dev-time events per person and subsystem, optionally with subtotals."""
    group = local_events.rollup if rollup else local_events.groupBy
    return group("github_id", "subsystem").agg(
        F.count("*").alias("events"),
        *(F.count_if(_flag(c)).alias(c) for c in ("passed", "told", "assisted", "ungraded")),
    )
