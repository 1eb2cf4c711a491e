"""Data jobs the design documents describe: path rules, recall, approvals, per-reviewer threads."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger.operators.overlap import overlap_band

GLOB = re.compile(r"\*\*/|\*\*|\*|\?|[^*?]+")
GLOB_PARTS = {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def any_glob(path: Column, globs: Sequence[str]) -> Column:
    """Whether a path matches one of the globs; they become one regular expression at plan time."""
    patterns = ("".join(GLOB_PARTS.get(p, re.escape(p)) for p in GLOB.findall(g)) for g in globs)
    return path.rlike(r"\A(" + "|".join(patterns) + r")\z") if globs else F.lit(False)


def path_policy(prs: DataFrame, paths: Sequence[str] = (), skip_paths: Sequence[str] = ()) -> DataFrame:
    """Add ``gate_by_path``: some file is on the allow list (all are, without one) and not skipped."""

    def counts(f: Column) -> Column:
        allowed = any_glob(f, paths) if paths else F.lit(True)
        return allowed & ~any_glob(f, skip_paths)

    return prs.withColumn("gate_by_path", F.coalesce(F.exists("files", counts), F.lit(False)))


def path_rigor(prs: DataFrame, harsh_paths: Sequence[str]) -> DataFrame:
    """Add ``rigor``: harsh when any file lies on a harsh path, else medium."""
    harsh = F.coalesce(F.exists("files", lambda f: any_glob(f, harsh_paths)), F.lit(False))
    return prs.withColumn("rigor", F.when(harsh, "harsh").otherwise("medium"))


def recall_due(gates: DataFrame, now: datetime | str, interval: str | None = None) -> DataFrame:
    """Passed gates due for recall. ``interval`` (such as ``"21 days"``) dates those without a due time."""
    due = F.col("next_recall_due")
    if interval is not None:
        due = F.coalesce(due, F.col("passed_at") + F.expr(f"INTERVAL {interval}"))
    return gates.filter((F.col("status") == "passed") & (due <= F.lit(now).cast("timestamp")))


def ai_comment_overlap(
    explanations: DataFrame, sources: DataFrame, ai_comments: DataFrame, **options: object
) -> DataFrame:
    """``overlap_band`` with AI reviewers' comments counted among the sources."""
    return overlap_band(explanations, sources.unionByName(ai_comments), **options)


def approver_mismatch(gates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Approvals (repo_id, pr_number, user_id) by someone who did not pass that pull request's gate."""
    passed = gates.filter("status = 'passed'").select(
        "repo_id", "pr_number", F.col("passed_by_id").alias("user_id")
    )
    return reviews.join(passed.distinct(), ["repo_id", "pr_number", "user_id"], "left_anti")


def thread_state(attempts: DataFrame) -> DataFrame:
    """State per gate and reviewer: attempts, whether passed, the hole last pointed out."""
    place = F.struct("created_at", "id")
    return attempts.groupBy("checkpoint_id", "reviewer_id").agg(
        F.count("*").alias("attempts"),
        F.max(F.coalesce("grade_pass", F.lit(False))).alias("passed"),
        F.max_by("hole", F.when(F.col("hole").isNotNull(), place)).alias("last_hole"),
    )
