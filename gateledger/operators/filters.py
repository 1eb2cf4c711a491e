"""Routing, predicates and the trivial-change classifier."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger.functions import diffs
from gateledger.functions.text import js_length, js_trim
from gateledger.operators.windows import latest_gate

# Subscribed actions per kind, and who may answer.
ROUTES = {
    "install": ["created", "added"],
    "opened": ["opened", "ready_for_review"],
    "synchronize": ["synchronize"],
    "comment": ["created"],
}
REVIEWER_ASSOCIATIONS = ["OWNER", "MEMBER", "COLLABORATOR"]
MIN_EXPLANATION_CHARS = 40

# Metadata of dev-time events that may leave a machine: never source text or raw explanations.
FORWARDED = [
    "id", "github_id", "github_login", "email", "session_id", "subsystem", "concept", "stage", "rigor",
    "assisted", "told", "passed", "ungraded", "scores", "overlap", "attempts", "repo", "created_at",
]


def route(events: DataFrame, kind: str) -> DataFrame:
    """Events that one of the four listeners subscribes to: install, opened, synchronize, comment."""
    stored = "pull_request" if kind in ("opened", "synchronize") else kind
    return events.filter((F.col("kind") == stored) & F.col("action").isin(ROUTES[kind]))


def not_draft(events: DataFrame) -> DataFrame:
    return events.filter(~F.coalesce(F.col("draft"), F.lit(False)))


def is_explanation() -> Column:
    """On a pull request, by a person with review standing, and longer than a nod."""
    body = F.coalesce(F.col("body"), F.lit(""))
    return (
        F.coalesce(F.col("is_pr"), F.lit(False))
        & ~F.col("user_type").eqNullSafe("Bot")
        & F.col("author_association").isin(REVIEWER_ASSOCIATIONS)
        & (js_length(js_trim(body)) >= MIN_EXPLANATION_CHARS)
    )


def eligible_comments(events: DataFrame) -> DataFrame:
    return events.filter(is_explanation())


def gate_by_id(gates: DataFrame, gate_id: str) -> DataFrame:
    return gates.filter(F.col("id") == gate_id)


def select_gates(
    gates: DataFrame,
    columns: list[str] | None = None,
    since: datetime | str | None = None,
    repo_ids: list[int] | None = None,
    **equal: object,
) -> DataFrame:
    """The store's predicates: equality, ``created_at >= since``, an id list, a column list."""
    for name, value in equal.items():
        gates = gates.filter(F.col(name) == F.lit(value))
    if since is not None:
        gates = gates.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if repo_ids is not None:
        gates = gates.filter(F.col("repo_id").isin(repo_ids))
    return gates.select(*columns) if columns else gates


def path_flags(files: DataFrame, path: str = "file") -> DataFrame:
    return files.withColumns(
        {
            "is_trivial": diffs.is_trivial_path(F.col(path)),
            "is_generated": diffs.is_generated_path(F.col(path)),
        }
    )


def changed_lines(prs: DataFrame, diff: str = "diff") -> DataFrame:
    return prs.withColumns(
        {"added": diffs.added_lines(F.col(diff)), "removed": diffs.removed_lines(F.col(diff))}
    )


def classify_prs(prs: DataFrame) -> DataFrame:
    """Add ``trivial`` and ``reason``; one pass over the rows, no shuffle.

    The two counts are columns of their own so that each text is scanned once.
    """
    counted = prs.withColumns(
        {
            "__files": diffs.meaningful_files(F.col("files")),
            "__lines": diffs.added_lines(F.col("diff")) + diffs.removed_lines(F.col("diff")),
        }
    )
    found = diffs.classification(F.col("files"), F.col("__files"), F.col("__lines"))
    return (
        counted.withColumn("__class", found)
        .withColumns({"trivial": F.col("__class.trivial"), "reason": F.col("__class.reason")})
        .drop("__class", "__files", "__lines")
    )


def dedupe_heads(prs: DataFrame, gates: DataFrame) -> DataFrame:
    """Drop an opened pull request whose head the latest gate already covers."""
    latest = latest_gate(gates).select("repo_id", "pr_number", F.col("head_sha").alias("__latest_head"))
    return (
        prs.join(latest, ["repo_id", "pr_number"], "left")
        .filter(~F.col("__latest_head").eqNullSafe(F.col("head_sha")))
        .drop("__latest_head")
    )


def forward_metadata(local_events: DataFrame) -> DataFrame:
    return local_events.select(*(c for c in FORWARDED if c in local_events.columns))
