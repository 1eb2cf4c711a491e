"""Outward actions of the gate as rows, one per check change or comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger.functions import replies
from gateledger.schemas import CLOSEOUT

# What each outcome does to the check (call, status, conclusion, title).
# A failed grade changes no check; a duplicate or an ignored comment does nothing at all.
CHECKS = {
    "trivial": ("create_check", "completed", "success", "Trivial — no comprehension needed"),
    "capped": ("create_check", "completed", "neutral", "Review-gate beta limit"),
    "gated": ("create_check", "in_progress", None, "Explain to merge"),
    "carried": ("create_check", "completed", "success", "Comprehension carried forward"),
    "ungraded": ("update_check", "completed", "neutral", "Grader unavailable"),
    "passed": ("update_check", "completed", "success", "Comprehension passed"),
}
PENDING_SUMMARY = "Answer the gate's comment with an explanation of the mechanism."
CARRIED_SUMMARY = "The decisions are the same as those explained in the passing answer."


def action_outbox(transitions: DataFrame) -> DataFrame:
    """Actions of each transition; ``action_id`` is stable, so a replayed batch writes the same rows.

    A ``closeout`` column, where present, enriches the reply to a pass.
    """
    outcome = F.col("outcome")
    note = F.coalesce(F.nullif(F.col("grade.note"), F.lit("")), F.lit("grader unavailable"))
    summaries = {
        "trivial": F.col("reason"),
        "capped": F.concat(F.col("capped"), F.lit(" daily beta limit reached")),
        "gated": F.lit(PENDING_SUMMARY),
        "carried": F.lit(CARRIED_SUMMARY),
        "ungraded": note,
        "passed": F.concat(F.lit("Explained by @"), F.col("user_login"), F.lit(".")),
    }
    close = F.col("closeout") if "closeout" in transitions.columns else F.lit(None).cast(CLOSEOUT)
    bodies = {
        "capped": replies.capped_body(F.col("capped")),
        "gated": replies.elicit_body(F.col("decisions")),
        "ungraded": replies.ungraded_body(note),
        "passed": replies.pass_body(F.col("user_login"), close),
        "failed": replies.rescue_body(F.col("grade.hole")),
    }
    null = F.lit(None).cast("string")

    def action(kind, status=null, conclusion=null, title=null, summary=null, body=null) -> Column:
        values = dict(kind=kind, status=status, conclusion=conclusion, title=title, summary=summary, body=body)
        return F.struct(*(v.alias(n) for n, v in values.items()))

    check = F.lit(None)
    for name, (kind, status, conclusion, title) in CHECKS.items():
        fixed = [F.lit(v).cast("string") for v in (kind, status, conclusion, title)]
        check = F.when(outcome == name, action(*fixed, summary=summaries[name])).otherwise(check)
    comment = F.lit(None)
    for name, body in bodies.items():
        comment = F.when(outcome == name, action(F.lit("comment"), body=body)).otherwise(comment)

    acting = transitions.filter(outcome.isin(*{*CHECKS, *bodies}))
    actions = acting.select(
        "delivery_id", "ts", "repo_id", "pr_number", "gate_id", "head_sha", outcome,
        F.posexplode(F.array(check, comment)).alias("part", "a"),
    ).filter(F.col("a").isNotNull())
    return actions.select(
        F.concat_ws(":", "delivery_id", F.col("a.kind")).alias("action_id"),
        "delivery_id", "ts", "repo_id", "pr_number", "gate_id", "head_sha", "outcome", "a.*",
    )
