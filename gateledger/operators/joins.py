"""Related rows as set-based joins. No broadcast is forced: Catalyst and AQE broadcast a side
only when its measured size is under the session's threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateledger.operators.scan import HOT_ROWS, Running, running_by_key
from gateledger.operators.windows import PR, latest_gate


def install_gates(gates: DataFrame, repos: DataFrame, installation_id: int) -> DataFrame:
    """Gates whose repository belongs to the installation."""
    own = repos.filter(F.col("installation_id") == installation_id).select(F.col("id").alias("repo_id"))
    return gates.join(own, "repo_id", "left_semi")


def comment_gate_asof(comments: DataFrame, gates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each comment with the newest gate of its pull request created at or before it.

    Gates and comments are laid out in one order and the last gate id is carried down, so no
    pair of comment and gate is ever formed. A gate at the same instant comes first.
    """
    c = comments.select(*PR, F.col("ts").alias("at"), F.lit(1).alias("side"), F.col("comment_id").cast("string").alias("key"))
    g = gates.select(*PR, F.col("created_at").alias("at"), F.lit(0).alias("side"), F.col("id").alias("key"))
    seen = running_by_key(
        c.unionByName(g),
        PR,
        ["at", "side", "key"],
        {"gate_id": Running("last", F.when(F.col("side") == 0, F.col("key")))},
        hot_rows=hot_rows,
    )
    return seen.filter("side = 1").select(
        F.col("key").alias("comment_id"), *PR, F.col("at").alias("ts"), "gate_id"
    )


def gate_attempts(gates: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every gate with its attempts; a gate without any keeps one row.

    The inner part is a join AQE can split on the attempts side when one gate is hot, which
    it could not do for a left join; the gates left over come from an anti join.
    """
    a = attempts.select(*(F.col(c).alias(f"attempt_{c}") for c in attempts.columns if c != "checkpoint_id"), F.col("checkpoint_id").alias("id"))
    matched = gates.join(a, "id")
    unmatched = gates.join(a.select("id").distinct(), "id", "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def carry_join(pushes: DataFrame, gates: DataFrame) -> DataFrame:
    """Pushes whose pull request's latest gate has passed with the same decisions."""
    latest = latest_gate(gates).select(
        *PR,
        F.col("id").alias("gate_id"),
        F.col("status").alias("gate_status"),
        F.col("decisions_hash"),
    )
    passed = latest.filter(F.col("gate_status") == "passed").drop("gate_status")
    return pushes.join(passed, [*PR, "decisions_hash"])


def ruleset_gap(install_repos: DataFrame, rulesets: DataFrame, managed_name: str) -> DataFrame:
    """Installed repositories that still lack the managed ruleset."""
    covered = rulesets.filter(F.col("name") == managed_name).select("owner", "repo")
    return install_repos.join(covered, ["owner", "repo"], "left_anti").select("owner", "repo").distinct()
