"""Writes of the gate store as set operations: upsert, pass, head move, cascading delete, schema drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gateledger.operators.scan import pick_per_key


def upsert_latest(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Base rows with the last change per key applied.

    Columns the changes carry overwrite, even with null; columns they lack keep their value.
    ``order`` columns that the base does not have are dropped. Both sides have one row per key
    when they meet, so a hot key costs one row.
    """
    last = pick_per_key(changes, keys, [F.desc(c) for c in order])
    provided = [c for c in changes.columns if c in base.columns and c not in keys]
    new = last.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in provided), F.lit(True).alias("__hit"))
    joined = base.join(new, list(keys), "full_outer")
    return joined.select(
        *(
            F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
            if c in provided
            else F.col(c)
            for c in base.columns
        )
    )


def _update(gates: DataFrame, changes: DataFrame, values: dict[str, str]) -> DataFrame:
    """Set gate columns from the change row of the same id, where there is one."""
    hit = changes.select(F.col("gate_id").alias("id"), F.lit(True).alias("__hit"), *(F.col(s).alias(f"__{t}") for t, s in values.items()))
    joined = gates.join(hit, "id", "left")
    return joined.select(
        *(
            F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in gates.columns
        )
    )


def apply_passes(gates: DataFrame, passes: DataFrame) -> DataFrame:
    """Mark gates passed (gate_id, passed_by, passed_by_id, passed_at, optional closeout).

    The last pass per gate wins. The close is applied only where the gate table has the column
    and the passes carry one: its absence never fails the pass itself.
    """
    last = pick_per_key(passes, ["gate_id"], [F.desc("passed_at"), F.desc("passed_by_id")])
    last = last.withColumn("__status", F.lit("passed"))
    values = {
        "status": "__status",
        "passed_by": "passed_by",
        "passed_by_id": "passed_by_id",
        "passed_at": "passed_at",
        "updated_at": "passed_at",
    }
    if "closeout" in gates.columns and "closeout" in passes.columns:
        values["closeout"] = "closeout"
    return _update(gates, last, {t: s for t, s in values.items() if t in gates.columns})


def apply_head_moves(gates: DataFrame, moves: DataFrame) -> DataFrame:
    """Move gates to a new head (gate_id, head_sha, moved_at); the last move wins."""
    last = pick_per_key(moves, ["gate_id"], [F.desc("moved_at"), F.desc("head_sha")])
    values = {"head_sha": "head_sha", "updated_at": "moved_at"}
    return _update(gates, last, {t: s for t, s in values.items() if t in gates.columns})


# Fixed value: the chain of parent links, top down, as (table, foreign key, parent table).
CASCADE = [
    ("repos", "installation_id", "installations"),
    ("gates", "repo_id", "repos"),
    ("attempts", "checkpoint_id", "gates"),
]


def cascade_delete(
    tables: dict[str, DataFrame],
    installation_ids: DataFrame,
    chain: Sequence[tuple[str, str, str]] = tuple(CASCADE),
    key: str = "id",
) -> dict[str, DataFrame]:
    """Survivors of every table once the installations (a one-column frame) are deleted."""
    top = chain[0][2]
    gone = installation_ids.toDF(key).distinct()
    survivors = {top: tables[top].join(gone, key, "left_anti")}
    for table, foreign, _ in chain:
        df = tables[table]
        parents = gone.withColumnRenamed(key, foreign)
        survivors[table] = df.join(parents, foreign, "left_anti")
        if key in df.columns:
            gone = df.join(parents, foreign, "left_semi").select(key)
    return survivors


def align_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Fit older or wider data to a schema: a missing column is null, an extra one is dropped."""
    have = set(df.columns)
    return df.select(
        *(
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        )
    )
