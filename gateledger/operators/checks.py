"""Integrity of stored tables: the keys, links and value sets the store's DDL declares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateledger.schemas import ENUMS, NOT_NULL, schema


def fk_orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Child rows whose non-null key has no parent."""
    ids = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(ids, key, "left_anti")


def unique_violations(
    df: DataFrame, keys: tuple[str, ...] = ("repo_id", "pr_number", "head_sha")
) -> DataFrame:
    """Key values that occur more than once. Null keys never clash, as in a unique index."""
    known = df.dropna(subset=list(keys))
    return known.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def table_checks(
    df: DataFrame, not_null: list[str], allowed: dict[str, list[str]] | None = None
) -> DataFrame:
    """One row per rule with the number of rows that break it, all counted in one pass."""
    rules = {f"{c} is null": F.col(c).isNull() for c in not_null}
    rules |= {f"{c} out of range": ~F.col(c).isin(values) for c, values in (allowed or {}).items()}
    counts = df.agg(*(F.count_if(broken).alias(name) for name, broken in rules.items()))
    return counts.select(
        F.explode(
            F.array(
                *(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules)
            )
        ).alias("r")
    ).select("r.*")


def check_table(df: DataFrame, name: str) -> DataFrame:
    """``table_checks`` with the rules of one of the six tables; in a column that is absent every row is null."""
    absent = [c for c in NOT_NULL[name] if c not in df.columns]
    allowed = {c: v for c, v in ENUMS.items() if c in schema(name).names and c in df.columns}
    return table_checks(df.withColumns({c: F.lit(None).cast("string") for c in absent}), NOT_NULL[name], allowed)
