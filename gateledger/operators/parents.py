"""Installations and repositories, the parents of gates, out of the events that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger.operators.store import align_schema
from gateledger.schemas import TABLE_DEFAULTS, schema

# Fixed value: the kind of account of an owner that names none.
ACCOUNT_TYPE = "Organization"


def naming(events: DataFrame) -> DataFrame:
    """Events that name both parents; one without an installation stores nothing."""
    return events.filter(F.col("installation_id").isNotNull() & F.col("repo_id").isNotNull())


def _newest(value: Column) -> Column:
    """The value of the last event that gives one. What an event leaves out keeps what an earlier one said."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct("ts", "delivery_id")))


def installations_of(events: DataFrame) -> DataFrame:
    """The installation table that a history leaves behind, a row for each installation.

    The account is that of the newest event, created at the first one. Aggregates alone, combined before
    the shuffle, so an installation with most events costs one row a task. Redeliveries change nothing.
    """
    given = F.nullif(F.col("account_type"), F.lit(""))
    kind = F.when(F.col("account_login").isNotNull() | given.isNotNull(), F.coalesce(given, F.lit(ACCOUNT_TYPE)))
    rows = naming(events).groupBy(F.col("installation_id").alias("id")).agg(
        _newest(F.col("account_login")).alias("account_login"),
        F.coalesce(_newest(kind), F.lit(ACCOUNT_TYPE)).alias("account_type"),
        F.min("ts").alias("created_at"),
    )
    return align_schema(rows, schema("installations"))


def repos_of(events: DataFrame) -> DataFrame:
    """The repository table: a repository that moved belongs to its newest installation, by its newest name."""
    rows = naming(events).groupBy(F.col("repo_id").alias("id")).agg(
        _newest(F.col("installation_id")).alias("installation_id"),
        _newest(F.col("repo_full_name")).alias("full_name"),
        _newest(F.nullif(F.col("default_branch"), F.lit(""))).alias("default_branch"),
        F.min("ts").alias("created_at"),
    )
    full = align_schema(rows, schema("repos"))
    return full.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in TABLE_DEFAULTS["repos"].items()})
