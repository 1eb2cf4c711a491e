"""Where queries and their SQL counterparts are registered, side by side."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.operators.scan import ensure_checkpoint_dir
from gateledger.plans import standins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Source:
    """The given tables and the stand-ins over them, for one scale."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        df = standins.table(self.spark, self.sf_dir, name)
        return standins.spread(df) if name in ("documents", "pages") else df

    def __getattr__(self, name: str) -> DataFrame:
        made_from = {
            "gates": "events", "repos": "events", "user_attempts": "events", "pr_events": "events",
            "attempts": "conversations", "local_events": "orders", "answers": "documents",
        }
        if name in made_from:
            table = self.table(made_from[name])
            return getattr(standins, name)(standins.spread(table) if name == "pr_events" else table)
        return self.table(name)


def query(sql: str | None = None, with_: tuple[str, ...] = ()):
    """Register a function of a ``Source`` under its own name."""

    def register(build: Callable[[Source], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, sf_dir: build(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = (f"WITH {', '.join(with_)} " if with_ else "") + sql
        return build

    return register


def us(name: str, alias: str | None = None) -> Column:
    return F.unix_micros(name).alias(alias or f"{name}_us")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for queries that write and read back."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
