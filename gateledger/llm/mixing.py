"""Mixing sources to target weights by weighted sampling without replacement.

Sources get shares of all words by weight, a share ending at ``most`` times what the source holds
and its excess going to the others. Within a source documents stand in the order of exponential
keys scaled by their quality (Efraimidis and Spirakis); whole epochs come first, and the rest of
the target is cut from the front of that order. Everything is DataFrame code.

A source of any size is dealt over ``BUCKETS`` ranges of the key: each range is sorted by itself
and starts at the sum of the ranges before it, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gateledger.llm.tables import WORD, cut, numbered, set_aside, whole

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKETS = 4096
SEED = 20_011
ROUNDS = 100_000  # far above the number of rounds that any set of sources takes


def words(text: str | Column = "text") -> Column:
    """The size of a text: its number of words; 0 for null."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def quality(text: str | Column = "text") -> Column:
    """A plain quality weight from 0.5 to 2: rises with the share of a-z among the characters.

    1.25 for an empty or null text.
    """
    t = whole(text)
    letters = F.length(t) - F.length(F.translate(t, "abcdefghijklmnopqrstuvwxyz", ""))
    share = letters / F.greatest(F.length(t), F.lit(1))
    return F.when(F.length(t) == 0, F.lit(1.25)).otherwise(F.lit(0.5) + F.lit(1.5) * share)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source with its target. ``sizes``: _key (no nulls, sorts as the sources do), _held.

    Each round gives the words left to the sources not yet at their limit, by weight; sources that
    come out above it stop there. The rounds end when none is above, which is the level at which
    shares and limits meet. Rounds exchange three sums, never the sources.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = numbered(sizes, F.col("_key"), into="_rank")
    weight = F.element_at(table, (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("_key", "_held", weight.alias("_weight"), (F.col("_held") * F.lit(float(most))).alias("_limit")))
    level = -1.0
    for _ in range(ROUNDS):
        stopped = F.col("_limit") <= F.lit(level) * F.col("_weight")
        total, held, free = ranked.agg(
            F.sum("_held"), F.sum(F.when(stopped, F.col("_limit"))), F.sum(F.when(~stopped, F.col("_weight")))
        ).head()
        if not free:
            break
        now = ((total or 0) - (held or 0.0)) / free
        if now <= level:
            break
        level = now
    return ranked.select(
        "_key", "_held", F.least(F.col("_limit"), F.lit(max(level, 0.0)) * F.col("_weight")).alias("_target")
    )


def mix(
    docs: DataFrame,
    size: Column,
    weight: Column,
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST,
    seed: int = SEED,
    into: str = "mix",
) -> DataFrame:
    """All rows of ``docs`` with a struct ``into``: size, source_size, target, taken.

    ``size`` and ``weight`` (> 0) are computed once, before any shuffle. Null sources are one
    source, the last. A document of size 0 takes nothing; a table of size 0 has targets 0. Rows with
    the same id, key and size may stand in any order; the same rows come out. A column that is
    already called ``into`` is replaced; other columns, whatever their names, are kept. The same
    rows and seed give the same mix.
    """
    away, back = set_aside(docs, into)
    one = (F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = docs.select(
        *away,
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t")).alias("_key"),
        size.cast("long").alias("_size"),
        (-F.log(one) / weight).alias("_place"),
        F.col(doc_id).alias("_id"),
    )
    bucket = F.least(F.lit(BUCKETS - 1), F.floor(F.lit(BUCKETS) * (F.lit(1.0) - F.exp(-F.col("_place")))))
    rows = rows.withColumn("_bucket", bucket.cast("int"))
    sums = cut(rows.groupBy("_key", "_bucket").agg(F.sum("_size").alias("_sum")))
    goals = targets(sums.groupBy("_key").agg(F.sum("_sum").alias("_held")), weights, most)
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum").join(goals, "_key")
    within = Window.partitionBy("_key", "_bucket").orderBy("_place", F.col("_id").asc_nulls_last(), "_size")
    before = F.coalesce(F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_before", before).join(starts, ["_key", "_bucket"])
    epochs = F.when(F.col("_held") > 0, F.floor(F.col("_target") / F.col("_held"))).otherwise(0)
    rest = F.round("_target").cast("long") - epochs * F.col("_held")
    part = F.greatest(F.lit(0), F.least(F.col("_size"), rest - F.col("_start") - F.col("_before")))
    return placed.select(
        *back,
        F.struct(
            F.col("_size").alias("size"),
            F.col("_held").alias("source_size"),
            F.col("_target").alias("target"),
            (epochs * F.col("_size") + part).cast("long").alias("taken"),
        ).alias(into),
    )
