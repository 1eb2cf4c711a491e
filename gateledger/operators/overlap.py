"""How much of an explanation restates its sources, as shared word n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger.functions.text import let
from gateledger.operators.scan import written

NGRAM = 5
MEDIUM_SHARE, HIGH_SHARE = 0.2, 0.5
FEW_NGRAMS = 500_000  # of the sources, up to which Spark may send them to every task


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(tokens: Column, n: int = NGRAM) -> Column:
    """Distinct n-grams of a word list as 64-bit hashes; fewer than ``n`` words have none.

    ``tokens`` should be a plain column or a bound value: every n-gram reads it ``n`` times.
    """
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_distinct(
        F.transform(starts, lambda i: F.xxhash64(*(F.get(tokens, i + j) for j in range(n))))
    )


def text_ngrams(text: Column, n: int = NGRAM) -> Column:
    return let(words(text), lambda tokens: ngrams(tokens, n))


def overlap_band(
    explanations: DataFrame,
    sources: DataFrame,
    key: str = "id",
    on: Sequence[str] = (),
    n: int = NGRAM,
    medium: float = MEDIUM_SHARE,
    high: float = HIGH_SHARE,
) -> DataFrame:
    """Add ``overlap_share`` and ``overlap`` (low, medium, high) to each explanation (``key`` is unique).

    ``on`` names columns that tie an explanation to its own sources; without it all sources
    count. An explanation with no source text is ``unknown``. Sources are reduced to distinct
    n-grams first, so the join keeps at most one match per n-gram of an explanation, and AQE can
    split it where one n-gram is common. They are written, so that Spark knows their size: few go to every
    task, and many are hashed, since a sort of all n-grams of the explanations would spill several times their size.
    """
    link = list(on)
    grams = explanations.select(key, *link, text_ngrams(F.col("explanation"), n).alias("__grams"))
    known = sources.filter(F.col("source").isNotNull())
    gone = written(known.select(*link, F.explode(text_ngrams(F.col("source"), n)).alias("__gram")).distinct())
    gone = gone if gone.count() <= FEW_NGRAMS else gone.hint("shuffle_hash")
    shared = (
        grams.select(key, *link, F.explode("__grams").alias("__gram"))
        .join(gone, [*link, "__gram"])
        .groupBy(key)
        .agg(F.count("*").alias("__shared"))
    )
    # The size is computed again in place: cheaper than a second join of every explanation.
    sized = explanations.withColumn("__all", F.size(text_ngrams(F.col("explanation"), n)))
    joined = sized.join(shared, key, "left")
    if link:
        present = known.select(*link, F.lit(True).alias("__has")).distinct()
        joined = joined.join(present, link, "left")
    else:
        joined = joined.withColumn("__has", F.lit(not known.isEmpty()))
    share = F.coalesce(F.col("__shared") / F.nullif(F.col("__all"), F.lit(0)), F.lit(0.0))
    band = (
        F.when(~F.coalesce("__has", F.lit(False)), "unknown")
        .when(share >= high, "high")
        .when(share >= medium, "medium")
        .otherwise("low")
    )
    return joined.withColumns({"overlap_share": share, "overlap": band}).drop("__all", "__shared", "__has")
