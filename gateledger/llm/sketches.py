"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash whose unsigned value lies below a fixed fraction of all hashes, so
sketches of any texts can be merged by union and compared at any sizes: what both hold of what one
holds estimates the containment of their shingles. A text none of whose hashes lies below keeps its
smallest one instead, so no text with a word has an empty sketch. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gateledger.llm.tables import whole

SHINGLE = 5
PER = 8  # one hash of so many is kept
BOUND = (1 << 64) // PER - (1 << 63)  # on the scale where unsigned order is signed order
FLIP = -(1 << 63)
GROUP_BYTES = 8 << 20
RANGES = 20_000


def shingle_hashes(text: Column, words: int = SHINGLE) -> Column:
    """Hashes of all runs of ``words`` words, moved so that unsigned order is signed order.

    A text of fewer words has one hash, of all of them; a text without words has none.
    """
    parts = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(parts, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        several = F.transform(
            F.sequence(F.lit(1), n - (words - 1)),
            lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(words)]).bitwiseXOR(F.lit(FLIP)),
        )
        short = F.array(F.aggregate(h, F.lit(words).cast("long"), lambda a, x: F.xxhash64(a, x)).bitwiseXOR(F.lit(FLIP)))
        return F.when(n >= words, several).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(hashed), runs), F.lit(0))


def sketch(text: Column, words: int = SHINGLE, bound: int = BOUND) -> Column:
    """Sorted distinct hashes below ``bound``, or else the smallest. Empty for a text without words."""

    def keep(h: Column) -> Column:
        low = F.filter(h, lambda x: x < F.lit(bound))
        least = F.when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(h)
        return F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).otherwise(least)

    return F.get(F.transform(F.array(shingle_hashes(text, words)), keep), F.lit(0))


def merged(a: Column, b: Column, bound: int = BOUND) -> Column:
    """The sketch of two texts taken together."""
    return F.get(F.transform(F.array(F.array_union(a, b)), lambda u: F.when(
        F.exists(u, lambda x: x < F.lit(bound)), F.sort_array(F.filter(u, lambda x: x < F.lit(bound)))
    ).when(F.size(u) > 0, F.array(F.array_min(u))).otherwise(u)), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of the union of two sketches; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def containment(a: Column, b: Column) -> Column:
    """Part of ``a`` that ``b`` holds; 1 for an empty ``a``."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x.bitwiseXOR(F.lit(FLIP)))), 16, "0")), "")


def with_next(docs: DataFrame, order: str, text: str, words: int = SHINGLE, bound: int = BOUND) -> DataFrame:
    """order, text, sketch of every row, with next_text and next_sketch of the row after it.

    Rows stand in descending order, nulls last, equal ones by their texts; after the last comes the
    first. They are dealt by ranges of the order of about GROUP_BYTES (at most RANGES of them, beyond
    which ranges grow and sort with spills). The last row of a range takes the first of the range
    after it, found by the highest order of each range: one number per range reaches the driver.
    """
    rows = docs.select(F.col(order).alias("order"), whole(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = max(1, min(RANGES, -(-total // GROUP_BYTES)))
    bounds: list[int] = []
    if parts > 1:
        at = [k / parts for k in range(1, parts)]
        bounds = sorted(set(rows.agg(F.percentile_approx("order", at, 5 * RANGES)).head()[0] or []))
    place = F.lit(0)
    if bounds:
        place = F.array_size(F.filter(F.from_json(F.lit(str(bounds)), "array<bigint>"), lambda b: b < F.col("order")))
    dealt = rows.withColumn("range", F.when(F.col("order").isNull(), F.lit(-1)).otherwise(place))
    tops = sorted((tuple(r) for r in dealt.groupBy("range").agg(F.max("order")).collect()), reverse=True)
    if not tops:
        return rows.select("*", sketch(F.col("text")).alias("sketch"), F.col("text").alias("next_text"), sketch(F.col("text")).alias("next_sketch"))
    turn = docs.sparkSession.createDataFrame(
        [(tops[k][0], tops[(k + 1) % len(tops)][1]) for k in range(len(tops))], "at int, top bigint"
    )
    leading = rows.filter(F.col("order").isin([t for _, t in tops if t is not None]) | (F.col("order").isNull() if tops[-1][1] is None else F.lit(False)))
    one = F.row_number().over(Window.partitionBy("order").orderBy("text"))
    heads = (
        leading.withColumn("nth", one).filter("nth = 1")
        .join(turn, F.col("order").eqNullSafe(F.col("top")))
        .select("at", F.struct("text", sketch(F.col("text"), words, bound).alias("sketch")).alias("head"))
    )
    w = Window.partitionBy("range").orderBy(F.col("order").desc_nulls_last(), "text")
    mine = F.struct("text", "sketch")
    after = dealt.withColumn("sketch", sketch(F.col("text"), words, bound)).withColumn("after", F.lead(mine).over(w))
    joined = after.join(heads, (F.col("range") == F.col("at")) & F.col("after").isNull(), "left")
    then = F.coalesce(F.col("after"), F.col("head"))
    return joined.select("order", "text", "sketch", then["text"].alias("next_text"), then["sketch"].alias("next_sketch"))


def fingerprints(docs: DataFrame, text: str = "text", into: str = "sketch") -> DataFrame:
    """All rows of ``docs`` with their sketch; a column called ``into`` is replaced. Null is empty."""
    return docs.withColumn(into, sketch(whole(text)))
