"""Exact top-k inner products by distributed selection over score histograms.

Vectors travel in blocks of whole numbers. Every round scores each block of candidates against each
block of queries once more and counts the scores of the range that still holds a query's k-th best;
the counts are summed over all candidates, and the range shrinks until it is one score. The last
pass gives each query what lies above its k-th score, and of the ties the smallest ids.

Blocks that meet are not joined into rows: a task gets a block of queries and then, one after the
other, its share of the blocks of candidates, so what it holds does not grow with the table.

Scores are exact: products are summed in floats while no partial sum can pass what the float holds
exactly, and in Python's whole numbers otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gateledger.llm.tables import cut, lean

QUERIES = 2048  # of a block
CANDIDATES = 4096
DIMS = 64  # a longer vector counts as several
SHARE = 64  # blocks of candidates that a task gets for a block of queries, about
SLAB = 64  # copies of a block that Spark makes at once
PAIRS = 1 << 17  # that a Python worker scores at once
BINS = 256
EXACT = {np.float32: 1 << 24, np.float64: 1 << 53}
KINDS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def whole_numbers(embedding: str, scale: float) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(embedding: str) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(embedding).isNotNull() & ~bad


def blocks(vectors: DataFrame, size: int, n_rows: int) -> DataFrame:
    """Rows (id, v) in blocks of about ``size`` with equally long vectors: block, dims, ids, vs (flat).

    Rows are dealt by their place, so rows that repeat an id spread like any others.
    """
    n = max(1, -(-n_rows // size))
    dealt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n))
    keyed = vectors.select("id", "v", F.size("v").alias("dims"), dealt.alias("block"))
    return keyed.groupBy("block", "dims").agg(
        F.collect_list(F.struct("id", "v")).alias("rows")
    ).select("block", "dims", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("vs"))


def largest(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def exact(bound: int) -> type:
    """What holds whole numbers up to ``bound`` exactly."""
    return next((kind for kind, most in EXACT.items() if bound < most), object)


def matrix(flat, n: int) -> np.ndarray:
    return np.asarray(flat).reshape(n, -1) if len(flat) else np.zeros((n, 0), dtype=np.int64)


def top_k(
    vectors: DataFrame, k: int, every: int, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best candidates of each query.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but those with the
    query's own id. Unusable vectors and null ids take no part; a query meets the vectors of its own
    length; all candidates come where there are fewer than ``k``. Ties go to the smaller id, and rows
    that repeat an id count each. Scores beyond a long are outside the contract.
    """
    vectors = vectors.filter(F.col(vec_id).isNotNull() & usable(embedding))
    vectors = cut(vectors.select(F.col(vec_id).cast("long").alias("id"), whole_numbers(embedding, scale).alias("v")))
    ask = F.col("id") % every == 0
    worth = F.greatest(F.lit(1), F.ceil(F.size("v") / DIMS))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n_rows, n_queries, least, most, reach = (x or 0 for x in vectors.agg(
        F.sum(worth), F.sum(F.when(ask, worth)), F.min(F.array_min("v")), F.max(F.array_max("v")), F.max(square)
    ).head())
    kind = next(kind for kind, bits in KINDS.items() if max(most, -least - 1) < 1 << (bits - 1))
    vectors = vectors.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    asked = cut(blocks(vectors.filter(ask), QUERIES, n_queries))
    served = cut(blocks(vectors, CANDIDATES, n_rows))
    n_asked, shares = (max(1, -(-n // size)) for n, size in ((n_queries, QUERIES), (n_rows, CANDIDATES * SHARE)))

    # |score| <= norm of the query times the largest norm, here a rounded sum, so one range holds all
    reach = int(reach * (1 + 1e-9)) + 1
    low, width = -reach, 2 * reach + 1
    spread = copied(served.withColumnsRenamed({"dims": "long", "ids": "cids", "vs": "cvs"}).drop("block"), "to", n_asked)
    state = asked.select(
        "block", "dims", "ids", "vs",
        F.transform("ids", lambda _: F.lit(str(low))).alias("lows"),
        F.transform("ids", lambda _: F.lit(k).cast("long")).alias("left"),
    )
    while width > 1:
        step = -(-width // BINS)
        found = histogram(state, spread, width, step, n_asked, shares)
        state = cut(narrowed(state, found, step))
        width = step
    return selected(state, spread, k, n_asked, shares)


def copied(rows: DataFrame, name: str, n: int) -> DataFrame:
    """``rows`` for each number below ``n``, which becomes the column ``name``.

    Spark holds all copies that explode makes of a row, so it makes some at a time.
    """
    slabs = [F.sequence(F.lit(k), F.lit(min(k + SLAB, n) - 1)) for k in range(0, n, SLAB)]
    return reduce(DataFrame.union, [rows.select(F.explode(slab).alias(name), "*") for slab in slabs])


def paired(state: DataFrame, spread: DataFrame, n_asked: int = 1, shares: int = 1) -> DataFrame:
    """Every block of queries, once in each share of the candidates, followed by the candidates that it meets there."""
    asked = copied(state.select("block", "dims", "ids", "vs", "lows"), "share", shares)
    served = spread.select(
        F.col("to").alias("block"), F.col("long").alias("dims"), F.col("cids").alias("ids"), F.col("cvs").alias("vs"),
        F.pmod(F.xxhash64("cids"), F.lit(shares)).alias("share"),
    )
    rows = asked.withColumn("served", F.lit(False)).unionByName(served.withColumn("served", F.lit(True)), allowMissingColumns=True)
    task = (F.col("block") * shares + F.col("share")).cast("int")
    return rows.repartitionById(n_asked * shares, task).sortWithinPartitions("block", "share", "dims", "served")


@dataclass(eq=False)
class Asked:
    """A block of queries in a task; arrays of its own, since a view would keep the batch it came in."""

    key: tuple[int, int, int]
    ids: np.ndarray
    q: np.ndarray
    lows: list[int]


def met(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Asked, np.ndarray, np.ndarray]]:
    """Block of queries, ids and vectors of a block of candidates, for all that meet; candidates without queries are left out."""
    asked = None
    for batch in batches:
        for r in batch.itertuples():
            key = (r.block, r.dims, r.share)
            if not r.served:
                asked = Asked(key, np.array(r.ids), matrix(np.array(r.vs), len(r.ids)), [int(x) for x in r.lows])
            elif asked is not None and asked.key == key:
                yield asked, np.asarray(r.ids), matrix(r.vs, len(r.ids))


def inside(asked: Asked, cids: np.ndarray, c: np.ndarray, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Scores from each query's low on, below low + width if that is given: queries (in their block), candidates, scores, lows.

    As many queries at a time as make PAIRS pairs.
    """
    bound = max(largest(asked.q) * largest(c) * c.shape[1], max(map(abs, asked.lows), default=0) + (width or 0))
    kind = exact(bound)
    q, c, lows = asked.q.astype(kind), c.astype(kind), np.array(asked.lows, dtype=kind)[:, None]
    n = max(1, PAIRS // len(cids))
    for k in range(0, len(q), n):
        s = q[k : k + n] @ c.T if c.shape[1] else np.zeros((len(q[k : k + n]), len(c)), dtype=kind)
        low = lows[k : k + n]
        here = (s >= low) & (asked.ids[k : k + n, None] != cids)
        if width is not None:
            here &= s < low + width
        at = np.flatnonzero(here)
        nth = at // len(cids)
        yield k + nth, at - nth * len(cids), s.ravel()[at], low.ravel()[nth]


def counted(state: DataFrame, spread: DataFrame, width: int, step: int, n_asked: int = 1, shares: int = 1) -> DataFrame:
    """block, dims, nth (of the query in its block), bin, n: scores of low + bin * step and on, by task.

    Candidate blocks that follow each other for the same queries are added up in the task.
    """

    def told(asked: Asked, total: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(total)
        return pd.DataFrame({"block": asked.key[0], "dims": asked.key[1], "nth": at // BINS, "bin": at % BINS, "n": total[at]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total = None, np.zeros(0, dtype=np.int64)
        for asked, cids, c in met(batches):
            if asked is not last:
                if last is not None:
                    yield told(last, total)
                last, total = asked, np.zeros(len(asked.ids) * BINS, dtype=np.int64)
            for nth, _, s, low in inside(asked, cids, c, width):
                if len(nth):
                    above = s - low
                    bins = ((above if above.dtype == object else above.astype(np.int64)) // step).astype(np.int64)
                    first, end = nth[0] * BINS, (nth[-1] + 1) * BINS
                    total[first:end] += np.bincount(nth * BINS + bins - first, minlength=end - first)
        if last is not None:
            yield told(last, total)

    return paired(state, spread, n_asked, shares).mapInPandas(lean(count), "block long, dims int, nth long, bin long, n long")


def histogram(state: DataFrame, spread: DataFrame, width: int, step: int, n_asked: int = 1, shares: int = 1) -> DataFrame:
    """The counts of :func:`counted` over all candidates."""
    return counted(state, spread, width, step, n_asked, shares).groupBy("block", "dims", "nth", "bin").agg(F.sum("n").alias("n"))


def narrowed(state: DataFrame, found: DataFrame, step: int) -> DataFrame:
    """The range of each query cut to the bin in which its count from the top reaches what is left.

    A query with fewer scores than it wants goes to the lowest bin that has any.
    """
    down = Window.partitionBy("block", "dims", "nth").orderBy(F.desc("bin"))
    want = state.select("block", "dims", F.posexplode("left").alias("nth", "want"))
    upto = found.withColumn("upto", F.sum("n").over(down)).join(want, ["block", "dims", "nth"])
    upto = upto.withColumn("above", F.col("upto") - F.col("n"))
    held = upto.filter("above < want").groupBy("block", "dims", "nth").agg(
        F.min_by(F.struct("bin", "above"), "bin").alias("at")
    ).groupBy("block", "dims").agg(F.map_from_entries(F.collect_list(F.struct("nth", "at"))).alias("at"))
    nth = F.sequence(F.lit(0), F.size("ids") - 1)
    at = lambda i: F.try_element_at("at", i.cast("long"))
    return state.join(held, ["block", "dims"], "left").select(
        "block", "dims", "ids", "vs",
        F.transform(nth, lambda i: (F.get("lows", i).cast("decimal(38,0)") + F.coalesce(at(i)["bin"], F.lit(0)) * F.lit(step).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string")).alias("lows"),
        F.transform(nth, lambda i: F.get("left", i) - F.coalesce(at(i)["above"], F.lit(0))).alias("left"),
    )


def best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score) the ``k`` highest scores of each query, ties by id."""
    nth, ids, s = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, ~s, nth))
    first = np.searchsorted(nth[order], nth[order])
    order = order[np.arange(len(order)) - first < k]
    return nth[order], ids[order], s[order]


def selected(state: DataFrame, spread: DataFrame, k: int, n_asked: int = 1, shares: int = 1) -> DataFrame:
    """All scores above the k-th and the ties with it, the smallest ids of each task first."""

    def told(asked: Asked, found: list) -> pd.DataFrame:
        nth, ids, s = best(found, k)
        return pd.DataFrame({"query_id": asked.ids[nth], "vec_id": ids, "score": s})

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, found, held, most = None, [], 0, PAIRS
        for asked, cids, c in met(batches):
            if asked is not last:
                if found:
                    yield told(last, found)
                last, found, held, most = asked, [], 0, PAIRS
            for nth, at, s, _ in inside(asked, cids, c):
                if len(nth):
                    found.append((nth, cids[at], s.astype(np.int64)))
                    held += len(nth)
                if held > most:
                    found = [best(found, k)]
                    held = len(found[0][0])
                    most = 2 * held + PAIRS
        if found:
            yield told(last, found)

    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = paired(state, spread, n_asked, shares).mapInPandas(lean(pick), "query_id long, vec_id long, score long")
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
