"""Near-duplicates by SimHash: fingerprints that differ in few bits, found on a grid of bit counts.

A fingerprint is cut into 32 segments of two bits; the counts of set bits of the segments are a
point of a grid. Points of two fingerprints are never further apart, in Manhattan distance, than the
fingerprints in bits. The 32 axes fall into GROUPS groups. Two points within LIMIT of each other
agree on all axes of at least GROUPS - LIMIT groups, so the range join over the grid is an equality
join over the cells of each choice of so many groups; the Manhattan distance then sifts the
pairs of a cell, and the bits decide. No link can be missed.

Counts are kept in unary (0: 00, 1: 01, 2: 11), so the Manhattan distance of two points is the
number of bits in which their codes differ.

Cells may hold thousands of fingerprints of near copies. The members of each cell are first linked
to its smallest and largest, which gives components; then cells are joined with themselves across
components only, and crowded cells of a single component are left out of that. A join gives nothing
but links that hold, however many fingerprints share a cell by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateledger.llm.components import components
from gateledger.llm.tables import cut, give_back, set_aside, sized, whole

SHINGLE = 4
SEED = 42
LIMIT = 4
GROUPS = 7
CROWD = 16  # members from which a cell of one component is set aside before the join
CHUNK = 1 << 16
ODD = 0x5555555555555555


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, bit 0 first."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str) -> int:
    """Unsigned SimHash over runs of SHINGLE words, A-Z lower-cased; 0 for a text without words."""
    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist())
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n)
    return int(np.packbits(2 * bits_of(hashes) > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        found = np.fromiter(map(fingerprint, batch), dtype=np.uint64, count=len(batch))
        yield pd.Series(found.view(np.int64))
    give_back()


def unary(fp: Column) -> Column:
    """The grid point of a fingerprint: the count of each two-bit segment, in unary."""
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(F.lit(ODD))
    both = fp.bitwiseAND(high).bitwiseAND(F.lit(ODD))
    return some.bitwiseOR(F.shiftleft(both, 1))


def masks() -> list[int]:
    """One mask over the 64 bits for each choice of GROUPS - LIMIT groups of axes, as signed longs."""
    group = [sum(3 << 2 * axis for axis in range(32) if axis % GROUPS == g) for g in range(GROUPS)]
    chosen = [sum(group[g] for g in some) for some in combinations(range(GROUPS), GROUPS - LIMIT)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def near(a: str, b: str) -> Column:
    """Within LIMIT on the grid, then within LIMIT in bits."""
    grid = F.bit_count(unary(F.col(a)).bitwiseXOR(unary(F.col(b)))) <= LIMIT
    return grid & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= LIMIT)


def celled(prints: DataFrame) -> DataFrame:
    cell = F.posexplode(F.array(*[F.col("point").bitwiseAND(F.lit(m)) for m in masks()])).alias("choice", "cell")
    return prints.withColumn("point", unary(F.col("fp"))).select(*prints.columns, cell)


def roots(prints: DataFrame) -> DataFrame:
    """node, root of every fingerprint (column fp, distinct) that is linked to another one."""
    key = ["choice", "cell"]
    n = prints.count()
    many = n * len(masks())
    prints = sized(prints.select("fp"), many)
    cells = celled(prints)
    hubs = cells.groupBy(*key).agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    # conditions on both sides are part of the join: only verified links leave it
    to_low, to_high = (near("fp", hub) & (F.col("fp") != F.col(hub)) for hub in ("low", "high"))
    star = sized(cells.join(hubs, key).filter(to_low | to_high), many)
    hub = F.explode(F.filter(F.array(F.when(to_low, F.col("low")), F.when(to_high, F.col("high"))), F.isnotnull))
    found = components(star.select(F.col("fp").alias("a"), hub.alias("b")))
    links = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    named = prints.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    cells = celled(cut(sized(named, many)))
    one = cells.groupBy(*key).agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    closed = one.filter((F.col("n") >= CROWD) & (F.col("lo") == F.col("hi"))).select(*key)
    rest = cells.join(closed, key, "left_anti")
    left = rest.select(*key, F.col("fp").alias("a"), F.col("root").alias("ra"))
    right = rest.select(*key, F.col("fp").alias("b"), F.col("root").alias("rb"))
    across = left.join(right, key).filter("ra < rb").filter(near("a", "b")).select("a", "b")
    return components(sized(links, n).union(sized(across, many)))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of every row, and the root that only its own class has."""
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_of(whole(text)).alias("fp")))
    n = rows.count() * len(masks())  # each row makes so many cells
    prints = cut(sized(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), n))
    found = roots(prints.select("fp"))
    named = prints.join(found, F.col("fp") == F.col("node"), "left")
    named = cut(sized(named.select("fp", "least", F.coalesce("root", "fp").alias("root")), n))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id", "root")
    return rows.join(of, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (long), component_id of every row: the smallest id that links reach.

    A null text counts as empty; texts without words share fingerprint 0 and are linked by it like
    any other. Rows with the same id stand each for themselves. A null id is never a component's
    name unless all ids in it are null.
    """
    return classes(docs, doc_id, text).drop("root")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each class of near copies: the one of smallest id.

    An id that several rows share stays once for each class in which it is the smallest; which of
    equal rows stays makes no difference. A row without an id only stays where no other has one.
    """
    found = classes(docs, doc_id, text)
    by_id = F.struct(F.col("doc_id").isNull(), "doc_id", "fingerprint")
    first = found.groupBy("root").agg(F.min(by_id).alias("first"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    chosen = first.select(name(F.col("first.doc_id")).alias("_name"), F.col("first.fingerprint").alias("_print")).distinct()
    chosen = cut(chosen)
    away, back = set_aside(docs, "")
    rows = docs.select(*away, name(F.col(doc_id)).alias("_name")).join(chosen, "_name")
    own = whole(f"_own{docs.columns.index(text)}")
    rows = rows.filter(fingerprint_of(own) == F.col("_print"))
    nth = F.row_number().over(Window.partitionBy("_name", "_print").orderBy(F.xxhash64(own)))
    return rows.withColumn("_nth", nth).filter("_nth = 1").select(*back)
