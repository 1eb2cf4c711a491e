"""Fill-in-middle transformation: texts cut at two ranks and put together anew.

The ranks count units, the parts of the text count code points. An indexable skip list over the units
leads from one to the other: a link of an express lane spans FAN links of the lane below and carries
how many units and how many code points it passes, so a descent that adds up the widths it passes
stands exactly at a rank after at most FAN steps a lane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateledger.llm.tables import set_aside, whole

FAN = 16
SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
PLACES = T.StructType([T.StructField(n, T.LongType()) for n in ("units", "first", "second")])


class SkipList:
    """Lanes of (units, code points) passed by each link, the widest lane last."""

    def __init__(self, chars: np.ndarray):
        units = np.ones(len(chars), np.int64)
        self.lanes = [(units, chars)]
        while len(units) > FAN:
            starts = np.arange(0, len(units), FAN)
            units, chars = np.add.reduceat(units, starts), np.add.reduceat(chars, starts)
            self.lanes.append((units, chars))

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        link = passed = at = 0
        for units, chars in reversed(self.lanes):
            link *= FAN
            while link < len(units) and passed + units[link] <= rank:
                passed, at, link = passed + int(units[link]), at + int(chars[link]), link + 1
        return at


def unit_widths(text: str, pattern: str | None) -> np.ndarray:
    """Code points of each unit. Without a pattern a unit is one code point. With one, a unit ends where a
    match ends and begins where the one before ended; what follows the last match is a unit of its own."""
    if pattern is None:
        return np.ones(len(text), np.int64)
    import regex

    ends = [m.end() for m in regex.finditer(pattern, text) if m.end() > m.start()]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.diff(np.array([0, *ends], np.int64))


def places(text: Column, first: Column, second: Column, unit: str | None = None) -> Column:
    """units of the text, and the code points before the ranks ``first`` and ``second`` modulo units + 1, the
    smaller one first."""

    @F.arrow_udf(PLACES)
    def found(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ones, others in batches:
            rows = []
            for text, one, other in zip(texts, ones.to_numpy(), others.to_numpy()):
                lanes = SkipList(unit_widths(text.as_py(), unit))
                n = len(lanes.lanes[0][0])
                ranks = sorted((int(one) % (n + 1), int(other) % (n + 1)))
                rows.append((n, *map(lanes.chars_before, ranks)))
            columns = zip(*rows) if rows else ([], [], [])
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PLACES.names)

    return found(text, first, second)


def checked(sentinels: tuple[str, str, str]) -> None:
    """A text without sentinels must not gain one where it meets one."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            shared = any(a[:k] == b[-k:] for k in range(1, min(len(a), len(b))))
            if not a or shared or (i != j and a in b):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    into: str = "infill",
    seed: int = 1,
    rate: int = 90,
    spm_rate: int = 20,
    unit: str | None = None,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """All rows of ``docs`` with n, form, prefix_chars, middle_chars, output in the struct ``into``.

    Four numbers h1 to h4 are the leading groups of eight digits of the hex SHA-256 of ``seed:id``.
    The prefix ends after the smaller of h1 and h2 modulo n + 1 units, the middle after the larger.
    ``rate`` of a hundred texts are transformed (h3), ``spm_rate`` of these with the suffix first (h4).
    The rest, empty texts and those that hold a sentinel are plain: unchanged, without parts.
    Null is empty, a null id counts as no digits. Repeated rows come out alike. A column called
    ``into`` is replaced, others are kept whatever their names. One text is held whole in a task.
    """
    checked(sentinels)
    p, s, m = map(F.lit, sentinels)
    away, back = set_aside(docs, into)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select(*away, whole(F.col(f"`{text}`")).alias("_text"), digest.alias("_digest"))
    rows = rows.withColumn("_at", places(F.col("_text"), h[0], h[1], unit))
    held = [F.contains(F.col("_text"), x) for x in (p, s, m)]
    plain = (F.col("_text") == "") | held[0] | held[1] | held[2] | (h[2] % 100 >= rate)
    rows = rows.withColumn("_form", F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm"))
    first, second = F.col("_at.first"), F.col("_at.second")
    prefix = F.substring("_text", F.lit(1), first.cast("int"))
    middle = F.substring("_text", (first + 1).cast("int"), (second - first).cast("int"))
    suffix = F.substring("_text", (second + 1).cast("int"), F.length("_text"))
    output = (
        F.when(F.col("_form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("_form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(F.col("_text"))
    )
    parts = F.col("_form") != "plain"
    result = F.struct(
        F.col("_at.units").alias("n"),
        F.col("_form").alias("form"),
        F.when(parts, first).alias("prefix_chars"),
        F.when(parts, second - first).alias("middle_chars"),
        output.alias("output"),
    )
    return rows.select(*back, result.alias(into))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made of."""
    p, s, m = map(F.lit, sentinels)

    def parts(lead: Column, mark: Column) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.length(lead) + 1, F.length(output))
        rest = F.split_part(body, mark, F.lit(2))
        return F.split_part(body, mark, F.lit(1)), F.split_part(rest, m, F.lit(1)), F.split_part(rest, m, F.lit(2))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
