"""Target-distribution importance resampling over hashed runs of words.

A task works through its texts in blocks. The distinct words of a block, with a delimiter on either
side, are the dictionary of an Aho-Corasick automaton; each carries the CRC and the length of its word.
A scan of the block emits these payloads in order, and the CRC of a run of words follows from the
payloads of neighbours alone, since CRC(ab) = shift(CRC(a), length of b) xor CRC(b). The remainders are
the buckets of the text. They are written once and read twice: for the counts of all texts, and for the
weight of each under the gains that corpus and target counts give.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateledger.llm.tables import cut, numbered, whole

BUCKETS = 10_000
RUNS = 3  # words of the longest run
LEAST_WORDS = 20  # of a text that may be drawn
SEED = 42
BLOCK = 2 << 20  # bytes of text scanned by one automaton
SHORT = 128  # lengths whose shift has a table of its own

#: ASCII letters in lower case, digits and all bytes beyond ASCII belong to words; all else delimits.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256))


def one_step(crc: np.ndarray) -> np.ndarray:
    """CRC states after one more zero byte, without the inversions at either end."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (crc & np.uint32(1)))
    return crc


@cache
def shifts() -> np.ndarray:
    """Tables of a shift by 0 to SHORT - 1 bytes: by length, byte of the CRC, value of that byte."""
    values = np.arange(256, dtype=np.uint32)
    table = np.empty((SHORT, 4, 256), np.uint32)
    table[0] = [values << np.uint32(8 * k) for k in range(4)]
    for n in range(1, SHORT):
        table[n] = one_step(table[n - 1])
    return table


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """CRCs moved over as many bytes as ``by`` says."""
    table, out, left = shifts(), crc, by
    while len(left) and left.max() > 0:
        n = np.minimum(left, SHORT - 1)
        a, b, c, d = ((out >> np.uint32(8 * k)) & np.uint32(255) for k in range(4))
        out = table[n, 0, a] ^ table[n, 1, b] ^ table[n, 2, c] ^ table[n, 3, d]
        left = left - n
    return out


def payloads(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """CRC and length of every word of a text that is folded already, by one scan of an automaton.

    A zero byte delimits; a byte 1 between delimiters is a word too, with length 0.
    """
    from ahocorasick import Automaton

    words = list(set(text.split(b"\0")) - {b""})
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    length = np.array([0 if w == b"\1" else len(w) for w in words], np.int64)
    found = Automaton()
    for k, word in enumerate(words):
        found.add_word(f"\0{word.decode('latin-1')}\0", k)
    if not words:
        return crc, length
    found.make_automaton()
    at = np.fromiter((k for _, k in found.iter(f"\0{text.decode('latin-1')}\0")), np.int64)
    return crc[at], length[at]


def buckets_of(crc: np.ndarray, length: np.ndarray, doc: np.ndarray, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every run of 1 to ``runs`` neighbouring words of one document."""
    spaced = shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), length) ^ crc
    found, owner, run = [crc % np.uint32(buckets)], [doc], crc
    for k in range(1, runs):
        run = shifted(run[:-1], length[k:] + 1) ^ spaced[k:]
        inside = doc[k:] == doc[: len(doc) - k] if k < len(doc) else np.zeros(0, bool)
        found.append(run[inside] % np.uint32(buckets))
        owner.append(doc[k:][inside])
    return np.concatenate(found), np.concatenate(owner)


def pieces(text: bytes) -> Iterator[bytes]:
    """A folded text in parts of about BLOCK bytes that end between words."""
    while len(text) > BLOCK:
        at = text.rfind(b"\0", 0, BLOCK)
        at = text.find(b"\0", BLOCK) if at < 0 else at
        if at < 0:
            break
        yield text[:at]
        text = text[at + 1 :]
    yield text


def featured(texts: list[bytes], runs: int, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Number of words and buckets (unsigned 16-bit, little-endian) of each text of a block."""
    folded = b"\0\1\0".join(t.translate(FOLD) for t in texts)
    crc, length = map(np.concatenate, zip(*map(payloads, pieces(folded))))
    ends = length == 0
    doc = np.cumsum(ends)[~ends]
    bucket, owner = buckets_of(crc[~ends], length[~ends], doc, runs, buckets)
    order = np.argsort(owner, kind="stable")
    bounds = np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]
    return np.bincount(doc, minlength=len(texts)), [b.astype("<u2").tobytes() for b in np.split(bucket[order], bounds)]


def features(docs: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """seat, doc_id, n_words, buckets of every row of ``docs`` (doc_id, text), written down.

    ``seat`` tells rows apart that are alike. A text is scanned in parts, but its payloads and buckets
    are held together: about 40 bytes a word.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbered in 16 bits")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
            starts = [0, *(np.flatnonzero(np.diff(sizes // BLOCK)) + 1), len(sizes)]
            for start, end in pairwise(starts):
                rows = batch.slice(start, end - start)
                n, found = featured(rows.column("text").to_pylist(), runs, buckets)
                columns = [rows.column("seat"), rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["seat", "doc_id", "n_words", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("seat"), "doc_id", F.col("text").cast("binary").alias("text"))
    return cut(rows.mapInArrow(build, f"seat long, doc_id {kind}, n_words long, buckets binary"))


def counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows lie in each bucket; at most ``buckets`` numbers leave a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for column in batch.columns:
                total += np.bincount(np.frombuffer(b"".join(column.to_pylist()), "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = rows.select("buckets").mapInArrow(count, "bucket long, n long")
    found = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        found[bucket] = n
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds to a weight: thousandths of the log ratio of its smoothed shares."""
    total, aim = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratios = [(float(t) + 1) * total / ((float(s) + 1) * aim) for s, t in zip(corpus, target)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weight_of(found: Column, gain: np.ndarray) -> Column:
    @F.arrow_udf(T.LongType())
    def weight(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([int(gain[np.frombuffer(b, "<u2")].sum()) for b in batch.to_pylist()], pa.int64())

    return weight(found)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = 5,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    runs: int = RUNS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of ``docs``.

    A document's weight is the sum of the gains of its features; its score adds Gumbel noise that the
    SHA-256 of ``seed:id`` fixes, so that the highest scores are a draw without replacement by weight.
    Of the rows with at least ``least_words`` words, ``percent`` of a hundred (rounded down) are drawn and
    ranked from 1: highest score first, then smaller id, null ids last. The others have no rank.

    Null and empty texts have no words, no features and weight 0. Repeated rows stand each for
    themselves and take neighbouring ranks; a null id counts as no digits. Empty tables are fine on
    either side. Both tables are counted whole; only ``buckets`` counts of each reach the driver.
    """
    rows = features(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole(F.col(f"`{text}`")).alias("text")), runs, buckets)
    aim = features(target.select(F.lit(0).alias("doc_id"), whole(F.col(f"`{target_text}`")).alias("text")), runs, buckets)
    gain = gains(counts(rows, buckets), counts(aim, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(share)))
    weighed = rows.select(
        "seat", "doc_id", "n_words", (F.octet_length("buckets") / 2).cast("long").alias("n_features"),
        weight_of(F.col("buckets"), gain).alias("weight"), (F.col("n_words") >= least_words).alias("able"),
    ).withColumn("score", F.col("weight") + noise)
    able = rows.filter(F.col("n_words") >= least_words).count()
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("seat")]
    placed = numbered(weighed, *order, into="place")
    rank = F.when(F.col("able") & (F.col("place") < percent * able // 100), F.col("place").cast("long") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def drawn(docs: DataFrame, scores: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id was drawn."""
    ids = scores.filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"))
    return docs.join(ids, F.col(f"`{doc_id}`").eqNullSafe(F.col("_drawn")), "left_semi")
