"""Exact removal of repeated substrings: suffixes sorted bucket by bucket, sifted by a difference cover.

Two equal strings of WIDTH bytes at any two places share, at some shift below PERIOD, a place that
belongs to the cover in both: the residues COVER have every difference modulo PERIOD. So a suffix
can only repeat WIDTH bytes of another if one of the cover samples within its first PERIOD bytes has
a first part (of WIDTH - PERIOD + 1 bytes) that occurs at another sample too.

1. Cover samples are named by their first part and dealt to buckets by name; each bucket is sorted by
   itself and tells which samples occur again.
2. The suffixes that hold such a sample are named by their first WIDTH bytes and dealt to buckets
   likewise; each bucket is sorted by itself, one at a time, by name, document and place, and
   tells which suffixes come after an equal one.
3. Each document loses the bytes that those suffixes' first WIDTH bytes cover.

Only equality of fixed lengths matters here, so the rank of a suffix is a 64-bit name of its prefix
rather than its place in the alphabet, and ties need no further text. The bucket of a suffix comes from
a second, independent name, so that different strings are taken for equal only where 64 bits and the
bucket agree. Names travel in the order of their places, so a bucket answers with one bit for each. Later copies of a whole text are known by their digest and take no part in 1
and 2.

Texts are read once, into a table of compressed blocks that is bucketed by block, so that answers
meet the texts again without the texts being shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.llm.tables import cut, whole

WIDTH = 100
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)  # a perfect difference set modulo 57
BLOCK_BYTES = 4 << 20
SEGMENT = 1 << 20
BUCKET_BYTES = 12 << 20  # of text, by which the number of buckets grows
BUCKETS = 64  # at least
FILES = 32 << 20
MOST_FILES = 50_000
LAST = 2**63 - 1  # the place of documents without an id

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
OTHERS = mixed(VALUES ^ np.uint64(0xD6E8FEB86659FD93))  # for a second name that does not depend on the first
POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(SEGMENT + WIDTH, BASE, dtype=np.uint64))])
INVERSES = np.concatenate([[np.uint64(1)], np.cumprod(np.full(SEGMENT + WIDTH, INVERSE, dtype=np.uint64))])


def names(raw: np.ndarray, at: np.ndarray, length: int, values: np.ndarray = VALUES) -> np.ndarray:
    """64-bit names of raw[i : i + length] for the places i of ``at`` (sorted); equal strings, equal names."""
    out = np.empty(len(at), dtype=np.uint64)
    for start in range(0, len(raw), SEGMENT):
        lo, hi = np.searchsorted(at, [start, start + SEGMENT])
        if lo == hi:
            continue
        part = raw[start : start + SEGMENT + length]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(values[part] * POWERS[: len(part)], out=sums[1:])
        i = at[lo:hi] - start
        out[lo:hi] = mixed((sums[i + length] - sums[i]) * INVERSES[i])
    return out


def dealt(found: np.ndarray, n_buckets: int, by_value: bool) -> tuple[np.ndarray, np.ndarray]:
    """The order in which names go to buckets, and where each bucket starts in it.

    Within a bucket they stand by their low 32 bits (``by_value``) or by their places.
    """
    bucket = (found >> np.uint64(48)) * np.uint64(n_buckets) >> np.uint64(16)
    if by_value:
        order = np.argsort(bucket << np.uint64(32) | found & np.uint64(0xFFFFFFFF), kind="stable")
    else:
        order = np.argsort(bucket.astype(np.uint16) if n_buckets <= 1 << 16 else bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))


def planes(values: np.ndarray, n_bytes: int) -> bytes:
    """The low bytes of whole numbers, byte by byte, so that even parts compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).tobytes()


def from_planes(data: bytes, n_bytes: int) -> np.ndarray:
    flat = np.frombuffer(data, dtype=np.uint8).reshape(n_bytes, -1)
    wide = np.zeros((flat.shape[1], 8), dtype=np.uint8)
    wide[:, :n_bytes] = flat.T
    return wide.view("<u8").ravel()


class Block:
    """The documents of a block of which no earlier copy is known, as one row of bytes."""

    def __init__(self, row, copies: bytes | None):
        self.ids = np.asarray(row.ids, dtype=np.int64)
        self.sizes = np.asarray(row.sizes, dtype=np.int64)
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.body), dtype=np.uint8)
        n = len(self.ids)
        self.copy = np.unpackbits(np.frombuffer(copies, dtype=np.uint8), count=n).astype(bool) if copies else np.zeros(n, bool)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def places(self, residues: tuple[int, ...] | None, length: int) -> np.ndarray:
        """Where ``length`` bytes of a document start, at the residues of the cover or everywhere."""
        out = []
        for start, size, copy in zip(self.starts.tolist(), self.sizes.tolist(), self.copy.tolist()):
            if copy or size < length:
                continue
            if residues is None:
                out.append(np.arange(start, start + size - length + 1))
            else:
                grid = (np.arange(0, size - length + 1, PERIOD)[:, None] + np.array(residues)).ravel()
                out.append(start + grid[grid <= size - length])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def samples(self, n_buckets: int):
        at = self.places(COVER, WIDTH - PERIOD + 1)
        found = names(self.raw, at, WIDTH - PERIOD + 1)
        return at, found, *dealt(found, n_buckets, by_value=True)

    def suffixes(self, answers: dict[int, bytes], n_buckets: int):
        """Suffixes that hold a sample which occurs again."""
        at, _, order, edges = self.samples(n_buckets)
        again = placed(answers, order, edges)
        holds = np.zeros(len(self.raw) + 1, dtype=np.int32)
        holds[at[again] + 1] = 1
        upto = np.cumsum(holds)
        own = self.places(None, WIDTH)
        own = own[upto[np.minimum(own + PERIOD, len(self.raw))] > upto[own]]
        where = names(self.raw, own, WIDTH, OTHERS)
        return own, names(self.raw, own, WIDTH), *dealt(where, n_buckets, by_value=False)


def placed(answers: dict[int, bytes], order: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The answers of all buckets, in the order of places."""
    out = np.zeros(len(order), dtype=bool)
    for bucket, bits in answers.items():
        lo, hi = int(edges[bucket]), int(edges[bucket + 1])
        out[order[lo:hi]] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=hi - lo).astype(bool)
    return out


def noted(notes: pd.DataFrame) -> tuple[bytes | None, dict[int, bytes], dict[int, bytes]]:
    by_kind: dict[str, dict[int, bytes]] = {"copies": {}, "samples": {}, "suffixes": {}}
    for r in notes.itertuples():
        by_kind[r.kind][r.bucket] = r.bits
    return by_kind["copies"].get(0), by_kind["samples"], by_kind["suffixes"]


def blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of whole texts: block, ids, sizes, digests, body."""
    task, k = TaskContext.get().partitionId(), 0
    ids, bodies, held = [], [], 0

    def made() -> pd.DataFrame:
        return pd.DataFrame({
            "block": [task << 32 | k], "ids": [ids], "sizes": [[len(b) for b in bodies]],
            "digests": [[hashlib.sha256(b).digest()[:16] for b in bodies]],
            "body": [zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))],
        })

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"]):
            ids.append(doc_id)
            bodies.append(text.encode())
            held += len(bodies[-1])
            if held >= BLOCK_BYTES:
                yield made()
                k, ids, bodies, held = k + 1, [], [], 0
    if bodies:
        yield made()


def copies_of(table: DataFrame) -> DataFrame:
    """block, kind, bucket, bits: which documents of a block have an earlier copy."""
    docs = table.select("block", F.posexplode(F.arrays_zip("ids", "digests")).alias("nth", "d"))
    docs = docs.select("block", "nth", F.col("d.ids").alias("id"), "d.digests")
    first = docs.groupBy(F.col("digests").alias("digest")).agg(
        F.min(F.struct("id", "block", "nth")).alias("first"), F.count("*").alias("n")
    ).filter("n > 1")
    later = docs.join(first, F.col("digests") == F.col("digest")).filter(F.struct("id", "block", "nth") != F.col("first"))

    def bits(rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(int(rows["nth"].max()) // 8 * 8 + 8, dtype=bool)
        flags[rows["nth"].to_numpy()] = True
        return pd.DataFrame({"block": rows["block"].iloc[:1], "kind": "copies", "bucket": 0, "bits": [np.packbits(flags).tobytes()]})

    return later.select("block", "nth").groupBy("block").applyInPandas(bits, NOTES)


NOTES = "block long, kind string, bucket int, bits binary"
SENT = "bucket int, block long, body binary"


def sample_names(n_buckets: int):
    def run(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        out, press = [], zstandard.ZstdCompressor(level=1)
        copies, _, _ = noted(notes)
        for row in rows.itertuples():
            _, found, order, edges = Block(row, copies).samples(n_buckets)
            low = (found & np.uint64(0xFFFFFFFF))[order]
            for b in np.flatnonzero(np.diff(edges)).tolist():
                steps = np.diff(low[edges[b] : edges[b + 1]], prepend=np.uint64(0))
                out.append((b, row.block, press.compress(planes(steps, 4))))
        return pd.DataFrame(out, columns=["bucket", "block", "body"])

    return run


def sample_answers(rows: pd.DataFrame) -> pd.DataFrame:
    """Which samples of a bucket occur at another place too."""
    unpress = zstandard.ZstdDecompressor()
    parts = [np.cumsum(from_planes(unpress.decompress(b), 4)).astype(np.uint32) for b in rows["body"]]
    values = np.concatenate(parts)
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    again = np.zeros(len(values), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return answers(rows, "samples", again, [len(p) for p in parts])


def suffix_names(n_buckets: int):
    def run(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        out, press = [], zstandard.ZstdCompressor(level=1)
        copies, samples, _ = noted(notes)
        for row in rows.itertuples():
            block = Block(row, copies)
            own, found, order, edges = block.suffixes(samples, n_buckets)
            doc = np.searchsorted(block.starts, own, side="right") - 1
            for b in np.flatnonzero(np.diff(edges)).tolist():
                mine = order[edges[b] : edges[b + 1]]
                docs, counts = np.unique(doc[mine], return_counts=True)
                head = np.concatenate([[len(docs)], block.ids[docs], counts]).astype("<i8").tobytes()
                out.append((b, row.block, press.compress(head + planes(found[mine], 8))))
        return pd.DataFrame(out, columns=["bucket", "block", "body"])

    return run


def suffix_answers(rows: pd.DataFrame) -> pd.DataFrame:
    """Which suffixes of a bucket stand behind an equal one, by document and place."""
    unpress, values, ids, sizes = zstandard.ZstdDecompressor(), [], [], []
    rows = rows.sort_values("block")
    for body in rows["body"]:
        data = unpress.decompress(body)
        n = int(np.frombuffer(data, dtype="<i8", count=1)[0])
        head = np.frombuffer(data, dtype="<i8", count=2 * n, offset=8)
        values.append(from_planes(data[8 + 16 * n :], 8))
        ids.append(np.repeat(head[:n], head[n:]))
        sizes.append(len(values[-1]))
    name, doc = np.concatenate(values), np.concatenate(ids)
    by_doc = np.argsort(doc, kind="stable")
    order = by_doc[np.argsort(name[by_doc], kind="stable")]
    later = np.zeros(len(name), dtype=bool)
    later[order[1:][name[order][1:] == name[order][:-1]]] = True
    return answers(rows, "suffixes", later, sizes)


def answers(rows: pd.DataFrame, kind: str, flags: np.ndarray, sizes: list[int]) -> pd.DataFrame:
    ends = np.cumsum(sizes)
    bits = [np.packbits(flags[e - n : e]).tobytes() for n, e in zip(sizes, ends.tolist())]
    return pd.DataFrame({"block": rows["block"].to_numpy(), "kind": kind, "bucket": rows["bucket"].to_numpy(), "bits": bits})


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string"


def removals(n_buckets: int):
    def run(rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        out = []
        copies, samples, suffixes = noted(notes)
        for row in rows.itertuples():
            block = Block(row, copies)
            own, _, order, edges = block.suffixes(samples, n_buckets)
            at = own[placed(suffixes, order, edges)]
            change = np.zeros(len(block.raw) + 1, dtype=np.int32)
            change[at] += 1
            change[at + WIDTH] -= 1
            gone = np.cumsum(change[:-1]) > 0
            for doc_id, start, size, copy in zip(block.ids.tolist(), block.starts.tolist(), block.sizes.tolist(), block.copy.tolist()):
                mine = gone[start : start + size]
                if copy and size >= WIDTH:
                    mine = np.ones(size, dtype=bool)
                edge = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                kept = block.raw[start : start + size][~mine].tobytes()
                spans = [{"start": a, "end": b} for a, b in edge.tolist()]
                out.append((doc_id, size, int(mine.sum()), spans, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    return run


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (of removed bytes, end exclusive), kept_sha256 of every row.

    A byte goes if a string of WIDTH bytes that covers it also starts earlier: in a row of smaller id,
    or in the same row. Rows that share an id, and rows without one, which come last, stand in the
    order in which they are read. Null is empty. Texts of fewer than WIDTH bytes lose nothing.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), whole(text).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_buckets, n_files = max(BUCKETS, -(-total // BUCKET_BYTES)), max(8, min(MOST_FILES, -(-total // FILES)))
    name = f"text_blocks_{uuid.uuid4().hex}"
    blocks = texts.mapInPandas(blocked, "block long, ids array<long>, sizes array<int>, digests array<binary>, body binary")
    blocks.write.format("parquet").bucketBy(n_files, "block").saveAsTable(name)
    try:
        table = spark.table(name)
        bodies = table.select("block", "ids", "sizes", "body").groupBy("block")
        notes = cut(copies_of(table))
        sent = bodies.cogroup(notes.groupBy("block")).applyInPandas(sample_names(n_buckets), SENT)
        notes = notes.union(cut(sent.groupBy("bucket").applyInPandas(sample_answers, NOTES)))
        sent = bodies.cogroup(notes.groupBy("block")).applyInPandas(suffix_names(n_buckets), SENT)
        notes = notes.union(cut(sent.groupBy("bucket").applyInPandas(suffix_answers, NOTES)))
        found = bodies.cogroup(notes.groupBy("block")).applyInPandas(removals(n_buckets), RESULT)
        return cut(found.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST))))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
