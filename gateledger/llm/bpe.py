"""Byte-level BPE: encoding by folded merges of distinct words, decoding by joined pieces.

A text is cut into words by the splitting pattern. A task encodes each distinct word once, by
folding merges over the array of its bytes: of all neighbours that together have a rank, the leftmost
of lowest rank become one, until none has. The rank map goes to the tasks as a literal of their
function. Nothing is shuffled, and what a task remembers is bounded.

The fold runs in Python. The same fold in Spark's higher-order functions gives the same ids, but its
nested lambdas are interpreted and took several times the allowed CPU time; README has the figures.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateledger.llm.tables import give_back, portions, whole, with_both

MEMO = 200_000  # distinct words that a task holds apart; it remembers at most twice as many
SHORT = 64  # bytes up to which a scan for the lowest rank beats a heap
NONE = 1 << 62  # the rank of what is no token


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Words(dict):
    """Ids of words by word, little-endian; a word is encoded when it is first asked for.

    Beyond ``memo`` words the ones asked for since the last time are kept apart and the older ones are dropped,
    so that what is asked for again and again is not encoded again. At most twice ``memo`` are remembered.
    """

    def __init__(self, ranks: dict[bytes, int], memo: int = MEMO):
        self.ranks, self.memo = ranks, memo
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            data = word.encode()
            ids = self.folded(data) if len(data) <= SHORT else self.folded_long(data)
            packed = pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.memo:
            self.older = dict(self)
            self.clear()
        self[word] = packed
        return packed

    def rank(self, piece: bytes) -> int:
        return self.ranks.get(piece, NONE)

    def folded(self, data: bytes) -> list[int]:
        rank = self.ranks.get
        cuts = list(range(len(data) + 1))  # where pieces begin, and the end
        pairs = [rank(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while pairs and (low := min(pairs)) != NONE:
            i = pairs.index(low)
            del pairs[i], cuts[i + 1]
            if i:
                pairs[i - 1] = rank(data[cuts[i - 1] : cuts[i + 1]], NONE)
            if i < len(pairs):
                pairs[i] = rank(data[cuts[i] : cuts[i + 2]], NONE)
        return [self.ranks[data[a:b]] for a, b in pairwise(cuts)]

    def folded_long(self, data: bytes) -> list[int]:
        """The same merges for a long word: pieces are linked, and pairs wait in a heap by rank and place."""
        n = len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by the start of a piece; 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.rank(data[i : i + 2])) != NONE]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:
                continue  # one of the two has been merged since
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := self.rank(data[i : ends[end]])) != NONE:
                    heappush(heap, (r, i, ends[end]))
            left = before[i]
            if left >= 0 and (r := self.rank(data[left:end])) != NONE:
                heappush(heap, (r, left, end))
        return [self.ranks[data[i:e]] for i, e in enumerate(ends) if e]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", into: str = "tokens") -> DataFrame:
    """All rows of ``docs`` with their ids in ``into``: unsigned 32-bit numbers, little-endian, as binary.

    ``pattern`` cuts a text into words that are encoded by themselves; every single byte must have a
    rank. There are no special tokens. Null is empty and has no ids. A column called ``into`` is
    replaced; others are kept whatever their names.
    """

    @F.arrow_udf(T.BinaryType())
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coded = encoder(ranks, pattern)
        for texts in chain.from_iterable(map(portions, batches)):
            yield pa.array([coded(text.as_py()) for text in texts], pa.binary())
        give_back()

    return docs.withColumn(into, ids_of(whole(text)))


def encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[str], bytes]:
    """The packed ids of a text; the words of earlier ones are remembered."""
    import regex

    find, words = regex.compile(pattern).findall, Words(ranks)

    def coded(text: str) -> bytes:
        return b"".join(map(words.__getitem__, find(text)))

    return coded


def n_tokens(tokens: str | Column = "tokens") -> Column:
    return (F.octet_length(tokens) / 4).cast("long")


def decode(docs: DataFrame, ranks: dict[bytes, int], tokens: str = "tokens", into: str = "decoded") -> DataFrame:
    """All rows with the bytes of their ids in ``into`` (replaced if there): their pieces joined.

    Null ids give null. An id without a piece is an error.
    """

    @F.arrow_udf(T.BinaryType())
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        joined = decoder(ranks)
        for ids in chain.from_iterable(map(portions, batches)):
            yield pa.array([None if t is None else joined(t) for t in ids.to_pylist()], pa.binary())

    return docs.withColumn(into, bytes_of(tokens))


def decoder(ranks: dict[bytes, int]) -> Callable[[bytes], bytes]:
    """The bytes of packed ids."""
    piece = {rank: token for token, rank in ranks.items()}.__getitem__

    def joined(ids: bytes) -> bytes:
        try:
            return b"".join(map(piece, np.frombuffer(ids, dtype="<u4").tolist()))
        except KeyError as e:
            raise ValueError(f"id {e} has no piece") from None

    return joined


def there_and_back(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", into: str = "tokens", back: str = "decoded"
) -> DataFrame:
    """:func:`encode`, and :func:`decode` of the ids it made, in one Python worker a task.

    One after the other they are two steps of a plan, and each task has a worker for either at the same time.
    """

    @F.arrow_udf(T.StructType().add("ids", T.BinaryType()).add("back", T.BinaryType()))
    def both_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coded, joined = encoder(ranks, pattern), decoder(ranks)
        for texts in chain.from_iterable(map(portions, batches)):
            ids = [coded(text.as_py()) for text in texts]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(joined, ids), pa.binary())], ["ids", "back"])
        give_back()

    return with_both(docs, both_of(whole(text)), into, back)
