"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding follows the vocabulary's merges: an agenda holds the adjacent pairs of symbols that together
are a piece, highest score first, the leftmost of equal ones; the best pair becomes one symbol and its
new neighbours enter the agenda. What is left without a piece is spelled in byte pieces.

Where no piece of the vocabulary has a space after another sign, merges never cross the place before a
space, so a text is cut there and a task merges each distinct stretch once. The new stretches of every
Arrow batch are checked against the sentencepiece library; one that comes out otherwise is an error.
"""

from __future__ import annotations

import re
import struct
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateledger.llm.tables import give_back, portions, whole, with_both

SPACE = "\u2581"  # how a vocabulary writes a space
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
BPE = 2  # the model type of merge vocabularies
MEMO_CHARS = 2_000_000  # characters of the distinct stretches a task remembers before it starts afresh
SHORT = 40  # characters up to which stretches are merged side by side, longer ones each by a heap
NONE = (1 << 31) - 1  # the rank of what is no piece
UNKNOWN_SIGN, PAD = -1, -2  # symbols of a character that is no piece, and of no character
REPLACEMENT = "�".encode()


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, message[at : at + size]
        at += size


class Vocabulary:
    """Pieces of a model file, their scores, and the ids around a text.

    Refused with a ValueError: model types other than BPE, a normaliser that changes texts, vocabularies
    without byte pieces, pieces that are user-defined or unused.
    """

    def __init__(self, model: bytes):
        self.model = model
        message = list(fields(model))
        trainer = dict(next((v for f, v in message if f == 2), b"") and fields(next(v for f, v in message if f == 2)))
        norm = dict(fields(next(v for f, v in message if f == 3)))
        if trainer.get(3, 1) != BPE or trainer.get(24, 0):
            raise ValueError("only merge vocabularies with spaces before words are known")
        if norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError("only the identity normaliser with a leading space is known")
        scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.kinds: list[int] = []
        self.surface: list[bytes] = []  # what each id adds to a text
        for id_, (_, entry) in enumerate((f, v) for f, v in message if f == 1):
            parts = dict(fields(entry))
            piece, kind = parts[1].decode(), parts.get(3, NORMAL)
            self.kinds.append(kind)
            if kind == NORMAL:
                self.ids[piece], scores[piece] = id_, struct.unpack("<f", parts.get(2, bytes(4)))[0]
                self.surface.append(piece.replace(SPACE, " ").encode())
            elif kind == BYTE:
                self.bytes[int(piece[1:-1], 16)] = id_
                self.surface.append(bytes([int(piece[1:-1], 16)]))
            elif kind in (UNKNOWN, CONTROL):
                self.surface.append(trainer.get(44, b" \xe2\x81\x87 ") if kind == UNKNOWN else b"")
            else:
                raise ValueError(f"piece {piece!r} is of a kind that is not known")
        if len(self.bytes) < 256:
            raise ValueError("only vocabularies with all byte pieces are known")
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        by_score = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks: dict[tuple[int, int], int] = {}  # of pairs of pieces that together are one, the best score first
        self.merged: dict[tuple[int, int], int] = {}
        for piece, id_ in self.ids.items():
            for k in range(1, len(piece)):
                if (left := self.ids.get(piece[:k])) is not None and (right := self.ids.get(piece[k:])) is not None:
                    self.ranks[left, right], self.merged[left, right] = by_score[scores[piece]], id_
        # where no piece goes on with a space after another sign, no merge crosses the place before a space
        crossing = any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        self.stretch = re.compile(r"(?s).+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read())


class Spoken(NamedTuple):
    """What decoding needs of a vocabulary."""

    surface: list[bytes]
    kinds: list[int]


class Agendas:
    """The agendas of many stretches at once: a row of symbols each, and a row of the ranks of its pairs.

    In every round the best pair of each row, the leftmost of equals, becomes one symbol, and the ranks of its
    two new neighbours are looked up; a row without a pair that is a piece is done.
    """

    def __init__(self, v: Vocabulary):
        keys = np.array([left << 32 | right for left, right in v.ranks], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank = np.append(np.array([*v.ranks.values()], np.int32)[order], NONE)
        self.both = np.append(np.array([*v.merged.values()], np.int32)[order], UNKNOWN_SIGN)
        self.sign = np.full(0x110000, UNKNOWN_SIGN, np.int32)
        for piece, id_ in v.ids.items():
            if len(piece) == 1:
                self.sign[ord(piece)] = id_

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged ids of pairs; NONE where a pair is no piece."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        there = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(there, self.rank[at], NONE), self.both[at]

    def symbols(self, stretches: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Numbers of stretches, and their symbols in rows filled up with PAD, as the rows get done."""
        lengths = np.fromiter(map(len, stretches), np.int64, count=len(stretches))
        width = max(2, int(lengths.max()))
        codes = np.frombuffer("".join([s.ljust(width) for s in stretches]).encode("utf-32-le"), "<u4").reshape(-1, width)
        rows = np.where(np.arange(width) < lengths[:, None], self.sign[codes], PAD)
        ranks, _ = self.looked_up(rows[:, :-1], rows[:, 1:])
        number, done = np.arange(len(rows)), []
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            open_ = ranks[np.arange(len(rows)), best] < NONE if ranks.shape[1] else np.zeros(len(rows), bool)
            done.append((number[~open_], rows[~open_]))
            rows, ranks, number, best = rows[open_], ranks[open_], number[open_], best[open_]
            if not len(rows):
                break
            line, wide = np.arange(len(rows)), rows.shape[1]
            _, one = self.looked_up(rows[line, best], rows[line, best + 1])
            rows[line, best] = one
            rows = rows[np.arange(wide) != best[:, None] + 1].reshape(len(rows), wide - 1)
            ranks = ranks[np.arange(wide - 1) != best[:, None]].reshape(len(rows), wide - 2)
            for at, some in ((best - 1, best > 0), (best, best < wide - 2)):
                l, a = line[some], at[some]
                ranks[l, a], _ = self.looked_up(rows[l, a], rows[l, a + 1])
        return done


class Stretches(dict):
    """Ids of stretches of text, packed. New ones are merged by the agenda and held against the library."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.other, self.chars = vocabulary, library(vocabulary.model), 0
        self.agendas = Agendas(vocabulary)

    def learn(self, stretches: set[str]) -> None:
        if self.chars > MEMO_CHARS:
            self.clear()
            self.chars = 0
        new = sorted(stretches.difference(self), key=len)
        self.chars += sum(map(len, new))
        self.update(zip(new, self.merged(new)))
        # a stretch begins with the sign that the library sets before a text, unless the text is empty
        told = [s for s in new if len(s) > 1]
        theirs = self.other.encode([s[1:].replace(SPACE, " ") for s in told], num_threads=1)
        mine = list(map(self.__getitem__, told))
        alike = list(map(len, mine)) == [4 * len(ids) for ids in theirs]
        if not alike or b"".join(mine) != array("I", chain.from_iterable(theirs)).tobytes():
            raise ValueError("the library encodes a text otherwise")

    def merged(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches that are sorted by length."""
        out = [b""] * len(stretches)
        start = 0
        for most in (8, 12, 20, SHORT):
            end = bisect_right(stretches, most, start, key=len)
            if end > start:
                for numbers, rows in self.agendas.symbols(stretches[start:end]):
                    flat, ends = rows[rows != PAD].astype("<u4").tobytes(), np.cumsum((rows != PAD).sum(axis=1)).tolist()
                    odd = (rows == UNKNOWN_SIGN).any(axis=1).tolist()
                    for k, (at, upto) in enumerate(zip(numbers.tolist(), ends)):
                        first = ends[k - 1] if k else 0
                        out[start + at] = self.spelled(stretches[start + at], rows[k].tolist()) if odd[k] else flat[4 * first : 4 * upto]
            start = end
        for at in range(start, len(stretches)):
            symbols = [self.v.ids.get(c, UNKNOWN_SIGN) for c in stretches[at]]
            out[at] = self.spelled(stretches[at], self.merged_long(symbols))
        return out

    def merged_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap for an agenda: symbols are linked, and entries that no longer hold are passed over."""
        rank, both = self.v.ranks.get, self.v.merged
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i) for i, pair in enumerate(pairwise(symbols)) if (r := rank(pair)) is not None]
        heapify(agenda)
        gone = None
        while agenda:
            best, i = heappop(agenda)
            k = after[i]
            if symbols[i] is gone or k >= n or rank((symbols[i], symbols[k])) != best:
                continue
            symbols[i], symbols[k], after[i] = both[symbols[i], symbols[k]], gone, after[k]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (r := rank((symbols[left], symbols[after[left]]))) is not None:
                    heappush(agenda, (r, left))
        return [x for x in symbols if x is not gone]

    def spelled(self, s: str, symbols: list[int]) -> bytes:
        """Packed ids, with byte pieces for characters that are no piece; each has kept its own symbol."""
        unknown = iter([c for c in s if c not in self.v.ids])
        ids = array("I")
        for x in symbols:
            if x == UNKNOWN_SIGN:
                ids.extend(map(self.v.bytes.__getitem__, next(unknown).encode()))
            elif x != PAD:
                ids.append(x)
        return ids.tobytes()

    def encoded(self, texts: list[str]) -> list[bytes]:
        cut_up = [self.v.stretch.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.learn(set().union(*cut_up))
        return [b"".join(map(self.__getitem__, parts)) for parts in cut_up]


def library(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "tokens") -> DataFrame:
    """All rows of ``docs`` with their ids in ``into``: unsigned 32-bit numbers, little-endian, as binary.

    The ids of begin and end stand around every text. Strings that look like special pieces are
    ordinary text. Null is empty and has these two ids alone. Repeated rows come out alike. A column
    called ``into`` is replaced; others are kept whatever their names. A text is held whole in a task.
    """

    @F.arrow_udf(T.BinaryType())
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coded = encoder(vocabulary)
        for texts in chain.from_iterable(map(portions, batches)):
            yield pa.array(coded(texts.to_pylist()), pa.binary())
        give_back()

    return docs.withColumn(into, ids_of(whole(F.col(f"`{text}`"))))


def encoder(vocabulary: Vocabulary) -> Callable[[list[str]], list[bytes]]:
    """The packed ids of texts, begin and end around them; stretches of earlier ones are remembered."""
    known = Stretches(vocabulary)
    begin, end = (array("I", [x]).tobytes() for x in (vocabulary.begin, vocabulary.end))
    return lambda texts: [begin + ids + end for ids in known.encoded(texts)]


def n_tokens(tokens: str | Column = "tokens") -> Column:
    return (F.octet_length(tokens) / 4).cast("long")


def valid(spelled: bytes) -> bytes:
    """UTF-8 with the replacement character for each byte that begins no character."""
    out = []
    while spelled:
        try:
            out.append(spelled.decode().encode())
            break
        except UnicodeDecodeError as e:
            out += [spelled[: e.start], REPLACEMENT]
            spelled = spelled[e.start + 1 :]
    return b"".join(out)


def text_of(ids: list[int], v: Vocabulary | Spoken) -> bytes:
    """The text of ids in UTF-8: pieces joined, runs of byte pieces read as characters."""
    joined = b"".join(map(v.surface.__getitem__, ids))
    first = next((i for i in ids if v.kinds[i] != CONTROL), None)
    lead = first is not None and v.kinds[first] == NORMAL and joined[:1] == b" "
    try:
        joined.decode()
    except UnicodeDecodeError:
        parts, spelled = [], b""
        for i in ids:
            if v.kinds[i] == BYTE:
                spelled += v.surface[i]
            else:
                parts += [valid(spelled), v.surface[i]]
                spelled = b""
        joined = b"".join([*parts, valid(spelled)])
    return joined[1:] if lead else joined


def decode(docs: DataFrame, vocabulary: Vocabulary, tokens: str = "tokens", into: str = "decoded") -> DataFrame:
    """All rows with the text of their ids in ``into`` (replaced if there).

    Begin and end add nothing, nor does the space before the first word. Null ids give null. An id
    that the vocabulary does not hold is an error.
    """

    spoken, model = Spoken(vocabulary.surface, vocabulary.kinds), vocabulary.model

    @F.arrow_udf(T.StringType())
    def texts_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spelled = decoder(spoken, library(model))
        for coded in chain.from_iterable(map(portions, batches)):
            yield pa.array(spelled(coded.to_pylist()), pa.string())
        give_back()

    return docs.withColumn(into, texts_of(F.col(f"`{tokens}`")))


def decoder(spoken: Spoken, other) -> Callable[[list[bytes | None]], list[str | None]]:
    """The texts of packed ids, each held against the library."""

    def spelled(coded: list[bytes | None]) -> list[str | None]:
        rows = [None if c is None else np.frombuffer(c, "<u4").tolist() for c in coded]
        if any(max(r) >= len(spoken.kinds) for r in rows if r):
            raise ValueError("an id is not in the vocabulary")
        texts = [None if r is None else text_of(r, spoken).decode() for r in rows]
        theirs = iter(other.decode([r for r in rows if r is not None], num_threads=1))
        if any(t != next(theirs) for t in texts if t is not None):
            raise ValueError("the library decodes a text otherwise")
        return texts

    return spelled


def there_and_back(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "tokens", back: str = "decoded") -> DataFrame:
    """:func:`encode`, and :func:`decode` of the ids it made, in one Python worker a task.

    One after the other they are two steps of a plan, and each task has a worker for either at the same time.
    """

    @F.arrow_udf(T.StructType().add("ids", T.BinaryType()).add("back", T.StringType()))
    def both_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coded = encoder(vocabulary)
        spelled = decoder(Spoken(vocabulary.surface, vocabulary.kinds), library(vocabulary.model))
        for texts in chain.from_iterable(map(portions, batches)):
            ids = coded(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(spelled(ids), pa.string())], ["ids", "back"])
        give_back()

    return with_both(docs, both_of(whole(F.col(f"`{text}`"))), into, back)
