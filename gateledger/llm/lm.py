"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams.

The model learns from the trusted texts of each language: counts of runs of ORDER characters, and
from them the counts of continuations of all shorter runs. Counts, contexts and probabilities are
tables, sharded by run, and only joins bring them together. Texts are cut into blocks; the distinct
runs of a block get their probabilities from those tables and meet the block's texts again, which
sum them up. A document goes if its perplexity is above its language's threshold, a quantile of the
trusted texts' perplexities with a margin. Words repeated on and on look like the language to such a
model, so a text goes as well if half of its words stand for a repetition (:func:`repeats`).

Runs of white space are one space, and digits are all the same digit, before anything is counted.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger.llm.tables import blocks_for, cut, give_back, lean, set_aside, sized, whole

ORDER = 4
START = "\n"  # stands before the first character of a text, ORDER - 1 times
ALPHABET = 1 << 16  # characters that share what even single characters leave over
BLOCK_CHARS = 24 << 20
TASK_BYTES = 12 << 20  # text that a task takes at least, however many splits it comes in
SALTS = 32  # copies of a language's one row, so that a hot language meets it in many tasks
PART_CHARS = 1 << 19  # worked on at a time
TABLE = 1 << 23  # values up to this are numbered by a table, larger ones by sorting
QUANTILE = 0.99
MARGIN = 2.0
ACCURACY = 10_000
REPEATED = 0.5  # share of words that equal the one a few before, from which a text repeats itself
PERIOD = 4  # words, at most
FEWEST = 10  # words of a text that can repeat itself

SPACE = re.compile(r"\s+")
NUMERAL = re.compile(r"[0-9]")
NO_LANGUAGE = ""


def kind(c: str) -> int:
    """3: capital, 2: other letter, 1: space or plain punctuation, 0: anything else."""
    return 3 if c.isupper() else 2 if c.isalpha() else int(c.isspace() or c in ",.;:'?-")


KINDS = np.array([kind(chr(c)) for c in range(0x3000)] + [2], dtype=np.int8)  # what lies beyond counts as letters


def normalised(text: str) -> str:
    return NUMERAL.sub("0", SPACE.sub(" ", text).strip())


def trusted_form(texts: list[str]) -> np.ndarray:
    """Which texts have the form of running prose, which the model trusts where nobody says more.

    97% of the characters are letters, spaces or plain punctuation, at most a tenth of the letters are
    capitals, words have two to eleven characters on average, and not too many of them are the same.
    Texts of under a hundred characters are not trusted.
    """
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    ends = np.cumsum(lengths)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[ends] - sums[ends - lengths]

    kinds = KINDS[np.minimum(codes, len(KINDS) - 1)]
    letters, capitals, prose = per_text(kinds >= 2), per_text(kinds == 3), per_text(kinds >= 1)
    n_words, varied = np.ones(len(texts)), np.zeros(len(texts), dtype=bool)
    for k, text in enumerate(texts):
        words = text.split()
        n_words[k] = max(1, len(words))
        varied[k] = len(set(words)) >= len(words) * 5 / (8 + math.sqrt(len(words)))
    mean = lengths / n_words
    return (
        (lengths >= 100) & (prose >= 0.97 * lengths) & (capitals <= 0.1 * np.maximum(letters, 1)) & (mean >= 3) & (mean <= 12) & varied
    )


def repeats(text: str) -> bool:
    """Whether the text repeats one to PERIOD words on and on."""
    words = text.split()
    n = len(words)
    return n >= FEWEST and any(sum(map(eq, words, words[k:])) >= REPEATED * (n - k) for k in range(1, PERIOD + 1))


def number(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and for each value its place among them."""
    if size > TABLE:
        return np.unique(values, return_inverse=True)
    there = np.zeros(size, dtype=bool)
    there[values] = True
    distinct = np.flatnonzero(there)
    place = np.zeros(size, dtype=np.int32)
    place[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, place[values]


class Runs:
    """The runs of ORDER characters of some texts: the distinct ones, and which stands where.

    The runs of text k end at its characters, so they are ``places[starts[k] : starts[k] + lengths[k]]``.
    """

    def __init__(self, texts: list[str], order: int = ORDER):
        pad = START * (order - 1)
        chars = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        codes, at = number(chars, 0x110000)
        alphabet = [chr(c) for c in codes.tolist()]
        grams, places = alphabet, at.astype(np.int64)
        for k in range(1, order):
            wide = places[: len(places) - 1] * len(alphabet) + at[k:]
            distinct, places = number(wide, max(1, len(grams) * len(alphabet)))
            heads, tails = np.divmod(distinct, len(alphabet))
            grams = [grams[h] + alphabet[t] for h, t in zip(heads.tolist(), tails.tolist())]
            places = places.astype(np.int64)
        self.lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.starts = np.cumsum(self.lengths + order - 1) - (self.lengths + order - 1)
        self.grams, self.places = grams, places

    def within(self, chosen: np.ndarray) -> np.ndarray:
        """Which places belong to the chosen texts, rather than to others or the padding between them."""
        edge = np.zeros(len(self.places) + 1, dtype=np.int64)
        np.add.at(edge, np.minimum(self.starts[chosen], len(self.places)), 1)
        np.add.at(edge, np.minimum((self.starts + self.lengths)[chosen], len(self.places)), -1)
        return np.cumsum(edge[:-1]) > 0


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of a task in blocks of about BLOCK_CHARS characters, with a number for each block."""
    task, k, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        held.append(batch)
        size += int(batch["text"].str.len().sum())
        if size >= BLOCK_CHARS:
            yield task << 32 | k, pd.concat(held, ignore_index=True)
            k, held, size = k + 1, [], 0
    if held:
        yield task << 32 | k, pd.concat(held, ignore_index=True)


def portions(texts: list[str]) -> Iterator[slice]:
    """Slices of about PART_CHARS characters."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= PART_CHARS or k + 1 == len(texts):
            yield slice(first, k + 1)
            first, size = k + 1, 0


def trust(rows: pd.DataFrame, texts: list[str]) -> np.ndarray:
    """The caller's word for it, or else the form of the text."""
    said = rows["trusted"].to_numpy(dtype=object)
    form = trusted_form(texts) if any(x is None or x is pd.NA for x in said) else np.zeros(len(texts), dtype=bool)
    return np.array([f if x is None or x is pd.NA else bool(x) for x, f in zip(said, form)], dtype=bool)


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, gram, n: how often the trusted texts of a block hold each run; 0 if only others do."""
    for _, rows in chunks(batches):
        for lang, some in rows.groupby("lang"):
            total: dict[str, int] = {}
            texts = some["text"].tolist()
            for part in portions(texts):
                runs = Runs([normalised(t) for t in texts[part]])
                good = trust(some[part], texts[part])
                n = np.bincount(runs.places[runs.within(good)], minlength=len(runs.grams))
                for gram, more in zip(runs.grams, n.tolist()):
                    total[gram] = total.get(gram, 0) + more
            yield pd.DataFrame({"lang": lang, "gram": list(total), "n": list(total.values())})


def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """block, lang, gram: the distinct runs of each block."""
    for block, rows in chunks(batches):
        for lang, some in rows.groupby("lang"):
            grams: set[str] = set()
            texts = some["text"].tolist()
            for part in portions(texts):
                grams.update(Runs([normalised(t) for t in texts[part]]).grams)
            yield pd.DataFrame({"block": block, "lang": lang, "gram": list(grams)})


def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """block, lang, digest, trusted, repeats, body: the texts of each block, normalised and compressed."""
    press = zstandard.ZstdCompressor(level=3)
    for block, rows in chunks(batches):
        for part in portions(rows["text"].tolist()):
            some = rows[part]
            texts = some["text"].tolist()
            yield pd.DataFrame({
                "block": block, "lang": some["lang"], "digest": [digest(t) for t in texts], "trusted": trust(some, texts),
                "repeats": [repeats(t) for t in texts],
                "body": [press.compress(normalised(t).encode()) for t in texts],
            })


def digest(text: str) -> str:
    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()


def scored(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """lang, digest, trusted, repeats, perplexity of the texts of a block, from the log-probabilities of its runs."""
    unpress, out = zstandard.ZstdDecompressor(), []
    for lang, some in rows.groupby("lang"):
        mine = known[known["lang"] == lang]
        log = dict(zip(mine["gram"], mine["logp"]))
        texts = [unpress.decompress(b).decode() for b in some["body"]]
        perplexity = np.full(len(texts), np.nan)
        for part in portions(texts):
            runs = Runs(texts[part])
            values = np.fromiter((log.get(g, np.nan) for g in runs.grams), dtype=np.float64, count=len(runs.grams))
            own = runs.within(np.ones(len(runs.starts), dtype=bool))
            if np.isnan(values[runs.places[own]]).any():
                raise ValueError("a run of a text is in no table: the texts did not read the same twice")
            sums = np.concatenate([[0.0], np.cumsum(np.where(own, values[runs.places], 0.0))])
            ends = np.minimum(runs.starts + runs.lengths, len(runs.places))
            total = sums[ends] - sums[np.minimum(runs.starts, len(runs.places))]
            some_chars = runs.lengths > 0
            with np.errstate(over="ignore"):
                perplexity[part][some_chars] = np.exp(-total[some_chars] / runs.lengths[some_chars])
        out.append(some[["lang", "digest", "trusted", "repeats"]].assign(perplexity=perplexity))
        del mine, log, texts
        give_back()
    return pd.concat(out) if out else pd.DataFrame(columns=["lang", "digest", "trusted", "repeats", "perplexity"])


def head(gram: str, n: int) -> Column:
    """All but the last character of a run of ``n``."""
    return F.substring(gram, 1, n - 1)


def tail(gram: str, n: int) -> Column:
    """The last ``n`` characters of a run."""
    return F.right(gram, F.lit(n)) if n else F.lit("")


def discounts(level: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: how much is taken from counts of one, two and more."""
    n = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    d = [k - F.try_divide((k + 1) * y * F.col(f"n{k + 1}"), F.col(f"n{k}")) for k in (1, 2, 3)]
    # small or odd samples: a formula may be undefined or leave its range
    safe = [F.when(x.between(0.0, float(k)), x).otherwise(F.lit(0.5 * k)) for k, x in zip((1, 2, 3), d)]
    return level.groupBy("lang").agg(*n).select(F.col("lang").alias("of"), *[x.alias(f"d{k}") for k, x in zip((1, 2, 3), safe)])


def by_language(rows: DataFrame, of: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` with what ``of`` has for their language in its single row, whose key column is ``of``.

    The single row is copied for SALTS groups of rows, which the column ``spread`` deals out.
    """
    copies = of.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_group", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    same = (F.col("lang") == F.col("of")) & (F.col("_group") == F.col("_salt"))
    return salted.join(copies, same, how).drop("of", "_salt", "_group")


def model(counts: DataFrame, n_runs: int, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables by length of run: (lang, gram, p) of what was seen, and (lang, gram, left) of contexts.

    ``counts``: lang, gram, n of the longest runs, ``n_runs`` at most. Shorter runs count the characters that precede
    them. p is the interpolated probability of the last character after the others, and ``left`` the
    share that a context gives to the next shorter one.
    """
    levels = {order: sized(counts, n_runs)}
    for k in range(order - 1, 0, -1):
        shorter = levels[k + 1].groupBy("lang", tail("gram", k).alias("gram")).agg(F.count("*").alias("n"))
        levels[k] = sized(shorter, n_runs)
    seen, contexts, below = [], [], None
    for k in range(1, order + 1):
        level = by_language(levels[k], discounts(levels[k]), "gram")
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.select("lang", "gram", head("gram", k).alias("context"), "n", F.least(off, F.col("n")).alias("off"))
        level = sized(level, n_runs)
        of = level.groupBy("lang", "context").agg(F.sum("n").alias("all"), F.sum("off").alias("taken"))
        of = of.select("lang", F.col("context").alias("gram"), (F.col("taken") / F.col("all")).alias("left"), "all")
        contexts.append(cut(sized(of, n_runs)))
        context = contexts[-1].select(F.col("lang").alias("l"), F.col("gram").alias("c"), "left", "all")
        joined = level.join(context, (F.col("lang") == F.col("l")) & (F.col("context") == F.col("c")))
        if below is None:
            lower = joined.withColumn("lower", F.lit(1.0 / ALPHABET))
        else:
            shorter = below.select(F.col("lang").alias("sl"), F.col("gram").alias("sg"), F.col("p").alias("lower"))
            lower = sized(joined, n_runs).join(shorter, (F.col("lang") == F.col("sl")) & (tail("gram", k - 1) == F.col("sg")))
        p = (F.col("n") - F.col("off")) / F.col("all") + F.col("left") * F.col("lower")
        below = cut(sized(lower.select("lang", "gram", p.alias("p")), n_runs))
        seen.append(below)
    return seen, contexts


def log_probabilities(grams: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, logp for every run, seen in trusted text or not."""
    n_runs = grams.count()
    seen, contexts = model(counts, n_runs, order)
    rows = grams.select("lang", "gram", F.lit(1.0 / ALPHABET).alias("p"))
    for k in range(1, order + 1):
        own = seen[k - 1].select(F.col("lang").alias("l1"), F.col("gram").alias("g1"), F.col("p").alias("known"))
        share = contexts[k - 1].select(F.col("lang").alias("l2"), F.col("gram").alias("g2"), "left")
        rows = rows.withColumn("own", tail("gram", k)).withColumn("context", F.substring("own", 1, k - 1))
        rows = sized(rows.join(own, (F.col("lang") == F.col("l1")) & (F.col("own") == F.col("g1")), "left"), n_runs)
        rows = (
            rows.join(share, (F.col("lang") == F.col("l2")) & (F.col("context") == F.col("g2")), "left")
            .select("lang", "gram", F.coalesce("known", F.coalesce("left", F.lit(1.0)) * F.col("p")).alias("p"))
        )
        rows = sized(rows, n_runs)
    return rows.select("lang", "gram", F.log("p").alias("logp"))


def perplexities(docs: DataFrame, trusted: Column | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, digest, trusted, repeats, perplexity of each distinct row of these; see :func:`judged`."""
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), whole(text).alias("text"),
        (F.lit(None) if trusted is None else trusted).cast("boolean").alias("trusted"),
    )
    # each task lists its own runs, so what is shuffled follows the text only if the tasks do
    rows = rows.coalesce(blocks_for(rows, block_bytes=TASK_BYTES))
    grams = rows.mapInPandas(lean(counted), "lang string, gram string, n long")
    counts = cut(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    logs = cut(log_probabilities(counts.select("lang", "gram"), counts.filter("n > 0")))
    needed = rows.mapInPandas(lean(listed), "block long, lang string, gram string")
    known = needed.join(logs, ["lang", "gram"]).select("block", "lang", "gram", "logp")
    bodies = rows.mapInPandas(lean(packed), "block long, lang string, digest string, trusted boolean, repeats boolean, body binary")
    found = bodies.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(
        scored, "lang string, digest string, trusted boolean, repeats boolean, perplexity double"
    )
    return cut(found.groupBy("lang", "digest").agg(
        F.max("trusted").alias("trusted"), F.first("repeats").alias("repeats"), F.first("perplexity").alias("perplexity")
    ))


def judged(
    docs: DataFrame, trusted: Column | None = None, text: str = "text", lang: str = "lang", quantile: float = QUANTILE,
    margin: float = MARGIN, into: str = "quality",
) -> DataFrame:
    """All rows with a struct ``into`` (replaced if there): perplexity, threshold, repeats, keep.

    ``trusted`` marks the rows whose text the model learns from; where it is null or not given, the form
    of the text says so (:func:`trusted_form`). The threshold of a language is the
    ``quantile`` of the perplexities of its distinct trusted texts, times ``margin``. Null languages are one
    language. A null or blank text has no perplexity; neither it nor a text in a language without
    trusted text is rejected for that. A text that ``repeats`` a few words on and on is rejected whatever
    its perplexity. ``docs`` must read the same rows in the same order twice, as files or
    a checkpoint do; equal texts of a language share one verdict.
    """
    found = perplexities(docs, trusted, text, lang)
    good = found.filter("trusted and perplexity is not null and not isnan(perplexity)")
    limits = good.groupBy(F.col("lang").alias("of")).agg(
        (F.percentile_approx("perplexity", quantile, ACCURACY) * margin).alias("threshold")
    )
    verdicts = by_language(found, limits, "digest", "left").select(
        F.col("lang").alias("_lang"), F.col("digest").alias("_digest"), F.nanvl("perplexity", F.lit(None)).alias("_perplexity"),
        F.col("threshold").alias("_threshold"), F.col("repeats").alias("_repeats"),
    )
    away, back = set_aside(docs, into)
    keyed = docs.select(
        *away,
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("_lang"),
        F.md5(F.encode(whole(text), "UTF-8")).alias("_digest"),
    )
    keep = F.coalesce(F.col("_perplexity") <= F.col("_threshold"), F.lit(True)) & ~F.col("_repeats")
    return keyed.join(verdicts, ["_lang", "_digest"]).select(
        *back, F.struct(
            F.col("_perplexity").alias("perplexity"), F.col("_threshold").alias("threshold"), F.col("_repeats").alias("repeats"),
            keep.alias("keep"),
        ).alias(into)
    )
