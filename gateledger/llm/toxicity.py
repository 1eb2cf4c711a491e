"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings that toxic texts hold and others do not is learned first, from
half of the learning rows. Features of a text are densities of lexicon hits, how near they stand to
a second person, and rates of capitals, punctuation and obfuscated words. Trees learn from the other
rows but a quarter of them, by which their scores are calibrated.

Only the model learns from a sample, of at most SAMPLE rows of each label; every text is scored whole.
A sampled row stands for as many rows of its label as there are for each in the sample, in the trees and
in the calibration, so that a score is a share of all rows however large the table is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateledger.llm.tables import cut, set_aside, whole

SAMPLE = 12_000  # learning rows of each label
LEXICON = 4096  # entries at most, the strongest
LEAST = 4  # toxic texts that hold an entry
STRONG = 0.8  # share of toxic texts among those that hold an entry, labels weighing the same
NEAR = 5  # words
TREES, DEPTH = 12, 3
MEMO = 500_000

WORD = re.compile(r"[^\W_](?:[\w@$*!|]*\w)?")
YOU = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer sie tu te toi ton ta tes vous "
    "votre vos tú ti tuyo tuya usted ustedes vosotros vuestro".split()
)
LEET = str.maketrans("013457@$!|", "oieastasii")
SIGNS = re.compile(r"[^\w\s]")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
FEATURES = ("density", "hits", "strength", "kinds", "longest_gap", "near_you", "you", "capitals", "punctuation", "exclaims", "obfuscated", "shouted")


def pieces(word: str) -> tuple[str, ...]:
    """A word and its beginnings; those end in a mark, so that they are never taken for words."""
    return (word, *(word[:n] + "~" for n in (4, 5, 6) if len(word) > n))


def plain(word: str) -> str:
    low = word.lower()
    return low if low.isalpha() or low.isdigit() else low.translate(LEET).replace("*", "")


class Features:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.memo = lexicon, {}

    def strength(self, word: str) -> float:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            found = self.memo[word] = max((self.lexicon.get(p, 0.0) for p in pieces(plain(word))), default=0.0)
        return found

    def of(self, text: str) -> list[float]:
        words = WORD.findall(text)
        n, size = max(1, len(words)), max(1, len(text))
        strengths = np.fromiter(map(self.strength, words), dtype=np.float64, count=len(words))
        at = np.flatnonzero(strengths)
        you = np.array([i for i, w in enumerate(words) if w.lower() in YOU])
        near = 0.0
        if len(at) and len(you):
            right = np.searchsorted(you, at)
            gap = np.minimum(
                np.abs(you[np.minimum(right, len(you) - 1)] - at), np.abs(at - you[np.maximum(right - 1, 0)])
            )
            near = float((gap <= NEAR).mean())
        odd = sum(1 for w in words if not w.isalnum() or not (w.isalpha() or w.isdigit()))
        gaps = [b - a for a, b in pairwise(at.tolist())]
        return [
            len(at) / n, math.log1p(len(at)), float(strengths.max(initial=0.0)), float(len({words[i].lower() for i in at})),
            max(gaps, default=0) / n, near, len(you) / n, len(CAPITAL.findall(text)) / size, len(SIGNS.findall(text)) / size,
            text.count("!") / size, odd / n, sum(1 for w in words if len(w) > 2 and w.isupper()) / n,
        ]


def features(lexicon: dict[str, float]):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Features(lexicon).of
        for batch in texts:
            yield pd.Series([of(t) for t in batch])

    return run


def word_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """label, piece, n: texts of a batch that hold each piece."""
    for batch in batches:
        for label, rows in batch.groupby("label"):
            held = [list({p for w in set(map(plain, WORD.findall(t))) for p in pieces(w)}) for t in rows["text"]]
            counts = pd.Series([p for some in held for p in some], dtype=object).value_counts()
            yield pd.DataFrame({"label": label, "piece": counts.index, "n": counts.to_numpy()})


def learned_lexicon(rows: DataFrame) -> dict[str, float]:
    """Log-odds of the strongest pieces of the toxic texts; at most LEXICON of them."""
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not total.get(1) or not total.get(0):
        return {}
    counts = rows.mapInPandas(word_pieces, "label int, piece string, n long").groupBy("piece").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("other"),
    )
    bad = F.col("toxic") / total[1]
    odds = F.log((F.col("toxic") + 0.5) / (total[1] + 1) / ((F.col("other") + 0.5) / (total[0] + 1)))
    strong = counts.filter((F.col("toxic") >= LEAST) & (bad / (bad + F.col("other") / total[0]) >= STRONG))
    best = strong.select("piece", odds.alias("odds")).orderBy(F.desc(F.col("odds")), "piece").limit(LEXICON)
    return {r["piece"]: r["odds"] for r in best.collect()}


def part(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def learning_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """label, text, a number (share) and the weight of the rows that may be learned from, SAMPLE per label at most.

    The sampled ids, 2 * SAMPLE at most, are what is broadcast.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (part(doc_id) != 0))
    usable = usable.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    mixed = F.xxhash64("id", F.lit(9))
    some = [usable.filter(F.col("label") == v).orderBy(mixed, "id").limit(SAMPLE) for v in (0, 1)]
    total = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.when(F.col("label") == 1, max(1.0, total.get(1, 0) / SAMPLE)).otherwise(max(1.0, total.get(0, 0) / SAMPLE))
    chosen = some[0].union(some[1]).select("id", "label", F.pmod(mixed, F.lit(8)).alias("share"), weight.alias("weight"))
    texts = docs.select(F.col(doc_id).alias("id"), whole(text).alias("text"))
    return cut(texts.join(F.broadcast(cut(chosen)), "id"))


def scored(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", into: str = "toxicity"
) -> DataFrame:
    """All rows of ``docs`` with a struct ``into`` (replaced if there): held_out, score.

    Rows whose id has a checksum divisible by five are held out and never learned from, nor are rows
    without an id. An id with several labels counts as toxic if one says so. Where one label has no
    learning rows every score is the other label, and 0 where both have none. Null is empty.
    """
    rows = learning_rows(docs, labels, doc_id, text, label)
    there = {r["label"] for r in rows.select("label").distinct().collect()}
    away, back = set_aside(docs, into)  # the models add columns of fixed names
    found = docs.select(*away, F.coalesce(part(doc_id) == 0, F.lit(False)).alias("_held"), whole(text).alias("_text"))
    if there != {0, 1}:
        alone = F.struct(F.col("_held").alias("held_out"), F.lit(1.0 if 1 in there else 0.0).alias("score"))
        return found.select(*back, alone.alias(into))
    of = features(learned_lexicon(rows.filter("share < 4")))
    known = cut(rows.filter("share >= 4").select("label", "share", "weight", of("text").alias("values")).coalesce(8))
    if known.select("label").distinct().count() < 2 or known.filter("share >= 6").select("label").distinct().count() < 2:
        known = cut(rows.select("label", F.lit(7).alias("share"), "weight", of("text").alias("values")).coalesce(8))  # too few rows to part
    known = known.withColumn("features", array_to_vector("values"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, labelCol="label", weightCol="weight", seed=5).fit(known)
    raw = trees.transform(known.filter("share >= 6")).select(
        vector_to_array("probability")[1].alias("raw"), F.col("label").cast("double").alias("label"), "weight"
    )
    level = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="score").fit(raw)
    named = found.withColumn("_values", of("_text")).withColumn("_features", array_to_vector("_values"))
    trees = trees.setFeaturesCol("_features").setPredictionCol("_p").setProbabilityCol("_probability").setRawPredictionCol("_margin")
    named = trees.transform(named).withColumn("_raw", vector_to_array("_probability")[1])
    named = level.setFeaturesCol("_raw").setPredictionCol("_score").transform(named)
    result = F.struct(F.col("_held").alias("held_out"), F.col("_score").alias("score"))
    return named.select(*back, result.alias(into))
