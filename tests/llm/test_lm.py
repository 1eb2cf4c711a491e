import math
import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest

from gateledger.llm import lm
from gateledger.llm.queries import QUERIES

N = lm.ORDER


def clean(text):
    return re.sub(r"[0-9]", "0", re.sub(r"\s+", " ", text or "").strip())


class Model:
    """Interpolated modified Kneser-Ney over characters, straight from its formulas."""

    def __init__(self, texts):
        self.counts = {N: Counter(g for t in texts for g in grams(t))}
        for k in range(N - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.contexts = {k: defaultdict(list) for k in self.counts}
        for k, counts in self.counts.items():
            for g, n in counts.items():
                self.contexts[k][g[:-1]].append(n)

    def discount(self, k, n):
        n1, n2, n3, n4 = (sum(c == j for c in self.counts[k].values()) for j in (1, 2, 3, 4))
        d = []
        for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)):
            x = j - (j + 1) * n1 / (n1 + 2 * n2) * b / a if a and n1 + 2 * n2 else -1
            d.append(x if 0 <= x <= j else j / 2)
        return min(d[min(n, 3) - 1], n)

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / lm.ALPHABET
        lower, found = self.p(gram[1:]), self.contexts[k].get(gram[:-1])
        if not found:
            return lower
        n = self.counts[k][gram]
        left = sum(self.discount(k, c) for c in found)
        return ((n - self.discount(k, n) if n else 0) + left * lower) / sum(found)

    def perplexity(self, text):
        own = grams(text)
        return math.exp(-sum(math.log(self.p(g)) for g in own) / len(own)) if own else None


def grams(text):
    padded = lm.START * (N - 1) + text
    return [padded[i : i + N] for i in range(len(text))]


def expected(rows):
    """By row (text, lang, trusted): perplexity, threshold."""
    out, by_lang = {}, defaultdict(list)
    for text, lang, trusted in rows:
        by_lang[lang].append((clean(text), trusted, text))
    for lang, some in by_lang.items():
        model = Model([t for t, trusted, _ in some if trusted])
        scores = [(model.perplexity(t), trusted, raw) for t, trusted, raw in some]
        distinct = sorted({raw: s for s, trusted, raw in scores if trusted and s is not None}.values())
        limit = distinct[math.ceil(lm.QUANTILE * len(distinct)) - 1] * lm.MARGIN if distinct else None
        out |= {(lang, raw): (s, limit) for s, _, raw in scores}
    return out


@pytest.fixture(scope="module")
def judged_rows(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["the", "ship", "sails", "over", "a", "quiet", "sea", "and", "turns", "again"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(3, 30))), rng.choice(["en", None]), True) for _ in range(60)]
    rows += [("".join(rng.choices("#%&XQ Z7", k=40)), "en", False) for _ in range(5)]
    rows += [(None, "en", False), ("", "en", True), ("9 8\t7", "en", False), ("no trusted text here", "xx", False), rows[0]]
    path = str(tmp_path_factory.mktemp("lm") / "rows")
    frame = [(i, *r, 1.0, "b") for i, r in enumerate(rows)]
    spark.createDataFrame(frame, "doc_id long, text string, lang string, good boolean, quality double, block string").write.parquet(path)
    return spark.read.parquet(path), rows


def test_against_the_formulas(judged_rows):
    docs, rows = judged_rows
    want, seen = expected(rows), 0
    for r in lm.judged(docs, docs["good"]).collect():
        score, limit = want[r.lang, r.text]
        seen += 1
        assert r.quality.perplexity == (None if score is None else pytest.approx(score, rel=1e-9))
        assert (r.quality.threshold is None) == (limit is None)
        assert limit is None or r.quality.threshold == pytest.approx(limit, rel=1e-6)
        assert r.quality.keep == (score is None or limit is None or score <= limit)
    assert seen == len(rows)
    assert not [r for r in lm.judged(docs, docs["good"]).filter("text like '%#%#%' and quality.keep").collect()]


def test_odd_documents(odd_docs, odd_rows, no_docs):
    rows = lm.judged(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    assert all(r.quality.keep for r in rows if not (r.text or "").strip())
    assert lm.judged(no_docs).count() == 0


def test_form():
    prose = "The ship sails over a quiet sea, and turns again. Some say it never came home from there; who knows? "
    texts = [prose, prose.upper(), "ship " * 40, "#%& " * 40, "a b c d e f g h " * 20, "short", ""]
    assert lm.trusted_form(texts).tolist() == [True] + [False] * 6
    assert len(lm.trusted_form([])) == 0


def test_labelled_documents(spark, sf_dir):
    rows = QUERIES["op2_quality_classifier"](spark, sf_dir).toPandas()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    both = pd.merge(rows, labels, on="doc_id")
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert good.keep.mean() >= 0.98 and (len(bad) == 0 or bad.keep.mean() <= 0.5)  # words repeated on and on look like the language


def test_words_repeated_on_and_on(spark, sf_dir):
    prose = "The ship sails over a quiet sea, and turns again. Some say it never came home from there; who knows? "
    texts = [prose + "are. " * 40, "Ed " * 300, "one of " * 20, prose * 5, "12 15 17 18 19 20 21 22 23 24", "no no no", "", prose]
    assert [lm.repeats(t) for t in texts] == [True] * 3 + [False] * 5
    rows = QUERIES["op2_quality_classifier"](spark, sf_dir).toPandas()
    both = pd.merge(rows, spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert len(bad) and good.keep.mean() >= 0.98 and bad.keep.mean() <= 0.05


def test_what_is_listed_follows_the_text_and_not_its_splits(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")

    def verdicts(rows):
        found = lm.judged(rows).select("doc_id", "quality.*").collect()
        return {r.doc_id: (round(r.perplexity or 0, 6), round(r.threshold or 0, 6), r.repeats, r.keep) for r in found}

    split = docs.repartition(40, "doc_id").sortWithinPartitions("doc_id")
    assert verdicts(split) == verdicts(docs)
    listed = []
    of = lm.blocks_for
    monkeypatch.setattr(lm, "blocks_for", lambda rows, **more: listed.append(of(rows, **more)) or listed[-1])
    lm.perplexities(split, None)
    assert listed == [1]


def test_a_run_without_a_probability_is_an_error():
    rows = pd.DataFrame({"lang": ["en"], "digest": ["d"], "trusted": [True], "repeats": [False], "body": [lm.zstandard.ZstdCompressor().compress(b"abcdef")]})
    with pytest.raises(ValueError, match="no table"):
        lm.scored(rows, pd.DataFrame({"lang": ["en"], "gram": ["abcd"], "logp": [-1.0]}))
