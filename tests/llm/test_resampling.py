import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gateledger.llm import resampling
from gateledger.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def features_of(text, runs=3, buckets=10_000):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def expected(rows, target, percent=5, least=20, seed=42):
    """(doc_id, n_features, weight, score) of each row, and the drawn ids in order."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features_of(text))
    for text in target:
        t.update(features_of(text))
    all_s, all_t = s.total() + 10_000, t.total() + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10_000)]
    out = []
    for doc_id, text in rows:
        found = features_of(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = [r for r, (_, text) in zip(out, rows) if len(words_of(text)) >= least]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    return out, able[: percent * len(able) // 100]


def test_shifts_compose_checksums():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.bytes(int(rng.choice([0, 1, 5, 127, 128, 700]))) for _ in range(2))
        moved = resampling.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("block", [1, 40, 1 << 21])
def test_features_of_odd_texts_in_blocks_of_any_size(odd_rows, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    texts = [(r[1] or "").encode() for r in odd_rows] + ["ÄÖ A\x00b c-D é 漢字x ".encode(), b"\x01 a \x01", b"w" * 300 + b" v " + b"u" * 200]
    n, found = resampling.featured(texts, 3, 10_000)
    for text, words, buckets in zip(texts, n, found):
        assert words == len(words_of(text.decode()))
        assert Counter(np.frombuffer(buckets, "<u2").tolist()) == Counter(features_of(text.decode()))


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    target = spark.createDataFrame([("the lazy dog",), (None,), ("it's one",)], "text string")
    rows, drawn = expected([r[:2] for r in odd_rows], ["the lazy dog", None, "it's one"], percent=50)
    found = resampling.resampled(odd_docs, target, percent=50)
    got = found.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(rows, key=repr)
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == [*range(1, len(drawn) + 1)]
    assert [tuple(r)[:4] for r in ranked] == drawn
    kept = resampling.drawn(odd_docs, found)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in drawn}
    assert resampling.resampled(no_docs, target).count() == 0
    none = resampling.resampled(odd_docs, target.filter("false")).collect()
    assert len(none) == len(odd_rows)


def test_a_third_of_repeated_rows_and_one_long_text(spark):
    long = "Some words, again and AGAIN; 漢字 9 " * 100_000
    rows = [(i, f"text {i} " * 12) for i in range(60)] + [(7, "the same row " * 9)] * 40 + [(99, long), (98, long)]
    want, drawn = expected(rows, ["again the same"], percent=20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = resampling.resampled(docs, spark.createDataFrame([("again the same",)], "text string"), percent=20).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got) == sorted(want)
    ranked = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [(r.doc_id, r.n_features, r.weight, r.score) for r in ranked] == drawn


def test_query(spark, sf_dir, documents):
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows, drawn = expected([(r.doc_id, r.text) for r in documents], target)
    rank = {r[0]: k for k, r in enumerate(drawn, 1)}
    got = [tuple(r) for r in QUERIES["op11_importance_resampling"](spark, sf_dir).collect()]
    assert sorted(got) == sorted((*r, rank.get(r[0])) for r in rows)
    assert len(drawn) > 3
