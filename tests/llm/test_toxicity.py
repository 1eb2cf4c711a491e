import random
import zlib

import pytest

from gateledger.llm import toxicity

RUDE = ["vermin", "grotbag", "snivel"]


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(1)
    words = ["tree", "house", "river", "stone", "you", "walk", "green", "paper"]
    rows = []
    for i in range(500):
        text = rng.choices(words, k=rng.randrange(5, 40))
        toxic = int(rng.random() < 0.25)
        for _ in range(toxic * rng.randrange(2, 5)):
            text.insert(rng.randrange(len(text)), rng.choice(RUDE))
        rows.append((i, " ".join(text), toxic))
    return rows


def run(spark, rows, labels):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {r.doc_id: r.toxicity for r in toxicity.scored(docs, labels).collect()}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_nothing_learned_from_held_out_rows(spark, marked):
    got = run(spark, marked, [(i, 1, t) for i, _, t in marked])
    assert {i: r.held_out for i, r in got.items()} == {i: held(i) for i, _, _ in marked}
    assert all(0 <= r.score <= 1 for r in got.values())
    right = [(got[i].score >= 0.5) == bool(t) for i, _, t in marked if held(i)]
    assert sum(right) / len(right) >= 0.95
    flipped = run(spark, marked, [(i, 0, 1 - t if held(i) else t) for i, _, t in marked])
    assert flipped == got


def test_one_label_or_none(spark, marked):
    assert {r.score for r in run(spark, marked[:20], []).values()} == {0.0}
    assert {r.score for r in run(spark, marked[:20], [(i, 1, 1) for i in range(20)]).values()} == {1.0}
    assert {r.score for r in run(spark, marked[:20], [(i, 1, 0) for i in range(20)] + [(None, 1, 1)]).values()} == {0.0}


def test_odd_documents(spark, odd_docs, odd_rows, no_docs, marked):
    labels = spark.createDataFrame([(i % 15, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(odd_docs, labels).collect()
    assert len(rows) == len(odd_rows) and set(rows[0].asDict()) == {*odd_docs.columns, "toxicity"}
    assert toxicity.scored(no_docs, labels).count() == 0


def test_own_columns_of_any_name_keep_their_values(spark, marked):
    names = ["_held", "_values", "_features", "_p", "_probability", "_margin", "_raw", "_score", "_text"]
    docs = spark.createDataFrame([(i, t, *[i + k for k in range(9)]) for i, t, _ in marked], ["doc_id", "text", *names])
    for labels in ([(i, 1, t) for i, _, t in marked], []):
        rows = toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert rows.columns == [*docs.columns, "toxicity"]
        assert all(r[2 + k] == r.doc_id + k for r in rows.collect() for k in range(9))


def test_features_of_odd_texts():
    of = toxicity.Features({"vermin": 2.0, "grot~": 1.0}).of
    assert of("") == [0.0] * len(toxicity.FEATURES)
    one = dict(zip(toxicity.FEATURES, of("you VERMIN and v3rmin, grotbag!!")))
    assert one["kinds"] == 3 and one["strength"] == 2.0 and one["near_you"] > 0 and one["exclaims"] > 0


def test_scores_of_a_sample_are_those_of_all_rows(spark, monkeypatch):
    rng = random.Random(6)
    words = ["tree", "house", "river", "stone", "you", "walk", "green", "paper"]
    rows, doubtful = [], "you walk grotbag tree river"  # toxic in 180 of 480 cases
    for i in range(6000):
        text = " ".join(rng.choices(words, k=5))
        rows.append((i, doubtful, int(i < 180)) if i < 480 else (i, f"{text} vermin snivel", 1) if i < 1020 else (i, text, 0))
    labels = [(i, 1, t) for i, _, t in rows]
    whole = run(spark, rows, labels)
    monkeypatch.setattr(toxicity, "SAMPLE", 600)  # about all toxic rows, one in seven of the others
    part = run(spark, rows, labels)
    assert 0.25 < whole[0].score < 0.5 and abs(part[0].score - whole[0].score) < 0.15 and part[0].score < 0.5
    assert part[600].score > 0.9 and part[2000].score < 0.1
