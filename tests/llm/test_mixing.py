import re
from collections import defaultdict

from gateledger.llm import mixing
from gateledger.llm.queries import QUERIES


def goals(held, weights=(5, 2, 1)):
    """Targets by repeated sharing; null is the last source."""
    names = sorted(held, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, stopped = sum(held.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(3 * held[s] for s in stopped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > 3 * held[s]}
        if not above:
            return {s: 3 * held[s] if s in stopped else share[s] for s in names}
        stopped |= above


def check(rows, sizes):
    held = defaultdict(int)
    for source, size in sizes:
        held[source] += size
    want, taken = goals(held), defaultdict(int)
    for source, r in rows:
        assert abs(r.target - want[source]) < 1e-6 * max(1, want[source]) and r.source_size == held[source]
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_query(spark, sf_dir, documents):
    rows = QUERIES["op7_source_mix"](spark, sf_dir).collect()
    source = {r.doc_id: r.source for r in documents}
    assert {r.doc_id: r.size for r in rows} == {r.doc_id: n_words(r.text) for r in documents}
    check([(source[r.doc_id], r) for r in rows], [(r.source, n_words(r.text)) for r in documents])
    assert sorted(rows) == sorted(QUERIES["op7_source_mix"](spark, sf_dir).collect())


def test_odd_documents(odd_docs, odd_rows, no_docs):
    rows = mixing.mix(odd_docs, mixing.words(), mixing.quality()).collect()
    assert len(rows) == len(odd_rows) and set(rows[0].asDict()) == set(odd_docs.columns)
    check([(r.source, r.mix) for r in rows], [(r[3], n_words(r[1])) for r in odd_rows])
    assert mixing.mix(no_docs, mixing.words(), mixing.quality()).count() == 0


def test_epochs_come_before_parts_and_quality_draws(spark):
    rows = [(i, "a" if i < 20 else "b", 10, 2.0 if i % 2 else 0.5) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")
    got = mixing.mix(df, df["size"], df["weight"]).collect()
    small = [r.mix.taken for r in got if r.source == "a"]
    assert small == [30] * 20  # stopped at three epochs
    big = [r for r in got if r.source == "b"]
    assert {r.mix.taken for r in big} <= set(range(11))
    good, poor = (sum(r.mix.taken for r in big if r.weight == w) for w in (2.0, 0.5))
    assert good > poor


def test_nothing_to_share(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, source string")
    rows = mixing.mix(df, mixing.F.lit(0), mixing.F.lit(1.0)).collect()
    assert {(r.mix.target, r.mix.taken) for r in rows} == {(0.0, 0)}
