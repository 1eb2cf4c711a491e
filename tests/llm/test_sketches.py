import hashlib

from pyspark.sql import functions as F

from gateledger.llm import sketches
from gateledger.llm.queries import QUERIES


def edited(docs):
    """doc_id, n_chars, digest of the edited text, in descending order; ``docs`` sorted that way."""
    out = []
    for k, (i, text) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(text) // 2
        out.append((i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return out


def check(rows, docs):
    docs = sorted(((r[0], r[1] or "") for r in docs), reverse=True)
    assert sorted(tuple(r)[:3] for r in rows) == sorted(edited(docs))
    prints = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(dict(docs)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    by_id = {r.doc_id: r for r in rows}
    for k, (i, _) in enumerate(docs):
        a, b = by_id[i].fingerprint, by_id[docs[(k + 1) % len(docs)][0]].fingerprint
        a, b = ({p[j : j + 16] for j in range(0, len(p), 16)} for p in (a, b))
        assert abs(by_id[i].near_next - (len(a & b) / len(a | b) if a | b else 1)) < 1e-9


def test_query(spark, sf_dir, documents):
    check(QUERIES["op3_document_fingerprints"](spark, sf_dir).collect(), documents)


def test_ranges_meet(spark, sf_dir, documents, monkeypatch):
    monkeypatch.setattr(sketches, "GROUP_BYTES", 20_000)
    check(QUERIES["op3_document_fingerprints"](spark, sf_dir).collect(), documents)


def test_odd_documents(odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(sketches, "GROUP_BYTES", 2000)
    rows = sketches.with_next(odd_docs, "doc_id", "text").collect()
    order = sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]
    assert sorted(((r.order, r.text, r.next_text) for r in rows), key=repr) == sorted(want, key=repr)
    assert sketches.with_next(no_docs, "doc_id", "text").count() == 0
    assert sketches.fingerprints(odd_docs, into="fp").count() == len(odd_rows)


def test_sketch_estimates_containment_of_unequal_texts(spark):
    words = [f"w{i}" for i in range(20_000)]
    long, short = " ".join(words), " ".join(words[5000:7000])
    df = spark.createDataFrame([(long, short)], "long string, short string")
    a, b = sketches.sketch(F.col("long")), sketches.sketch(F.col("short"))
    r = df.select(
        F.size(a).alias("n"), sketches.containment(b, a).alias("inside"), sketches.containment(a, b).alias("holds"),
        (sketches.merged(a, b) == a).alias("same"), sketches.likeness(a, a).alias("one"),
    ).head()
    assert abs(r.n / 20_000 - 1 / sketches.PER) < 0.02
    assert r.inside == 1.0 and abs(r.holds - 0.1) < 0.03 and r.same and r.one == 1.0


def test_short_texts(spark):
    df = spark.createDataFrame([("", 0), ("  ", 0), ("one", 1), ("one two", 1), ("a b c d e", 1)], "text string, n int")
    for r in df.select("n", F.size(sketches.sketch(F.col("text"))).alias("got")).collect():
        assert r.got == r.n
