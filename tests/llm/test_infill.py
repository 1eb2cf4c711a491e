import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gateledger.llm import infill
from gateledger.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text, seed=1):
    text, x = text or "", sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(s in text for s in infill.SENTINELS) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return len(text), "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_descents_end_at_every_rank():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, infill.FAN, infill.FAN + 1, 700):
        widths = rng.integers(1, 9, n)
        lanes = infill.SkipList(widths)
        assert [lanes.chars_before(r) for r in range(n + 1)] == [0, *np.cumsum(widths).tolist()]
        assert all(len(units) <= infill.FAN for units, _ in lanes.lanes[-1:])


def test_units_by_a_pattern():
    assert infill.unit_widths("ab  cd. e", r"\s*\w+").tolist() == [2, 4, 3]
    assert infill.unit_widths("ab!!", r"\w+").tolist() == [2, 2]
    assert infill.unit_widths("", r"\w+").tolist() == []


def test_odd_documents(odd_docs, odd_rows):
    rows = infill.fill_in_middle(odd_docs).withColumn("back", infill.restored(F.col("infill.output"), F.col("infill.form"))).collect()
    assert set(rows[0].asDict()) == {*odd_docs.columns, "infill", "back"}
    assert sorted((tuple(r)[:10] for r in rows), key=repr) == sorted(map(tuple, odd_rows), key=repr)
    for r in rows:
        assert tuple(r.infill) == expected(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_many_ids_sentinels_and_clashing_names(spark):
    texts = ["<P", "<S>", "x<M>y", "<<S", "🎉é́漢 <", "><P<S<M", "ab" * 50, ""]
    rows = [(i, texts[i % len(texts)], "own", 7) for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, body string, infill string, _text int")
    got = infill.fill_in_middle(docs, "id", "body", seed=9)
    got = got.withColumn("back", infill.restored(F.col("infill.output"), F.col("infill.form"))).collect()
    assert {r.infill.form for r in got} == {"plain", "psm", "spm"}
    assert len(got) == 400
    for r in got:
        assert tuple(r.infill) == expected(r.id, r.body, 9)
        assert (r.back, r._text) == (r.body, 7)


def test_cuts_between_words_and_one_long_text(spark):
    long = "漢字 and words " * 400_000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one two  three four", long, "a b"] * 3)], "doc_id long, text string")
    for r in infill.fill_in_middle(docs, rate=100, unit=r"\s*\S+").collect():
        units = infill.unit_widths(r.text, r"\s*\S+")
        assert r.infill.n == len(units)
        ends = {0, *np.cumsum(units).tolist()}
        assert {r.infill.prefix_chars, r.infill.prefix_chars + r.infill.middle_chars} <= ends
    for r in infill.fill_in_middle(docs).collect():
        assert tuple(r.infill) == expected(r.doc_id, r.text)


def test_empty_table_and_bad_sentinels(no_docs):
    assert infill.fill_in_middle(no_docs).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("aa", "<S>", "<M>"), ("", "<S>", "<M>"), ("<P>", "P>x", "<M>"), ("ab", "xaby", "q")):
        with pytest.raises(ValueError, match="overlap"):
            infill.checked(bad)


def test_query(spark, sf_dir, documents):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_fill_in_middle"](spark, sf_dir).collect()}
    want = {}
    for r in documents:
        *parts, output = expected(r.doc_id, r.text)
        want[r.doc_id] = (*parts, sha(output), sha(r.text or ""))
    assert got == want
