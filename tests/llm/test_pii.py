import hashlib
import re

import pytest

from gateledger.llm import pii
from gateledger.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, text):
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    found = ((k, m) for k, p in PLAIN.items() for m in re.finditer(p, text))
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found if good(k, m[0]))


TRICKY = [
    "", "@", "a@b", "a@b.c@d.e", "a.b@c..d", "x@y.z.", "a@@b.cc", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1", "9" * 4000 + ".1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "+1 (366) 555-9807.", "+1--", "++12345678", "+1 2+3 4567 8901",
    "aaa@bbb.cc,ddd@ee.ff", "ä@b.cd", "a" * 3000 + "@b.cd", "+" + "1" * 16,
]


@pytest.mark.parametrize("text", TRICKY)
def test_plain_spans(text):
    assert pii.listed(pii.find(text)[0]) == base(text)


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("mail john [AT] mail.example.com now", "email", "john [AT] mail.example.com"),
        ("ask john at mail dot example dot com", "email", "john at mail dot example dot com"),
        ("to jоhn@example.com", "email", "jоhn@example.com"),  # a Cyrillic o
        ("card ４１１１ 1111 1111 1111 ok", "card", "４１１１ 1111 1111 1111"),
        ("call plus one two three five five five one two three four!", "phone", "plus one two three five five five one two three four"),
        ("host 10[.]0[.]0[.]1 up", "ip", "10[.]0[.]0[.]1"),
    ],
)
def test_disguises_point_back_into_the_source(text, kind, hidden):
    at = text.index(hidden)
    assert (at, at + len(hidden)) in pii.find(text)[1][kind]


@pytest.mark.parametrize("text", ["look at the dot on the map", "meet me at noon", "one two three, go", "we are at example.com now", "Привет, мир", "a [.] b"])
def test_clean_texts_stay_clean(text):
    base, more = pii.find(text)
    assert not any([*base.values(), *more.values()])


def test_redaction():
    assert pii.redacted("a b@c.de 1.2.3.4", "email:2:8,ip:9:16") == "a [EMAIL] [IP]"
    assert pii.redacted("abcdef", "email:0:3,ip:2:5") == "[EMAIL]f"


def test_odd_documents(odd_docs, odd_rows, no_docs):
    rows = pii.personal_data(odd_docs).collect()
    assert sorted(r.pii.base for r in rows) == sorted(base(r[1] or "") for r in odd_rows)
    assert set(rows[0].asDict()) == {*odd_docs.columns, "pii"}
    assert pii.personal_data(no_docs).count() == 0
    assert sum(r.t is None for r in odd_docs.select(pii.cleaned("text").alias("t")).collect()) == 1


def test_query(spark, sf_dir, documents):
    got = {r.doc_id: r.base_sha256 for r in QUERIES["op5_personal_data"](spark, sf_dir).collect()}
    assert got == {r.doc_id: hashlib.sha256(base(r.text or "").encode()).hexdigest() for r in documents}
