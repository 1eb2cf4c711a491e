import hashlib
import random

import numpy as np

from gateledger.llm import substrings
from gateledger.llm.queries import QUERIES


def removals(docs):
    """Brute force over (id, text) in order: n_bytes, n_removed, n_spans, digest of what is kept."""
    seen, out = set(), []
    for _, text in docs:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - 99):
            part = body[i : i + 100]
            if part in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(part)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(body, gone) if not g)
        out.append((len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return [(r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in df.collect()]


def test_cover_has_every_difference():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_names_do_not_depend_on_place_or_segment():
    raw = np.frombuffer(b"abcdefgh" * (substrings.SEGMENT // 4), dtype=np.uint8)
    at = np.arange(0, len(raw) - 100, 8)
    assert len(np.unique(substrings.names(raw, at, 100))) == 1
    assert len(np.unique(substrings.names(raw, np.arange(8), 100))) == 8


def test_planted_passages(spark):
    rng = random.Random(5)
    some = ["".join(rng.choices("abc äö", k=n)) for n in (99, 100, 101, 150, 157, 400)]
    rows = []
    for i in range(120):
        text = "".join(rng.choices("abcdefgh ", k=rng.randrange(150)))
        for _ in range(rng.randrange(3)):
            text += rng.choice(some)[rng.randrange(3) :] + "".join(rng.choices("xyz", k=rng.randrange(20)))
        rows.append((i * 7 % 120, text))
    rows += [(200, "ab" * 300), (201, "a" * 1000), (202, "ab" * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    rows.sort()
    got = sorted(substrings.repeated(df).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got] == removals(rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("text_blocks")]


def test_odd_documents(odd_docs, odd_rows, no_docs):
    order = sorted(range(len(odd_rows)), key=lambda k: (odd_rows[k][0] is None, odd_rows[k][0], k))
    want = removals([odd_rows[k][:2] for k in order])
    assert sorted(found(substrings.repeated(odd_docs))) == sorted(want)
    assert substrings.repeated(no_docs).count() == 0


def test_query(spark, sf_dir, documents):
    rows = QUERIES["op6_repeated_substrings"](spark, sf_dir).collect()
    want = removals(sorted((r.doc_id, r.text) for r in documents))
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(rows)] == want
