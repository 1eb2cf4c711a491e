import random

import pandas as pd
import xxhash

from gateledger.llm import simhash
from gateledger.llm.components import components
from gateledger.llm.queries import QUERIES


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def linked(prints):
    """The smallest index that each print reaches."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(prints))]


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(300):  # chains and stars at up to four bits, and close misses at five
        flips = rng.sample(range(64), rng.choice([1, 2, 3, 4, 4, 5]))
        prints.append(rng.choice(prints) ^ sum(1 << b for b in flips))
    hub = rng.getrandbits(64)
    prints += list({hub ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)})[:400]
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(pd.DataFrame({"fp": signed}))
    group = {r.node: r.root for r in simhash.roots(df).collect()}
    names = [group.get(p, p) for p in signed]
    want = linked(prints)
    assert len(set(zip(names, want))) == len(set(names)) == len(set(want))


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
    assert components(df.filter("a < 0")).count() == 0


def test_odd_documents(odd_docs, odd_rows, no_docs):
    prints = [fingerprint(r[1] or "") for r in odd_rows]
    roots, ids = linked(prints), [r[0] for r in odd_rows]
    least = {r: min((i for i, q in zip(ids, roots) if q == r and i is not None), default=None) for r in roots}
    got = simhash.near_duplicates(odd_docs).collect()
    want = [(i, p - (1 << 64) if p >> 63 else p, least[r]) for i, p, r in zip(ids, prints, roots)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_document_of_each_class_stays(odd_docs, odd_rows, no_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    prints = [fingerprint(r.text or "") for r in kept.collect()]
    assert len(prints) == len(set(linked([fingerprint(r[1] or "") for r in odd_rows])))
    assert linked(prints) == list(range(len(prints)))
    assert simhash.one_of_each(no_docs).count() == 0


def test_query(spark, sf_dir, documents):
    rows = sorted(QUERIES["op8_simhash"](spark, sf_dir).collect())
    docs = sorted(documents)
    prints = [fingerprint(r.text or "") for r in docs]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in rows] == [docs[k].doc_id for k in linked(prints)]
