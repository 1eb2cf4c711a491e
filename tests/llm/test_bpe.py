import numpy as np
import pytest
import tiktoken

from gateledger.llm import bpe
from gateledger.llm.queries import QUERIES, public_tokenizers

VOCABULARY = public_tokenizers()
RANKS = bpe.read_ranks(VOCABULARY.path("byte_bpe_50k.tiktoken"))
OWN = tiktoken.Encoding("own", pat_str=VOCABULARY.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(tokens):
    return np.frombuffer(tokens, dtype="<u4").tolist()


def test_odd_documents_as_the_library_encodes_them(odd_docs, odd_rows):
    rows = bpe.decode(bpe.encode(odd_docs, RANKS, VOCABULARY.PATTERN), RANKS).collect()
    assert len(rows) == len(odd_rows)
    assert set(odd_docs.columns) | {"tokens", "decoded"} == set(rows[0].asDict())
    for r in rows:
        assert ids(r.tokens) == OWN.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")


def test_random_characters(spark):
    rng = np.random.default_rng(3)
    signs = [*map(chr, range(0x180)), *"а字语🎉‍᠎ 　\x1c\x85٣²½<|>'"]
    texts = ["".join(rng.choice(signs, rng.integers(1, 60))) for _ in range(150)] + ["<|endoftext|>", "ab" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in bpe.encode(df, RANKS, VOCABULARY.PATTERN).collect():
        assert ids(r.tokens) == OWN.encode_ordinary(r.text)


def test_empty_table_and_unknown_id(spark, no_docs):
    assert bpe.encode(no_docs, RANKS, VOCABULARY.PATTERN).count() == 0
    odd = spark.createDataFrame([(bytearray(b"\xff\xff\xff\x7f"),)], "tokens binary")
    with pytest.raises(Exception, match="no piece"):
        bpe.decode(odd, RANKS).collect()
    assert bpe.decode(spark.createDataFrame([(None,)], "tokens binary"), RANKS).head().decoded is None


def test_query(spark, sf_dir, documents):
    got = {r.doc_id: r.n_tokens for r in QUERIES["op1_byte_bpe"](spark, sf_dir).collect()}
    assert got == {r.doc_id: len(OWN.encode_ordinary(r.text or "")) for r in documents}


def test_there_and_back_is_one_step_of_the_plan(odd_docs, odd_rows, no_docs):
    found = bpe.there_and_back(odd_docs, RANKS, VOCABULARY.PATTERN)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    two = bpe.decode(bpe.encode(odd_docs, RANKS, VOCABULARY.PATTERN), RANKS)
    assert found.columns == two.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)
    assert bpe.there_and_back(no_docs, RANKS, VOCABULARY.PATTERN).count() == 0


def test_query_has_one_python_worker_a_task(spark, sf_dir):
    plan = QUERIES["op1_byte_bpe"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_common_words_outlive_a_full_memory():
    folds = []

    class Counted(bpe.Words):
        def folded(self, data):
            folds.append(data)
            return super().folded(data)

    words = Counted(RANKS, memo=50)
    for k in range(2000):
        for word in (" common", f" rare{k}"):
            assert ids(words[word]) == OWN.encode_ordinary(word)
        assert len(words) + len(words.older) <= 100
    assert folds.count(b" common") == 1 and len(folds) == 2001


def test_words_fold_as_the_library_does():
    rng = np.random.default_rng(5)
    pieces = sorted(RANKS)
    words = bpe.Words(RANKS)
    for data in [b"".join(pieces[k] for k in rng.integers(0, len(pieces), n)) for n in (1, 1, 2, 2, 3, 3, 4, 5) * 50]:
        assert words.folded(data) == words.folded_long(data)
