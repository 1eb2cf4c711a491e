from tokenizers import Tokenizer

from gateledger.llm import tokens
from gateledger.llm.queries import QUERIES, public_tokenizers

PATH = public_tokenizers().path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_odd_documents_and_the_cache(spark, odd_docs, odd_rows, no_docs, tmp_path):
    cache = str(tmp_path / "cache")
    assert tokens.token_counts(no_docs, cache, PATH).count() == 0
    for _ in range(2):
        got = tokens.token_counts(odd_docs, cache, PATH, limit=100).collect()
        want = [(r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 100) for r in odd_rows]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        assert spark.read.parquet(cache).count() == len({tokens.normalised(r[1] or "") for r in odd_rows})


def test_special_strings_and_white_space(spark, tmp_path):
    texts = ["<|endoftext|>", "a<|ENDOFTEXT|>b", "x <|startoftext|>y z w", "é e ́", "\x1c\x85a\x0bb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, str(tmp_path / "c"), PATH).collect()}
    assert got == {i: count(t) for i, t in enumerate(texts)}


def test_query(spark, sf_dir, documents):
    got = {r.doc_id: r.n_tokens for r in QUERIES["op4_token_counts"](spark, sf_dir).collect()}
    assert got == {r.doc_id: count(r.text) for r in documents}
