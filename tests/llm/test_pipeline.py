from collections import Counter

import numpy as np
import tiktoken

import corpus_pipeline
from gateledger.llm import bpe, pii
from gateledger.llm.queries import QUERIES, public_tokenizers
from test_mixing import goals, n_words
from test_simhash import fingerprint, linked


def brute(spark, sf_dir, documents):
    """Texts by id after the first three stages; verdicts of the first are tested by themselves."""
    keep = {r.doc_id for r in QUERIES["op2_quality_classifier"](spark, sf_dir).filter("keep").collect()}
    docs = sorted((r for r in documents if r.doc_id in keep), key=lambda r: r.doc_id)
    root = linked([fingerprint(r.text or "") for r in docs])
    docs = [r for k, r in enumerate(docs) if root[k] == k]

    def clean(text):
        base, more = pii.find(text)
        return pii.redacted(text, pii.listed({k: base[k] + more[k] for k in base}))

    return {r.doc_id: (clean(r.text or ""), r.source, r.lang) for r in docs}


def test_run(spark, sf_dir, documents):
    vocabulary = public_tokenizers()
    ranks = bpe.read_ranks(vocabulary.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = brute(spark, sf_dir, documents)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    copies, held, taken = Counter(r.doc_id for r in rows), Counter(), Counter()
    for r in rows:
        text, source, lang = texts[r.doc_id]
        assert (r.source, r.lang, r.exact) == (source, lang, True)
        assert np.frombuffer(r.tokens, dtype="<u4").tolist() == own.encode_ordinary(text) and r.n_tokens == len(r.tokens) // 4
        taken[source] += n_words(text)
    for text, source, _ in texts.values():
        held[source] += n_words(text)
    assert max(copies.values()) <= 3
    largest = max(n_words(t) for t, _, _ in texts.values())
    assert all(abs(taken[s] - goal) <= largest for s, goal in goals(held).items())


def test_stages_on_odd_documents(spark, odd_docs, no_docs, sf_dir, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mix", "tokens"]
    for k, docs in enumerate((odd_docs, no_docs)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "tokens" or out.columns == odd_docs.columns
            out.write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert (docs.count() > 0) == (k == 0)


def test_own_columns_of_any_name_keep_their_values(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = docs.selectExpr("*", "doc_id + 0.5 AS quality", "doc_id * 2 AS mix", "doc_id AS verdict", "'s' AS Share", "doc_id AS _verdict")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, named, sf_dir)
        assert out.columns == named.columns
        for r in out.select("doc_id", "quality", "mix", "verdict", "Share", "_verdict").collect():
            assert (float(r.quality), r.mix, r.verdict, r.Share, r._verdict) == (r.doc_id + 0.5, r.doc_id * 2, r.doc_id, "s", r.doc_id)


def test_tokens_have_one_python_worker_a_task(spark, sf_dir):
    found = corpus_pipeline.tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
