import hashlib

import numpy as np
import pytest
import sentencepiece

from gateledger.llm import pieces
from gateledger.llm.queries import QUERIES, public_tokenizers

PATH = public_tokenizers().path("piece_bpe_32k.model")
VOCABULARY = pieces.Vocabulary.load(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_bos=True, add_eos=True)


def ids(tokens):
    return np.frombuffer(tokens, dtype="<u4").tolist()


def test_odd_documents_as_the_library_encodes_them(odd_docs, odd_rows):
    rows = pieces.decode(pieces.encode(odd_docs, VOCABULARY), VOCABULARY).collect()
    assert set(odd_docs.columns) | {"tokens", "decoded"} == set(rows[0].asDict())
    assert sorted((tuple(r)[:10] for r in rows), key=repr) == sorted(map(tuple, odd_rows), key=repr)
    for r in rows:
        assert ids(r.tokens) == library_ids(r.text)
        assert r.decoded == LIBRARY.decode(ids(r.tokens))


def test_random_characters_and_spaces():
    rng = np.random.default_rng(4)
    signs = [*map(chr, range(0x180)), *"а字语🎉‍ 　\x85٣<|>'▁▁▁      "]
    texts = ["".join(rng.choice(signs, rng.integers(1, 80))) for _ in range(400)]
    texts += ["<s>", "</s><unk><0x41>", " " * 500, "a" * 700, "▁a ▁", "x" + " " * 33 + "y", "ab" * 900 + " ab" * 900]
    known = pieces.Stretches(VOCABULARY)
    for text in texts:
        mine = [VOCABULARY.begin, *ids(known.encoded([text])[0]), VOCABULARY.end]
        assert mine == library_ids(text), text
        assert pieces.text_of(mine, VOCABULARY).decode() == LIBRARY.decode(mine), text


def test_random_ids_decode_as_the_library_decodes_them(spark):
    rng = np.random.default_rng(6)
    rows = [rng.integers(0, 32_000, rng.integers(0, 30)).tolist() for _ in range(200)]
    rows += [rng.integers(0, 300, rng.integers(0, 20)).tolist() for _ in range(300)]
    rows += [[28705, 28705, 264], [1, 233, 191, 28705], [0, 264], [233, 191, 165, 264], [], [2, 1, 28705]]
    df = spark.createDataFrame([(bytearray(np.array(r, "<u4").tobytes()),) for r in rows] + [(None,)], "tokens binary")
    for r in pieces.decode(df, VOCABULARY).collect():
        assert r.decoded == (None if r.tokens is None else LIBRARY.decode(ids(r.tokens)))


def test_one_long_text_and_an_empty_table(spark, no_docs):
    text = "Zwölf Wörter und 漢字 stehen  hier, again and again.\n" * 40_000
    got = pieces.encode(spark.createDataFrame([(text,)], "text string"), VOCABULARY).head()
    assert ids(got.tokens) == library_ids(text)
    assert pieces.encode(no_docs, VOCABULARY).count() == 0


def test_a_difference_and_an_unknown_id_are_errors(spark):
    other = pieces.Vocabulary.load(PATH)
    other.merged = {pair: 5 for pair in other.merged}
    with pytest.raises(Exception, match="encodes a text otherwise"):
        pieces.encode(spark.createDataFrame([("the other",)], "text string"), other).collect()
    with pytest.raises(Exception, match="not in the vocabulary"):
        pieces.decode(spark.createDataFrame([(bytearray(b"\xff\xff\xff\x7f"),)], "tokens binary"), VOCABULARY).collect()


def test_other_kinds_of_models_are_refused():
    model = VOCABULARY.model.replace(b"\x18\x02 \x80\xfa\x01", b"\x18\x01 \x80\xfa\x01", 1)  # model_type 2, vocab_size 32000
    assert model != VOCABULARY.model
    with pytest.raises(ValueError, match="merge vocabularies"):
        pieces.Vocabulary(model)


def test_query(spark, sf_dir, documents):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_sentencepiece"](spark, sf_dir).collect()}
    want = {}
    for r in documents:
        found = library_ids(r.text)
        digests = (np.array(found, "<u4").tobytes(), LIBRARY.decode(found).encode())
        want[r.doc_id] = (len(found), *(hashlib.sha256(d).hexdigest() for d in digests))
    assert got == want


def test_there_and_back_is_one_step_of_the_plan(odd_docs, no_docs, spark, sf_dir):
    found = pieces.there_and_back(odd_docs, VOCABULARY)
    two = pieces.decode(pieces.encode(odd_docs, VOCABULARY), VOCABULARY)
    assert found.columns == two.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)
    assert pieces.there_and_back(no_docs, VOCABULARY).count() == 0
    plan = QUERIES["op12_sentencepiece"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
