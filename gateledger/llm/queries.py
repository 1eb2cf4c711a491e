"""The operators as queries over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

import importlib.util
import os
import uuid
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.llm import bpe, infill, lm, mixing, pieces, pii, resampling, simhash, sketches, substrings, tokens, topk, toxicity
from gateledger.llm.tables import read
from gateledger.operators.scan import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def public_tokenizers() -> ModuleType:
    """The public vocabularies: the installed module, or the folder that TOKENIZERS names."""
    folder = os.environ.get("TOKENIZERS", "/opt/tokenizers")
    if importlib.util.find_spec("public_tokenizers"):
        return importlib.import_module("public_tokenizers")
    spec = importlib.util.spec_from_file_location("public_tokenizers", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def query(sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


@query()
def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch of each text and of its text with the tail taken from the next document."""
    rows = sketches.with_next(read(spark, sf_dir, "documents"), "doc_id", "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketches.sketch(F.col("edited")))
    return rows.select(
        F.col("order").alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        sketches.as_text(F.col("sketch")).alias("fingerprint"),
        sketches.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        sketches.containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"),
    )


@query()
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes from every document."""
    docs = read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "source", mixing.words().alias("size"), mixing.quality().alias("weight"))
    mixed = mixing.mix(docs, F.col("size"), F.col("weight"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query(TOP_K_SQL)
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best scores of every twentieth vector among all others."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), k=20, every=20)


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, by a cache in a fresh part of the shared folder."""
    cache = f"{ensure_checkpoint_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    return tokens.token_counts(read(spark, sf_dir, "documents"), cache, public_tokenizers().path("word_bpe_49k.json"))


@query()
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text."""
    found = pii.personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = {k: F.regexp_count("pii.base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in pii.KINDS}
    return found.select(
        "doc_id", *count.values(), F.sha2(F.encode("pii.base", "UTF-8"), 256).alias("base_sha256"), "pii.spans"
    )


@query()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash and class of near copies of every text."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text back from them, as digests."""
    vocabulary = public_tokenizers()
    ranks = bpe.read_ranks(vocabulary.path("byte_bpe_50k.tiktoken"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.there_and_back(docs, ranks, vocabulary.PATTERN).select(
        "doc_id",
        bpe.n_tokens().alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every text and whether it stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = lm.judged(docs)
    return found.select("doc_id", "lang", "quality.perplexity", "quality.threshold", "quality.keep")


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, read(spark, sf_dir, "labels")).select("doc_id", "toxicity.held_out", "toxicity.score")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query()
def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every text loses to strings of 100 bytes that started earlier."""
    found = substrings.repeated(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query()
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every text towards the benchmark texts, and the twentieth part that is drawn."""
    found = resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query()
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the merge vocabulary, and the text back from them, as digests."""
    vocabulary = pieces.Vocabulary.load(public_tokenizers().path("piece_bpe_32k.model"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.there_and_back(docs, vocabulary).select(
        "doc_id",
        pieces.n_tokens().alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


INFILL_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS x FROM documents
), h AS (
  SELECT doc_id, text, n, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS r1, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS r2,
    ('0x' || substr(x, 17, 8))::BIGINT % 100 AS r3, ('0x' || substr(x, 25, 8))::BIGINT % 100 AS r4 FROM d
), f AS (
  SELECT doc_id, text, n, least(r1, r2) AS a, greatest(r1, r2) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r3 >= 90 THEN 'plain'
      WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT doc_id, text, n, form, a, b, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


@query(INFILL_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut in three and put together anew, and the text back from it, as digests."""
    found = infill.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "infill.*")
    text = infill.restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("restored_sha256"),
    )
