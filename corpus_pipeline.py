"""From documents to training tokens, in stages that each read what the one before wrote.

run() writes every stage but the last as Parquet in the shared checkpoint folder and reads it again, so
a lost executor never costs more than the stage at work.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.llm import bpe, lm, mixing, pii, simhash
from gateledger.llm.queries import public_tokenizers
from gateledger.llm.tables import read
from gateledger.operators.scan import ensure_checkpoint_dir


#: Rows of whole texts that go to a Python worker at once; bounds the memory of a task on long texts.
BATCH_ROWS = 2000


def lean(spark: SparkSession) -> None:
    """Small batches for Python workers, and the disk of the stage before set free.

    Spark deletes shuffle files once the frames that wrote them are collected on the driver, which an
    idle driver puts off for up to half an hour, longer than a stage takes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is above their language's threshold go."""
    lean(spark)
    verdict = unused(docs, "verdict")
    return lm.judged(docs, into=verdict).filter(f"{verdict}.keep").drop(verdict)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    lean(spark)
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind; n_chars follows the text."""
    lean(spark)
    clean = docs.withColumn("text", pii.cleaned("text"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of a document taken in part, at least half counts as whole."""
    lean(spark)
    share = unused(docs, "share")
    mixed = mixing.mix(docs, mixing.words(), mixing.quality(), into=share)
    size, taken = F.col(f"{share}.size"), F.col(f"{share}.taken")
    times = F.when(size > 0, F.round(taken / size)).otherwise(0).cast("int")
    copies = mixed.withColumn(share, times).filter(F.col(share) > 0)
    return copies.withColumn(share, F.explode(F.sequence(F.lit(1), F.col(share)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    lean(spark)
    vocabulary = public_tokenizers()
    ranks = bpe.read_ranks(vocabulary.path("byte_bpe_50k.tiktoken"))
    coded = bpe.there_and_back(docs.select("doc_id", "lang", "source", "text"), ranks, vocabulary.PATTERN)
    exact = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select(
        "doc_id", "lang", "source", bpe.n_tokens().alias("n_tokens"), "tokens", exact.alias("exact")
    )


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("tokens", tokens),
]

ORACLE_SQL = None  # no stage but the mix can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
