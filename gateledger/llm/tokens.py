"""Token counts by way of a digest cache.

A text is normalised, and the digest of what results, joined with the digest of the tokenizer's
file, is looked up in a stored table of counts. Only distinct contents that are not stored are
encoded, and their counts are appended to the table.

Normalising makes each run of ASCII white space one space and drops it at both ends, which this
kind of tokenizer, blind to white space, does not see. For the same reason the count of a text is
the sum over its pieces between white space, so a task encodes a piece it has met before only once.
Special strings hold no white space and are treated as the library treats them by default.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from gateledger.llm.tables import cut, whole

MEMO = 400_000  # pieces a task remembers before it starts afresh
BATCH = 20_000
CACHE = "content_digest string, tokenizer_digest string, n_tokens long"


def normalised(text: str) -> bytes:
    return b" ".join(text.encode().split())


@F.pandas_udf(T.StringType())
def digest_of(texts: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha256(normalised(t)).hexdigest() for t in texts])


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts tokens of normalised texts with the tokenizers library, remembering pieces."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), {}

    def counts(self, texts: list[bytes]) -> list[int]:
        pieces = [t.split() for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list(set().union(*pieces).difference(self.memo))
        for at in range(0, len(new), BATCH):
            part = new[at : at + BATCH]
            got = self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)
            self.memo.update(zip(part, map(len, got)))
        known = self.memo.__getitem__
        return [sum(map(known, p)) for p in pieces]


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer; empty where nothing is stored yet."""
    try:
        stored = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    mine = stored.filter(F.col("tokenizer_digest") == tokenizer)
    return mine.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each content that a task meets, once, compressed."""
    seen: set[str] = set()
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        if len(seen) > 2 * MEMO:
            seen.clear()
        fresh = []
        for text in batch["text"]:
            body = normalised(text)
            digest = hashlib.sha256(body).hexdigest()
            if digest not in seen:
                seen.add(digest)
                fresh.append((digest, press.compress(body)))
        yield pd.DataFrame(fresh, columns=["content_digest", "body"])


def encoded(path: str):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, unpress, done = Counter(path), zstandard.ZstdDecompressor(), set()
        for batch in batches:
            # equal digests stand together: only the last of a batch can go on in the next
            batch = batch[~batch["content_digest"].duplicated() & ~batch["content_digest"].isin(done)]
            texts = [unpress.decompress(b) for b in batch["body"]]
            yield pd.DataFrame({"content_digest": batch["content_digest"], "n_tokens": counter.counts(texts)})
            done = set(batch["content_digest"].tail(1)) or done

    return encode


def token_counts(
    docs: DataFrame, cache: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; counts new to ``cache`` are appended to it.

    ``tokenizer`` is the path of a tokenizers file whose pieces end at white space. No special tokens
    are added, nothing is cut or padded. Null is empty and has 0 tokens. Rows with the same id stand
    each for themselves. A rerun finds everything stored and encodes nothing.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    texts = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    rows = cut(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest_of("text").alias("content_digest")))
    stored = read_cache(spark, cache, version)
    missing = cut(rows.select("content_digest").distinct().join(stored, "content_digest", "left_anti"))
    if not missing.isEmpty():
        todo = texts.select("text").mapInPandas(packed, "content_digest string, body binary")
        todo = todo.join(missing, "content_digest", "left_semi").sortWithinPartitions("content_digest")
        new = todo.mapInPandas(encoded(tokenizer), "content_digest string, n_tokens long")
        new.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version)
    counted = rows.join(counts, "content_digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
