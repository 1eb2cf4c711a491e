"""The event log and what hangs off its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.functions.text import split_full_name
from gateledger.schemas import EVENTS, schema


def read_events(
    spark: SparkSession, path: str, streaming: bool = False, fmt: str = "parquet", **options: object
) -> DataFrame:
    """The typed event log, as a batch or as a stream; ``fmt`` is any file format Spark reads."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema("events")).format(fmt).options(**options).load(path)


def parse_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """Events out of a message source such as Kafka, one JSON document per message."""
    parsed = F.from_json(F.col(value).cast("string"), EVENTS)
    return raw.select(parsed.alias("e")).select("e.*")


def pr_files(events: DataFrame) -> DataFrame:
    """One row per changed file; a pull request without files keeps one row with a null file."""
    kept = [c for c in events.columns if c not in ("files", "diff")]
    return events.select(*kept, F.explode_outer("files").alias("file"))


def _full_name(repo: Column, account: Column) -> Column:
    own = F.nullif(repo["full_name"], F.lit(""))
    return F.coalesce(own, F.concat_ws("/", account, repo["name"]))


def install_repos(events: DataFrame) -> DataFrame:
    """Repositories of install events as (owner, repo); names without both parts are left out.

    An empty ``repositories`` list still wins over ``repositories_added``; an empty full name does not.
    """
    listed = F.coalesce("repositories", "repositories_added")
    named = events.select(
        "delivery_id", "installation_id", "account_login", F.explode(listed).alias("r")
    ).withColumn("name", split_full_name(_full_name(F.col("r"), F.col("account_login"))))
    return named.select("delivery_id", "installation_id", "name.owner", "name.repo").filter(
        (F.col("owner") != "") & (F.col("repo") != "")
    )
