"""The six stored tables: typed scans and appends with defaults; the ledger of outward actions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gateledger.operators.store import align_schema
from gateledger.schemas import TABLE_DEFAULTS, schema

# Columns stored as JSON text in a relational source.
JSON_COLUMNS = {"gates": ["decisions", "closeout"], "attempts": ["scores"]}


def read_entity(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: object) -> DataFrame:
    """One of the six tables under its fixed schema; columns a file lacks read as null."""
    return spark.read.schema(schema(name)).format(fmt).options(**options).load(path)


def read_entity_jdbc(
    spark: SparkSession,
    name: str,
    url: str,
    table: str,
    partition_column: str = "id",
    bounds: tuple[object, object] | None = None,
    partitions: int = 64,
    **options: object,
) -> DataFrame:
    """The same from a relational database, read in ``partitions`` ranges of a column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if bounds is not None:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=partitions,
        )
    return parse_json_columns(reader.load(), name)


def parse_json_columns(df: DataFrame, name: str) -> DataFrame:
    """JSON text columns of a table as their nested types, the rest cast to the fixed schema."""
    target = schema(name)
    for column in JSON_COLUMNS.get(name, []):
        if column in df.columns:
            df = df.withColumn(column, F.from_json(F.col(column).cast("string"), target[column].dataType))
    return align_schema(df, target)


def with_defaults(df: DataFrame, name: str, identity: Column | None = None) -> DataFrame:
    """Full rows of a table: given values, else the table's defaults, else null.

    Text ids are a hash of ``identity`` so that a retried task writes the same row.
    """
    defaults: dict[str, Column] = {c: F.lit(v) for c, v in TABLE_DEFAULTS[name].items()}
    defaults |= {c: F.current_timestamp() for c in ("created_at", "updated_at")}
    if identity is not None:
        defaults["id"] = F.substring(F.sha2(identity, 256), 1, 32)
    full = align_schema(df, schema(name))
    return full.withColumns({c: F.coalesce(c, v) for c, v in defaults.items() if c in full.columns})


def _append_new(rows: DataFrame, path: str) -> None:
    """Append rows whose id is neither stored yet nor repeated, so a rerun adds nothing."""
    rows = rows.dropDuplicates(["id"])
    try:
        stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        rows = rows.join(stored.select("id"), "id", "left_anti").select(*rows.columns)
    rows.write.mode("append").parquet(path)


def append_gates(df: DataFrame, path: str) -> None:
    """Append new gates; the id follows from the gate's unique key."""
    identity = F.concat_ws(":", "repo_id", "pr_number", "head_sha")
    rows = with_defaults(df, "gates", identity)
    empty = F.array().cast(schema("gates")["decisions"].dataType)
    _append_new(rows.withColumn("decisions", F.coalesce("decisions", empty)), path)


def append_attempts(df: DataFrame, path: str) -> None:
    """Append attempts; the id follows from the gate, the comment, the reviewer, the words and the time.

    The same comment twice is one attempt. Attempts without a comment are all kept: those that are alike
    in everything are told apart by their place among each other, so a rerun of the same rows adds nothing.
    """
    full = align_schema(df, schema("attempts"))
    parts = ["checkpoint_id", "comment_id", "reviewer_id", "explanation", "created_at"]
    alike = F.row_number().over(Window.partitionBy(*parts).orderBy("reviewer_login", "hole"))
    full = full.withColumn("__nth", F.when(F.col("comment_id").isNull(), alike))
    when = F.when(F.col("comment_id").isNull(), F.unix_micros("created_at"))
    named = F.struct(
        "checkpoint_id", "comment_id", "reviewer_id", F.sha2("explanation", 256).alias("words"), when.alias("at"), F.col("__nth").alias("nth")
    )
    identity = F.to_json(named, {"ignoreNullFields": "false"})
    rows = with_defaults(full.withColumn("id", F.coalesce("id", F.substring(F.sha2(identity, 256), 1, 32))), "attempts")
    _append_new(rows, path)


def append_actions(actions: DataFrame, path: str, run: str, batch: int, redelivered_days: int = 1) -> None:
    """Write those actions of a batch that no other batch under ``path`` has written, so each is there once.

    What is stored is the ledger: a batch owns the folder of its ``run`` and number and replaces what a
    failed try of it left there, and is compared with all other folders, those of other checkpoints too.
    Folders hold a part for each day; a batch reads the ids of its own days and of those around them in
    which a delivery can have come again. One writer at a time: two at once do not see each other.
    ``actions`` is read twice, so give a written table.
    """
    spark = actions.sparkSession
    rows = actions.dropDuplicates(["action_id"]).withColumn("day", F.to_date("ts"))
    first, last = actions.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).head()
    keys = StructType.fromDDL("action_id string, run string, batch bigint, day date")
    try:
        stored = spark.read.schema(keys).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        day = F.col("day")
        near = day.between(F.date_sub(F.lit(first), redelivered_days), F.date_add(F.lit(last), redelivered_days))
        others = stored.filter((F.col("run") != run) | (F.col("batch") != batch)).filter(near | day.isNull())
        rows = rows.join(others.select("action_id"), "action_id", "left_anti").select(*rows.columns)
    rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/run={run}/batch={batch}")
