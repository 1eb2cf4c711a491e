"""Pull-request data derived from the given tables, which hold none: same shapes, row for row.

Each function has a common table expression of the same name in :mod:`gateledger.plans.sql`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.schemas import DECISIONS, GRADE

TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str, streaming: bool = False) -> DataFrame:
    """A given table under its fixed schema, with naive timestamps taken as UTC."""
    if streaming:
        reader = spark.readStream.schema(TABLES[name]).option("pathGlobFilter", f"{name}.parquet")
        df = reader.parquet(sf_dir)
    else:
        df = spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a table that comes as fewer splits than there are cores; larger ones stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def text_id(col: str) -> Column:
    """Numeric ids as text that sorts in numeric order."""
    return F.lpad(F.col(col).cast("string"), 12, "0")


def props_k() -> Column:
    """The one field of ``props``, always ``{"k": <int>}``; cheaper than parsing JSON at every use."""
    return F.translate("props", '{}"k: ', "").cast("int")


def gates(events: DataFrame) -> DataFrame:
    passed = F.col("event_type") == "purchase"
    return events.select(
        text_id("event_id").alias("id"),
        F.col("user_id").alias("repo_id"),
        (F.col("user_id") % 10).alias("installation_id"),
        (props_k() % 3).alias("pr_number"),
        F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string")).alias("head_sha"),
        F.substring(F.sha2("event_type", 256), 1, 16).alias("decisions_hash"),
        F.lit("medium").alias("rigor"),
        F.when(passed, "passed").otherwise("pending").alias("status"),
        F.when(passed, F.concat(F.lit("u"), (F.col("event_id") % 50).cast("string"))).alias("passed_by"),
        F.when(passed, F.col("event_id") % 50).alias("passed_by_id"),
        F.when(passed, F.col("ts")).alias("passed_at"),
        F.col("ts").alias("created_at"),
    )


def repos(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("id"), (F.col("user_id") % 10).alias("installation_id")
    ).distinct()


def attempts(conversations: DataFrame) -> DataFrame:
    """Each turn is an attempt on its conversation; a turn's place stands for its time."""
    return conversations.select(
        F.format_string("%010d-%04d", "conv_id", "turn").alias("id"),
        F.col("conv_id").cast("string").alias("checkpoint_id"),
        F.col("role").alias("reviewer_login"),
        F.length("role").cast("bigint").alias("reviewer_id"),
        F.col("text").alias("explanation"),
        (F.length("text") % 4 == 0).alias("grade_pass"),
        (F.length("text") % 5 == 0).alias("ungraded"),
        F.when(F.length("text") % 4 != 0, F.substring("text", 1, 20)).alias("hole"),
        F.lit(True).alias("assisted"),
        F.col("turn").alias("created_at"),
    )


def local_events(orders: DataFrame) -> DataFrame:
    price = F.floor("o_totalprice")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("github_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("github_login"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit("@x"))).alias("email"),
        F.col("o_orderpriority").alias("subsystem"),
        F.col("o_orderstatus").alias("concept"),
        (F.col("o_orderstatus") == "F").alias("passed"),
        (price % 3 == 0).alias("told"),
        (price % 2 == 0).alias("assisted"),
        F.when(price % 5 != 0, price % 7 == 0).alias("ungraded"),
        F.col("o_orderdate").alias("created_at"),
    )


def user_attempts(events: DataFrame) -> DataFrame:
    """Merge-time attempts of people: one per event."""
    return events.select(
        text_id("event_id").alias("id"),
        F.when(F.col("user_id") % 13 != 0, F.col("user_id")).alias("reviewer_id"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("reviewer_login"),
        (F.col("value") >= 40).alias("grade_pass"),
        F.lit(True).alias("assisted"),
        F.col("ts").alias("created_at"),
    )


def pr_events(events: DataFrame) -> DataFrame:
    """A pull-request event log: opens, pushes and graded comments, with every edge case mixed in."""
    k, n = props_k(), F.col("event_id")
    kind = F.col("event_type")
    is_push = kind.isin("click", "view")
    is_comment = kind.isin("purchase", "error")
    topic = F.concat(F.lit("topic-"), (n % 2).cast("string"))
    decisions = F.array(
        F.struct(
            topic.alias("concept"),
            F.concat(F.lit("summary of "), topic).alias("summary"),
            F.lit(None).cast("string").alias("question"),
        )
    )
    graded = is_comment & (k % 29 != 1)
    grade = F.struct(
        (F.col("value") >= 40).alias("pass"),
        (k % 19 == 2).alias("ungraded"),
        F.array().cast("array<string>").alias("covered"),
        F.array().cast("array<string>").alias("missing"),
        topic.alias("hole"),
        F.lit("no answer").alias("note"),
    )
    day = F.floor(F.dayofmonth("ts") / 10).cast("string")
    return events.select(
        text_id("event_id").alias("delivery_id"),
        F.when(is_comment, "comment").otherwise("pull_request").alias("kind"),
        F.when(is_comment, "created").when(is_push, "synchronize").when(k % 2 == 0, "opened").otherwise("ready_for_review").alias("action"),
        "ts",
        (F.col("user_id") % 10).alias("installation_id"),
        F.col("user_id").alias("repo_id"),
        (k % 3).alias("pr_number"),
        F.concat(F.lit("c"), F.when(is_push, n.cast("string")).otherwise(F.concat(F.lit("d"), day))).alias("head_sha"),
        F.when(k % 13 == 0, True).when(k % 11 != 0, False).alias("draft"),
        F.when(k % 10 == 0, F.array(F.lit("docs/guide.md"), F.lit("LICENSE")))
        .when(k % 10 == 1, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("src/m"), k.cast("string"), F.lit(".py")), F.lit("README.md")))
        .alias("files"),
        F.concat(
            F.lit("+++ b/x\n"), F.repeat(F.lit("+line\n"), k % 20), F.repeat(F.lit("-old\n"), (n % 5).cast("int"))
        ).alias("diff"),
        F.when(k % 17 == 0, F.array().cast(DECISIONS)).otherwise(decisions.cast(DECISIONS)).alias("decisions"),
        F.when(is_comment, n).alias("comment_id"),
        F.when(
            is_comment,
            F.when(k % 7 == 0, "lgtm").otherwise(
                F.concat(F.lit("It holds because of mechanism number "), n.cast("string"), F.lit(" and not by luck."))
            ),
        ).alias("body"),
        F.col("user_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_login"),
        F.when(k % 17 == 3, "Bot").when(k % 17 != 4, "User").alias("user_type"),
        F.element_at(F.array(*map(F.lit, ["OWNER", "MEMBER", "COLLABORATOR", "CONTRIBUTOR"])), k % 4 + 1).alias("author_association"),
        (is_comment & (k % 23 != 5)).alias("is_pr"),
        F.when(graded, grade.cast(GRADE)).alias("grade"),
    )


def answers(documents: DataFrame) -> DataFrame:
    """Model answers of varying quality: fenced, in chatter, cut off, not a list, empty concept."""
    verdict = F.when(F.col("lang") == "en", "strong").when(F.col("lang") == "fr", "thin").otherwise(F.col("lang"))
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.col("source").alias("concept"), verdict.alias("verdict"), F.col("text").alias("note")
                )
            ).alias("topics"),
            F.col("text").alias("strongest"),
            F.col("lang").alias("growth_edge"),
            F.lit("ok").alias("one_line"),
        )
    )
    shape = F.col("doc_id") % 6
    raw = (
        F.when(shape == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nBye {x}")))
        .when(shape == 1, F.concat(F.lit("Sure. "), body, F.lit(" Done.")))
        .when(shape == 2, F.lit('} no object {'))
        .when(shape == 3, F.lit('{"topics": "none", "one_line": "x"}'))
        .when(shape == 4, F.lit('{"topics": [{"concept": "", "verdict": "solid"}]}'))
        .otherwise(body)
    )
    return documents.select("doc_id", raw.alias("raw"))
