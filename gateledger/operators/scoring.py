"""Batch scoring of text through one pluggable model function.

A scorer is a picklable function without arguments that builds the model client once per
partition and returns ``complete(system, user, model=None, timeout=60.0) -> str``. Requests are
deduplicated before any call; an exception costs only its own row; answers are parsed by native
columns. A failed or unreadable grade is ``ungraded`` and never a pass.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gateledger.functions.answers import extract_json, normalise_closeout
from gateledger.functions.text import ask_for, clip, ground_truth, let, numbered
from gateledger.operators.aggregates import grader_eval
from gateledger.operators.overlap import words
from gateledger.operators.scan import cut
from gateledger.schemas import DECISIONS, GRADE

Complete = Callable[..., str]
Scorer = Callable[[], Complete]

# Time bounds of a call, and how much of an explanation the close reads.
TIMEOUT_S, CLOSEOUT_TIMEOUT_S = 60.0, 30.0
CLOSEOUT_CHARS = 6000

AT_ONCE = 256  # requests that a task holds as Python values, with their answers
ROUNDS = 16  # parts in which requests without a stored answer are asked
ANSWERS = "__key string, raw string, error string"

COVERED_SHARE = {"medium": 0.5, "harsh": 0.8}
WHOLE_CHANGE = "the change as a whole"


def score_text(
    df: DataFrame,
    scorer: Scorer,
    system: Column,
    user: Column,
    model: str | None = None,
    timeout: float = TIMEOUT_S,
    calls_at_once: int | None = None,
    ledger: str | None = None,
    rounds: int = ROUNDS,
    pause_s: float = 0.0,
    observed: Observation | str | None = None,
) -> DataFrame:
    """Add ``raw`` (the answer, '' when the model gave none) and ``error`` (null when it answered).

    ``calls_at_once`` bounds the partitions and with them the concurrent calls; ``pause_s`` is the least
    time between the starts of two calls of a partition. Answers are
    written to the checkpoint folder: a lost executor must not repeat paid calls downstream.

    With a ``ledger``, a shared folder, answers are kept there by digest of model, system and user, and only
    requests without one are asked, in ``rounds`` parts of their digests. Tasks that are done keep their answers
    even if the job dies: a later run repeats at most the calls of the tasks that were at work. Failed calls are
    not kept, so the next run asks again. One ledger may serve many prompts and models; name another model,
    or another folder, when a model changes under its name. ``observed`` counts rows, answered and failed ones.
    """

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        complete, free = None, 0.0
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(start, AT_ONCE)
                raws, errors = [], []
                for s, u in zip(some.column("__system").to_pylist(), some.column("__user").to_pylist(), strict=True):
                    time.sleep(max(0.0, free - time.monotonic()))
                    free = time.monotonic() + pause_s
                    try:
                        complete = complete or scorer()
                        raws.append(complete(s, u, model=model, timeout=timeout) or "")
                        errors.append(None)
                    except Exception as err:  # any failure of a call leaves its row unanswered
                        raws.append(None)
                        errors.append(str(err) or type(err).__name__)
                answers = [some.column("__key"), pa.array(raws, pa.string()), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(answers, names=["__key", "raw", "error"])

    # a given number of partitions, which adaptive execution does not merge
    tasks = calls_at_once or df.sparkSession.sparkContext.defaultParallelism

    def ask(requests: DataFrame) -> DataFrame:
        return requests.repartition(tasks).mapInArrow(call, ANSWERS)

    request = F.struct(F.lit(model).cast("string").alias("model"), "__system", "__user")
    key = F.sha2(F.to_json(request, {"ignoreNullFields": "false"}), 256)
    keyed = df.withColumns({"__system": system, "__user": user}).withColumn("__key", key)
    requests = keyed.select("__key", "__system", "__user").dropDuplicates(["__key"])
    answers = cut(ask(requests)) if ledger is None else _kept(requests, ask, ledger, rounds)
    scored = keyed.join(answers, "__key").drop("__key", "__system", "__user")
    if observed is None:
        return scored
    counts = F.count("*").alias("asked"), F.count("raw").alias("answered"), F.count("error").alias("failed")
    return scored.observe(observed, *counts)


def _kept(requests: DataFrame, ask: Callable[[DataFrame], DataFrame], ledger: str, rounds: int) -> DataFrame:
    """Answers of all requests: those in the ledger, and new ones that each round adds to it."""
    spark = requests.sparkSession
    columns = StructType.fromDDL(ANSWERS)

    def stored() -> DataFrame:
        # two jobs at once may have asked the same: any answer will do, but the same one every time
        kept = spark.read.schema(columns).parquet(ledger).filter("raw IS NOT NULL")
        return kept.groupBy("__key").agg(F.min("raw").alias("raw"), F.lit(None).cast("string").alias("error"))

    # an empty part, so that the folder is there
    spark.createDataFrame([], columns).write.mode("append").parquet(ledger)
    missing = cut(requests.join(stored().select("__key"), "__key", "left_anti"))
    part = F.pmod(F.xxhash64("__key"), F.lit(rounds))
    for n in range(0 if missing.isEmpty() else rounds):
        asked = ask(missing.filter(part == n))
        # the second committer moves the files of a task when the task is done, not when the job is
        asked.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(ledger)
    failed = spark.read.schema(columns).parquet(ledger).filter("raw IS NULL").groupBy("__key").agg(F.max("error").alias("error"))
    known = requests.select("__key").join(stored(), "__key", "left").join(
        failed.withColumnRenamed("error", "__failed"), "__key", "left"
    )
    return cut(known.select("__key", "raw", F.when(F.col("raw").isNull(), F.col("__failed")).alias("error")))


def decompose_batch(prs: DataFrame, scorer: Scorer, **options: object) -> DataFrame:
    """Add ``decompose_ok`` and ``decisions`` to pull requests with a ``diff``; failure gives an empty list."""
    system = F.lit(
        "List the decisions a code change rests on. Answer with one JSON object: "
        '{"decisions": [{"concept": "...", "summary": "...", "question": "..."}]}'
    )
    scored = score_text(prs.drop("decisions"), scorer, system, F.coalesce("diff", F.lit("")), **options)
    found = F.try_variant_get(extract_json(F.col("raw")), "$.decisions", DECISIONS)
    return scored.withColumns(
        {
            "decompose_ok": found.isNotNull(),
            "decisions": F.coalesce(found, F.array().cast(DECISIONS)),
        }
    ).drop("raw", "error")


def grade_prompt(rigor: Column) -> Column:
    return F.concat(
        F.lit("Grade whether an explanation shows the mechanism of each listed decision. Rigor: "),
        rigor,
        F.lit(
            '. Answer with one JSON object: {"pass": true, "covered": ["..."], "missing": ["..."], "hole": "..."}'
        ),
    )


def read_grade(raw: Column, error: Column) -> Column:
    """An answer as a grade; anything without a plain true or false ``pass`` is ungraded."""
    no_names = F.array().cast("array<string>")

    def read(parsed: Column) -> Column:
        def names(path: str) -> Column:
            return F.coalesce(F.try_variant_get(parsed, path, "array<string>"), no_names)

        kind = F.schema_of_variant(F.try_variant_get(parsed, "$.pass", "variant"))
        graded = F.coalesce(kind == "BOOLEAN", F.lit(False))
        return F.struct(
            F.coalesce(graded & F.try_variant_get(parsed, "$.pass", "boolean"), F.lit(False)).alias("pass"),
            (~graded).alias("ungraded"),
            names("$.covered").alias("covered"),
            names("$.missing").alias("missing"),
            F.coalesce(F.try_variant_get(parsed, "$.hole", "string"), F.lit("")).alias("hole"),
            F.when(~graded, F.coalesce(error, F.lit("unreadable grade"))).alias("note"),
        ).cast(GRADE)

    return let(extract_json(raw), read)


def grade_batch(requests: DataFrame, scorer: Scorer, **options: object) -> DataFrame:
    """Add ``grade`` to requests (decisions, explanation, rigor)."""
    user = F.concat(
        F.lit("Decisions:\n"), ground_truth(F.col("decisions")),
        F.lit("\n\nExplanation:\n"), F.coalesce("explanation", F.lit("")),
    )
    scored = score_text(requests, scorer, grade_prompt(F.col("rigor")), user, **options)
    return scored.withColumn("grade", read_grade(F.col("raw"), F.col("error"))).drop("raw", "error")


def closeout_prompt(decisions: Column) -> Column:
    topics = F.coalesce(
        F.nullif(numbered(decisions, "\n", "  "), F.lit("")), F.lit(f"  ({WHOLE_CHANGE})")
    )
    return F.concat(
        F.lit("An explanation has passed. For each topic say how well it was explained (strong, solid or thin).\nTopics:\n"),
        topics,
        F.lit(
            '\nAnswer with one JSON object: {"topics": [{"concept": "...", "verdict": "...", "note": "..."}], '
            '"strongest": "...", "growth_edge": "...", "one_line": "..."}'
        ),
    )


def closeout_batch(passed: DataFrame, scorer: Scorer, **options: object) -> DataFrame:
    """Add ``closeout`` to passed explanations (decisions, explanation); any failure gives null."""
    text = clip(F.coalesce("explanation", F.lit("")), CLOSEOUT_CHARS)
    options = {"timeout": CLOSEOUT_TIMEOUT_S, **options}
    scored = score_text(passed, scorer, closeout_prompt(F.col("decisions")), text, **options)
    return scored.withColumn("closeout", normalise_closeout(F.col("raw"))).drop("raw", "error")


def coverage_grade(decisions: Column, explanation: Column, rigor: Column) -> Column:
    """Offline grade without a model: a decision is covered when enough of its summary's distinct
    words appear in the explanation. Passes when every decision is covered, and there is one."""
    needed = F.when(rigor == "harsh", COVERED_SHARE["harsh"]).otherwise(COVERED_SHARE["medium"])
    told = F.array_distinct(words(F.coalesce(explanation, F.lit(""))))

    def covered(d: Column, told: Column) -> Column:
        wanted = F.array_distinct(words(F.coalesce(d["summary"], F.lit(""))))
        return let(
            wanted,
            lambda w: F.when(F.size(w) > 0, F.size(F.array_intersect(w, told)) / F.size(w) >= needed).otherwise(
                F.lit(False)
            ),
        )

    def concepts(marked: Column, wanted: bool) -> Column:
        kept = F.filter(marked, lambda m: m["ok"] == F.lit(wanted))
        return F.transform(kept, lambda m: F.coalesce(m["d"]["concept"], F.lit("")))

    def grade(marked: Column) -> Column:
        open_ = F.filter(marked, lambda m: ~m["ok"])
        some = F.coalesce(F.size(marked) > 0, F.lit(False))
        hole = (
            F.when(~some, F.lit(WHOLE_CHANGE))
            .when(F.size(open_) > 0, ask_for(F.get(open_, F.lit(0))["d"]))
            .otherwise(F.lit(""))
        )
        return F.struct(
            (some & (F.size(open_) == 0)).alias("pass"),
            F.lit(False).alias("ungraded"),
            concepts(marked, True).alias("covered"),
            concepts(marked, False).alias("missing"),
            hole.alias("hole"),
            F.lit(None).cast("string").alias("note"),
        )

    marked = let(
        told,
        lambda t: F.transform(
            F.coalesce(decisions, F.array().cast(DECISIONS)),
            lambda d: F.struct(d.alias("d"), covered(d, t).alias("ok")),
        ),
    )
    return let(marked, grade)


def coverage_scorer(requests: DataFrame) -> DataFrame:
    """``grade_batch`` by :func:`coverage_grade`: all native columns, no Python workers."""
    grade = coverage_grade(F.col("decisions"), F.col("explanation"), F.col("rigor"))
    return requests.withColumn("grade", grade)


def run_eval(scenarios: DataFrame, scorer: Scorer | None = None, **options: object) -> DataFrame:
    """Grade every scenario (name, explanation, decisions, rigors, expected) at each of its rigors
    and count the errors per rigor. Without a scorer the coverage grade is measured."""
    cases = scenarios.withColumn("rigor", F.explode("rigors"))
    graded = grade_batch(cases, scorer, **options) if scorer else coverage_scorer(cases)
    verdicts = graded.select(
        "name",
        "rigor",
        F.try_element_at("expected", F.col("rigor")).alias("expected"),
        "grade.pass",
        "grade.ungraded",
    )
    return grader_eval(verdicts, ["rigor"]).select(
        "rigor", "false_pass", "false_fail", "total", "correct", "accuracy_pct"
    )
