"""The gate of every pull request over a whole history, without Python workers.

A pull request's pending gates form a stack: a new gate goes on top, an explanation is
measured against the top, a pass takes the top away. So each step of the machine is a running
value over the pull request's events:

1. an opened event is a duplicate if the last effective event had the same head;
2. a push carries a pass forward if its decisions equal those of the gate before it and a pass
   arrived since the run of equal decisions began;
3. the stack height is a running sum of +1 (new gate) and -1 (pass), held at zero;
4. an explanation's gate is the last one created at the height it finds.

In the usual plan all of these share one shuffle on (repo_id, pr_number); pull requests with
too many events for one task take the bucketed plan of :mod:`gateledger.operators.scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gateledger.functions.text import decisions_hash
from gateledger.operators.filters import ROUTES, classify_prs, is_explanation
from gateledger.operators.pull_request import folded
from gateledger.operators.quota import DAILY_GLOBAL, DAILY_PER_INSTALL, history_replay
from gateledger.operators.scan import (
    HOT_ROWS, Running, cut, hot_keys, hour_of, join_null_safe, run_split, running, split_hot, written,
)
from gateledger.operators.windows import PR

ORDER = ["ts", "delivery_id"]
GRADED = "grade:"  # before the id of a comment: the id of the event with its grade


def gate_id(repo: Column, pr: Column, delivery: Column) -> Column:
    """A gate's id is a function of the delivery that opens it, so retried tasks agree."""
    return F.substring(F.sha2(F.concat_ws(":", repo, pr, delivery), 256), 1, 32)


def relevant_events(events: DataFrame) -> DataFrame:
    """Classified pull-request events and eligible comments as narrow rows; diffs and file lists end here."""
    opened = (F.col("kind") == "pull_request") & F.col("action").isin(ROUTES["opened"])
    pushed = (F.col("kind") == "pull_request") & F.col("action").isin(ROUTES["synchronize"])
    ready = ~F.coalesce(F.col("draft"), F.lit(False))
    commented = (F.col("kind") == "comment") & F.col("action").isin(ROUTES["comment"]) & is_explanation()
    graded = (F.col("kind") == "grade") & F.col("grade").isNotNull()
    step = (
        F.when(opened & ready, "opened")
        .when(pushed & ready, "pushed")
        .when(commented | graded, "explained")
    )
    none = F.lit(None).cast("string")
    capped = F.col("capped") if "capped" in events.columns else none
    bound = F.when(F.col("kind") == "grade", F.col("gate_id")) if "gate_id" in events.columns else none
    # The plain filter on kind reaches the scan; the one on step cannot.
    known = events.filter(F.col("kind").isin("pull_request", "comment", "grade"))
    kept = known.withColumn("step", step).filter(F.col("step").isNotNull())
    is_pr = F.col("step") != "explained"
    return classify_prs(kept).select(
        "delivery_id",
        "ts",
        "installation_id",
        *PR,
        "step",
        "head_sha",
        F.when(is_pr, F.coalesce("decisions", F.array().cast(kept.schema["decisions"].dataType))).alias("decisions"),
        F.when(is_pr, decisions_hash(F.col("decisions"))).alias("decisions_hash"),
        F.when(is_pr, F.col("trivial")).alias("trivial"),
        F.when(is_pr, F.col("reason")).alias("reason"),
        F.when(is_pr, capped).alias("capped"),
        "comment_id",
        "user_id",
        "user_login",
        F.when(~is_pr, F.coalesce("body", F.lit(""))).alias("body"),
        F.when(~is_pr, F.col("grade")).alias("grade"),
        bound.alias("bound"),
    )


def _place() -> Column:
    return F.struct(*ORDER)


def _mark_carries(rows: DataFrame, effective: Column, passes: Column, bucket: Column | None) -> DataFrame:
    """Add ``carries``: this push would carry a pass forward if it took effect."""
    rows = rows.withColumns({"__effective": effective, "__pass": passes})
    rows = running(
        rows,
        PR,
        ORDER,
        {
            "__before_hash": Running("last", F.when(F.col("__effective"), F.col("decisions_hash")), before=True),
            "__last_pass": Running("max", F.when(F.col("__pass"), _place()), before=True),
        },
        bucket,
    )
    same = (F.col("step") == "pushed") & F.col("__before_hash").eqNullSafe(F.col("decisions_hash"))
    starts = F.when(F.col("__effective") & ~same, _place())
    rows = running(rows.withColumn("__same", same), PR, ORDER, {"__run_start": Running("max", starts)}, bucket)
    carries = F.col("__same") & F.coalesce(F.col("__last_pass") > F.col("__run_start"), F.lit(False))
    return rows.withColumn("carries", carries).drop(
        "__before_hash", "__last_pass", "__run_start", "__same", "__pass"
    )


def carry_forward(pushes: DataFrame, passes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Which gated pushes carry an earlier pass onto their head, over a whole history.

    ``pushes`` (repo_id, pr_number, ts, delivery_id, action, decisions_hash) hold only effective
    events; ``passes`` (repo_id, pr_number, ts, delivery_id) are passing explanations.
    """
    step = F.when(F.col("action").isin(ROUTES["synchronize"]), "pushed").otherwise("opened")
    p = pushes.select(*PR, *ORDER, "action", "decisions_hash", step.alias("step"))
    rows = p.unionByName(passes.select(*PR, *ORDER, F.lit("explained").alias("step")), allowMissingColumns=True)
    is_pass = F.col("step") == "explained"

    def run(part: DataFrame, hot: bool) -> DataFrame:
        return _mark_carries(part, ~is_pass, is_pass, hour_of("ts") if hot else None)

    return split_hot(rows, PR, run, hot_rows).filter(~is_pass).select(
        *PR, *ORDER, "action", "decisions_hash", F.col("carries").alias("carried")
    )


def _passes() -> Column:
    ungraded = F.coalesce(F.col("grade.ungraded"), F.lit(False))
    return F.col("grade").isNotNull() & ~ungraded & F.coalesce(F.col("grade.pass"), F.lit(False))


def _machine(rows: DataFrame, bucket: Column | None) -> DataFrame:
    is_pr = F.col("step") != "explained"
    stateful = is_pr & ~F.col("trivial") & F.col("capped").isNull()
    rows = running(
        rows, PR, ORDER, {"__before_head": Running("last", F.when(stateful, F.col("head_sha")), before=True)}, bucket
    )
    duplicate = (F.col("step") == "opened") & F.coalesce(F.col("__before_head") == F.col("head_sha"), F.lit(False))
    rows = rows.withColumn("duplicate", duplicate).drop("__before_head")

    graded = F.col("grade").isNotNull()
    ungraded = F.coalesce(F.col("grade.ungraded"), F.lit(False))
    passes = _passes()
    effective = F.coalesce(stateful & ~F.col("duplicate"), F.lit(False))
    rows = _mark_carries(rows, effective, passes, bucket)

    new_gate = F.col("__effective") & ~F.col("carries")
    own_id = gate_id(F.col("repo_id"), F.col("pr_number"), F.col("delivery_id"))
    rows = rows.withColumns(
        {
            "__new": new_gate,
            "__id": F.when(new_gate, own_id),
            "__step": F.when(new_gate, 1).when(passes, -1).otherwise(0),
        }
    )
    rows = running(
        rows,
        PR,
        ORDER,
        {
            "__sum": Running("sum", F.col("__step")),
            "__latest": Running("last", F.col("__id"), before=True),
        },
        bucket,
    )
    rows = running(rows, PR, ORDER, {"__low": Running("min", F.col("__sum"), before=True)}, bucket)
    # Height before the row: the walk so far, lifted by its deepest dip below zero.
    height = F.col("__sum") - F.col("__step") - F.least(F.lit(0), F.coalesce("__low", F.lit(0)))
    level = F.when(F.col("__new"), height + 1).when(F.col("step") == "explained", height).otherwise(0)
    rows = running(
        rows.withColumn("__level", level),
        [*PR, "__level"],
        ORDER,
        {"__target": Running("last", F.col("__id"))},
        bucket,
    )

    target = F.when(F.col("__level") > 0, F.col("__target"))
    outcome = (
        F.when(F.col("duplicate"), "duplicate")
        .when(F.col("trivial"), "trivial")
        .when(F.col("capped").isNotNull(), "capped")
        .when(F.col("__new"), "gated")
        .when(F.col("__effective"), "carried")
        .when(target.isNull(), "ignored")
        .when(~graded, "requested")
        .when(ungraded, "ungraded")
        .when(passes, "passed")
        .otherwise("failed")
    )
    gate = (
        F.when(F.col("__new"), F.col("__id"))
        .when(F.col("__effective"), F.col("__latest"))
        .when(F.col("step") == "explained", target)
    )
    moves = rows.withColumns({"outcome": outcome, "gate_id": gate})
    return moves.withColumn("capped", F.when(F.col("outcome") == "capped", F.col("capped"))).drop(
        "__effective", "__new", "__id", "__step", "__sum", "__latest", "__low", "__level", "__target", "duplicate"
    )


def _machine_by_heat(rows: DataFrame, hot: bool) -> DataFrame:
    return _machine(rows, hour_of("ts") if hot else None)


def _machine_by_fold(rows: DataFrame) -> DataFrame:
    """The machine for pull requests with grades that name their gate, streamed in order through Python tasks."""
    grade = {
        "graded": F.col("grade").isNotNull(),
        "ungraded": F.coalesce("grade.ungraded", F.lit(False)),
        "passes": F.coalesce("grade.pass", F.lit(False)),
    }
    ready = rows.withColumns(grade).repartition(*PR).sortWithinPartitions(*PR, *ORDER)
    out = StructType([*ready.schema, *StructType.fromDDL("outcome string, gate_id string, carries boolean")])
    moves = ready.mapInArrow(folded, out).drop(*grade)
    return moves.withColumn("capped", F.when(F.col("outcome") == "capped", F.col("capped")))


def gate_machine(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One transition per relevant event, in event time.

    Explanations carry their ``grade`` (from the stored attempts, or from ``grade`` events);
    one without a grade yet is ``requested``. A ``grade`` event with a ``gate_id`` counts for that gate,
    however many were opened since it was asked for; without one it counts for the newest pending gate.
    A gate that has passed can pass again, and one that the pull request never had is ``ignored``.
    A ``capped`` column, where present, holds the
    limit an event ran into (:func:`replay_gates` works it out). Outcomes: duplicate, trivial,
    capped, gated, carried, ignored, requested, ungraded, passed, failed.
    """
    rows = relevant_events(events)
    if "gate_id" not in events.columns:
        return split_hot(rows.drop("bound"), PR, _machine_by_heat, hot_rows)
    asked = events.filter((F.col("kind") == "grade") & F.col("grade").isNotNull() & F.col("gate_id").isNotNull())
    bound = cut(asked.select(*PR).distinct())
    if bound.isEmpty():
        return split_hot(rows.drop("bound"), PR, _machine_by_heat, hot_rows)
    others = split_hot(join_null_safe(rows, bound, PR, "left_anti").drop("bound"), PR, _machine_by_heat, hot_rows)
    return others.unionByName(_machine_by_fold(join_null_safe(rows, bound, PR, "left_semi")).drop("bound"))


def replay_gates(
    events: DataFrame,
    per_install: int = DAILY_PER_INSTALL,
    limit: int = DAILY_GLOBAL,
    hours: int = 24,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``gate_machine`` under the daily limits.

    Limits depend on which events open gates and gates depend on the limits, but each event only
    on earlier ones. So :func:`gateledger.operators.quota.history_replay` replays both together, where the events
    that may open gates are enough for a limit to bind, and the machine runs once, under its labels. Texts, decisions
    and grades stay out of both and are joined once at the end. Every grade counts for the newest pending gate here.
    """
    wide = written(relevant_events(events.drop("capped", "gate_id")).drop("capped", "bound"))
    grade = F.when(F.col("grade").isNotNull(), F.struct("grade.pass", "grade.ungraded")).alias("grade")
    narrow = wide.select(
        "delivery_id", "ts", "installation_id", *PR, "step", "head_sha", "decisions_hash", "trivial", grade
    )
    hot = hot_keys(narrow, PR, hot_rows)
    tests = written(run_split(narrow, PR, hot, _tested))
    labels = written(history_replay(tests, per_install, limit, hours).withColumnRenamed("id", "delivery_id"))
    moves = run_split(narrow.join(labels, "delivery_id", "left"), PR, hot, _machine_by_heat)
    return wide.join(moves.select("delivery_id", "capped", "carries", "outcome", "gate_id"), "delivery_id")


def _tested(rows: DataFrame, hot: bool) -> DataFrame:
    """What limits may be tested on: substantive pull-request events, with the passes told before each."""
    tested = (F.col("step") != "explained") & ~F.col("trivial")
    some = rows.withColumns({"__tested": tested, "__pass": _passes()}).filter("__tested OR __pass")
    told = {"told": Running("count", F.when(F.col("__pass"), 1), before=True)}
    return running(some, PR, ORDER, told, hour_of("ts") if hot else None).filter("__tested").select(
        F.col("delivery_id").alias("id"), *PR, "installation_id", F.col("ts").alias("created_at"),
        (F.col("step") == "opened").alias("opened"), "head_sha", "decisions_hash", "told",
    )


def gates_of(transitions: DataFrame, rigor: str = "medium") -> DataFrame:
    """The gate table a history leaves behind, in one pass: a gate opens once, takes the head of the last push
    that carried it, and its last pass counts. ``closeout`` is that of the pass, where transitions have one
    (:func:`with_closeouts`)."""
    outcome, place = F.col("outcome"), F.struct(*ORDER)

    def the(name: str, *columns: str) -> Column:
        return F.any_value(F.when(outcome == name, F.struct(*columns)), F.lit(True)).alias(name)

    passed = ["user_login", "user_id", "ts", *(["closeout"] if "closeout" in transitions.columns else [])]
    held = transitions.filter(outcome.isin("gated", "passed", "carried"))
    gates = held.groupBy(F.col("gate_id").alias("id")).agg(
        the("gated", *PR, "head_sha", "decisions", "decisions_hash", "ts"),
        F.max_by(F.struct(*passed), F.when(outcome == "passed", place)).alias("passed"),
        F.max_by("head_sha", F.when(outcome == "carried", place)).alias("moved_head"),
        F.max("ts").alias("last_ts"),
    )
    return gates.select(
        "id",
        *(F.col(f"gated.{c}").alias(c) for c in PR),
        F.coalesce("moved_head", "gated.head_sha").alias("head_sha"),
        "gated.decisions",
        "gated.decisions_hash",
        F.lit(rigor).alias("rigor"),
        F.when(F.col("passed").isNotNull(), "passed").otherwise("pending").alias("status"),
        F.col("passed.user_login").alias("passed_by"),
        F.col("passed.user_id").alias("passed_by_id"),
        F.col("passed.ts").alias("passed_at"),
        F.col("gated.ts").alias("created_at"),
        F.col("last_ts").alias("updated_at"),
        *([F.col("passed.closeout").alias("closeout")] if "closeout" in passed else []),
    )


def attempts_of(transitions: DataFrame) -> DataFrame:
    """The attempt rows a history leaves behind, ungraded ones included."""
    tried = transitions.filter(F.col("outcome").isin("ungraded", "passed", "failed"))
    return tried.select(
        F.col("delivery_id").alias("id"),
        F.col("gate_id").alias("checkpoint_id"),
        F.col("user_login").alias("reviewer_login"),
        F.col("user_id").alias("reviewer_id"),
        "comment_id",
        F.col("body").alias("explanation"),
        F.lit(True).alias("assisted"),
        (F.col("outcome") == "passed").alias("grade_pass"),
        (F.col("outcome") == "ungraded").alias("ungraded"),
        F.struct("grade.covered", "grade.missing").alias("scores"),
        F.lit("unknown").alias("overlap"),
        F.col("grade.hole").alias("hole"),
        F.col("ts").alias("created_at"),
    )


def _tellable(transitions: DataFrame) -> DataFrame:
    """The transitions that explanations are put together from, and all answers, written once: whoever reads
    them again does not run the machine again."""
    kept = F.col("outcome").isin("gated", "requested", "ungraded", "passed", "failed") | F.col("delivery_id").startswith(GRADED)
    return written(
        transitions.filter(kept).select(
            "delivery_id", "ts", "installation_id", *PR, "gate_id", "comment_id", "user_id", "user_login", "body", "decisions", "outcome"
        )
    )


def told(transitions: DataFrame, wanted: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Explanations with the outcome ``wanted``, each with its gate's decisions and all that was told:
    every recorded attempt on the gate so far, then this explanation."""
    return _told(_tellable(transitions), wanted, hot_rows)


def _told(rows: DataFrame, wanted: str, hot_rows: int) -> DataFrame:
    outcome = F.col("outcome")
    # gates without such an explanation need no texts
    gates = rows.filter(outcome == wanted).select("gate_id").distinct()
    some = rows.filter(outcome.isin("gated", "requested", "ungraded", "passed", "failed")).join(gates, "gate_id", "left_semi")
    values = {
        "__earlier": Running("text", F.when(~outcome.isin("gated", "requested"), F.col("body")), before=True),
        "__asked": Running("last", F.when(outcome == "gated", F.col("decisions"))),
    }
    seen = split_hot(
        some,
        ["gate_id"],
        lambda part, hot: running(part, ["gate_id"], ORDER, values, hour_of("ts") if hot else None),
        hot_rows,
    )
    return seen.filter(outcome == wanted).select(
        "delivery_id", "ts", "installation_id", *PR, "gate_id", "comment_id", "user_id", "user_login", "body",
        F.concat_ws("\n\n", "__earlier", "body").alias("explanation"),
        F.col("__asked").alias("decisions"),
    )


def grade_requests(transitions: DataFrame, hot_rows: int = HOT_ROWS, rigor: str = "medium") -> DataFrame:
    """Explanations that await a grade, as :func:`gateledger.operators.scoring.grade_batch` takes them.

    A request whose grade event is among the transitions has been answered and is left out.
    """
    rows = _tellable(transitions)
    answered = rows.select(F.col("delivery_id").alias("__answer")).filter(F.col("__answer").startswith(GRADED))
    open_ = _told(rows, "requested", hot_rows).join(
        answered, F.concat(F.lit(GRADED), F.col("delivery_id")) == F.col("__answer"), "left_anti"
    )
    return open_.withColumn("rigor", F.lit(rigor))


def grade_events(graded: DataFrame, at: Column) -> DataFrame:
    """Graded requests as events for the log, known at the time ``at``. Each keeps the gate its explanation was
    told to, and its id follows from the comment's, so a batch that is graded again adds no other event."""
    return graded.select(
        F.concat(F.lit(GRADED), "delivery_id").alias("delivery_id"), F.lit("grade").alias("kind"), F.lit("graded").alias("action"),
        at.alias("ts"), "installation_id", *PR, "comment_id", "body", "user_id", "user_login", "grade", "gate_id",
    )


def graded_log(events: DataFrame, grades: DataFrame) -> DataFrame:
    """The log with grade events added; one that is there already is not added twice."""
    new = grades.join(events.filter("kind = 'grade'").select("delivery_id"), "delivery_id", "left_anti")
    return events.unionByName(new, allowMissingColumns=True)


def with_closeouts(transitions: DataFrame, closed: DataFrame) -> DataFrame:
    """Transitions with the ``closeout`` of each pass; ``closed``: delivery_id, closeout of graded passes.

    The gate table and the replies to passes take it from there.
    """
    mine = closed.select(F.col("delivery_id").alias("__of"), "closeout")
    return transitions.join(mine, F.col("delivery_id") == F.col("__of"), "left").drop("__of")
