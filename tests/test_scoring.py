import json
import os
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gateledger.operators import overlap, scoring
from gateledger.schemas import DECISIONS

def counting_model():
    def complete(system, user, model=None, timeout=60.0):
        with open(system, "a") as f:
            f.write(user[-1] + "\n")
        if user.endswith("boom"):
            raise RuntimeError("boom")
        return None if user.endswith("none") else f"{timeout:g} {user}"

    return complete


def test_equal_requests_are_scored_once_and_errors_stay_local(spark, tmp_path):
    log = os.path.join(tmp_path, "calls")
    df = spark.createDataFrame([(i, "abc") for i in range(50)] + [(50, "boom"), (51, "none")], "i int, t string")
    scored = scoring.score_text(df, counting_model, F.lit(log), F.col("t"), calls_at_once=2)
    got = {r.i: (r.raw, r.error) for r in scored.collect()}
    assert len(got) == 52 and got[3] == ("60 abc", None) and got[50] == (None, "boom") and got[51] == ("", None)
    scored.count()
    with open(log) as f:
        assert sorted(f.read().split()) == ["c", "e", "m"]  # not called again by a second action


def test_answers_in_the_ledger_are_not_asked_for_again(spark, tmp_path):
    log, ledger = os.path.join(tmp_path, "calls"), str(tmp_path / "ledger")
    df = spark.createDataFrame([(i, f"r{i}") for i in range(9)] + [(9, "boom"), (10, "none"), (11, None)], "i int, t string")

    def ask(rows, **options):
        scored = scoring.score_text(rows, counting_model, F.lit(log), F.coalesce("t", F.lit("x")), calls_at_once=2, ledger=ledger, rounds=3, **options)
        return {r.i: (r.raw, r.error) for r in scored.collect()}

    def calls():
        with open(log) as f:
            return len(f.read().split())

    few = ask(df.filter("i < 5"))
    assert few[3] == ("60 r3", None) and calls() == 5
    seen = Observation()
    got = ask(df, observed=seen)
    assert calls() == 12 and got[3] == few[3] and got[9] == (None, "boom") and got[10] == ("", None) and got[11] == ("60 x", None)
    assert seen.get == {"asked": 12, "answered": 11, "failed": 1}
    assert ask(df) == got and calls() == 13  # only the failed one
    assert ask(df, model="other") == got and calls() == 25
    assert ask(df.limit(0)) == {}


def failing_model():
    """Dies as a worker does when its machine goes, at one request."""

    def complete(system, user, model=None, timeout=60.0):
        if user == "r7" and not os.path.exists(system + ".mended"):
            time.sleep(2)
            os._exit(1)
        return counting_model()(system, user, model, timeout)

    return complete


def test_a_job_that_dies_keeps_the_answers_of_tasks_that_were_done(spark, tmp_path):
    log, ledger = os.path.join(tmp_path, "calls"), str(tmp_path / "ledger")
    df = spark.createDataFrame([(i, f"r{i}") for i in range(40)], "i int, t string")

    def ask():
        return scoring.score_text(df, failing_model, F.lit(log), F.col("t"), calls_at_once=8, ledger=ledger, rounds=2).count()

    with pytest.raises(Exception):
        ask()
    kept = spark.read.schema(scoring.ANSWERS).parquet(ledger).count()
    with open(log) as f:
        before = len(f.read().split())
    open(log + ".mended", "w").close()
    assert kept > 0 and ask() == 40
    with open(log) as f:
        assert len(f.read().split()) - before == 40 - kept


BATTERY = {  # name: (explanation, assisted, medium, harsh)
    "strong": ("Tokens come back on each read in proportion to the time gone by, so no timer is needed; two hosts would each allow the full rate.", False, True, True),
    "restated": ("The change adds a limiter with a map of buckets and returns false under one token.", False, False, False),
    "wrong": ("A counter is set to zero at the start of each minute in a shared table.", False, False, False),
    "names only": ("There is a map, a capacity, a window and a check.", False, False, False),
    "partial": ("Tokens come back over time so no timer is needed, and they are capped.", False, True, False),
    "slop": ("A thoughtful and robust design that reflects sound judgement throughout.", False, False, False),
    "empty": ("dunno", False, False, False),
    "parroted": ("It takes the bucket or a new one, adds elapsed times rate, and subtracts one.", True, False, False),
}


def battery(spark):
    rows = [(n, t, a, [("limiter", "s", None)], ["medium", "harsh"], {"medium": m, "harsh": h}) for n, (t, a, m, h) in BATTERY.items()]
    return spark.createDataFrame(rows, f"name string, explanation string, assisted boolean, decisions {DECISIONS}, rigors array<string>, expected map<string,boolean>")


def judge(text, harsh):
    return "so no timer" in text and (not harsh or "two hosts" in text)


def strict_model():
    def complete(system, user, model=None, timeout=60.0):
        return json.dumps({"pass": judge(user, "Rigor: harsh" in system), "covered": [], "missing": [], "hole": ""})

    return complete


def lenient_model():
    def complete(system, user, model=None, timeout=60.0):
        if "dunno" in user:
            raise TimeoutError
        return '{"pass": true}'

    return complete


def test_grader_battery(spark):
    got = {r.rigor: r for r in scoring.run_eval(battery(spark), strict_model).collect()}
    assert all(r.correct == r.total == 8 and r.false_pass == r.false_fail == 0 and r.accuracy_pct == 100 for r in got.values())
    got = {r.rigor: r for r in scoring.run_eval(battery(spark), lenient_model).collect()}
    assert (got["medium"].false_pass, got["medium"].correct) == (5, 2)  # an outage is not a pass, nor correct
    assert (got["harsh"].false_pass, got["harsh"].correct) == (6, 1)


def test_unreadable_grades_never_pass(spark):
    raws = ['{"pass": "true"}', '{"pass": 1}', "", None, "{}", "pass", '{"pass": true, "covered": ["a"], "hole": "h"}', '{"pass": false, "missing": "x"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = {r.i: r.g for r in df.select("i", scoring.read_grade(F.col("raw"), F.lit(None).cast("string")).alias("g")).collect()}
    assert [i for i in got if got[i]["pass"]] == [6] and [i for i in got if not got[i].ungraded] == [6, 7]
    assert got[6].covered == ["a"] and got[6].hole == "h" and got[7].missing == [] and got[0].note == "unreadable grade"


def test_coverage_grade(spark):
    two = [("a-b", "lazy refill on read", "Why lazy?"), ("c", "cap tokens", None)]
    data = [(1, two, "The refill is lazy on each read, and tokens cap out."), (2, two, "cap the tokens"), (3, [], "x"), (4, None, "x")]
    df = spark.createDataFrame(data, f"i int, decisions {DECISIONS}, explanation string").withColumn("rigor", F.lit("harsh"))
    graded = scoring.coverage_scorer(df)
    got = {r.i: r.grade for r in graded.collect()}
    assert got[1]["pass"] and got[1].covered == ["a-b", "c"] and got[1].hole == ""
    assert not got[2]["pass"] and got[2].missing == ["a-b"] and got[2].hole == "Why lazy?"
    assert got[3].hole == got[4].hole == "the change as a whole" and not got[3]["pass"] and not got[4]["pass"]
    assert "Python" not in graded._jdf.queryExecution().executedPlan().toString()


def test_overlap_bands(spark):
    told = spark.createDataFrame([(1, "g", "One two three four five six."), (2, "g", "quite another text with many words"), (3, "h", "one two three four five"), (4, "g", "short")], "id int, gate string, explanation string")
    sources = spark.createDataFrame([("g", "zero one two three four five six seven"), ("g", None)], "gate string, source string")
    got = {r.id: (r.overlap_share, r.overlap) for r in overlap.overlap_band(told, sources, on=["gate"]).collect()}
    assert got == {1: (1.0, "high"), 2: (0.0, "low"), 3: (0.0, "unknown"), 4: (0.0, "low")}
    pooled = overlap.overlap_band(told, sources.drop("gate"))
    assert {r.id: r.overlap for r in pooled.collect()} == {1: "high", 2: "low", 3: "high", 4: "low"}


def lists_in_memory():
    """Answers with the number of answers that its task still holds as Python values."""

    def complete(system, user, model=None, timeout=60.0):
        import sys

        return str(len(sys._getframe(1).f_locals["raws"]))

    return complete


def test_a_task_holds_few_requests_as_python_values(spark):
    requests = spark.range(3000).selectExpr("CAST(id AS STRING) AS u").coalesce(1)
    got = scoring.score_text(requests, lists_in_memory, F.lit("s"), F.col("u"), calls_at_once=1).select("raw").collect()
    assert len(got) == 3000 and max(int(r.raw) for r in got) < 1000
