import os
import random
from datetime import timedelta

import pyarrow as pa
import pytest
from history import GOOD, START, events, frame, replay, steps, with_late_grades
from pyspark.sql import functions as F

from gateledger.operators import machine, outbox, quota
from gateledger.operators.pull_request import PullRequest
from gateledger.operators.quota import Meter


def outcomes(df):
    return {r.delivery_id: (r.outcome, r.gate_id, r.capped) for r in df.select("delivery_id", "outcome", "gate_id", "capped").collect()}


@pytest.mark.parametrize("seed, hot_rows", [(1, 10**9), (2, 10**9), (2, 30), (3, 0)])
def test_machine_equals_sequential_replay(spark, seed, hot_rows):
    rows = events(500, seed)
    got = outcomes(machine.gate_machine(frame(spark, rows), hot_rows))
    assert got == replay(rows)
    assert {o for o, *_ in got.values()} >= {"gated", "carried", "duplicate", "trivial", "passed", "failed", "ungraded", "requested", "ignored"}


@pytest.mark.parametrize("seed", [4, 5])
def test_late_grades_count_for_the_gate_they_were_asked_for(spark, seed):
    rows = with_late_grades(events(400, seed), seed)
    want = replay(rows)
    assert outcomes(machine.gate_machine(frame(spark, rows))) == want
    graded = {d: x for d, x in want.items() if d.startswith("grade:")}
    assert {o for o, *_ in graded.values()} == {"passed", "failed", "ungraded", "ignored"}


def test_a_late_grade_passes_a_gate_below_the_newest(spark):
    rows = [event(1, "opened"), event(2, "talk"), event(3, "synchronize", decisions=[("y", "s", None)]), event(5, "talk")]
    first = machine.gate_machine(frame(spark, rows)).orderBy("ts").collect()
    requests = machine.grade_requests(machine.gate_machine(frame(spark, rows))).orderBy("ts")
    assert [(r.gate_id, r.decisions[0].concept, r.rigor) for r in requests.collect()] == [(first[0].gate_id, "x", "medium"), (first[2].gate_id, "y", "medium")]
    grade = F.struct(*(F.lit(v).cast(t).alias(n) for n, t, v in (("pass", "boolean", True), ("ungraded", "boolean", False), ("covered", "array<string>", None),
                     ("missing", "array<string>", None), ("hole", "string", ""), ("note", "string", None))))
    graded = machine.grade_events(requests.limit(1).withColumn("grade", grade), F.col("ts") + F.expr("INTERVAL 10 HOURS"))
    log = machine.graded_log(machine.graded_log(frame(spark, rows), graded), graded)
    assert log.count() == 5
    moves = machine.gate_machine(log)
    assert [m.outcome for m in moves.orderBy("ts").collect()] == ["gated", "requested", "gated", "requested", "passed"]
    status = {g.id: (g.status, g.passed_by) for g in machine.gates_of(moves).collect()}
    assert status == {first[0].gate_id: ("passed", "me"), first[2].gate_id: ("pending", None)}
    assert [r.delivery_id for r in machine.grade_requests(moves).collect()] == ["d5"]


def event(i, kind, **more):
    e = dict(delivery_id=f"d{i}", ts=START + timedelta(hours=i), installation_id=1, repo_id=1, pr_number=1, user_id=9, user_login="me")
    if kind == "talk":
        e |= dict(kind="comment", action="created", is_pr=True, user_type="User", author_association="MEMBER", body=GOOD, comment_id=i)
    else:
        e |= dict(kind="pull_request", action=kind, draft=False, head_sha=f"h{i}", files=["a.py"], diff="+x\n" * 20, decisions=[("x", "s", None)])
    return e | more


PASS, FAIL, OUT = (True, False, ["x"], [], "", None), (False, False, [], ["x"], "hole", None), (False, True, [], [], "", "down")


def run(spark, rows):
    return [r.outcome for r in machine.gate_machine(frame(spark, rows)).orderBy("ts").collect()]


def test_an_older_pending_gate_is_the_next_target(spark):
    rows = [event(1, "opened"), event(2, "synchronize", decisions=[("y", "s", None)]), event(3, "talk", grade=PASS), event(4, "talk", grade=PASS), event(5, "talk", grade=PASS)]
    moves = machine.gate_machine(frame(spark, rows)).orderBy("ts").collect()
    assert [m.outcome for m in moves] == ["gated", "gated", "passed", "passed", "ignored"]
    assert [m.gate_id for m in moves[2:4]] == [moves[1].gate_id, moves[0].gate_id]


def test_failed_decompositions_share_a_hash(spark):
    rows = [event(1, "opened", decisions=[]), event(2, "talk", grade=PASS), event(3, "synchronize", decisions=[])]
    assert run(spark, rows) == ["gated", "passed", "carried"]


def test_ungraded_leaves_the_gate_open(spark):
    rows = [event(1, "opened"), event(2, "talk", grade=OUT), event(3, "talk", grade=FAIL), event(4, "talk", grade=PASS)]
    assert run(spark, rows) == ["gated", "ungraded", "failed", "passed"]


def test_opened_never_carries_and_changed_decisions_regate(spark):
    rows = [event(1, "opened"), event(2, "talk", grade=PASS), event(3, "ready_for_review"), event(4, "synchronize"), event(5, "synchronize", decisions=[("z", "s", None)])]
    assert run(spark, rows) == ["gated", "passed", "gated", "gated", "gated"]


def test_trivial_push_leaves_older_gates_alone(spark):
    rows = [event(1, "opened"), event(2, "synchronize", files=["a.md"]), event(3, "talk", grade=PASS), event(4, "synchronize")]
    assert run(spark, rows) == ["gated", "trivial", "passed", "carried"]


def test_tables_and_requests_of_a_history(spark):
    rows = [event(1, "opened"), event(2, "talk", grade=FAIL), event(3, "talk", body=GOOD + " More."), event(4, "talk", grade=PASS, body=GOOD + " Yes."), event(5, "synchronize")]
    moves = machine.gate_machine(frame(spark, rows))
    gate = machine.gates_of(moves).first()
    assert (gate.status, gate.head_sha, gate.passed_by, gate.passed_by_id) == ("passed", "h5", "me", 9)
    assert gate.updated_at > gate.passed_at > gate.created_at and gate.decisions[0].concept == "x"
    attempts = machine.attempts_of(moves).orderBy("created_at").collect()
    assert [a.grade_pass for a in attempts] == [False, True] and attempts[0].hole == "hole"
    for hot in (10**9, 0):
        request = machine.grade_requests(moves, hot).collect()
        assert [r.explanation for r in request] == [f"{GOOD}\n\n{GOOD} More."]
        assert request[0].decisions[0].concept == "x"


def test_carry_forward_equals_the_machine(spark):
    rows = events(600, 11)
    moves = machine.gate_machine(frame(spark, rows))
    pushes = moves.filter("outcome IN ('gated', 'carried')").withColumn(
        "action", F.when(F.col("step") == "pushed", "synchronize").otherwise("opened")
    )
    passes = moves.filter("outcome = 'passed'").select("repo_id", "pr_number", "ts", "delivery_id")
    want = {(r.delivery_id, r.outcome == "carried") for r in pushes.collect()}
    for hot in (10**9, 20):
        assert {(r.delivery_id, r.carried) for r in machine.carry_forward(pushes, passes, hot).collect()} == want


@pytest.mark.parametrize("seed", range(8))
def test_limits_against_brute_force(spark, seed):
    r = random.Random(seed)
    # dense and thin histories, with quiet days between the storms of some
    per_install, limit, hours, days, n = [(2, 5, 6, 2, 300), (3, 3, 6, 2, 300), (2, 9, 10, 2, 300), (2, 6, 5, 30, 250), (3, 7, 8, 20, 300),
                                          (4, 100, 24, 12, 300), (100, 6, 4, 15, 300), (1, 4, 3, 40, 300)][seed]
    calm = r.sample(range(days), days // 4)
    minutes = [m for m in (r.randrange(0, 1440 * days, 20) for _ in range(n)) if m // 1440 not in calm]
    offers = [(f"{i:04d}", r.choice([None, 1, 1, 1, 2, 3, 4, 5, 6]), 60 * m, r.random() < 0.8) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(offers, "id string, installation_id bigint, t bigint, counts boolean")
    df = df.select("id", "installation_id", "counts", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("created_at"))
    meter, want = Meter(hours * 3600), {}
    for i, inst, t, counts in sorted(offers, key=lambda o: (o[2], o[0])):
        want[i] = None
        if inst is not None:
            meter.advance(t)
            want[i] = meter.refuse(inst, per_install, limit)
            if want[i] is None and counts:
                meter.admit(t, inst)
    assert len(set(want.values())) > 1
    got = quota.quota_replay(df, per_install, limit, hours)
    assert {x.id: x.capped for x in got.collect()} == want


def test_limit_boundary_is_inclusive(spark):
    offers = [("a", 1, 0), ("b", 1, 86400), ("c", 1, 86401)]
    df = spark.createDataFrame(offers, "id string, installation_id bigint, t bigint").withColumn("created_at", F.timestamp_seconds("t"))
    got = {r.id: r.capped for r in quota.quota_replay(df, 1, 9).collect()}
    assert got == {"a": None, "b": "install", "c": None}
    both = quota.quota_replay(df, 1, 1).collect()
    assert {r.id: r.capped for r in both} == {"a": None, "b": "global", "c": None}
    assert {r.capped for r in quota.quota_replay(df, 0, 5).collect()} == {"install"}


@pytest.mark.parametrize("seed", [5, 6])
def test_history_under_limits_equals_sequential_replay(spark, seed):
    rows = events(250, seed, hours=60)
    got = outcomes(machine.replay_gates(frame(spark, rows), per_install=4, limit=6))
    want = replay(rows, per_install=4, limit=6)
    assert got == want
    assert {c for *_, c in want.values()} >= {None, "global"}


def limited(rows, per_install, limit):
    """One event after another; an event without an installation is never limited and adds no counted gate."""
    prs, out, meter = {}, {}, Meter(24 * 3_600_000_000)
    for s in steps(rows):
        pr, capped = prs.setdefault((s.repo, s.pr), PullRequest(s.repo, s.pr)), None
        duplicate = s.step == "opened" and pr.gate is not None and pr.head == s.head_sha
        counted = s.installation is not None and s.step != "explained" and not duplicate and not s.trivial
        if counted:
            at = int(s.ts.timestamp() * 1_000_000)
            meter.advance(at)
            capped = meter.refuse(s.installation, per_install, limit)
        outcome, gate = pr.apply(s._replace(capped=capped))
        if counted and outcome == "gated":
            meter.admit(at, s.installation)
        out[s.delivery_id] = (outcome, gate, capped)
    return out


@pytest.mark.parametrize(
    "kind, per_install, limit, hot_rows",
    [("moving", 3, 7, 10**9), ("moving", 3, 7, 20), ("own", 2, 10**6, 10**9), ("some move", 2, 10**6, 10**9), ("calm days", 5, 12, 10**9), ("far limits", 99, 999, 10**9)],
)
def test_limits_and_gates_are_replayed_together(spark, kind, per_install, limit, hot_rows):
    r = random.Random(kind)
    rows = events(1500, 21, prs=12, hours=600) if kind == "calm days" else events(400, 21, prs=12, hours=120)
    if kind == "calm days":
        rows = [e for e in rows if (e["ts"] - START).days % 8 < 3]
    for e in rows:
        own = e["repo_id"] if kind != "calm days" else e["repo_id"] % 3
        anywhere = kind == "moving" or kind == "some move" and e["repo_id"] < 2
        e["installation_id"] = r.choice([None, 0, 1, 2]) if anywhere else own
    want = limited(rows, per_install, limit)
    assert outcomes(machine.replay_gates(frame(spark, rows), per_install, limit, hot_rows=hot_rows)) == want
    found = {c for *_, c in want.values()}
    assert found == {"own": {None, "install"}, "some move": {None, "install"}, "far limits": {None}}.get(kind, {None, "install", "global"})
    assert {o for o, *_ in want.values()} >= {"gated", "carried", "duplicate", "passed"}


def test_tables_written_under_limits_do_not_grow_with_the_history(spark):
    def tables(n, hours):
        folder = spark.conf.get("spark.checkpoint.dir")
        before = {t for t in os.listdir(folder) if t.startswith("table-")}
        moves = machine.replay_gates(frame(spark, events(n, 5, hours=hours)), per_install=4, limit=6)
        assert moves.filter("capped = 'global'").count() > 0
        return len({t for t in os.listdir(folder) if t.startswith("table-")} - before)

    assert tables(900, 220) == tables(120, 30)


def test_outbox(spark):
    rows = [event(1, "opened"), event(2, "talk", grade=FAIL), event(3, "talk", grade=OUT), event(4, "talk", grade=PASS), event(5, "synchronize"),
            event(6, "synchronize", files=[]), event(7, "opened", head_sha="h5")]
    actions = outbox.action_outbox(machine.gate_machine(frame(spark, rows))).orderBy("ts", "kind").collect()
    assert [(a.outcome, a.kind, a.status, a.conclusion) for a in actions] == [
        ("gated", "comment", None, None),
        ("gated", "create_check", "in_progress", None),
        ("failed", "comment", None, None),
        ("ungraded", "comment", None, None),
        ("ungraded", "update_check", "completed", "neutral"),
        ("passed", "comment", None, None),
        ("passed", "update_check", "completed", "success"),
        ("carried", "create_check", "completed", "success"),
        ("trivial", "create_check", "completed", "success"),
    ]
    assert len({a.action_id for a in actions}) == len(actions)
    capped = frame(spark, [event(1, "opened")]).withColumn("capped", F.lit("install"))
    kinds = [(a.kind, a.conclusion, a.summary) for a in outbox.action_outbox(machine.gate_machine(capped)).orderBy("kind").collect()]
    assert kinds == [("comment", None, None), ("create_check", "neutral", "install daily beta limit reached")]


def test_machine_plan(spark, tmp_path):
    frame(spark, events(50, 1)).write.parquet(str(tmp_path / "log"))
    from gateledger.sources.events import read_events

    plan = machine.gate_machine(read_events(spark, str(tmp_path / "log")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "PushedFilters: [In(kind, [comment,grade,pull_request])]" in plan


def test_offers_reach_the_replay_packed(spark):
    n = 3000
    columns = {
        "stretch": ["all:0"] * n + ["own:1:1"] * 10, "alone": [False] * n + [True] * 10, "at": [*range(0, n * 10**6, 10**6), *range(10)],
        "id": [f"{i:05d}" for i in range(n + 10)], "installation_id": [i % 3 for i in range(n + 10)],
        "counts": [i % 5 > 0 for i in range(n + 10)], "open": [i > 100 for i in range(n + 10)],
    }
    (packed,) = quota._packed(iter([pa.RecordBatch.from_pydict(columns)]))
    assert packed.num_rows < 20 and max(map(len, packed["ids"].to_pylist())) <= quota.PACK
    assert [i for ids in packed["ids"].to_pylist() for i in ids] == columns["id"]
    assert all(len({a // quota.CELL_US for a in at}) == 1 for at in packed["at"].to_pylist())
    got = [x for out in quota._replay(iter([packed]), 2, 5, 60 * 10**6) for labels in out["labels"].to_pylist() for x in labels]
    meter, want = Meter(60 * 10**6), []
    for i, (at, install, counts) in enumerate(zip(columns["at"], columns["installation_id"], columns["counts"])):
        meter = Meter(60 * 10**6) if i == n else meter
        meter.advance(at)
        refused = meter.refuse(install, 2, 5 if i < n else 10**9)
        if refused is None and counts:
            meter.admit(at, install)
        want.append({None: 0, "global": 1, "install": 2}[refused] if columns["open"][i] else 0)
    # by itself an installation is alone in its stretch; the last ten offers here are of three
    assert got[:n] == want[:n] and set(got) == {0, 1, 2}


def test_crowded_minutes_against_brute_force(spark):
    offers = [(f"{i:05d}", i % 7, i // 40, i % 6 > 0) for i in range(4000)]
    df = spark.createDataFrame(offers, "id string, installation_id bigint, t bigint, counts boolean")
    df = df.select("id", "installation_id", "counts", F.timestamp_millis(F.col("t") * 90_000 + 1_700_000_000_000).alias("created_at"))
    meter, want = Meter(3600), {}
    for i, inst, t, counts in offers:
        meter.advance(t * 90)
        want[i] = meter.refuse(inst, 4, 20)
        if want[i] is None and counts:
            meter.admit(t * 90, inst)
    assert {x.id: x.capped for x in quota.quota_replay(df, 4, 20, 1).collect()} == want


def test_requests_and_loop_run_the_machine_once_each(spark, tmp_path):
    frame(spark, events(200, 7)).write.parquet(str(tmp_path / "log"))
    moves = machine.gate_machine(spark.read.parquet(str(tmp_path / "log")))
    requests = machine.grade_requests(moves)
    assert requests.count() > 0
    # whoever reads requests or tellings again reads written rows, not the log
    for read in (requests, machine.told(moves, "passed")):
        assert read.inputFiles() and not any("/log/" in f for f in read.inputFiles())
