"""Queries over event histories: routing, the gate machine, limits, streams, actions."""

from __future__ import annotations

import json
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger.functions import replies
from gateledger.operators import aggregates, filters, machine, outbox, quota, scoring
from gateledger.operators.scan import cut
from gateledger.operators.store import align_schema
from gateledger.plans import standins
from gateledger.plans.registry import Source, fresh_folder, query, us
from gateledger.plans.sql import GATES, PR_EVENTS
from gateledger.plans.sql import machine as machine_sql
from gateledger.plans.sql import relevant as relevant_sql
from gateledger.plans.sql import sql_pick, sql_text
from gateledger.plans.stored import pushes
from gateledger.plans.texts import parity_model
from gateledger.schemas import schema
from gateledger.sources import tables
from gateledger.sources.events import read_events
from gateledger.streaming import jobs
from gateledger.streaming.machine import live_gate_machine as live_machine

MOVES = (PR_EVENTS, machine_sql())


@query(
    """SELECT 'opened' AS listener, delivery_id FROM pr_events WHERE kind = 'pull_request' AND action IN ('opened', 'ready_for_review')
    UNION ALL SELECT 'synchronize', delivery_id FROM pr_events WHERE kind = 'pull_request' AND action = 'synchronize'
    UNION ALL SELECT 'comment', delivery_id FROM pr_events WHERE kind = 'comment' AND action = 'created'
    UNION ALL SELECT 'install', delivery_id FROM pr_events WHERE kind = 'install' AND action IN ('created', 'added')""",
    (PR_EVENTS,),
)
def route(s: Source):
    parts = [
        filters.route(s.pr_events, kind).select(F.lit(kind).alias("listener"), "delivery_id")
        for kind in filters.ROUTES
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("SELECT delivery_id FROM pr_events WHERE NOT coalesce(draft, false)", (PR_EVENTS,))
def not_draft(s: Source):
    return filters.not_draft(s.pr_events).select("delivery_id")


@query(
    "SELECT delivery_id, outcome, gate_id, carries, capped, reason, head_sha, epoch_us(ts) AS ts_us FROM (SELECT * REPLACE (CASE WHEN step <> 'explained' THEN reason END AS reason) FROM moves)",
    MOVES,
)
def gate_machine(s: Source):
    return _outcomes(machine.gate_machine(s.pr_events))


def _outcomes(moves: DataFrame) -> DataFrame:
    return moves.select("delivery_id", "outcome", "gate_id", "carries", "capped", "reason", "head_sha", us("ts"))


GATES_OF = """SELECT n.gate_id AS id, n.repo_id, n.pr_number, coalesce(c.head_sha, n.head_sha) AS head_sha, n.dhash AS decisions_hash,
  CASE WHEN p.ts IS NULL THEN 'pending' ELSE 'passed' END AS status, p.user_login AS passed_by, epoch_us(p.ts) AS passed_at_us,
  epoch_us(greatest(n.ts, p.ts, c.ts)) AS updated_at_us
FROM (SELECT * FROM moves WHERE outcome = 'gated') n
LEFT JOIN (SELECT * FROM moves WHERE outcome = 'passed') p ON n.gate_id = p.gate_id
LEFT JOIN (SELECT * FROM moves WHERE outcome = 'carried' QUALIFY row_number() OVER (PARTITION BY gate_id ORDER BY ts DESC) = 1) c ON n.gate_id = c.gate_id"""


@query(GATES_OF, MOVES)
def gates_of(s: Source):
    gates = machine.gates_of(machine.gate_machine(s.pr_events))
    return gates.select(
        "id", "repo_id", "pr_number", "head_sha", "decisions_hash", "status", "passed_by", us("passed_at"), us("updated_at")
    )


@query(
    """SELECT delivery_id AS id, gate_id AS checkpoint_id, user_login AS reviewer_login, body AS explanation,
      outcome = 'passed' AS grade_pass, outcome = 'ungraded' AS ungraded, topic AS hole FROM moves WHERE outcome IN ('ungraded', 'passed', 'failed')""",
    MOVES,
)
def attempts_of(s: Source):
    attempts = machine.attempts_of(machine.gate_machine(s.pr_events))
    return attempts.select("id", "checkpoint_id", "reviewer_login", "explanation", "grade_pass", "ungraded", "hole")


@query(
    """SELECT delivery_id, gate_id, concat_ws(chr(10) || chr(10), earlier, body) AS explanation FROM (
      SELECT *, string_agg(CASE WHEN outcome <> 'requested' THEN body END, chr(10) || chr(10)) OVER (
        PARTITION BY gate_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
      FROM moves WHERE outcome IN ('requested', 'ungraded', 'passed', 'failed')) WHERE outcome = 'requested'""",
    MOVES,
)
def grade_requests(s: Source):
    requests = machine.grade_requests(machine.gate_machine(s.pr_events))
    return requests.select("delivery_id", "gate_id", "explanation")


def _outbox_sql() -> str:
    nl = "chr(10) || chr(10)"
    seed = "CASE WHEN no_decisions THEN 'whole' ELSE topic END"
    listed = (
        f"CASE WHEN NOT no_decisions THEN {sql_pick(replies.PLAIN.lead_ins, f'({seed}) || ' + sql_text('^'))} || ':' || chr(10)"
        " || '- the ' || replace(topic, '-', ' ') || ': how it works and why' END"
    )
    elicit = (
        f"concat_ws({nl}, '### Explain this change to merge', {sql_pick(replies.PLAIN.openings, seed)}, {listed}, "
        f"{sql_pick(replies.PLAIN.closings, f'({seed}) || ' + sql_text('~'))})"
    )
    rescue = f"concat_ws({nl}, {sql_pick(replies.PLAIN.rescue_heads, 'topic')}, topic, 'Another reply here will be graded too.')"
    passed = f"concat_ws({nl}, '{replies.PASS_HEAD}', 'Thank you, @' || user_login || '. Your reply explains the mechanism.')"
    ungraded = f"concat_ws({nl}, '### Grader unavailable', 'No grade was given (no answer). The check is neutral, not passed.')"
    summary = {
        "trivial": "reason",
        "gated": sql_text(outbox.PENDING_SUMMARY),
        "carried": sql_text(outbox.CARRIED_SUMMARY),
        "ungraded": "'no answer'",
        "passed": "'Explained by @' || user_login || '.'",
    }
    body = {"gated": elicit, "failed": rescue, "passed": passed, "ungraded": ungraded}
    parts = [
        f"SELECT delivery_id || ':{kind}' AS action_id, outcome, '{kind}' AS kind, {sql_text(status)} AS status, "
        f"{sql_text(conclusion)} AS conclusion, {sql_text(title)} AS title, {summary[name]} AS summary, NULL AS body "
        f"FROM moves WHERE outcome = '{name}'"
        for name, (kind, status, conclusion, title) in outbox.CHECKS.items()
        if name in summary
    ]
    parts += [
        f"SELECT delivery_id || ':comment', outcome, 'comment', NULL, NULL, NULL, NULL, {text} FROM moves WHERE outcome = '{name}'"
        for name, text in body.items()
    ]
    return " UNION ALL ".join(parts)


@query(_outbox_sql(), MOVES)
def action_outbox(s: Source):
    actions = outbox.action_outbox(machine.gate_machine(s.pr_events))
    return actions.select("action_id", "outcome", "kind", "status", "conclusion", "title", "summary", "body")


@query(f"SELECT action_id, outcome, kind, CASE WHEN CAST(substr(action_id, 12, 1) AS INTEGER) % 2 = 0 THEN 'a' ELSE 'b' END AS run FROM ({_outbox_sql()})", MOVES)
def append_actions(s: Source):
    """Actions of even deliveries under one checkpoint, then of all under another, its batch written twice."""
    folder = fresh_folder(s.spark, "actions")
    actions = cut(outbox.action_outbox(machine.gate_machine(s.pr_events)))
    tables.append_actions(actions.filter(F.substring("delivery_id", 12, 1).cast("int") % 2 == 0), folder, "a", 0)
    for _ in range(2):
        tables.append_actions(actions, folder, "b", 0)
    return s.spark.read.parquet(folder).select("action_id", "outcome", "kind", "run")


@query(
    """SELECT delivery_id, coalesce(same AND last_pass > run_start, false) AS carried FROM (
      SELECT *, max(CASE WHEN is_push AND NOT same THEN ts END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_start FROM (
        SELECT *, coalesce(is_push AND event_id % 9 <> 0 AND event_type = last_value(CASE WHEN is_push THEN event_type END IGNORE NULLS) OVER w, false) AS same,
          max(CASE WHEN NOT is_push THEN ts END) OVER w AS last_pass
        FROM (SELECT event_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS delivery_id, user_id, ts, event_type,
            event_type IN ('click', 'view', 'purchase') AS is_push FROM events
          WHERE event_type IN ('click', 'view', 'purchase') OR value >= 20)
        WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
    WHERE is_push"""
)
def carry_forward(s: Source):
    passes = s.events.filter("event_type NOT IN ('click', 'view', 'purchase') AND value >= 20").select(
        F.col("user_id").alias("repo_id"),
        F.lit(1).alias("pr_number"),
        "ts",
        standins.text_id("event_id").alias("delivery_id"),
    )
    return machine.carry_forward(pushes(s).drop("value"), passes).select("delivery_id", "carried")


PER_INSTALL, ALL = 5, 40


# A fold over the whole history in time order, one element per offer.
QUOTA = f"""WITH {GATES}, o AS (SELECT id, CAST(installation_id AS BIGINT) AS i, epoch_us(created_at) AS t FROM gates),
folded AS (SELECT list_reduce(
  list({{'t': t, 'i': i, 'w': CAST([] AS STRUCT(t BIGINT, i BIGINT)[]), 'g': CAST([] AS VARCHAR[]), 'n': CAST([] AS VARCHAR[]), 'id': id}} ORDER BY t, id),
  lambda a, x: {{'t': x.t, 'i': x.i,
    'w': CASE WHEN len(list_filter(a.w, lambda v: v.t >= x.t - 86400000000)) >= {ALL}
           OR len(list_filter(a.w, lambda v: v.t >= x.t - 86400000000 AND v.i = x.i)) >= {PER_INSTALL}
         THEN list_filter(a.w, lambda v: v.t >= x.t - 86400000000)
         ELSE list_append(list_filter(a.w, lambda v: v.t >= x.t - 86400000000), {{'t': x.t, 'i': x.i}}) END,
    'g': CASE WHEN len(list_filter(a.w, lambda v: v.t >= x.t - 86400000000)) >= {ALL} THEN list_append(a.g, x.id) ELSE a.g END,
    'n': CASE WHEN len(list_filter(a.w, lambda v: v.t >= x.t - 86400000000)) < {ALL}
           AND len(list_filter(a.w, lambda v: v.t >= x.t - 86400000000 AND v.i = x.i)) >= {PER_INSTALL} THEN list_append(a.n, x.id) ELSE a.n END,
    'id': x.id}},
  {{'t': CAST(0 AS BIGINT), 'i': CAST(0 AS BIGINT), 'w': CAST([] AS STRUCT(t BIGINT, i BIGINT)[]), 'g': CAST([] AS VARCHAR[]), 'n': CAST([] AS VARCHAR[]), 'id': ''}}) AS f FROM o)
SELECT id, CASE WHEN id IN (SELECT unnest(f.g) FROM folded) THEN 'global' WHEN id IN (SELECT unnest(f.n) FROM folded) THEN 'install' END AS capped FROM o"""


@query(QUOTA)
def quota_replay(s: Source):
    return quota.quota_replay(s.gates, PER_INSTALL, ALL).select("id", "capped")


# Machine and limits together, event by event: a fold whose state holds every pull request (k), the
# window of admitted gates (w) and the results so far (o).
PR_STATE = "STRUCT(k VARCHAR, head VARCHAR, dhash VARCHAR, gate VARCHAR, passed BOOLEAN, pending VARCHAR[])"
RESULT = "STRUCT(id VARCHAR, outcome VARCHAR, gate VARCHAR, carries BOOLEAN, capped VARCHAR)"
NOTHING = f"'p': CAST([] AS {PR_STATE}[]), 'w': CAST([] AS STRUCT(t BIGINT, i BIGINT)[]), 'o': CAST([] AS {RESULT}[])"
def folded_sql(source: str, all_: str, per_install: str, result: str) -> str:
    """``result``: id, outcome, gate, carries, capped of every event of ``source``, by a fold in time order."""
    return f"""ev AS (SELECT {{'id': delivery_id, 't': epoch_us(ts), 'i': CAST(installation_id AS BIGINT), 'k': repo_id || ':' || pr_number, 'step': step,
    'head': head_sha, 'dhash': dhash, 'trivial': trivial AND step <> 'explained', 'graded': graded, 'ungraded': g_ungraded, 'passes': g_pass, 'bound': bound, {NOTHING}}} AS e,
    ts, delivery_id FROM {source}),
folded AS (SELECT list_reduce(list(e ORDER BY ts, delivery_id), lambda a, x:
  list_transform([{{'pr': list_filter(a.p, lambda v: v.k = x.k)[1], 'w': list_filter(a.w, lambda v: v.t >= x.t - 86400000000)}}], lambda b:
  list_transform([{{'dup': x.step = 'opened' AND coalesce(b.pr.head = x.head, false),
    'carries': x.step = 'pushed' AND coalesce(b.pr.passed AND b.pr.dhash = x.dhash, false)}}], lambda c:
  list_transform([CASE WHEN x.step <> 'explained' AND NOT c.dup AND NOT x.trivial THEN
    CASE WHEN len(b.w) >= {all_} THEN 'global' WHEN len(list_filter(b.w, lambda v: v.i = x.i)) >= {per_install} THEN 'install' END END], lambda cap:
  list_transform([CASE WHEN c.dup THEN 'duplicate' WHEN x.trivial THEN 'trivial' WHEN cap IS NOT NULL THEN 'capped' WHEN c.carries THEN 'carried'
    WHEN x.step <> 'explained' THEN 'gated' WHEN x.bound IS NULL AND coalesce(len(b.pr.pending), 0) = 0 THEN 'ignored' WHEN NOT x.graded THEN 'requested'
    WHEN x.ungraded THEN 'ungraded' WHEN x.passes THEN 'passed' ELSE 'failed' END], lambda o:
  list_transform([CASE WHEN o = 'gated' THEN substr(sha256(x.k || ':' || x.id), 1, 32) WHEN o = 'carried' THEN b.pr.gate
    WHEN o IN ('requested', 'ungraded', 'passed', 'failed') THEN coalesce(x.bound, b.pr.pending[-1]) END], lambda g:
    {{'id': x.id, 't': x.t, 'i': x.i, 'k': x.k, 'step': x.step, 'head': x.head, 'dhash': x.dhash, 'trivial': x.trivial, 'graded': x.graded,
      'ungraded': x.ungraded, 'passes': x.passes, 'bound': x.bound,
      'p': CASE o WHEN 'gated' THEN list_append(list_filter(a.p, lambda v: v.k <> x.k), {{'k': x.k, 'head': x.head, 'dhash': x.dhash, 'gate': g,
          'passed': false, 'pending': list_append(coalesce(b.pr.pending, CAST([] AS VARCHAR[])), g)}})
        WHEN 'carried' THEN list_append(list_filter(a.p, lambda v: v.k <> x.k), {{'k': x.k, 'head': x.head, 'dhash': b.pr.dhash, 'gate': b.pr.gate,
          'passed': b.pr.passed, 'pending': b.pr.pending}})
        WHEN 'passed' THEN list_append(list_filter(a.p, lambda v: v.k <> x.k), {{'k': x.k, 'head': b.pr.head, 'dhash': b.pr.dhash, 'gate': b.pr.gate,
          'passed': b.pr.passed OR g = b.pr.gate, 'pending': list_filter(b.pr.pending, lambda q: q <> g)}})
        ELSE a.p END,
      'w': CASE WHEN o = 'gated' THEN list_append(b.w, {{'t': x.t, 'i': x.i}}) ELSE b.w END,
      'o': list_append(a.o, {{'id': x.id, 'outcome': o, 'gate': g, 'carries': c.carries, 'capped': CASE WHEN o = 'capped' THEN cap END}})}})[1])[1])[1])[1])[1],
  {{'id': '', 't': CAST(0 AS BIGINT), 'i': CAST(0 AS BIGINT), 'k': '', 'step': '', 'head': '', 'dhash': '', 'trivial': false, 'graded': false,
    'ungraded': false, 'passes': false, 'bound': '', {NOTHING}}}) AS f FROM ev),
{result} AS (SELECT unnest(f.o, recursive := true) FROM folded)"""


UNBOUND = "unbound AS (SELECT *, CAST(NULL AS VARCHAR) AS bound FROM relevant)"
LIMITED = folded_sql("unbound", str(ALL), str(PER_INSTALL), "limited")


@query(
    """SELECT delivery_id, outcome, gate AS gate_id, carries, limited.capped, CASE WHEN step <> 'explained' THEN reason END AS reason, head_sha, epoch_us(ts) AS ts_us
    FROM limited JOIN relevant ON delivery_id = id""",
    (PR_EVENTS, relevant_sql(), UNBOUND, LIMITED),
)
def replay_gates(s: Source):
    return _outcomes(machine.replay_gates(s.pr_events, PER_INSTALL, ALL))


# Requests are graded by what all was told, two days later, each for the gate it was asked for.
TOLD = """told AS (SELECT *, concat_ws(chr(10) || chr(10), earlier, body) AS explanation FROM (
  SELECT *, string_agg(CASE WHEN outcome <> 'requested' THEN body END, chr(10) || chr(10)) OVER (
    PARTITION BY gate_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
  FROM moves WHERE outcome IN ('requested', 'ungraded', 'passed', 'failed')))"""
ALL_GRADED = """later AS (SELECT * REPLACE ('grade:' || delivery_id AS delivery_id, ts + INTERVAL 2 DAYS AS ts, true AS graded,
    length(explanation) % 9 <> 0 AND length(explanation) % 2 = 0 AS g_pass, length(explanation) % 9 = 0 AS g_ungraded), gate_id AS bound
  FROM told WHERE outcome = 'requested'),
both_kinds AS (SELECT *, CAST(NULL AS VARCHAR) AS bound FROM relevant UNION ALL BY NAME SELECT * FROM later)"""
NO_LIMIT = str(10**9)


def _later(column: str) -> Column:
    return F.col(column) + F.expr("INTERVAL 2 DAYS")


@query(
    "SELECT id AS delivery_id, outcome, gate AS gate_id, carries FROM looped",
    (*MOVES, TOLD, ALL_GRADED, folded_sql("both_kinds", NO_LIMIT, NO_LIMIT, "looped")),
)
def grade_loop(s: Source):
    """Requests out of the machine, graded by a model, back into the log as events, and through the machine again."""
    requests = machine.grade_requests(machine.gate_machine(s.pr_events))
    graded = scoring.grade_batch(requests, parity_model)
    log = machine.graded_log(s.pr_events, machine.grade_events(graded, _later("ts")))
    return machine.gate_machine(log).select("delivery_id", "outcome", "gate_id", "carries")


def closing_by_length():
    """A model that names topics and verdicts by the length of what it read; some of its answers are no close."""

    def complete(system: str, user: str, model: str | None = None, timeout: float = 60.0) -> str:
        n = len(user)
        if n % 11 == 0:
            return "nothing to say"
        topics = [{"concept": f"part {n % 3}", "verdict": ("strong", "thin", "odd")[n % 3], "note": "n"}]
        return json.dumps({"topics": topics, "strongest": "s", "growth_edge": "g", "one_line": "o"})

    return complete


@query(
    """SELECT user_id AS passed_by_id, 'part ' || (n % 3) AS concept, count(*) FILTER (n % 3 = 0) AS strong, count(*) FILTER (n % 3 = 2) AS solid,
      count(*) FILTER (n % 3 = 1) AS thin FROM (SELECT user_id, least(length(explanation), 6000) AS n FROM told WHERE outcome = 'passed')
    WHERE n % 11 <> 0 GROUP BY 1, 2""",
    (*MOVES, TOLD),
)
def closeout_record(s: Source):
    """Passes closed by a model, their closes kept with the gates, and the record of every person made of those."""
    moves = cut(machine.gate_machine(s.pr_events))
    closed = scoring.closeout_batch(machine.told(moves, "passed"), closing_by_length)
    gates = machine.gates_of(machine.with_closeouts(moves, closed))
    return aggregates.topic_record(gates).select("passed_by_id", "concept", "strong", "solid", "thin")


@query("SELECT delivery_id, kind, epoch_us(ts) AS ts_us FROM pr_events", (PR_EVENTS,))
def dedupe_deliveries(s: Source):
    copies = s.pr_events.unionAll(s.pr_events.withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 MINUTES")))
    return jobs.dedupe_deliveries(copies).select("delivery_id", "kind", us("ts"))


@query(
    """SELECT epoch_us(start) AS window_start_us, installation_id, count(*) AS gates FROM (
      SELECT installation_id, unnest(generate_series(date_trunc('hour', created_at) - INTERVAL 23 HOURS, date_trunc('hour', created_at), INTERVAL 1 HOUR)) AS start
      FROM gates) GROUP BY ALL""",
    (GATES,),
)
def streaming_gate_counts(s: Source):
    counts = jobs.streaming_gate_counts(s.gates)
    return counts.select(us("window_start"), "installation_id", "gates")


def _live(s: Source):
    """A session of its own for a stream over the events table, and the folders it writes."""
    spark = s.spark.newSession()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    tasks = str(min(int(s.spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    events = standins.pr_events(standins.table(spark, s.sf_dir, "events", streaming=True))
    return events, fresh_folder(s.spark, "live")


@query(
    "SELECT delivery_id, outcome, gate_id, reason, epoch_us(ts) AS ts_us FROM (SELECT * REPLACE (CASE WHEN step <> 'explained' THEN reason END AS reason) FROM moves)",
    MOVES,
)
def live_gate_machine(s: Source):
    events, folder = _live(s)
    deduped = jobs.dedupe_deliveries(events)
    jobs.write_transitions(live_machine(deduped), folder, f"{folder}/checkpoint", once=True).awaitTermination()
    moves = s.spark.read.parquet(f"{folder}/transitions")
    return moves.select("delivery_id", "outcome", "gate_id", "reason", us("ts"))


def _log_in_slices(s: Source, order: list[int]) -> str:
    """The event log as files of four stretches of time, written one after another in the given order."""
    folder = fresh_folder(s.spark, "log")
    rows = s.pr_events
    edges = rows.agg(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75], 1000)).head()[0]
    slice_ = reduce(add, (F.when(F.unix_micros("ts") > e, 1).otherwise(0) for e in edges))
    full = align_schema(rows, schema("events")).withColumn("slice", slice_)
    for k in order:
        full.filter(F.col("slice") == k).drop("slice").repartition(FILES, "delivery_id").write.mode("append").parquet(folder)
    return folder


FILES = 4
LIVE_SQL = "SELECT delivery_id, outcome, gate_id, epoch_us(ts) AS ts_us FROM moves"


def _streamed(s: Source, log: str) -> DataFrame:
    """Transitions of the whole stream job over a log, a slice in each micro-batch."""
    spark = s.spark.newSession()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    tasks = str(min(int(s.spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    out = fresh_folder(s.spark, "live")
    jobs.streaming_pipeline(spark, log, out, f"{out}/checkpoint", once=True, maxFilesPerTrigger=FILES).awaitTermination()
    return s.spark.read.parquet(f"{out}/transitions")


@query(LIVE_SQL, MOVES)
def streaming_pipeline(s: Source):
    """Event log to transitions in several micro-batches, state read back in each."""
    return _streamed(s, _log_in_slices(s, [0, 1, 2, 3])).select("delivery_id", "outcome", "gate_id", us("ts"))


@query(LIVE_SQL, MOVES)
def reconciled(s: Source):
    """The same with stretches out of order: late events come out as such and their pull requests are replayed."""
    log = _log_in_slices(s, [1, 0, 3, 2])
    moves = jobs.reconciled(_streamed(s, log), read_events(s.spark, log))
    return moves.select("delivery_id", "outcome", "gate_id", us("ts"))


@query(
    f"SELECT kind, outcome, count(*) AS n FROM ({_outbox_sql()}) GROUP BY 1, 2",
    MOVES,
)
def live_actions(s: Source):
    events, folder = _live(s)
    deduped = jobs.dedupe_deliveries(events)
    jobs.write_transitions(live_machine(deduped), folder, f"{folder}/checkpoint", once=True).awaitTermination()
    return s.spark.read.parquet(f"{folder}/actions").groupBy("kind", "outcome").agg(F.count("*").alias("n"))
