"""Queries over the stored tables: scans, appends, updates, joins, counts, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gateledger.operators import aggregates, checks, filters, joins, parents, policy, profile, store, windows
from gateledger.plans.registry import Source, fresh_folder, query, us
from gateledger.plans.sql import ATTEMPTS, GATES, LOCAL_EVENTS, PR_EVENTS, REPOS, USER_ATTEMPTS
from gateledger.plans.standins import props_k, text_id
from gateledger.schemas import schema
from gateledger.sources import events as event_source
from gateledger.sources import tables


@query("SELECT user_id, epoch_us(ts) AS ts_us FROM events")
def read_events(s: Source):
    return event_source.read_events(s.spark, f"{s.sf_dir}/events.parquet").select("user_id", us("ts"))


@query(
    "SELECT id, repo_id, pr_number, head_sha, status, rigor, passed_by_id, epoch_us(created_at) AS created_at_us FROM gates",
    (GATES,),
)
def read_entity(s: Source):
    folder = fresh_folder(s.spark, "gates")
    tables.append_gates(s.gates, folder)
    rows = tables.read_entity(s.spark, "gates", folder)
    return rows.select(
        "id", "repo_id", "pr_number", "head_sha", "status", "rigor", "passed_by_id", us("created_at")
    )


@query(
    """SELECT DISTINCT substr(sha256(repo_id || ':' || pr_number || ':' || head_sha), 1, 32) AS id, repo_id, pr_number,
      head_sha, 'pending' AS status, 'medium' AS rigor, CAST(0 AS INTEGER) AS n_decisions FROM gates""",
    (GATES,),
)
def append_gates(s: Source):
    folder = fresh_folder(s.spark, "gates")
    tables.append_gates(s.gates.drop("id", "status", "rigor"), folder)
    rows = tables.read_entity(s.spark, "gates", folder)
    return rows.select(
        "id", "repo_id", "pr_number", "head_sha", "status", "rigor", F.size("decisions").alias("n_decisions")
    )


@query(
    """SELECT substr(sha256('{"checkpoint_id":"' || checkpoint_id || '","comment_id":null,"reviewer_id":' || reviewer_id || ',"words":"' || sha256(explanation)
        || '","at":null,"nth":' || row_number() OVER (PARTITION BY checkpoint_id, reviewer_id, explanation) || '}'), 1, 32) AS id,
      checkpoint_id, explanation, true AS assisted, false AS ungraded FROM attempts""",
    (ATTEMPTS,),
)
def append_attempts(s: Source):
    folder = fresh_folder(s.spark, "attempts")
    rows = s.attempts.drop("id", "assisted", "ungraded", "created_at")
    tables.append_attempts(rows, folder)
    return tables.read_entity(s.spark, "attempts", folder).select(
        "id", "checkpoint_id", "explanation", "assisted", "ungraded"
    )


@query(
    "SELECT delivery_id, f.file FROM pr_events LEFT JOIN LATERAL (SELECT unnest(files) AS file) f ON true",
    (PR_EVENTS,),
)
def pr_files(s: Source):
    return event_source.pr_files(s.pr_events).select("delivery_id", "file")


INSTALLS = """installs AS (
  SELECT CAST(page_id AS VARCHAR) AS delivery_id, regexp_extract(url, '://[^/]+/([^?#]*)', 1) AS path, page_id FROM pages),
listed AS (
  SELECT delivery_id, unnest(CASE WHEN page_id % 4 = 0 THEN [path || '/x'] WHEN page_id % 4 = 1 THEN CAST([] AS VARCHAR[])
    ELSE [path, 'acct/n' || page_id] END) AS full_name FROM installs),
install_repos AS (
  SELECT delivery_id, string_split(full_name, '/')[1] AS owner, string_split(full_name, '/')[2] AS repo FROM listed
  WHERE coalesce(string_split(full_name, '/')[1], '') <> '' AND coalesce(string_split(full_name, '/')[2], '') <> '')"""


def installs(s: Source):
    path = F.regexp_extract("url", "://[^/]+/([^?#]*)", 1)
    kind = "array<struct<full_name:string,name:string>>"

    def entry(full, name):
        return F.struct(full.alias("full_name"), name.alias("name"))

    none = F.lit(None).cast("string")
    both = F.array(
        entry(path, none),
        entry(F.lit(""), F.concat(F.lit("n"), F.col("page_id").cast("string"))),
    )
    return s.pages.select(
        F.col("page_id").cast("string").alias("delivery_id"),
        F.lit(1).cast("bigint").alias("installation_id"),
        F.lit("acct").alias("account_login"),
        F.when(F.col("page_id") % 4 == 1, F.array().cast(kind))
        .when(F.col("page_id") % 4 > 1, both.cast(kind))
        .alias("repositories"),
        F.array(entry(F.concat(path, F.lit("/x")), none)).cast(kind).alias("repositories_added"),
    )


@query("SELECT delivery_id, owner, repo FROM install_repos", (INSTALLS,))
def install_repos(s: Source):
    return event_source.install_repos(installs(s)).select("delivery_id", "owner", "repo")


@query(
    """SELECT DISTINCT i.owner, i.repo FROM install_repos i WHERE NOT EXISTS (
      SELECT 1 FROM rulesets r WHERE r.owner = i.owner AND r.repo = i.repo AND r.name = 'managed')""",
    (
        INSTALLS,
        """rulesets AS (SELECT owner, repo,
             CASE WHEN CAST(delivery_id AS BIGINT) % 3 = 0 THEN 'managed' ELSE 'own' END AS name FROM install_repos)""",
    ),
)
def ruleset_gap(s: Source):
    repos = event_source.install_repos(installs(s))
    managed = F.when(F.col("delivery_id").cast("bigint") % 3 == 0, "managed").otherwise("own")
    return joins.ruleset_gap(repos, repos.select("owner", "repo", managed.alias("name")), "managed")


# The log with what installations and repositories are called, which changes with the hour and is left out at times.
NAMED = """named AS (SELECT *, installation_id AS i, CASE WHEN k % 5 <> 0 THEN 'acct-' || (installation_id + hour(ts) // 12) END AS login,
    CASE WHEN k % 5 <> 0 AND k % 3 = 0 THEN 'User' WHEN k % 3 = 1 THEN '' END AS kind_of,
    CASE WHEN k % 7 <> 0 THEN 'acct/r' || repo_id || '-' || hour(ts) END AS full_name, CASE WHEN k % 6 = 0 THEN 'trunk' WHEN k % 6 = 1 THEN '' END AS branch
  FROM (SELECT *, lpad(CAST(event_id AS VARCHAR), 12, '0') AS delivery_id, user_id AS repo_id, user_id % 10 AS installation_id FROM src) WHERE installation_id <> 9)"""


def named(s: Source):
    hour = F.hour("ts")
    events = s.events.select(
        text_id("event_id").alias("delivery_id"), "ts", F.col("user_id").alias("repo_id"),
        (F.col("user_id") % 10).alias("installation_id"), props_k().alias("k"),
    )
    k, some = F.col("k"), F.col("k") % 5 != 0
    account = (F.col("installation_id") + F.floor(hour / 12)).cast("string")
    return events.select(
        "delivery_id", "ts", "repo_id",
        F.when(F.col("installation_id") != 9, F.col("installation_id")).alias("installation_id"),
        F.when(some, F.concat(F.lit("acct-"), account)).alias("account_login"),
        F.when(some & (k % 3 == 0), "User").when(k % 3 == 1, "").alias("account_type"),
        F.when(k % 7 != 0, F.concat(F.lit("acct/r"), F.col("repo_id").cast("string"), F.lit("-"), hour.cast("string"))).alias("repo_full_name"),
        F.when(k % 6 == 0, "trunk").when(k % 6 == 1, "").alias("default_branch"),
    )


@query(
    """SELECT i AS id, arg_max(login, (ts, delivery_id)) FILTER (login IS NOT NULL) AS account_login,
      coalesce(arg_max(coalesce(nullif(kind_of, ''), 'Organization'), (ts, delivery_id)) FILTER (login IS NOT NULL OR nullif(kind_of, '') IS NOT NULL), 'Organization') AS account_type,
      epoch_us(min(ts)) AS created_at_us FROM named GROUP BY 1""",
    (PR_EVENTS, NAMED),
)
def installations_of(s: Source):
    return parents.installations_of(named(s)).select("id", "account_login", "account_type", us("created_at"))


@query(
    """SELECT repo_id AS id, arg_max(i, (ts, delivery_id)) AS installation_id, arg_max(full_name, (ts, delivery_id)) FILTER (full_name IS NOT NULL) AS full_name,
      coalesce(arg_max(branch, (ts, delivery_id)) FILTER (nullif(branch, '') IS NOT NULL), 'main') AS default_branch, '{}' AS config, epoch_us(min(ts)) AS created_at_us
    FROM named GROUP BY 1""",
    (PR_EVENTS, NAMED),
)
def repos_of(s: Source):
    return parents.repos_of(named(s)).select("id", "installation_id", "full_name", "default_branch", "config", us("created_at"))


@query(
    """SELECT unnest([{'rule': 'id is null', 'violations': count(*) FILTER (id IS NULL)}, {'rule': 'repo_id is null', 'violations': count(*) FILTER (repo_id IS NULL)},
      {'rule': 'pr_number is null', 'violations': count(*) FILTER (pr_number IS NULL)}, {'rule': 'pr_node_id is null', 'violations': count(*)},
      {'rule': 'head_sha is null', 'violations': count(*) FILTER (head_sha IS NULL)}, {'rule': 'decisions is null', 'violations': count(*)},
      {'rule': 'decisions_hash is null', 'violations': count(*) FILTER (decisions_hash IS NULL)}, {'rule': 'rigor is null', 'violations': count(*) FILTER (rigor IS NULL)},
      {'rule': 'status is null', 'violations': count(*) FILTER (status IS NULL)}, {'rule': 'created_at is null', 'violations': count(*) FILTER (created_at IS NULL)},
      {'rule': 'updated_at is null', 'violations': count(*)}, {'rule': 'status out of range', 'violations': count(*) FILTER (status NOT IN ('pending', 'passed', 'trivial', 'error'))},
      {'rule': 'rigor out of range', 'violations': count(*) FILTER (rigor NOT IN ('medium', 'harsh'))}], recursive := true) FROM gates""",
    (GATES,),
)
def check_table(s: Source):
    """The rules of the gate table over gates that lack three of its columns."""
    return checks.check_table(s.gates, "gates")


@query(
    """SELECT coalesce(b.id, n.id) AS id, b.full_name, CASE WHEN n.id IS NOT NULL THEN n.branch ELSE b.branch END AS default_branch
    FROM (SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS branch FROM customer WHERE c_custkey % 2 = 0) b
    FULL JOIN (SELECT o_custkey AS id, o_orderpriority AS branch FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) n ON b.id = n.id"""
)
def upsert_latest(s: Source):
    base = s.customer.filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("default_branch")
    )
    changes = s.orders.select(
        F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("default_branch"), "o_orderdate", "o_orderkey"
    )
    return store.upsert_latest(base, changes, ["id"], ["o_orderdate", "o_orderkey"])


@query(
    """SELECT g.id, CASE WHEN p.gate_id IS NOT NULL THEN 'passed' ELSE g.status END AS status,
      CASE WHEN p.gate_id IS NOT NULL THEN p.by ELSE g.passed_by END AS passed_by,
      CASE WHEN p.gate_id IS NOT NULL THEN p.by_id ELSE g.passed_by_id END AS passed_by_id,
      epoch_us(CASE WHEN p.gate_id IS NOT NULL THEN p.ts ELSE g.passed_at END) AS passed_at_us
    FROM gates g LEFT JOIN (
      SELECT lpad(CAST(event_id - event_id % 3 AS VARCHAR), 12, '0') AS gate_id, 'r' || user_id AS by, user_id AS by_id, ts
      FROM events WHERE event_type = 'error'
      QUALIFY row_number() OVER (PARTITION BY event_id - event_id % 3 ORDER BY ts DESC, user_id DESC) = 1) p ON g.id = p.gate_id""",
    (GATES,),
)
def apply_passes(s: Source):
    passes = s.events.filter("event_type = 'error'").select(
        F.lpad((F.col("event_id") - F.col("event_id") % 3).cast("string"), 12, "0").alias("gate_id"),
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("passed_by"),
        F.col("user_id").alias("passed_by_id"),
        F.col("ts").alias("passed_at"),
    )
    return store.apply_passes(s.gates, passes).select("id", "status", "passed_by", "passed_by_id", us("passed_at"))


@query(
    """SELECT g.id, coalesce(m.head, g.head_sha) AS head_sha FROM gates g LEFT JOIN (
      SELECT lpad(CAST(event_id - event_id % 3 AS VARCHAR), 12, '0') AS gate_id, 'm' || event_id AS head FROM events
      WHERE event_type = 'view'
      QUALIFY row_number() OVER (PARTITION BY event_id - event_id % 3 ORDER BY ts DESC, 'm' || event_id DESC) = 1) m ON g.id = m.gate_id""",
    (GATES,),
)
def apply_head_moves(s: Source):
    moves = s.events.filter("event_type = 'view'").select(
        F.lpad((F.col("event_id") - F.col("event_id") % 3).cast("string"), 12, "0").alias("gate_id"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("head_sha"),
        F.col("ts").alias("moved_at"),
    )
    return store.apply_head_moves(s.gates, moves).select("id", "head_sha")


def hierarchy(s: Source):
    """Region, nation, customer, orders as the four levels of the store."""
    return {
        "installations": s.region.select(F.col("r_regionkey").cast("bigint").alias("id")),
        "repos": s.nation.select(
            F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("installation_id")
        ),
        "gates": s.customer.select(
            F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("repo_id"), F.col("c_mktsegment").alias("status")
        ),
        "attempts": s.orders.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("checkpoint_id"), F.col("o_orderstatus").alias("overlap")
        ),
    }


@query(
    """SELECT 'installations' AS tbl, CAST(r_regionkey AS BIGINT) AS id FROM region WHERE r_regionkey NOT IN (1, 3)
    UNION ALL SELECT 'repos', CAST(n_nationkey AS BIGINT) FROM nation WHERE n_regionkey NOT IN (1, 3)
    UNION ALL SELECT 'gates', c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))
    UNION ALL SELECT 'attempts', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer
      WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)))"""
)
def cascade_delete(s: Source):
    levels = hierarchy(s)
    gone = levels["installations"].filter(F.col("id").isin(1, 3))
    kept = store.cascade_delete(levels, gone)
    parts = [df.select(F.lit(name).alias("tbl"), "id") for name, df in kept.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "SELECT id, status, rigor, CAST(NULL AS VARCHAR) AS pr_node_id, true AS no_closeout, CAST(NULL AS BIGINT) AS check_run_id FROM gates",
    (GATES,),
)
def align_schema(s: Source):
    aligned = store.align_schema(s.gates, schema("gates"))
    return aligned.select(
        "id", "status", "rigor", "pr_node_id", F.col("closeout").isNull().alias("no_closeout"), "check_run_id"
    )


@query("SELECT id, status, decisions_hash FROM gates WHERE id = '000000000042'", (GATES,))
def gate_by_id(s: Source):
    return filters.gate_by_id(s.gates, "000000000042").select("id", "status", "decisions_hash")


@query(
    """SELECT id, decisions_hash FROM gates WHERE status = 'pending' AND pr_number = 1
      AND created_at >= TIMESTAMP '2024-01-10 00:00:00' AND repo_id IN (1, 2, 3, 5, 8)""",
    (GATES,),
)
def select_gates(s: Source):
    return filters.select_gates(
        s.gates,
        ["id", "decisions_hash"],
        since="2024-01-10 00:00:00",
        repo_ids=[1, 2, 3, 5, 8],
        status="pending",
        pr_number=1,
    )


@query(
    """SELECT p.id FROM gates p LEFT JOIN (
      SELECT repo_id, pr_number, head_sha FROM gates WHERE decisions_hash <> substr(sha256('signup'), 1, 16)
      QUALIFY row_number() OVER (PARTITION BY repo_id, pr_number ORDER BY created_at DESC, id DESC) = 1) g
      USING (repo_id, pr_number)
    WHERE p.decisions_hash = substr(sha256('signup'), 1, 16) AND g.head_sha IS DISTINCT FROM p.head_sha""",
    (GATES,),
)
def dedupe_heads(s: Source):
    signup = F.substring(F.sha2(F.lit("signup"), 256), 1, 16)
    prs = s.gates.filter(F.col("decisions_hash") == signup)
    return filters.dedupe_heads(prs, s.gates.filter(F.col("decisions_hash") != signup)).select("id")


@query(
    """SELECT id, github_id, github_login, email, subsystem, concept, assisted, told, passed, ungraded,
      epoch_us(created_at) AS created_at_us FROM local_events""",
    (LOCAL_EVENTS,),
)
def forward_metadata(s: Source):
    local = s.local_events.withColumns({"explanation": F.col("concept"), "ground_truth": F.col("concept")})
    rows = filters.forward_metadata(local)
    return rows.select(*(c for c in rows.columns if c != "created_at"), us("created_at"))


@query(
    "SELECT g.id FROM gates g WHERE g.repo_id IN (SELECT id FROM repos WHERE installation_id = 3)", (GATES, REPOS)
)
def install_gates(s: Source):
    return joins.install_gates(s.gates, s.repos, 3).select("id")


@query(
    """SELECT CAST(c.event_id AS VARCHAR) AS comment_id, g.id AS gate_id
    FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) % 3 AS pr_number FROM events WHERE event_type IN ('purchase', 'error')) c
    ASOF LEFT JOIN gates g
      ON c.user_id = g.repo_id AND c.pr_number = g.pr_number AND c.ts >= g.created_at""",
    (GATES,),
)
def comment_gate_asof(s: Source):
    comments = s.pr_events.filter("kind = 'comment'")
    return joins.comment_gate_asof(comments, s.gates).select("comment_id", "gate_id")


@query(
    "SELECT c_custkey AS id, o_orderkey AS attempt_id, o_orderstatus AS attempt_overlap FROM customer LEFT JOIN orders ON c_custkey = o_custkey"
)
def gate_attempts(s: Source):
    levels = hierarchy(s)
    return joins.gate_attempts(levels["gates"], levels["attempts"]).select("id", "attempt_id", "attempt_overlap")


@query(
    """SELECT coalesce(u.github_id, m.github_id, d.github_id) AS github_id, u.github_login,
      coalesce(attempts, 0) AS attempts, coalesce(attempts_passed, 0) AS attempts_passed,
      coalesce(local_events, 0) AS local_events, coalesce(local_passed, 0) AS local_passed
    FROM (SELECT c_custkey AS github_id, c_name AS github_login FROM customer) u
    FULL JOIN (SELECT reviewer_id AS github_id, count(*) AS attempts, count(*) FILTER (grade_pass) AS attempts_passed
      FROM user_attempts WHERE reviewer_id IS NOT NULL GROUP BY 1) m ON u.github_id = m.github_id
    FULL JOIN (SELECT github_id, count(*) AS local_events, count(*) FILTER (passed) AS local_passed
      FROM local_events WHERE github_id IS NOT NULL GROUP BY 1) d ON coalesce(u.github_id, m.github_id) = d.github_id""",
    (USER_ATTEMPTS, LOCAL_EVENTS),
)
def profile_join(s: Source):
    users = s.customer.select(F.col("c_custkey").alias("github_id"), F.col("c_name").alias("github_login"))
    return profile.profile_join(users, s.user_attempts, s.local_events)


@query(
    "SELECT o_orderkey AS id FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"
)
def fk_orphans(s: Source):
    parents = s.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return checks.fk_orphans(hierarchy(s)["attempts"], parents, "checkpoint_id").select("id")


@query(
    """SELECT p.delivery_id, g.id AS gate_id FROM (
      SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS delivery_id, user_id AS repo_id, CAST(props->>'$.k' AS INTEGER) % 3 AS pr_number,
        substr(sha256(CASE WHEN value > 20 THEN 'purchase' ELSE event_type END), 1, 16) AS h FROM events WHERE event_type IN ('click', 'view')) p
    JOIN (SELECT * FROM gates QUALIFY row_number() OVER (PARTITION BY repo_id, pr_number ORDER BY created_at DESC, id DESC) = 1) g
      ON p.repo_id = g.repo_id AND p.pr_number = g.pr_number AND p.h = g.decisions_hash AND g.status = 'passed'""",
    (GATES,),
)
def carry_join(s: Source):
    known = F.when(F.col("value") > 20, "purchase").otherwise(F.col("event_type"))
    pushes = s.events.filter(F.col("event_type").isin("click", "view")).select(
        text_id("event_id").alias("delivery_id"),
        F.col("user_id").alias("repo_id"),
        (props_k() % 3).alias("pr_number"),
        F.substring(F.sha2(known, 256), 1, 16).alias("decisions_hash"),
    )
    return joins.carry_join(pushes, s.gates).select("delivery_id", "gate_id")


@query(
    "SELECT c_custkey AS id, count(o_orderkey) AS attempts FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"
)
def attempt_counts(s: Source):
    levels = hierarchy(s)
    return aggregates.attempt_counts(levels["gates"], levels["attempts"])


@query("SELECT count(*) AS gates FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'")
def gates_since(s: Source):
    return aggregates.gates_since(s.gates, "2024-01-20 12:00:00")


@query(
    """SELECT CAST(n_nationkey AS BIGINT) AS installation_id, coalesce(n, 0) AS gates FROM nation
    LEFT JOIN (SELECT user_id % 10 AS i, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1) ON i = n_nationkey"""
)
def gates_since_by_install(s: Source):
    installations = s.nation.select(F.col("n_nationkey").cast("bigint").alias("id"))
    return aggregates.gates_since_by_install(installations, s.repos, s.gates, "2024-01-20 12:00:00")


@query(
    """SELECT checkpoint_id, row_number() OVER (PARTITION BY checkpoint_id ORDER BY created_at, id) AS position, explanation
    FROM attempts""",
    (ATTEMPTS,),
)
def explanations_in_order(s: Source):
    return windows.explanations_in_order(s.attempts, F.floor(F.col("created_at") / 100))


@query(
    """SELECT checkpoint_id, id AS attempt_id, reviewer_login AS passed_by, reviewer_id AS passed_by_id, n AS attempts_to_pass
    FROM (SELECT *, row_number() OVER (PARTITION BY checkpoint_id ORDER BY created_at, id) AS n FROM attempts)
    WHERE grade_pass QUALIFY row_number() OVER (PARTITION BY checkpoint_id ORDER BY n) = 1""",
    (ATTEMPTS,),
)
def gate_pass(s: Source):
    return aggregates.gate_pass(s.attempts, F.floor(F.col("created_at") / 100)).drop("passed_at")


GRADES = """grades AS (SELECT l.doc_id, CASE WHEN l.doc_id % 2 = 0 THEN 'medium' ELSE 'harsh' END AS rigor, quality = 1 AS expected,
  toxic = 0 AS pass, l.doc_id % 10 = 0 AS ungraded FROM labels l)"""


def grades(s: Source):
    return s.labels.select(
        F.when(F.col("doc_id") % 2 == 0, "medium").otherwise("harsh").alias("rigor"),
        (F.col("quality") == 1).alias("expected"),
        (F.col("toxic") == 0).alias("pass"),
        (F.col("doc_id") % 10 == 0).alias("ungraded"),
    )


@query(
    """SELECT rigor, count(*) AS total, count(*) FILTER (pass = expected AND NOT ungraded) AS correct,
      count(*) FILTER (pass AND NOT expected) AS false_pass, count(*) FILTER (NOT pass AND expected) AS false_fail,
      CAST(round(count(*) FILTER (pass = expected AND NOT ungraded) * 100.0 / count(*)) AS BIGINT) AS accuracy_pct
    FROM grades GROUP BY rigor""",
    (GRADES,),
)
def grader_eval(s: Source):
    return aggregates.grader_eval(grades(s), ["rigor"])


@query(
    """SELECT n, round(((b + n - p - e + b) / n - ch) / (1 - ch), 6) AS kappa FROM (
      SELECT *, (CAST(p AS DOUBLE) * e + CAST(n - p AS DOUBLE) * (n - e)) / (CAST(n AS DOUBLE) * n) AS ch FROM (
        SELECT count(*) AS n, count(*) FILTER (pass AND expected) AS b, count(*) FILTER (pass) AS p, count(*) FILTER (expected) AS e FROM grades))""",
    (GRADES,),
)
def grader_kappa(s: Source):
    return aggregates.grader_kappa(grades(s))


@query("SELECT repo_id, pr_number, head_sha, count(*) AS copies FROM gates GROUP BY ALL HAVING count(*) > 1", (GATES,))
def unique_violations(s: Source):
    return checks.unique_violations(s.gates)


@query(
    """SELECT rule, CAST(v AS BIGINT) AS violations FROM (SELECT
      count(*) FILTER (github_id IS NULL) AS "github_id is null", count(*) FILTER (github_login IS NULL) AS "github_login is null",
      count(*) FILTER (concept NOT IN ('F', 'O')) AS "concept out of range" FROM local_events)
    UNPIVOT (v FOR rule IN ("github_id is null", "github_login is null", "concept out of range"))""",
    (LOCAL_EVENTS,),
)
def table_checks(s: Source):
    return checks.table_checks(s.local_events, ["github_id", "github_login"], {"concept": ["F", "O"]})


@query(
    """SELECT github_id, subsystem, count(*) AS events, count(*) FILTER (passed) AS passed, count(*) FILTER (told) AS told,
      count(*) FILTER (assisted) AS assisted, count(*) FILTER (ungraded) AS ungraded FROM local_events GROUP BY 1, 2""",
    (LOCAL_EVENTS,),
)
def subsystem_summary(s: Source):
    return aggregates.subsystem_summary(s.local_events)


@query(
    """SELECT github_id, arg_max(github_login, (created_at, id)) FILTER (github_login IS NOT NULL) AS github_login,
      arg_max(email, (created_at, id)) FILTER (email IS NOT NULL) AS email,
      epoch_us(min(created_at)) AS first_seen_us, epoch_us(max(created_at)) AS last_seen_us
    FROM (SELECT reviewer_id AS github_id, reviewer_login AS github_login, NULL AS email, created_at, id FROM user_attempts
      UNION ALL SELECT github_id, github_login, email, created_at, id FROM local_events)
    WHERE github_id IS NOT NULL GROUP BY 1""",
    (USER_ATTEMPTS, LOCAL_EVENTS),
)
def users_from_events(s: Source):
    users = profile.users_from_events(s.user_attempts, s.local_events)
    return users.select("github_id", "github_login", "email", us("first_seen"), us("last_seen"))


@query(
    """SELECT 'merge' AS surface, id, reviewer_id AS github_id, grade_pass AS passed, NULL AS concept, epoch_us(created_at) AS created_at_us FROM user_attempts
    UNION ALL SELECT 'dev', id, github_id, passed, concept, epoch_us(created_at) FROM local_events""",
    (USER_ATTEMPTS, LOCAL_EVENTS),
)
def surface_union(s: Source):
    both = profile.surface_union(s.user_attempts, s.local_events)
    return both.select("surface", "id", "github_id", "passed", "concept", us("created_at"))


@query(
    """SELECT id, repo_id, pr_number, status FROM gates
    QUALIFY row_number() OVER (PARTITION BY repo_id, pr_number ORDER BY created_at DESC, id DESC) = 1""",
    (GATES,),
)
def latest_gate(s: Source):
    return windows.latest_gate(s.gates).select("id", "repo_id", "pr_number", "status")


@query(
    """SELECT id, repo_id, pr_number FROM gates WHERE status = 'pending'
    QUALIFY row_number() OVER (PARTITION BY repo_id, pr_number ORDER BY created_at DESC, id DESC) = 1""",
    (GATES,),
)
def open_gate(s: Source):
    return windows.open_gate(s.gates).select("id", "repo_id", "pr_number")


@query("SELECT id, repo_id, pr_number FROM gates ORDER BY created_at DESC, id DESC LIMIT 1", (GATES,))
def newest_gate(s: Source):
    return windows.newest_gate(s.gates).select("id", "repo_id", "pr_number")


@query("SELECT id, checkpoint_id, created_at FROM attempts ORDER BY created_at, id", (ATTEMPTS,))
def attempts_oldest_first(s: Source):
    return windows.attempts_oldest_first(s.attempts).select("id", "checkpoint_id", "created_at")


@query(
    """SELECT id, string_agg(explanation, chr(10) || chr(10)) OVER (PARTITION BY checkpoint_id ORDER BY created_at, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative FROM attempts""",
    (ATTEMPTS,),
)
def cumulative_explanation(s: Source):
    rows = windows.cumulative_explanation(s.attempts, F.floor(F.col("created_at") / 100))
    return rows.select("id", "cumulative")


@query(
    """SELECT id, position, cumulative FROM (SELECT *, row_number() OVER w AS position, string_agg(explanation, chr(10) || chr(10)) OVER w AS cumulative FROM attempts
      WINDOW w AS (PARTITION BY checkpoint_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE grade_pass""",
    (ATTEMPTS,),
)
def told_at(s: Source):
    """Texts of the passing attempts alone, built from places in texts that are stored once."""
    bucket = F.floor(F.col("created_at") / 100)
    asked = windows.explanation_places(s.attempts, bucket).filter("grade_pass")
    rows = windows.told_at(asked, windows.explanations_in_order(s.attempts, bucket))
    return rows.select("id", "position", "cumulative")


@query(
    """SELECT id, row_number() OVER w AS attempt_no, sum(CAST(grade_pass AS INTEGER)) OVER w = 1 AND grade_pass AS first_pass
    FROM attempts WINDOW w AS (PARTITION BY checkpoint_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    (ATTEMPTS,),
)
def attempt_rank(s: Source):
    ranked = windows.attempt_rank(s.attempts, F.floor(F.col("created_at") / 100))
    return ranked.select("id", "attempt_no", "first_pass")


@query(
    """SELECT id, installation_id,
      count(*) OVER (PARTITION BY installation_id ORDER BY created_at RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)
        - count(*) OVER (PARTITION BY installation_id, created_at ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS installation_before,
      count(*) OVER (ORDER BY created_at RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)
        - count(*) OVER (PARTITION BY created_at ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS global_before
    FROM gates""",
    (GATES,),
)
def rolling_gate_counts(s: Source):
    return windows.rolling_gate_counts(s.gates).drop("created_at")


@query(
    """SELECT delivery_id, CAST(sum(CASE WHEN h IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, delivery_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island FROM (
      SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS delivery_id, user_id, ts, event_type AS h,
        lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev
      FROM events WHERE event_type IN ('click', 'view', 'purchase'))"""
)
def gate_islands(s: Source):
    return windows.gate_islands(pushes(s)).select("delivery_id", "island")


def pushes(s: Source):
    """Pushes of one pull request per user; the event type stands for the decisions hash."""
    kept = s.events.filter(F.col("event_type").isin("click", "view", "purchase"))
    return kept.select(
        F.col("user_id").alias("repo_id"),
        F.lit(1).alias("pr_number"),
        "ts",
        text_id("event_id").alias("delivery_id"),
        F.when(F.col("event_id") % 9 == 0, "opened").otherwise("synchronize").alias("action"),
        F.col("event_type").alias("decisions_hash"),
        "value",
    )


@query(
    """SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderdate + INTERVAL 21 DAYS <= TIMESTAMP '1996-06-30 00:00:00'"""
)
def recall_due(s: Source):
    gates = s.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "passed").otherwise("pending").alias("status"),
        F.col("o_orderdate").alias("passed_at"),
        F.lit(None).cast("timestamp").alias("next_recall_due"),
    )
    return policy.recall_due(gates, "1996-06-30 00:00:00", "21 days").select("id")


@query(
    """SELECT DISTINCT r.user_id AS repo_id, r.pr_number, r.reviewer AS user_id FROM (
      SELECT user_id, CAST(props->>'$.k' AS INTEGER) % 3 AS pr_number, event_id % 50 AS reviewer FROM events WHERE event_type = 'view') r
    WHERE NOT EXISTS (SELECT 1 FROM gates g WHERE g.status = 'passed' AND g.repo_id = r.user_id AND g.pr_number = r.pr_number AND g.passed_by_id = r.reviewer)""",
    (GATES,),
)
def approver_mismatch(s: Source):
    reviews = s.events.filter("event_type = 'view'").select(
        F.col("user_id").alias("repo_id"),
        (props_k() % 3).alias("pr_number"),
        (F.col("event_id") % 50).alias("user_id"),
    )
    return policy.approver_mismatch(s.gates, reviews).distinct()


@query(
    """SELECT checkpoint_id, reviewer_id, count(*) AS attempts, bool_or(grade_pass) AS passed,
      arg_max(hole, (created_at, id)) FILTER (hole IS NOT NULL) AS last_hole FROM attempts GROUP BY 1, 2""",
    (ATTEMPTS,),
)
def thread_state(s: Source):
    return policy.thread_state(s.attempts)
