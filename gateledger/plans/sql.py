"""Common table expressions: the stand-ins of :mod:`gateledger.plans.standins` in SQL."""

from __future__ import annotations

from gateledger.functions.diffs import GENERATED_RE, TRIVIAL_RE

K = "CAST(props->>'$.k' AS INTEGER)"

GATES = f"""gates AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, user_id AS repo_id, user_id % 10 AS installation_id,
    {K} % 3 AS pr_number, 'c' || (event_id % 7) AS head_sha, substr(sha256(event_type), 1, 16) AS decisions_hash,
    'medium' AS rigor, CASE WHEN event_type = 'purchase' THEN 'passed' ELSE 'pending' END AS status,
    CASE WHEN event_type = 'purchase' THEN 'u' || (event_id % 50) END AS passed_by,
    CASE WHEN event_type = 'purchase' THEN event_id % 50 END AS passed_by_id,
    CASE WHEN event_type = 'purchase' THEN ts END AS passed_at, ts AS created_at
  FROM events)"""

REPOS = "repos AS (SELECT DISTINCT user_id AS id, user_id % 10 AS installation_id FROM events)"

ATTEMPTS = """attempts AS (
  SELECT printf('%010d-%04d', conv_id, turn) AS id, CAST(conv_id AS VARCHAR) AS checkpoint_id,
    role AS reviewer_login, CAST(length(role) AS BIGINT) AS reviewer_id, text AS explanation,
    length(text) % 4 = 0 AS grade_pass, length(text) % 5 = 0 AS ungraded,
    CASE WHEN length(text) % 4 <> 0 THEN substr(text, 1, 20) END AS hole, true AS assisted, turn AS created_at
  FROM conversations)"""

LOCAL_EVENTS = """local_events AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_custkey % 11 <> 0 THEN o_custkey END AS github_id,
    CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey END AS github_login,
    CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey || '@x' END AS email,
    o_orderpriority AS subsystem, o_orderstatus AS concept, o_orderstatus = 'F' AS passed,
    CAST(floor(o_totalprice) AS BIGINT) % 3 = 0 AS told, CAST(floor(o_totalprice) AS BIGINT) % 2 = 0 AS assisted,
    CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 5 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 7 = 0 END AS ungraded,
    o_orderdate AS created_at
  FROM orders)"""

USER_ATTEMPTS = """user_attempts AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id,
    CASE WHEN user_id % 13 <> 0 THEN user_id END AS reviewer_id,
    CASE WHEN event_id % 2 = 0 THEN 'u' || user_id END AS reviewer_login,
    value >= 40 AS grade_pass, true AS assisted, ts AS created_at
  FROM events)"""

PR_EVENTS = f"""src AS (
  SELECT *, {K} AS k, event_type IN ('click', 'view') AS is_push, event_type IN ('purchase', 'error') AS is_comment,
    'topic-' || (event_id % 2) AS topic
  FROM events),
pr_events AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS delivery_id,
    CASE WHEN is_comment THEN 'comment' ELSE 'pull_request' END AS kind,
    CASE WHEN is_comment THEN 'created' WHEN is_push THEN 'synchronize' WHEN k % 2 = 0 THEN 'opened' ELSE 'ready_for_review' END AS action,
    ts, user_id % 10 AS installation_id, user_id AS repo_id, k % 3 AS pr_number,
    'c' || CASE WHEN is_push THEN CAST(event_id AS VARCHAR) ELSE 'd' || (day(ts) // 10) END AS head_sha,
    CASE WHEN k % 13 = 0 THEN true WHEN k % 11 <> 0 THEN false END AS draft,
    CASE WHEN k % 10 = 0 THEN ['docs/guide.md', 'LICENSE'] WHEN k % 10 = 1 THEN CAST([] AS VARCHAR[])
      ELSE ['src/m' || k || '.py', 'README.md'] END AS files,
    '+++ b/x' || chr(10) || repeat('+line' || chr(10), k % 20) || repeat('-old' || chr(10), event_id % 5) AS diff,
    k % 17 = 0 AS no_decisions, topic, 'summary of ' || topic AS summary,
    CASE WHEN is_comment THEN event_id END AS comment_id,
    CASE WHEN is_comment THEN CASE WHEN k % 7 = 0 THEN 'lgtm'
      ELSE 'It holds because of mechanism number ' || event_id || ' and not by luck.' END END AS body,
    user_id, 'u' || user_id AS user_login,
    CASE WHEN k % 17 = 3 THEN 'Bot' WHEN k % 17 <> 4 THEN 'User' END AS user_type,
    (['OWNER', 'MEMBER', 'COLLABORATOR', 'CONTRIBUTOR'])[k % 4 + 1] AS author_association,
    is_comment AND k % 23 <> 5 AS is_pr,
    is_comment AND k % 29 <> 1 AS graded, value >= 40 AS g_pass, k % 19 = 2 AS g_ungraded
  FROM src)"""

SPACE = r"[\s\x{00A0}\x{FEFF}]"
TRIM = "regexp_replace({0}, '^[\\s\\x{{00A0}}\\x{{FEFF}}]+|[\\s\\x{{00A0}}\\x{{FEFF}}]+$', '', 'g')"


def classified(source: str) -> str:
    """``classified``: the source with trivial, reason; needs files and diff columns."""
    return f"""counted AS (
  SELECT *, len(list_filter(files, lambda f: NOT regexp_matches(f, '{TRIVIAL_RE}') AND NOT regexp_matches(f, '{GENERATED_RE}'))) AS meaningful,
    len(list_filter(string_split(diff, chr(10)), lambda l: (starts_with(l, '+') AND NOT starts_with(l, '+++'))
      OR (starts_with(l, '-') AND NOT starts_with(l, '---')))) AS changed
  FROM {source}),
classified AS (
  SELECT *, len(files) = 0 OR meaningful = 0 OR changed <= 8 AS trivial,
    CASE WHEN len(files) = 0 THEN 'no files changed' WHEN meaningful = 0 THEN 'only docs/lockfile/generated files'
      WHEN changed <= 8 THEN 'tiny change (' || changed || ' lines)'
      ELSE meaningful || ' substantive file(s), ' || changed || ' changed lines' END AS reason
  FROM counted)"""


def relevant(source: str = "pr_events", capped: str = "CAST(NULL AS VARCHAR)") -> str:
    """``relevant``: the classified events that the machine takes, with their step."""
    return f"""{classified(source)},
relevant AS (
  SELECT *, {capped} AS capped,
    substr(sha256(CASE WHEN no_decisions THEN '[]' ELSE '[{{"concept":"' || topic || '","summary":"' || summary || '"}}]' END), 1, 16) AS dhash,
    CASE WHEN kind = 'comment' THEN 'explained' WHEN action = 'synchronize' THEN 'pushed' ELSE 'opened' END AS step
  FROM classified
  WHERE (kind = 'pull_request' AND NOT coalesce(draft, false))
    OR (kind = 'comment' AND is_pr AND user_type IS DISTINCT FROM 'Bot'
      AND author_association IN ('OWNER', 'MEMBER', 'COLLABORATOR') AND length({TRIM.format("body")}) >= 40))"""


def machine(source: str = "pr_events", capped: str = "CAST(NULL AS VARCHAR)") -> str:
    """``moves``: one transition per relevant event, by plain windows."""
    pr = "PARTITION BY repo_id, pr_number ORDER BY ts, delivery_id"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""{relevant(source, capped)},
m1 AS (SELECT *, step <> 'explained' AND NOT trivial AND capped IS NULL AS stateful FROM relevant),
m2 AS (SELECT *, step = 'opened' AND coalesce(last_value(CASE WHEN stateful THEN head_sha END IGNORE NULLS) OVER ({pr} {before}) = head_sha, false) AS dup FROM m1),
m3 AS (SELECT *, stateful AND NOT dup AS effective, step = 'explained' AND graded AND NOT g_ungraded AND g_pass AS passes FROM m2),
m4 AS (SELECT *, step = 'pushed' AND coalesce(last_value(CASE WHEN effective THEN dhash END IGNORE NULLS) OVER ({pr} {before}) = dhash, false) AS same,
    max(CASE WHEN passes THEN ts END) OVER ({pr} {before}) AS last_pass FROM m3),
m5 AS (SELECT *, max(CASE WHEN effective AND NOT same THEN ts END) OVER ({pr} {upto}) AS run_start FROM m4),
m6 AS (SELECT *, same AND coalesce(last_pass > run_start, false) AS carries FROM m5),
m7 AS (SELECT *, effective AND NOT carries AS is_new FROM m6),
m8 AS (SELECT *, CASE WHEN is_new THEN 1 WHEN passes THEN -1 ELSE 0 END AS delta,
    CASE WHEN is_new THEN substr(sha256(repo_id || ':' || pr_number || ':' || delivery_id), 1, 32) END AS own FROM m7),
m9 AS (SELECT *, sum(delta) OVER ({pr} {upto}) AS height_sum, last_value(own IGNORE NULLS) OVER ({pr} {before}) AS latest FROM m8),
m10 AS (SELECT *, height_sum - delta - least(0, coalesce(min(height_sum) OVER ({pr} {before}), 0)) AS height FROM m9),
m11 AS (SELECT *, CASE WHEN is_new THEN height + 1 WHEN step = 'explained' THEN height ELSE 0 END AS level FROM m10),
m12 AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY repo_id, pr_number, level ORDER BY ts, delivery_id {upto}) AS target FROM m11),
moves AS (
  SELECT *, CASE WHEN dup THEN 'duplicate' WHEN step <> 'explained' AND trivial THEN 'trivial' WHEN capped IS NOT NULL THEN 'capped'
      WHEN is_new THEN 'gated' WHEN effective THEN 'carried' WHEN level <= 0 OR target IS NULL THEN 'ignored'
      WHEN NOT graded THEN 'requested' WHEN g_ungraded THEN 'ungraded' WHEN passes THEN 'passed' ELSE 'failed' END AS outcome,
    CASE WHEN is_new THEN own WHEN effective THEN latest WHEN step = 'explained' AND level > 0 THEN target END AS gate_id
  FROM m12)"""


def sql_text(value: str | None) -> str:
    """A string literal."""
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_pick(options: list[str], seed: str) -> str:
    """The option that the expression ``seed`` picks."""
    listed = ", ".join(map(sql_text, options))
    codes = f"list_transform(string_split({seed}, ''), lambda c: CAST(unicode(c) AS BIGINT))"
    n = f"list_reduce({codes}, lambda h, x: (h * 31 + x) % 4294967296, CAST(0 AS BIGINT)) % {len(options)}"
    return f"([{listed}])[CAST({n} AS INTEGER) + 1]"
