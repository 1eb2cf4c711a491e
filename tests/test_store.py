from datetime import datetime

from pyspark.sql import functions as F

from gateledger.operators import aggregates, checks, filters, parents, policy, profile, store, windows
from gateledger.schemas import CLOSEOUT, REPO_LIST, TABLES, schema
from gateledger.sources import events as event_source
from gateledger.sources import tables


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_upsert_overwrites_provided_columns_only(spark):
    base = spark.createDataFrame([(1, "a", "main", "{}"), (2, "b", "main", "{}")], "id long, full_name string, default_branch string, config string")
    changes = spark.createDataFrame([(1, "a2", None, 1), (1, "a3", None, 2), (3, "c", "dev", 1)], "id long, full_name string, default_branch string, at int")
    got = store.upsert_latest(base, changes, ["id"], ["at"])
    assert rows(got, "id", "full_name", "default_branch", "config") == [(1, "a3", None, "{}"), (2, "b", "main", "{}"), (3, "c", "dev", None)]


def test_a_pass_survives_a_missing_closeout_column(spark):
    gates = spark.createDataFrame([("g", "pending", None), ("h", "pending", None)], "id string, status string, passed_by string")
    passes = spark.createDataFrame([("g", "me", 5, datetime(2024, 1, 1), None)], f"gate_id string, passed_by string, passed_by_id long, passed_at timestamp, closeout {CLOSEOUT}")
    assert rows(store.apply_passes(gates, passes), "id", "status", "passed_by") == [("g", "passed", "me"), ("h", "pending", None)]
    full = store.align_schema(gates, schema("gates"))
    closed = passes.withColumn("closeout", F.expr(f"cast(named_struct('topics', array(), 'strongest', 's', 'growth_edge', '', 'one_line', '') as {CLOSEOUT})"))
    got = store.apply_passes(full, closed).filter("id = 'g'").first()
    assert got.closeout.strongest == "s" and got.updated_at == got.passed_at == datetime(2024, 1, 1)


def test_head_moves_and_dedupe(spark):
    gates = spark.createDataFrame([("g", 1, 1, "old", 1), ("h", 1, 2, "x", 1)], "id string, repo_id long, pr_number int, head_sha string, created_at int")
    moves = spark.createDataFrame([("g", "m1", 1), ("g", "m2", 2)], "gate_id string, head_sha string, moved_at int")
    moved = store.apply_head_moves(gates, moves)
    assert rows(moved, "id", "head_sha") == [("g", "m2"), ("h", "x")]
    prs = spark.createDataFrame([(1, 1, "m2"), (1, 2, "y"), (9, 9, "z")], "repo_id long, pr_number int, head_sha string")
    assert rows(filters.dedupe_heads(prs, moved), "head_sha") == [("y",), ("z",)]


def test_cascade(spark):
    def t(ddl, *r):
        return spark.createDataFrame(list(r), ddl)

    data = {
        "installations": t("id long", (1,), (2,)),
        "repos": t("id long, installation_id long", (10, 1), (20, 2)),
        "gates": t("id string, repo_id long", ("a", 10), ("b", 20)),
        "attempts": t("id string, checkpoint_id string", ("x", "a"), ("y", "b"), ("z", "b")),
    }
    kept = store.cascade_delete(data, data["installations"].filter("id = 1"))
    assert {n: rows(df, "id") for n, df in kept.items()} == {
        "installations": [(2,)], "repos": [(20,)], "gates": [("b",)], "attempts": [("y",), ("z",)],
    }


def test_appends_fill_defaults_and_add_nothing_twice(spark, tmp_path):
    new = spark.createDataFrame([(1, 2, "sha", "n", "h")], "repo_id long, pr_number int, head_sha string, pr_node_id string, decisions_hash string")
    path = str(tmp_path / "gates")
    tables.append_gates(new, path)
    tables.append_gates(new, path)
    got = tables.read_entity(spark, "gates", path)
    assert got.schema.names == schema("gates").names
    assert got.select("id").distinct().count() == 1
    first = got.first()
    assert (first.status, first.rigor, first.decisions, first.closeout) == ("pending", "medium", [], None) and first.created_at
    assert rows(checks.unique_violations(got), "repo_id", "pr_number", "head_sha", "copies") == []
    broken = dict(rows(checks.check_table(got.withColumn("status", F.lit("odd")), "gates"), "rule", "violations"))
    assert broken["status out of range"] == 1 and broken["head_sha is null"] == 0
    old = got.drop("closeout").withColumn("extra", F.lit(1))
    assert store.align_schema(old, schema("gates")).schema.names == schema("gates").names


def test_json_columns_of_a_relational_source(spark):
    raw = spark.createDataFrame([("g", '[{"concept":"c","summary":"s"}]', None)], "id string, decisions string, closeout string")
    assert tables.parse_json_columns(raw, "gates").first().decisions[0].concept == "c"
    assert set(TABLES) == {"installations", "repos", "gates", "attempts", "users", "local_events"}


def test_install_repos(spark):
    one, two = [("o/r/x", None)], [("", "n"), ("lonely", None)]
    data = [("a", one, None), ("b", None, two), ("c", [], two), ("d", None, None)]
    df = spark.createDataFrame([(d, 1, "acct", x, y) for d, x, y in data], f"delivery_id string, installation_id long, account_login string, repositories {REPO_LIST}, repositories_added {REPO_LIST}")
    assert rows(event_source.install_repos(df), "delivery_id", "owner", "repo") == [("a", "o", "r"), ("b", "acct", "n")]


def test_parse_events_and_files(spark):
    raw = spark.createDataFrame([('{"delivery_id":"x","kind":"pull_request","files":["a","b"]}',), ('{"delivery_id":"y","files":[]}',)], "value string")
    parsed = event_source.parse_events(raw)
    assert rows(event_source.pr_files(parsed), "delivery_id", "file") == [("x", "a"), ("x", "b"), ("y", None)]
    assert filters.not_draft(parsed).count() == 2


def test_eligible_comments(spark):
    body = " \t" + "x" * 40 + "\n "
    data = [(body, "User", "MEMBER", True), (body, None, "OWNER", True), (body, "Bot", "OWNER", True), (body, "User", "CONTRIBUTOR", True),
            ("\n" + "x" * 39 + "  ", "User", "OWNER", True), (None, "User", "OWNER", True), (body, "User", "OWNER", False), ("🌊" * 20, "User", "COLLABORATOR", True)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, body string, user_type string, author_association string, is_pr boolean")
    assert rows(filters.eligible_comments(df), "i") == [(0,), (1,), (7,)]


def test_attempt_order_and_first_pass(spark):
    data = [("g", "b", 1, False, 7), ("g", "a", 1, None, 8), ("g", "c", 2, True, 9), ("g", "d", 3, True, 7), ("h", "e", 1, False, 7)]
    df = spark.createDataFrame([(*d, d[1]) for d in data], "checkpoint_id string, id string, created_at int, grade_pass boolean, reviewer_id long, explanation string")
    df = df.withColumn("reviewer_login", F.lit("u"))
    for hot in (10**9, 1):
        b = F.col("created_at")
        assert rows(windows.explanations_in_order(df, b, hot), "checkpoint_id", "position", "explanation") == [("g", 1, "a"), ("g", 2, "b"), ("g", 3, "c"), ("g", 4, "d"), ("h", 1, "e")]
        assert rows(aggregates.gate_pass(df, b, hot), "checkpoint_id", "attempt_id", "passed_by_id", "attempts_to_pass") == [("g", "c", 9, 3)]
        texts = dict(rows(windows.cumulative_explanation(df, b, hot), "id", "cumulative"))
        assert texts["d"] == "a\n\nb\n\nc\n\nd" and texts["e"] == "e"
        asked = windows.explanation_places(df, b, hot)
        assert "explanation" not in asked.columns
        built = windows.told_at(asked.filter("id <> 'b'").union(asked.filter("id = 'd'")), windows.explanations_in_order(df, b, hot))
        assert rows(built, "id", "cumulative") == sorted([*((i, t) for i, t in texts.items() if i != "b"), ("d", texts["d"])])
        own = dict(rows(windows.cumulative_explanation(df, b, hot, by_reviewer=True), "id", "cumulative"))
        assert own["d"] == "b\n\nd"


def test_grader_eval_never_counts_ungraded_as_correct(spark):
    data = [(True, True, False), (False, False, True), (True, False, False), (False, True, False), (None, False, False)]
    df = spark.createDataFrame(data, "pass boolean, expected boolean, ungraded boolean")
    got = aggregates.grader_eval(df).first()
    assert (got.total, got.correct, got.false_pass, got.false_fail, got.accuracy_pct) == (5, 1, 1, 1, 20)
    assert aggregates.grader_kappa(df.filter("pass AND expected")).first().kappa is None


def test_people(spark):
    attempts = spark.createDataFrame([("a", 1, None, True, 5), ("b", None, "x", True, 1)], "id string, reviewer_id long, reviewer_login string, grade_pass boolean, created_at int")
    local = spark.createDataFrame([("c", 1, "me", "m@x", True, 3), ("d", 2, "you", None, None, 4)], "id string, github_id long, github_login string, email string, passed boolean, created_at int")
    users = profile.users_from_events(attempts, local)
    assert rows(users, "github_id", "github_login", "email", "first_seen", "last_seen") == [(1, "me", "m@x", 3, 5), (2, "you", None, 4, 4)]
    joined = profile.profile_join(users.filter("github_id = 1"), attempts, local)
    assert rows(joined, *joined.columns) == [(1, "me", 1, 1, 1, 1), (2, None, 0, 0, 1, 0)]
    summary = aggregates.subsystem_summary(
        local.select("github_id", F.lit("s").alias("subsystem"), "passed", *(F.lit(True).alias(c) for c in ("told", "assisted", "ungraded"))), rollup=True
    )
    assert summary.filter("github_id IS NULL").first().events == 2


def test_policies(spark):
    df = spark.createDataFrame([(1, ["src/a/b.py", "docs/x.md"]), (2, ["docs/x.md"]), (3, []), (4, ["lib/auth/k.go"])], "i int, files array<string>")
    got = policy.path_policy(df, ["src/**", "lib/**/*.go"], ["docs/**", "**/*.md"])
    assert rows(got, "i", "gate_by_path") == [(1, True), (2, False), (3, False), (4, True)]
    assert rows(policy.path_policy(df, (), ["docs/**"]), "i", "gate_by_path") == [(1, True), (2, False), (3, False), (4, True)]
    assert rows(policy.path_rigor(df, ["lib/auth/**"]), "i", "rigor") == [(1, "medium"), (2, "medium"), (3, "medium"), (4, "harsh")]
    threads = spark.createDataFrame([("g", 1, "a", 1, False, "h1"), ("g", 1, "b", 2, False, "h2"), ("g", 2, "c", 3, True, None)], "checkpoint_id string, reviewer_id long, id string, created_at int, grade_pass boolean, hole string")
    assert rows(policy.thread_state(threads), "reviewer_id", "attempts", "passed", "last_hole") == [(1, 2, False, "h2"), (2, 1, True, None)]


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(10).select("id", F.lit(1).alias("repo_id"), F.lit("x").alias("head_sha")).write.parquet(str(tmp_path / "g"))
    gates = spark.read.parquet(str(tmp_path / "g"))
    plan = filters.select_gates(gates, ["id"], repo_id=1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(repo_id,1)" in plan and "head_sha" not in plan


def test_attempts_without_a_comment_are_all_kept(spark, tmp_path):
    from gateledger.sources import tables

    path = str(tmp_path / "attempts")
    rows = [("g", 5, None, "one"), ("g", None, 5, "one"), ("g", None, None, "two"), ("g", None, None, "two"), ("g", 7, 8, "three"), ("g", 7, 8, "three"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "checkpoint_id string, comment_id bigint, reviewer_id bigint, explanation string")
    for _ in range(2):
        tables.append_attempts(df, path)
        stored = spark.read.parquet(path)
        assert stored.count() == stored.select("id").distinct().count() == 6


def test_each_action_is_stored_once_under_all_checkpoints(spark, tmp_path):
    path = str(tmp_path / "actions")

    def actions(*ids, day=1):
        data = [(i, datetime(2024, 1, day) if i != "null" else None, i) for i in ids]
        return spark.createDataFrame(data, "action_id string, ts timestamp, body string")

    def stored():
        return rows(spark.read.schema("action_id string, run string, batch long, body string, day date").parquet(path), "action_id", "run", "batch")

    tables.append_actions(actions("a", "b", "b"), path, "1e5", 0)
    tables.append_actions(actions("b", "c", "null", day=2), path, "1e5", 1)  # b came again a day later
    tables.append_actions(actions("b", "c", "d", "null", day=2), path, "1e5", 1)  # tried again, with more
    assert stored() == [("a", "1e5", 0), ("b", "1e5", 0), ("c", "1e5", 1), ("d", "1e5", 1), ("null", "1e5", 1)]
    before = stored()
    tables.append_actions(actions("a", "b", "c", "d", "null"), path, "other", 0)
    tables.append_actions(actions(), path, "other", 1)
    assert stored() == before
    tables.append_actions(actions("a", "z"), path, "other", 0)
    assert stored() == [*before, ("z", "other", 0)]


def test_parents_of_a_history(spark):
    at = [datetime(2024, 1, d) for d in range(1, 6)]
    data = [("a", at[1], 1, 10, "old", "User", "old/r", "dev"), ("b", at[2], 1, 10, "new", None, "new/r", None), ("c", at[0], 1, 11, None, None, None, ""),
            ("d", at[3], 2, 10, "two", "", None, None), ("e", at[4], None, 10, "x", "x", "x/x", "x"), ("f", at[4], 3, None, "x", "x", "x/x", "x"), ("d", at[3], 2, 10, "two", "", None, None)]
    df = spark.createDataFrame(data, "delivery_id string, ts timestamp, installation_id long, repo_id long, account_login string, account_type string, repo_full_name string, default_branch string")
    installs, repos = parents.installations_of(df), parents.repos_of(df)
    assert rows(installs, "id", "account_login", "account_type", "created_at") == [(1, "new", "Organization", at[0]), (2, "two", "Organization", at[3])]
    assert rows(repos, "id", "installation_id", "full_name", "default_branch", "config", "created_at") == [(10, 2, "new/r", "dev", "{}", at[1]), (11, 1, None, "main", "{}", at[0])]
    assert checks.fk_orphans(repos, installs, "installation_id").count() == 0
    assert installs.schema.names == schema("installations").names and parents.repos_of(df.limit(0)).count() == 0


def test_an_absent_column_breaks_its_rule_in_every_row(spark):
    df = spark.createDataFrame([(1, "User"), (None, "Robot")], "id long, account_type string")
    got = dict(rows(checks.check_table(df, "installations"), "rule", "violations"))
    assert got == {"id is null": 1, "account_login is null": 2, "account_type is null": 0, "created_at is null": 2, "account_type out of range": 1}
