"""Fixed schemas of the six tables and of the event log, as Spark DDL. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

DECISIONS = "array<struct<concept:string,summary:string,question:string>>"
CLOSEOUT = (
    "struct<topics:array<struct<concept:string,verdict:string,note:string>>,"
    "strongest:string,growth_edge:string,one_line:string>"
)
SCORES = "struct<covered:array<string>,missing:array<string>>"
GRADE = "struct<pass:boolean,ungraded:boolean,covered:array<string>,missing:array<string>,hole:string,note:string>"
REPO_LIST = "array<struct<full_name:string,name:string>>"

TABLES: dict[str, str] = {
    "installations": (
        "id bigint, account_login string, account_type string, suspended_at timestamp, created_at timestamp"
    ),
    "repos": (
        "id bigint, installation_id bigint, full_name string, default_branch string, config string, "
        "config_synced_at timestamp, created_at timestamp"
    ),
    "gates": (
        "id string, repo_id bigint, pr_number int, pr_node_id string, head_sha string, check_run_id bigint, "
        f"decisions {DECISIONS}, decisions_hash string, rigor string, status string, passed_by string, "
        f"passed_by_id bigint, passed_at timestamp, closeout {CLOSEOUT}, next_recall_due timestamp, "
        "created_at timestamp, updated_at timestamp"
    ),
    "attempts": (
        "id string, checkpoint_id string, reviewer_login string, reviewer_id bigint, comment_id bigint, "
        f"explanation string, assisted boolean, grade_pass boolean, ungraded boolean, scores {SCORES}, "
        "overlap string, hole string, created_at timestamp"
    ),
    "users": "github_id bigint, github_login string, email string, first_seen timestamp, last_seen timestamp",
    "local_events": (
        "id string, github_id bigint, github_login string, email string, session_id string, subsystem string, "
        "concept string, stage string, rigor string, assisted boolean, told boolean, passed boolean, "
        "ungraded boolean, scores string, overlap string, attempts int, repo string, created_at timestamp"
    ),
}

EVENTS = (
    "delivery_id string, kind string, action string, ts timestamp, installation_id bigint, repo_id bigint, "
    "repo_full_name string, pr_number int, head_sha string, draft boolean, files array<string>, diff string, "
    f"decisions {DECISIONS}, comment_id bigint, body string, user_id bigint, user_login string, "
    "user_type string, author_association string, is_pr boolean, account_login string, account_type string, "
    f"default_branch string, pr_node_id string, repositories {REPO_LIST}, repositories_added {REPO_LIST}, "
    # a grade event names the gate it was asked for; ``capped`` is the limit an event ran into
    f"grade {GRADE}, gate_id string, capped string"
)

# Defaults of the stored tables and the sets their text columns draw from.
TABLE_DEFAULTS = {
    "installations": {},
    "repos": {"default_branch": "main", "config": "{}"},
    "gates": {"rigor": "medium", "status": "pending"},
    "attempts": {"assisted": True, "ungraded": False},
}
ENUMS = {
    "status": ["pending", "passed", "trivial", "error"],
    "rigor": ["medium", "harsh"],
    "overlap": ["low", "medium", "high", "unknown"],
    "stage": ["plan", "build"],
    "account_type": ["Organization", "User"],
}
NOT_NULL = {
    "installations": ["id", "account_login", "account_type", "created_at"],
    "repos": ["id", "installation_id", "full_name", "default_branch", "config", "created_at"],
    "gates": [
        "id", "repo_id", "pr_number", "pr_node_id", "head_sha", "decisions", "decisions_hash",
        "rigor", "status", "created_at", "updated_at",
    ],
    "attempts": [
        "id", "checkpoint_id", "reviewer_login", "reviewer_id", "explanation", "assisted",
        "grade_pass", "ungraded", "created_at",
    ],
    "users": ["github_id", "first_seen", "last_seen"],
    "local_events": ["id", "created_at"],
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(EVENTS if name == "events" else TABLES[name])
