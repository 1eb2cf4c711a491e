"""Random event logs and a plain sequential replay to compare with."""

import random
from collections import namedtuple
from datetime import datetime, timedelta, timezone

from gateledger.operators.quota import Meter
from gateledger.schemas import EVENTS
from gateledger.operators.pull_request import PullRequest

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
Step = namedtuple("Step", "delivery_id ts installation repo pr step head_sha decisions_hash trivial capped graded ungraded passes bound", defaults=[None])
GOOD = "This holds because the bucket refills lazily on each read."


def events(n, seed, prs=6, hours=200):
    """Raw events as dicts; several share an instant."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        pr = r.randrange(prs) if r.random() < 0.6 else 0
        at = START + timedelta(minutes=30 * r.randrange(hours * 2))
        e = dict(delivery_id=f"d{i:05d}", ts=at, installation_id=pr % 2, repo_id=pr // 2, pr_number=pr % 2, user_id=r.randrange(5), user_login="u")
        kind = r.choice(["open", "push", "push", "talk", "talk", "talk"])
        if kind == "talk":
            grade = None if r.random() < 0.1 else (r.random() < 0.5, r.random() < 0.1, [], [], "hole", "note")
            e |= dict(kind="comment", action="created", is_pr=True, user_type=r.choice(["User", None, "User", "Bot"]),
                      author_association=r.choice(["MEMBER", "OWNER", "NONE"]), body=r.choice([GOOD, GOOD + "!", "lgtm"]),
                      comment_id=i, grade=grade)
        else:
            topic = r.choice(["x", "x", "y"])
            e |= dict(kind="pull_request", action=r.choice(["opened", "ready_for_review"]) if kind == "open" else "synchronize",
                      draft=r.choice([None, False, False, True]), head_sha=f"h{r.randrange(4)}" if kind == "open" else f"p{i}",
                      files=r.choice([["a.py"], ["a.py"], ["a.py"], ["a.md"]]), diff="+x\n" * 20,
                      decisions=r.choice([[(topic, "s", None)], [(topic, "s", None)], []]))
        out.append(e)
    return out


def frame(spark, rows):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(EVENTS)
    return spark.createDataFrame([tuple(e.get(f.name) for f in schema) for e in rows], schema)


def steps(rows):
    """The relevant events in order, judged independently of Spark."""
    out = []
    for e in sorted(rows, key=lambda e: (e["ts"], e["delivery_id"])):
        if e["kind"] == "grade":
            g = e["grade"]
            out.append(Step(e["delivery_id"], e["ts"], e["installation_id"], e["repo_id"], e["pr_number"], "explained", None, None, False, None,
                            True, bool(g[1]), bool(g[0]), e["gate_id"]))
        elif e["kind"] == "comment":
            ok = e["user_type"] != "Bot" and e["author_association"] in ("MEMBER", "OWNER", "COLLABORATOR") and len(e["body"].strip()) >= 40
            if not ok:
                continue
            g = e["grade"]
            out.append(Step(e["delivery_id"], e["ts"], e["installation_id"], e["repo_id"], e["pr_number"], "explained", None, None, False, None,
                            g is not None, bool(g and g[1]), bool(g and g[0])))
        elif not e["draft"]:
            out.append(Step(e["delivery_id"], e["ts"], e["installation_id"], e["repo_id"], e["pr_number"],
                            "pushed" if e["action"] == "synchronize" else "opened", e["head_sha"], repr(e["decisions"]), e["files"] == ["a.md"], None,
                            False, False, False))
    return out


def replay(rows, per_install=None, limit=None, hours=24):
    """{delivery: (outcome, gate, capped)} one event after another."""
    prs, out = {}, {}
    meter = Meter(hours * 3_600_000_000)
    for s in steps(rows):
        pr = prs.setdefault((s.repo, s.pr), PullRequest(s.repo, s.pr))
        capped = None
        if limit is not None and s.step != "explained":
            duplicate = s.step == "opened" and pr.gate is not None and pr.head == s.head_sha
            if not duplicate and not s.trivial:
                at = int(s.ts.timestamp() * 1_000_000)
                meter.advance(at)
                capped = meter.refuse(s.installation, per_install, limit)
        outcome, gate = pr.apply(s._replace(capped=capped))
        if limit is not None and outcome == "gated":
            meter.admit(at, s.installation)
        out[s.delivery_id] = (outcome, gate, capped)
    return out


def with_late_grades(rows, seed, most_hours=60):
    """The same log with every grade taken off its comment and told later, in any order, to the gate it was asked for."""
    r = random.Random(seed)
    bare = [e | {"grade": None} for e in rows]
    asked = {d: gate for d, (outcome, gate, _) in replay(bare).items() if outcome == "requested"}
    late = [
        e | dict(kind="grade", action="graded", delivery_id=f"grade:{e['delivery_id']}", gate_id=asked[e["delivery_id"]],
                 ts=e["ts"] + timedelta(minutes=r.randrange(1, 60 * most_hours)), grade=e["grade"])
        for e in rows if e.get("grade") and e["delivery_id"] in asked
    ]
    odd = [e | {"delivery_id": f"{e['delivery_id']}:again", "gate_id": r.choice([e["gate_id"], "none such"])} for e in r.sample(late, len(late) // 6)]
    return bare + late + odd
