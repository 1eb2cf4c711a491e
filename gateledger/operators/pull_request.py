"""The gate of one pull request, event after event: what the windows of ``machine`` compute at once.

Used by the stream, and in batch for pull requests whose grades name their gate. Such a grade may pass a
gate that is no longer the newest pending one, so pending gates are not a stack that only its top leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa


class Stack(list):
    """Ids of pending gates, newest on top, and of every gate whether it has passed."""

    def __init__(self) -> None:
        super().__init__()
        self.passed: dict[str, bool] = {}

    def open(self, gate: str) -> None:
        self.append(gate)
        self.passed[gate] = False

    def holds(self, gate: str) -> bool:
        return gate in self.passed

    def newest(self) -> str | None:
        """The newest pending gate; gates that passed further down leave when they come up."""
        while self and self.passed[self[-1]]:
            self.pop()
        return self[-1] if self else None

    def close(self, gate: str) -> None:
        self.passed[gate] = True


@dataclass
class PullRequest:
    """Gate state of one pull request and its transition function."""

    repo_id: int
    pr_number: int
    head: str | None = None
    hash: str | None = None
    gate: str | None = None
    passed: bool = False
    pending: Stack = field(default_factory=Stack)

    def carries(self, e) -> bool:
        """Whether a push would take the pass of the latest gate along."""
        return e.step == "pushed" and self.passed and self.hash == e.decisions_hash

    def apply(self, e) -> tuple[str, str | None]:
        """Outcome of an event and the gate it concerns."""
        if e.step == "explained":
            return self._explain(e)
        if e.step == "opened" and self.gate is not None and self.head == e.head_sha:
            return "duplicate", None
        if e.trivial:
            return "trivial", None
        if e.capped is not None:
            return "capped", None
        if self.carries(e):
            self.head = e.head_sha
            return "carried", self.gate
        name = f"{self.repo_id}:{self.pr_number}:{e.delivery_id}"
        self.gate = hashlib.sha256(name.encode()).hexdigest()[:32]
        self.head, self.hash, self.passed = e.head_sha, e.decisions_hash, False
        self.pending.open(self.gate)
        return "gated", self.gate

    def _explain(self, e) -> tuple[str, str | None]:
        bound = getattr(e, "bound", None)
        target = self.pending.newest() if bound is None else bound if self.pending.holds(bound) else None
        if target is None:
            return "ignored", None
        if not e.graded:
            return "requested", target
        if e.ungraded:
            return "ungraded", target
        if not e.passes:
            return "failed", target
        self.pending.close(target)
        if target == self.gate:
            self.passed = True
        return "passed", target


class Step(NamedTuple):
    """What the transition function reads of an event."""

    repo_id: int
    pr_number: int
    delivery_id: str
    step: str
    head_sha: str | None
    decisions_hash: str | None
    trivial: bool | None
    capped: str | None
    graded: bool
    ungraded: bool | None
    passes: bool | None
    bound: str | None


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with outcome, gate_id and carries. They come sorted by pull request and order; a task holds the
    gates of one pull request at a time, and columns that are not read pass as they are."""
    pr = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in Step._fields]
        out = []
        for e in map(Step._make, zip(*columns)):
            if pr is None or (pr.repo_id, pr.pr_number) != (e.repo_id, e.pr_number):
                pr = PullRequest(e.repo_id, e.pr_number)
            carries = pr.carries(e)
            out.append((*pr.apply(e), carries))
        outcome, gate, carried = zip(*out) if out else ((), (), ())
        more = [pa.array(outcome, pa.string()), pa.array(gate, pa.string()), pa.array(carried, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "outcome", "gate_id", "carries"])
