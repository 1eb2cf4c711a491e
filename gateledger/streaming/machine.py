"""The gate machine as a stateful stream: a small state per pull request.

State holds the latest gate, the ids of the pending ones and of every gate whether it has passed, never texts.
A call of the state store waits for an answer and takes far longer than a transition, so pull requests share the
state value of their bucket, and only the rest of large ones lies in state maps. Each micro-batch of a
pull request is applied in (ts, delivery_id) order; an event older than the last applied one is
reported as ``late`` and changes nothing. Bound the micro-batch with the source's
``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger``.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from gateledger.operators.machine import relevant_events
from gateledger.operators.pull_request import PullRequest, Step
from gateledger.operators.windows import PR

BUCKETS = 1 << 13  # of pull requests, each with one state value; fixed for a checkpoint
STATE = "prs string"  # the pull requests of a bucket by name, in JSON
REMEMBER_HOURS = 24  # of event time before the last applied event, for which a redelivery is known
PRUNE = 256  # remembered ids from which old ones are looked for
HELD = 1024  # remembered ids of a pull request that the state value holds; more of them all lie in a state map
OUTPUT = "repo_id bigint, pr_number int, delivery_id string, at bigint, outcome string, gate_id string, payload string"
OUT = Row("repo_id", "pr_number", "delivery_id", "at", "outcome", "gate_id", "payload")
Event = namedtuple("Event", [*Step._fields, "at", "payload"])
# Nested and wide columns cross the Python worker as one JSON string.
PAYLOAD = [
    "installation_id", "step", "head_sha", "decisions", "decisions_hash", "trivial", "reason",
    "capped", "comment_id", "user_id", "user_login", "body", "grade",
]


class StoredStack:
    """A :class:`Stack` with only the top held in the state value; full chunks below it lie in a state map.
    So do the newest gates and whether they have passed; older gates lie in another map.

    Every call of a state map waits for the state store, so that a pull request of few gates costs one
    read and one write per micro-batch. Its value stays small however many gates it leaves pending.
    """

    CHUNK = 64

    def __init__(self, chunks, passed, count: int, top: list[str], recent: dict[str, bool] | None = None):
        self.chunks, self.passed, self.count, self.ids = chunks, passed, count, top
        self.recent = {} if recent is None else recent

    def open(self, gate: str) -> None:
        self.recent[gate] = False
        if len(self.recent) > 2 * self.CHUNK:
            for old in list(self.recent)[: self.CHUNK]:
                self.passed.updateValue((old,), (self.recent.pop(old),))
        self.ids.append(gate)
        if len(self.ids) > 2 * self.CHUNK:
            self.chunks.updateValue((self.count,), (self.ids[: self.CHUNK],))
            self.ids, self.count = self.ids[self.CHUNK :], self.count + 1

    def holds(self, gate: str) -> bool:
        return gate in self.recent or self.passed.containsKey((gate,))

    def has_passed(self, gate: str) -> bool:
        return self.recent[gate] if gate in self.recent else self.passed.getValue((gate,))[0]

    def newest(self) -> str | None:
        while self.ids and self.has_passed(self.ids[-1]):
            self.ids.pop()
            if not self.ids and self.count:
                self.count -= 1
                self.ids = list(self.chunks.getValue((self.count,))[0])
                self.chunks.removeKey((self.count,))
        return self.ids[-1] if self.ids else None

    def close(self, gate: str) -> None:
        if gate in self.recent:
            self.recent[gate] = True
        else:
            self.passed.updateValue((gate,), (True,))


class Deliveries:
    """Ids of deliveries and their times. Few are held in the state value, many lie in a state map."""

    def __init__(self, stored, moved: int, held: dict[str, int]):
        self.stored, self.moved, self.held = stored, moved, held

    def add(self, delivery: str, at: int) -> bool:
        """Whether the delivery is a new one."""
        if delivery in self.held or (self.moved and self.stored.containsKey((delivery,))):
            return False
        self.held[delivery] = at
        return True

    def prune(self, before: int) -> None:
        """Forget what is older, once there are many, and move what is too much for the value."""
        if len(self.held) + self.moved <= PRUNE:
            return
        self.held = {k: at for k, at in self.held.items() if at >= before}
        if self.moved:
            old = [k for k, (at,) in self.stored.iterator() if at < before]
            for k in old:
                self.stored.removeKey(k)
            self.moved -= len(old)
        if len(self.held) > HELD:
            for k, at in self.held.items():
                self.stored.updateValue((k,), (at,))
            self.moved, self.held = self.moved + len(self.held), {}


class Part:
    """The entries of one pull request in a state map of its bucket."""

    def __init__(self, whole, name: str):
        self.whole, self.name = whole, name

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.whole.updateValue((self.name, *key), value)

    def getValue(self, key: tuple) -> tuple:
        return self.whole.getValue((self.name, *key))

    def containsKey(self, key: tuple) -> bool:
        return self.whole.containsKey((self.name, *key))

    def removeKey(self, key: tuple) -> None:
        self.whole.removeKey((self.name, *key))

    def iterator(self) -> Iterator[tuple]:
        return ((tuple(k)[1:], v) for k, v in self.whole.iterator() if k[0] == self.name)


def name_of(e: Event) -> str:
    return f"{e.repo_id}:{e.pr_number}"


class GateProcessor(StatefulProcessor):
    """Keeps the ``PullRequest`` of every one in a bucket in the state store, and the ids of its deliveries for a while."""

    def __init__(self, remember_us: int):
        self.remember_us = remember_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", STATE)
        self.chunks = handle.getMapState("pending", "pr string, n int", "gates array<string>")
        self.gates = handle.getMapState("gates", "pr string, gate string", "passed boolean")
        self.seen = handle.getMapState("seen", "pr string, delivery string", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.latest.get()
        prs = json.loads(stored[0]) if stored else {}
        first = next(rows)
        read = itemgetter(*map(first.__fields__.index, Event._fields))
        events = [Event._make(read(first)), *(Event._make(read(r)) for r in rows)]
        events.sort(key=lambda e: (name_of(e), e.at, e.delivery_id))
        for name, mine in groupby(events, key=name_of):
            yield from self.moved(prs, name, list(mine))
        self.latest.update((json.dumps(prs, separators=(",", ":")),))

    def moved(self, prs: dict, name: str, events: list[Event]) -> Iterator[Row]:
        """Transitions of a pull request for its events in their order; its new state is put into ``prs``."""
        pr, done = PullRequest(events[0].repo_id, events[0].pr_number), (-(2**62), "")
        count, top, recent, held, moved = 0, [], {}, {}, 0
        if name in prs:
            pr.head, pr.hash, pr.gate, pr.passed, at, delivery, count, top, recent, held, moved = prs[name]
            done = (at, delivery)
        pr.pending = StoredStack(Part(self.chunks, name), Part(self.gates, name), count, top, recent)
        seen = Deliveries(Part(self.seen, name), moved, held)
        for e in events:
            if not seen.add(e.delivery_id, e.at):
                continue  # delivered again
            place, result = (e.at, e.delivery_id), ("late", None)
            if place > done:
                done, result = place, pr.apply(e)
            yield OUT(pr.repo_id, pr.pr_number, e.delivery_id, e.at, *result, e.payload)
        seen.prune(done[0] - self.remember_us)
        stack = pr.pending
        prs[name] = [pr.head, pr.hash, pr.gate, pr.passed, *done, stack.count, stack.ids, stack.recent, seen.held, seen.moved]

    def close(self) -> None:
        pass


def live_gate_machine(events: DataFrame, remember_hours: int = REMEMBER_HOURS, buckets: int = BUCKETS) -> DataFrame:
    """``gate_machine`` over a stream of events; the same outcomes, plus ``late``.

    A delivery that comes again within ``remember_hours`` of event time changes nothing and comes out
    once. Nothing is dropped for its age: each relevant delivery has one transition.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = relevant_events(events)
    payload_type = StructType([rows.schema[c] for c in PAYLOAD])
    flat = rows.select(
        *PR,
        "delivery_id",
        F.unix_micros("ts").alias("at"),
        "step",
        "head_sha",
        "decisions_hash",
        F.coalesce("trivial", F.lit(False)).alias("trivial"),
        "capped",
        "bound",
        F.col("grade").isNotNull().alias("graded"),
        F.coalesce("grade.ungraded", F.lit(False)).alias("ungraded"),
        F.coalesce("grade.pass", F.lit(False)).alias("passes"),
        F.to_json(F.struct(*PAYLOAD)).alias("payload"),
        F.pmod(F.xxhash64(*PR), F.lit(buckets)).alias("bucket"),
    )
    moved = flat.groupBy("bucket").transformWithState(
        statefulProcessor=GateProcessor(remember_hours * 3_600_000_000),
        outputStructType=StructType.fromDDL(OUTPUT),
        outputMode="append",
        timeMode="none",
    )
    return moved.withColumn("p", F.from_json("payload", payload_type)).select(
        "delivery_id", F.timestamp_micros("at").alias("ts"), *PR, "outcome", "gate_id", "p.*"
    )
