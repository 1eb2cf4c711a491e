"""Rolling daily limits: which offered gates are admitted.

An offer is refused when the gates admitted in the trailing window (a gate exactly as old as
the window still counts) have reached the limit, over all installations first, then for its
own. Refused offers do not count, so this is a recurrence and no window over offers gives it.

But admitted gates are never more than offered ones. Where the offers of the trailing window
stay below a limit it cannot be reached, and such an offer is admitted whatever came before. Offers
are counted by installation and hour, and these counts cut the history:

* An hour is *crowded* for an installation, or *busy* for all, if the offers of the hour and of the
  window before it could reach the limit. All other offers are admitted at once.
* Crowded hours of an installation that are no more than a window apart form a chain, busy hours
  a storm. A chain within a window of a storm belongs to it, and joins all storms it touches.
* Chains by themselves and storms with their chains are independent recurrences. Each is replayed
  with the offers of the window before it, streamed in order through one task that holds
  no more than the admitted gates of one window and steps over refused stretches at once.

That task sorts no offers. Many tasks sort those of a few minutes each and pack neighbours into one row of plain
arrays; ids stay behind and meet their labels afterwards, in many tasks again.

Installations that stay under their limit never reach a replay, and a storm costs the others nothing.

In a history (:func:`history_replay`) limits and gates depend on each other: whether an event is an offer at all, and
whether it counts, follows from the gates of its pull request. There the same task also holds the last gate of each pull
request that it meets, so labels come out right at once. Every event that may be an offer is counted as one to find the
stretches; pull requests with an event there take part with all their events. What shares a pull request with a storm
or with another installation is one recurrence with it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gateledger.operators.scan import written

HOUR_US = 3_600_000_000
CELL_US = 600_000_000  # offers of one recurrence and this much time are sorted and packed together
PACK = 256  # offers in a packed row at most
LABELS = ["global", "install"]  # by label, from 1
OWN, ALL = "own", "all"
OFFERED = ["installation_id", "counts", "open"]  # packed of an offer, beside its id and time
NEVER = -(2**62)  # stands for no time and no key, before all others

# The limits the reference service starts with.
DAILY_PER_INSTALL = 20
DAILY_GLOBAL = 500


def quota_replay(
    offers: DataFrame, per_install: int = DAILY_PER_INSTALL, limit: int = DAILY_GLOBAL, hours: int = 24
) -> DataFrame:
    """Add ``capped`` to offers (id, installation_id, created_at, ...): ``global``, ``install`` or null.

    Ids are strings and unique; equal times are taken in id order. An offer with ``counts``
    false (a pass carried forward) is tested but adds no gate. An offer without an
    installation is never refused and, having no stored parent, adds no counted gate.
    """
    known = offers.filter(F.col("installation_id").isNotNull())
    if limit <= 0 or per_install <= 0:
        label = F.lit("global" if limit <= 0 else "install")
        return offers.withColumn("capped", F.when(F.col("installation_id").isNotNull(), label))
    at = F.unix_micros("created_at")
    counts = F.col("counts") if "counts" in offers.columns else F.lit(True)
    rows = known.select("id", "installation_id", at.alias("at"), F.floor(at / HOUR_US).alias("hour"), counts.alias("counts"))
    placed = rows.join(stretches(rows, per_install, limit, hours), ["installation_id", "hour"])
    labels = _labels(placed, OFFERED, lambda packs: _replay(packs, per_install, limit, hours * HOUR_US))
    return offers.join(labels, "id", "left")


def history_replay(
    tests: DataFrame, per_install: int = DAILY_PER_INSTALL, limit: int = DAILY_GLOBAL, hours: int = 24
) -> DataFrame:
    """id, capped: the events of a history that a limit refuses, where the gates follow from the limits too.

    ``tests`` holds all substantive pull-request events: id, repo_id, pr_number, installation_id, created_at, opened
    (or a push), head_sha, decisions_hash, told (passing explanations of the pull request before the event). One that
    is a duplicate of its gate's head may get a label as well; it means nothing there.
    Heads and decisions of one pull request are compared by 64-bit hashes.
    """
    if limit <= 0 or per_install <= 0:
        label = F.lit("global" if limit <= 0 else "install").alias("capped")
        return tests.filter(F.col("installation_id").isNotNull()).select("id", label)
    pr, at = ["repo_id", "pr_number"], F.unix_micros("created_at")
    rows = tests.select(
        "id", *(F.coalesce(F.col(c).cast("bigint"), F.lit(NEVER)).alias(c) for c in pr), "opened", "told",
        F.when(at.isNotNull(), F.col("installation_id")).alias("installation_id"), F.floor(at / HOUR_US).alias("hour"),
        F.coalesce(at, F.lit(NEVER)).alias("at"),
        F.when(F.col("head_sha").isNotNull(), F.xxhash64("head_sha")).alias("head"), F.xxhash64("decisions_hash").alias("hash"),
    )
    known = rows.filter(F.col("installation_id").isNotNull()).select("installation_id", "hour", F.lit(True).alias("counts"))
    found = stretches(known, per_install, limit, hours).groupBy("installation_id", "hour")
    placed = rows.join(written(found.agg((~F.min("alone")).alias("storm"))), ["installation_id", "hour"], "left")

    each = placed.groupBy(*pr).agg(F.collect_set("installation_id").alias("installs"), F.max("storm").alias("storm"))
    prs = written(each.filter("storm IS NOT NULL").select(*pr, "installs", (F.col("storm") | (F.size("installs") > 1)).alias("shared")))
    joint = prs.filter("shared").select(F.explode("installs").alias("install")).distinct().withColumn("joint", F.lit(True))
    named = prs.withColumn("install", F.element_at("installs", 1)).join(joint, "install", "left")
    stretch = F.when(F.col("joint"), ALL).otherwise(F.concat_ws(":", F.lit(OWN), "install"))
    return _labels(
        rows.join(named.select(*pr, stretch.alias("stretch")), pr),
        ["installation_id", *pr, "opened", "head", "hash", "told"],
        lambda packs: _replay_history(packs, per_install, limit, hours * HOUR_US),
    )


Replay = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _labels(rows: DataFrame, columns: Sequence[str], replay: Replay) -> DataFrame:
    """id, capped of the rows that ``replay`` refuses, stretch by stretch; ``rows``: stretch, at, id and ``columns``."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    packed = "stretch string, first bigint, first_id string, ids array<string>, " + ", ".join(f"{c} array<{kinds[c]}>" for c in ["at", *columns])
    dealt = rows.repartition("stretch", F.floor(F.col("at") / CELL_US)).sortWithinPartitions("stretch", "at", "id")
    packs = written(dealt.select("stretch", "id", "at", *columns).mapInArrow(lambda batches: _packed(batches, columns), packed))
    ordered = packs.drop("ids").repartition("stretch").sortWithinPartitions("stretch", "first", "first_id")
    replayed = ordered.mapInArrow(replay, "stretch string, first_id string, labels array<tinyint>")
    both = replayed.join(packs.select("stretch", "first_id", "ids"), ["stretch", "first_id"])
    each = both.select(F.inline(F.arrays_zip("ids", "labels"))).filter("labels > 0")
    return each.select(F.col("ids").alias("id"), F.element_at(F.array(*map(F.lit, LABELS)), F.col("labels").cast("int")).alias("capped"))


def stretches(rows: DataFrame, per_install: int, limit: int, hours: int) -> DataFrame:
    """installation_id, hour, stretch, alone, open: the recurrences that the offers of an hour take part in.

    ``open`` marks hours whose offers the recurrence decides, the others only lead up to it. ``alone``
    marks the chain of a single installation. ``rows``: installation_id, hour, counts. What reaches the
    driver is one row an hour of history, under nine thousand a year, whatever the number of offers.
    """
    spark = rows.sparkSession
    n, tested = F.sum(F.col("counts").cast("int")).alias("n"), F.max((~F.col("counts")).cast("int")).alias("tested")
    trailing = Window.partitionBy("installation_id").orderBy("hour").rangeBetween(-hours, 0)
    own = rows.groupBy("installation_id", "hour").agg(n, tested)
    own = written(own.withColumn("crowded", F.sum("n").over(trailing) + F.col("tested") > per_install))

    storms = busy_runs(own.groupBy("hour").agg(F.sum("n"), F.max("tested")).collect(), limit, hours)
    near = [(k, hour) for k, (first, last) in enumerate(storms) for hour in range(first - hours, last + hours + 1)]
    near = spark.createDataFrame(near, "storm int, hour bigint")

    key = ["installation_id", "chain"]
    w = Window.partitionBy("installation_id").orderBy("hour")
    begins = F.coalesce(F.col("hour") - F.lag("hour").over(w) > hours, F.lit(True)).cast("int")
    crowded = own.filter("crowded").withColumn("begins", begins)
    crowded = crowded.withColumn("chain", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chains = crowded.join(near, "hour", "left").groupBy(*key).agg(
        F.min("hour").alias("first"), F.max("hour").alias("last"), F.min("storm").alias("storm"), F.max("storm").alias("until")
    )
    chains = written(chains) if storms else chains
    reach = dict(chains.filter("storm IS NOT NULL").groupBy("storm").agg(F.max("until")).collect()) if storms else {}

    # a chain joins all storms from the first to the last that it touches
    named, until = [], -1
    for k in range(len(storms)):
        named.append((k, named[-1][1] if k <= until else f"all:{k}"))
        until = max(until, reach.get(k, k))
    felt = {(name, hour) for (k, name), (first, last) in zip(named, storms) for hour in range(first - hours, last + 1)}
    felt = spark.createDataFrame(sorted(felt), "stretch string, hour bigint")
    busy = spark.createDataFrame([(hour,) for first, last in storms for hour in range(first, last + 1)], "hour bigint")

    alone = F.concat_ws(":", F.lit(OWN), "installation_id", "chain")
    joined = chains.join(spark.createDataFrame(named, "storm int, stretch string"), "storm", "left")
    some = joined.select(
        "installation_id", F.coalesce("stretch", alone).alias("stretch"),
        F.explode(F.sequence(F.col("first") - hours, F.col("last"))).alias("hour"),
    )
    everyone = own.join(felt, "hour").select("installation_id", "stretch", "hour")
    flags = own.join(busy.withColumn("busy", F.lit(True)), "hour", "left").select(
        "installation_id", "hour", (F.col("crowded") | F.coalesce("busy", F.lit(False))).alias("open")
    )
    is_alone = F.col("stretch").startswith(OWN).alias("alone")
    return everyone.union(some).distinct().join(flags, ["installation_id", "hour"]).select("*", is_alone)


def busy_runs(by_hour: list[tuple[int, int, int]], limit: int, hours: int) -> list[tuple[int, int]]:
    """First and last hour of each run of busy hours that are at most ``hours`` apart.

    ``by_hour``: hour, offers that count, 1 if there are others too. An hour between two busy ones of
    a run counts as one of them.
    """
    offered = {hour: n for hour, n, _ in by_hour}
    runs: list[tuple[int, int]] = []
    for hour, _, tested in sorted(map(tuple, by_hour)):
        if sum(offered.get(h, 0) for h in range(hour - hours, hour + 1)) + tested > limit:
            if runs and hour - runs[-1][1] <= hours:
                runs[-1] = (runs[-1][0], hour)
            else:
                runs.append((hour, hour))
    return runs


class Meter:
    """Gates still inside the window, over all and per installation."""

    def __init__(self, span: int, admitted: Iterable[tuple[int, int]] = ()):
        self.span = span
        self.window: deque[tuple[int, int]] = deque(admitted)
        self.per_install = Counter(i for _, i in self.window)

    def advance(self, now: int) -> None:
        while self.window and self.window[0][0] < now - self.span:
            gone = self.window.popleft()[1]
            self.per_install[gone] -= 1
            if not self.per_install[gone]:
                del self.per_install[gone]

    def refuse(self, install: int, per_install: int, limit: int) -> str | None:
        if len(self.window) >= limit:
            return "global"
        return "install" if self.per_install[install] >= per_install else None

    def admit(self, now: int, install: int) -> None:
        self.window.append((now, install))
        self.per_install[install] += 1

    def full_until(self) -> int:
        """The last instant at which the oldest gate still counts."""
        return self.window[0][0] + self.span


def _packed(batches: Iterator[pa.RecordBatch], columns: Sequence[str] = OFFERED) -> Iterator[pa.RecordBatch]:
    """Neighbours of one stretch and cell as one row; rows come sorted by stretch, time and id."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column
        names = column("stretch").dictionary_encode().indices.to_numpy()
        cells = column("at").to_numpy() // CELL_US
        breaks = np.flatnonzero((np.diff(names) != 0) | (np.diff(cells) != 0)) + 1
        firsts = np.union1d(np.arange(0, batch.num_rows, PACK), breaks)
        offsets = pa.array(np.append(firsts, batch.num_rows), pa.int32())
        heads = [column(c).take(pa.array(firsts)) for c in ("stretch", "at", "id")]
        lists = [pa.ListArray.from_arrays(offsets, column(c)) for c in ("id", "at", *columns)]
        yield pa.RecordBatch.from_arrays([*heads, *lists], names=["stretch", "first", "first_id", "ids", "at", *columns])


def _plain(batch: pa.RecordBatch, name: str, fill) -> np.ndarray:
    """The values of a packed column, ``fill`` for nulls."""
    return pc.fill_null(batch.column(name).flatten(), fill).to_numpy(zero_copy_only=False)


def _labelled(batch: pa.RecordBatch, ends: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(labels))
    return pa.RecordBatch.from_arrays([batch.column("stretch"), batch.column("first_id"), lists], names=["stretch", "first_id", "labels"])


def _replay(batches: Iterator[pa.RecordBatch], per_install: int, limit: int, span: int) -> Iterator[pa.RecordBatch]:
    """Labels of the open offers of each stretch, 0 for none; packed rows come sorted by stretch, time and id."""
    meter, current = Meter(span), None
    for batch in batches:
        names = batch.column("stretch").to_pylist()
        at, installs = _plain(batch, "at", 0), _plain(batch, "installation_id", 0)
        counts, opened = _plain(batch, "counts", False), _plain(batch, "open", False)
        ends = np.cumsum(pc.list_value_length(batch.column("at")).to_numpy())
        labels = np.zeros(len(at), dtype=np.int8)
        i = k = 0
        while k < len(names):
            if names[k] != current:
                meter, current = Meter(span), names[k]
            label, most = (2, per_install) if current.startswith(OWN) else (1, limit)
            k = bisect_right(names, current, k)
            end = int(ends[k - 1])
            while i < end:
                now = int(at[i])
                meter.advance(now)
                if len(meter.window) >= most:
                    upto = i + int(np.searchsorted(at[i:end], meter.full_until(), side="right"))
                    labels[i:upto] = label
                    i = upto
                    continue
                install = int(installs[i])
                refused = meter.refuse(install, per_install, limit)
                if refused is not None:
                    labels[i] = LABELS.index(refused) + 1
                elif counts[i]:
                    meter.admit(now, install)
                i += 1
        labels[~opened] = 0
        yield _labelled(batch, ends, labels)


def _replay_history(batches: Iterator[pa.RecordBatch], per_install: int, limit: int, span: int) -> Iterator[pa.RecordBatch]:
    """Labels of the events of each stretch, 0 for none; packed rows come sorted by stretch, time and id.

    Held are the gates of one window and, of each pull request with a gate so far, head, decisions and passes told
    when its last gate opened. Events without an installation are never refused and may change those, so
    a refused run ends before the next one.
    """
    meter, current, gates = Meter(span), None, {}
    for batch in batches:
        names = batch.column("stretch").to_pylist()
        at, installs = _plain(batch, "at", 0), _plain(batch, "installation_id", 0)
        repos, numbers, opens = _plain(batch, "repo_id", 0), _plain(batch, "pr_number", 0), _plain(batch, "opened", False)
        heads, hashes, told = _plain(batch, "head", 0), _plain(batch, "hash", 0), _plain(batch, "told", 0)
        known = pc.is_valid(batch.column("installation_id").flatten()).to_numpy(zero_copy_only=False)
        free = np.append(np.flatnonzero(~known), len(at))
        ends = np.cumsum(pc.list_value_length(batch.column("at")).to_numpy())
        labels = np.zeros(len(at), dtype=np.int8)
        i = k = 0
        while k < len(names):
            if names[k] != current:
                meter, current, gates = Meter(span), names[k], {}
            label, most = (2, per_install) if current.startswith(OWN) else (1, limit)
            k = bisect_right(names, current, k)
            end = int(ends[k - 1])
            while i < end:
                now = int(at[i])
                meter.advance(now)
                if known[i] and len(meter.window) >= most:
                    upto = i + int(np.searchsorted(at[i:end], meter.full_until(), side="right"))
                    upto = min(upto, int(free[np.searchsorted(free, i)]))
                    labels[i:upto] = label
                    i = upto
                    continue
                pr, head = (int(repos[i]), int(numbers[i])), int(heads[i])
                before = gates.get(pr)
                if opens[i] and before is not None and head and head == before[0]:
                    i += 1
                    continue
                install = int(installs[i])
                refused = meter.refuse(install, per_install, limit) if known[i] else None
                if refused is not None:
                    labels[i] = LABELS.index(refused) + 1
                elif not opens[i] and before is not None and before[1] == hashes[i] and told[i] > before[2]:
                    gates[pr] = (head or before[0], *before[1:])
                else:
                    gates[pr] = (head or (before[0] if before else 0), int(hashes[i]), int(told[i]))
                    if known[i]:
                        meter.admit(now, install)
                i += 1
        yield _labelled(batch, ends, labels)
