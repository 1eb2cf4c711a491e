from datetime import timedelta

from history import events, frame, replay, with_late_grades
from pyspark.sql import functions as F

from gateledger.operators import machine, outbox
from gateledger.sources.events import read_events
from gateledger.streaming import jobs
from gateledger.operators.pull_request import Stack
from gateledger.streaming.machine import StoredStack


def write_batches(spark, rows, folder, size):
    """One file per batch, in event order, named so that the stream reads them in order."""
    rows = sorted(rows, key=lambda e: (e["ts"], e["delivery_id"]))
    for n, i in enumerate(range(0, len(rows), size)):
        frame(spark, rows[i : i + size]).coalesce(1).write.mode("append").parquet(folder)
    return n + 1


def test_stream_equals_batch_over_many_micro_batches(spark, tmp_path):
    rows = events(300, 21)
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    write_batches(spark, rows, source, 60)
    query = jobs.streaming_pipeline(spark, source, out, str(tmp_path / "cp"), once=True, maxFilesPerTrigger=2)
    query.awaitTermination()
    moves = spark.read.parquet(f"{out}/transitions")
    got = {r.delivery_id: (r.outcome, r.gate_id, None) for r in moves.collect()}
    assert got == replay(rows)

    # Redeliveries in a later run are dropped and nothing is emitted twice.
    before = spark.read.parquet(f"{out}/actions").count()
    again = [e | {"ts": e["ts"] + timedelta(minutes=1)} for e in rows[:40]]
    frame(spark, again).coalesce(1).write.mode("append").parquet(source)
    jobs.streaming_pipeline(spark, source, out, str(tmp_path / "cp"), once=True, maxFilesPerTrigger=2).awaitTermination()
    actions = spark.read.parquet(f"{out}/actions")
    assert actions.count() == before == actions.select("action_id").distinct().count()
    whole = outbox.action_outbox(machine.gate_machine(jobs.dedupe_deliveries(read_events(spark, source))))
    columns = ["action_id", "kind", "outcome", "body", "summary"]
    assert sorted(map(tuple, actions.select(columns).collect()), key=repr) == sorted(map(tuple, whole.select(columns).collect()), key=repr)


def test_batch_dedupe_keeps_the_earliest_copy(spark):
    rows = events(30, 2)
    copies = rows + [e | {"ts": e["ts"] + timedelta(minutes=5)} for e in rows] * 3
    got = jobs.dedupe_deliveries(frame(spark, copies))
    assert got.count() == 30
    first = {e["delivery_id"]: e["ts"].replace(tzinfo=None) for e in rows}
    assert {r.delivery_id: r.ts for r in got.collect()} == first


class Chunks(dict):
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__
    getValue = dict.__getitem__
    containsKey = dict.__contains__


def test_stored_stack_behaves_like_the_one_in_memory():
    import random

    r = random.Random(0)
    stored, plain, gates = StoredStack(Chunks(), Chunks(), 0, []), Stack(), []
    for i in range(5000):
        newest = plain.newest()
        assert stored.newest() == newest
        if gates and r.random() < (0.3 if i < 2500 else 0.7):
            gate = newest if newest and r.random() < 0.6 else r.choice(gates)  # the top, or any other, passed or not
            stored.close(gate), plain.close(gate)
        else:
            gates.append(str(i))
            stored.open(gates[-1]), plain.open(gates[-1])
        assert stored.holds(gates[-1]) and not stored.holds("none")
        assert len(stored.ids) <= 2 * StoredStack.CHUNK


def test_streamed_window_counts_equal_the_batch(spark, tmp_path):
    source, out = str(tmp_path / "gates"), str(tmp_path / "counts")
    gates = spark.range(400).select(
        (F.col("id") % 3).alias("installation_id"), F.timestamp_seconds(F.col("id") * 900 + 1_700_000_000).alias("created_at")
    )
    gates.coalesce(1).write.parquet(source)
    stream = jobs.streaming_gate_counts(spark.readStream.schema(gates.schema).parquet(source))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    want = {tuple(r) for r in jobs.streaming_gate_counts(gates).collect()}
    assert got <= want and len(got) > 200  # windows still open at the watermark are not out yet


def test_late_events_change_nothing(spark, tmp_path):
    rows = sorted(events(60, 8, prs=1), key=lambda e: (e["ts"], e["delivery_id"]))
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    for part in (rows[30:], rows[:30]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        jobs.streaming_pipeline(spark, source, out, str(tmp_path / "cp"), once=True).awaitTermination()
    got = {r.delivery_id: r.outcome for r in spark.read.parquet(f"{out}/transitions").collect()}
    want = {d: o for d, (o, *_) in replay(rows[30:]).items()}
    early = set(replay(rows[:30]))
    assert got == want | dict.fromkeys(early - {e["delivery_id"] for e in rows[30:]}, "late")


def test_late_grades_count_for_their_gate_in_stream_and_batch(spark, tmp_path):
    rows = with_late_grades(events(260, 33), 5)
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    write_batches(spark, rows, source, 50)
    jobs.streaming_pipeline(spark, source, out, str(tmp_path / "cp"), once=True, maxFilesPerTrigger=2).awaitTermination()
    want = replay(rows)
    assert {r.delivery_id: (r.outcome, r.gate_id, None) for r in spark.read.parquet(f"{out}/transitions").collect()} == want
    batch = machine.gate_machine(read_events(spark, source)).select("delivery_id", "outcome", "gate_id", "capped").collect()
    assert {r.delivery_id: tuple(r)[1:] for r in batch} == want


def test_out_of_order_backfill_reconciles_to_the_batch_result(spark, tmp_path):
    rows = sorted(events(160, 12), key=lambda e: (e["ts"], e["delivery_id"]))
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    parts = [rows[i : i + 40] for i in range(0, 160, 40)]
    for part in (parts[1], parts[0] + parts[1][:9], parts[3], parts[2]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
    jobs.streaming_pipeline(spark, source, out, str(tmp_path / "cp"), once=True, maxFilesPerTrigger=1).awaitTermination()
    moves = spark.read.parquet(f"{out}/transitions")
    want = replay(rows)
    assert sorted(r.delivery_id for r in moves.collect()) == sorted(want)
    assert moves.filter("outcome = 'late'").count() > 10
    log = jobs.dedupe_deliveries(read_events(spark, source))
    got = jobs.reconciled(moves, log).select("delivery_id", "outcome", "gate_id", "capped").collect()
    assert {r.delivery_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


class Counting(Chunks):
    calls = 0

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def iterator(self):
        return iter(self.items())


class Value:
    stored = None

    def get(self):
        return self.stored

    def update(self, value):
        self.stored = value


def test_few_calls_of_the_state_store_and_the_same_outcomes():
    """Pull requests of usual size read and write one value together; a large one spills, with the same outcomes."""
    from pyspark.sql import Row

    from gateledger.operators.pull_request import PullRequest
    from gateledger.streaming.machine import Event, GateProcessor

    def event(pr, i):
        step = ("opened", "pushed", "explained")[i % 3]
        return Row(**Event(1, pr, f"{i:06}", step, f"c{i}", f"d{i % 5}", False, None, True, False, i % 7 == 0, None, i * 1000, "")._asdict())

    for n, spills in ((60, False), (9000, True)):
        processor, plain = GateProcessor(24 * 3_600_000_000), {1: PullRequest(1, 1), 2: PullRequest(1, 2)}
        processor.latest, processor.chunks, processor.gates, processor.seen = Value(), Counting(), Counting(), Counting()
        rows = [event(pr, i) for i in range(n) for pr in (2, 1)]
        got = []
        for at in range(0, 2 * n, n // 3):
            part = rows[at : at + n // 3]
            got += list(processor.handleInputRows((7,), iter(part + rows[max(0, at - 5) : at + 3]), None))  # some come again
        want = [(e.pr_number, e.delivery_id, *plain[e.pr_number].apply(e)) for e in rows]
        assert sorted((r.pr_number, r.delivery_id, r.outcome, r.gate_id) for r in got) == sorted(want)
        calls = [m.calls for m in (processor.chunks, processor.gates, processor.seen)]
        assert (sum(calls) > 0) == spills
        assert len(processor.seen) == (2 * n if spills else 0)
