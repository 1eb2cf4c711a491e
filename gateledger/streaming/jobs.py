"""Stream jobs: redelivery removal, live quota counters, and events to actions end to end."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gateledger.operators.machine import gate_machine
from gateledger.operators.outbox import action_outbox
from gateledger.operators.scan import cut, join_null_safe, pick_per_key
from gateledger.operators.windows import PR
from gateledger.sources.events import read_events
from gateledger.sources.tables import append_actions
from gateledger.streaming.machine import REMEMBER_HOURS, live_gate_machine

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedupe_deliveries(events: DataFrame, within: str = "1 day") -> DataFrame:
    """Keep one copy of each delivery: within the watermark on a stream, the earliest in a batch."""
    if events.isStreaming:
        return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["delivery_id"])
    return pick_per_key(events, ["delivery_id"], [F.col("ts")])


def reconciled(transitions: DataFrame, events: DataFrame) -> DataFrame:
    """Transitions of a stream in which pull requests that had late events are replayed from the log, in batch.

    ``events`` is the whole log without redeliveries. Only pull requests with a late event are read again.
    """
    behind = cut(transitions.filter("outcome = 'late'").select(*PR).distinct())
    again = gate_machine(join_null_safe(events, behind, PR, "left_semi"))
    same = [c for c in transitions.columns if c in again.columns]
    kept = join_null_safe(transitions, behind, PR, "left_anti")
    return kept.select(same).unionByName(again.select(same))


def streaming_gate_counts(
    gates: DataFrame, window: str = "24 hours", slide: str = "1 hour", late: str = "1 hour"
) -> DataFrame:
    """Gates per installation in sliding windows, for a stream or a batch.

    Gates are counted per slide first and only the counts are spread over the windows, so a row
    is not copied once per window.
    """
    rows = gates.withWatermark("created_at", late) if gates.isStreaming else gates
    by_slide = rows.groupBy(F.window("created_at", slide), "installation_id").agg(F.count("*").alias("n"))
    spread = by_slide.groupBy(F.window(F.window_time("window"), window, slide), "installation_id")
    return spread.agg(F.sum("n").alias("gates")).select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "installation_id",
        "gates",
    )


def write_transitions(transitions: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write transitions and their actions. Each micro-batch owns the folder of its checkpoint and id,
    so a repeated batch replaces what it wrote before, and another checkpoint replaces nothing. An action that
    another batch or checkpoint has written under ``out`` is not written again."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/transitions/run={run}/batch={batch_id}")
        written = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/transitions/run={run}/batch={batch_id}")
        append_actions(action_outbox(written), f"{out}/actions", run, batch_id)

    writer = transitions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def streaming_pipeline(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    remember_hours: int = REMEMBER_HOURS,
    once: bool = False,
    **read_options: object,
) -> StreamingQuery:
    """Event log in, transitions and actions out: read, drop redeliveries, replay the gates, emit.

    Every delivery comes out as one transition if it is relevant; late ones change nothing until
    :func:`reconciled` replays their pull requests.
    """
    events = read_events(spark, source, streaming=True, **read_options)
    return write_transitions(live_gate_machine(events, remember_hours), out, checkpoint, once)
