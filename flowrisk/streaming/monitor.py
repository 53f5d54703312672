"""The monitor: polled snapshots to new connections to context to scored alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.functions.model import BASELINE, LinearModel
from flowrisk.functions.scoring import detections
from flowrisk.operators.feedback import alert_id
from flowrisk.operators.snapshots import ORDER, PROCESS, as_flows
from flowrisk.schema import ALERT
from flowrisk.sources.connections import as_snapshots, parse_connection_json
from flowrisk.streaming.context import StreamingConnections, StreamingContext
from flowrisk.streaming.state import compact_epochs, last_epoch, run, staged, write_epoch

#: A host that is silent for a day leaves the monitor's state.
EXPIRE_US = 24 * 3600 * 1_000_000
#: Epochs after which the monitor's sinks are put into fewer folders.
COMPACT_EVERY = 128


def open_folder(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A folder that files are dropped into."""
    return spark.readStream.schema(schema).parquet(path)


def stream_flow_context(stream: DataFrame, folder: str, keys: list[str], seq: list[str],
                        failed: Column, interval: str | None = None):
    """Context for an ordered flow feed: ``folder/rows`` and the late rows in ``folder/late``."""
    context = StreamingContext(folder, keys, seq)

    def process(batch: DataFrame, epoch: int) -> None:
        rows, late = context.process(batch, epoch, failed)
        write_epoch(rows, f"{folder}/rows", epoch)
        write_epoch(late, f"{folder}/late", epoch)

    return run(stream, process, f"{folder}/checkpoint", interval)


def stream_new_connections(stream: DataFrame, folder: str, interval: str | None = None, time: str = "snapshot_no",
                           delay: int = 0, expire: int | None = None):
    """New connections in ``folder/rows`` and rows behind their host's watermark in ``folder/late``.

    Snapshots may come in any order within ``delay``; see StreamingConnections.
    """
    connections = StreamingConnections(folder, time=time, delay=delay, expire=expire)

    def process(batch: DataFrame, epoch: int) -> None:
        rows, late = connections.process(batch, epoch)
        write_epoch(rows, f"{folder}/rows", epoch)
        write_epoch(late, f"{folder}/late", epoch)

    return run(stream, process, f"{folder}/checkpoint", interval)


def finish_new_connections(like: DataFrame, folder: str, time: str = "snapshot_no", delay: int = 0) -> None:
    """At the end of a feed: tells what the last ``delay`` still holds, as the epoch after the last one.

    ``like`` has the feed's columns. If the feed goes on after all, its next batch takes that epoch's place.
    """
    spark = like.sparkSession
    epoch = last_epoch(spark, f"{folder}/rows") + 1
    rows, _ = StreamingConnections(folder, time=time, delay=delay).process(like.limit(0), epoch, close=True)
    write_epoch(rows, f"{folder}/rows", epoch)


def open_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Collected polls: JSON files in folders ``host=.../snapshot_no=.../ts_us=...``."""
    schema = "value string, host string, snapshot_no bigint, ts_us bigint"
    texts = spark.readStream.schema(schema).option("wholetext", True).text(path)
    return as_snapshots(parse_connection_json(texts, "value", ["host", "snapshot_no", "ts_us"]))


def monitor(stream: DataFrame, folder: str, model: LinearModel = BASELINE, threshold: float = 0.60,
            alerts_only: bool = True, interval: str | None = None, delay_us: int = 0,
            expire_us: int | None = EXPIRE_US):
    """Score every new connection in its process context and append the alerts, in the columns of ALERT
    with alert_id, host and ts_us.

    Needs ``ts_us``, the time of the poll, and takes ``process_name``. Connections of a poll share the
    time, so within a source time follows the snapshot number. Hosts have clocks of their own. Polls may come in
    any order within ``delay_us``, and are scored when it is over; later ones go to ``folder/late``. A host that is
    silent while the feed moves on by ``expire_us`` leaves the state.
    """
    connections = StreamingConnections(folder, time="ts_us", delay=delay_us, expire=expire_us)
    context = StreamingContext(folder, PROCESS, ORDER, delay_us=0, check_order=False, clock=["host"], expire_us=expire_us)

    def process(batch: DataFrame, epoch: int) -> None:
        if "process_name" not in batch.columns:
            batch = batch.withColumn("process_name", F.lit("unknown"))
        news, late = connections.process(batch, epoch)
        write_epoch(late, f"{folder}/late", epoch)
        flows = staged(as_flows(news), f"{folder}/stage-connections", epoch)
        rows, _ = context.process(flows, epoch, F.col("failed"))
        rows = rows.withColumnsRenamed({"state": "connection_state"}).withColumn(
            "process_id", F.col("pid").cast("bigint"))
        scored = detections(rows, model, threshold, keep=["host", "ts_us", "src_port", "process_id",
                                                          "process_name", "connection_state", "direction"])
        if alerts_only:
            scored = scored.filter("is_alert")
        scored = scored.withColumn("alert_id", alert_id())
        write_epoch(scored.select("host", "ts_us", "alert_id", *ALERT.names), f"{folder}/alerts", epoch)
        if epoch % COMPACT_EVERY == COMPACT_EVERY - 1:
            for sink in ("alerts", "late"):
                compact_epochs(batch.sparkSession, f"{folder}/{sink}")

    return run(stream, process, f"{folder}/checkpoint", interval)
