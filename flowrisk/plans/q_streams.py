"""Streaming queries: the tables arrive in slices, one run per slice, each resuming the last."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowrisk.plans import fixtures as X
from flowrisk.plans.oracle import CTX, FLOWS, SNAPSHOTS, scored, with_
from flowrisk.plans.q_flows import _CONNECTION, _NEW, _OBSERVED, polled
from flowrisk.plans.registry import query
from flowrisk.session import shared_path
from flowrisk.streaming.monitor import (finish_new_connections, monitor, open_folder, stream_flow_context,
                                        stream_new_connections)

SLICES = 3


def feed(spark, df, slice_number, start, name: str) -> str:
    """Drop the slices of ``df`` into a folder one after the other and run the query on each."""
    folder = shared_path(spark, name)
    for i in range(SLICES):
        df.filter(slice_number == i).write.mode("append").parquet(f"{folder}/in")
        start(open_folder(spark, f"{folder}/in", df.schema), folder).awaitTermination()
    return folder


def _flow_slice():
    return F.least(F.expr(f"(ts_us - {X.EPOCH_US}) div 130000000"), F.lit(SLICES - 1))


def _poll_slice():
    return F.least(F.expr("snapshot_no div 130"), F.lit(SLICES - 1))


@query("stream_flow_context", with_(FLOWS, CTX) + """SELECT seq, connections_60s, failed_connections_60s,
    unique_dst_ports_60s FROM ctx""")
def flow_context(spark, d):
    folder = feed(spark, X.flows(spark, d), _flow_slice(), lambda s, f: stream_flow_context(
        s, f, ["src_ip"], ["seq"], F.col("rst_count") > 0), "flow-context")
    return spark.read.parquet(f"{folder}/rows").select(
        "seq", "connections_60s", "failed_connections_60s", "unique_dst_ports_60s")


def _shuffled_slice():
    """Every seventh poll, and every eleventh of a host's rows, comes one slice late."""
    late = (F.col("snapshot_no") % 7 == 3) | (F.col("remote_port") % 11 == 5)
    return F.least(F.expr("snapshot_no div 130") + late.cast("int"), F.lit(SLICES - 1))


@query("stream_new_connections", with_(SNAPSHOTS, _NEW) + f"SELECT {_CONNECTION} FROM new")
def new_rows(spark, d):
    """Polls out of order, and some in parts, all within a delay of 300 polls."""
    polls = X.snapshots(spark, d)
    folder = feed(spark, polls, _shuffled_slice(), lambda s, f: stream_new_connections(s, f, delay=300), "connections")
    finish_new_connections(polls, folder, delay=300)
    return spark.read.parquet(f"{folder}/rows").select(*_CONNECTION.split(", "))


def _monitored(spark, d, alerts_only: bool):
    folder = feed(spark, polled(spark, d), _poll_slice(),
                  lambda s, f: monitor(s, f, alerts_only=alerts_only), "monitor")
    return spark.read.parquet(f"{folder}/alerts")


_MONITORED = [*_OBSERVED, f"""shaped AS (SELECT *, 0.0::DOUBLE AS duration_ms, 1 AS packets,
    0 AS bytes_sent, 0 AS bytes_received, 0 AS rst_count, NULL AS label,
    CASE WHEN lower(state) IN ('synsent', 'synreceived') THEN 1 ELSE 0 END AS syn_count
  FROM observed)""", scored("shaped")]


@query("stream_context", with_(*_MONITORED) + """SELECT host, pid, ts_us, src_ip, dst_ip, src_port,
    dst_port, state, direction, risk_score FROM scored""")
def process_context(spark, d):
    """Every new connection, scored in its process context."""
    return _monitored(spark, d, False).select(
        "host", F.col("process_id").alias("pid"), "ts_us", "src_ip", "dst_ip", "src_port", "dst_port",
        F.col("connection_state").alias("state"), "direction", "risk_score")


@query("stream_monitor", with_(*_MONITORED) + """SELECT host, pid, direction, severity,
    array_to_string(rule_list, ',') AS rule_ids, count(*) AS alerts FROM scored WHERE is_alert
  GROUP BY ALL""")
def stream_monitor(spark, d):
    """The alerts of the monitor, counted by process."""
    return _monitored(spark, d, True).groupBy(
        "host", F.col("process_id").alias("pid"), "direction", "severity",
        F.array_join("rule_ids", ",").alias("rule_ids")).agg(F.count(F.lit(1)).alias("alerts"))
