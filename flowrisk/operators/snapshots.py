"""Connection snapshots: what is new since the last poll, its direction and its context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.constants import FAILED_STATES, SERVER_PORTS, SYN_STATES
from flowrisk.functions.normalize import us_text
from flowrisk.operators.context import with_context
from flowrisk.session import stage

KEY = ["local_address", "local_port", "remote_address", "remote_port", "pid"]
PROCESS = ["host", "src_ip", "pid", "direction"]
ORDER = ["snapshot_no", *KEY[:4]]


def new_connections(snapshots: DataFrame, host: str = "host", number: str = "snapshot_no",
                    key: list[str] = KEY) -> DataFrame:
    """Connections that the host's previous snapshot did not list; returning ones count again.

    The snapshot number is part of the join key, so one busy connection spreads over the polls.
    """
    before = snapshots.select(host, (F.col(number) + 1).alias(number), *key)
    return snapshots.join(before, [host, number, *key], "left_anti")


def with_direction(connections: DataFrame) -> DataFrame:
    """Inbound connections hit a server port from a high port; their endpoints are swapped."""
    inbound = F.col("local_port").isin(SERVER_PORTS) & (F.col("remote_port") > 1024)

    def side(when_inbound: str, otherwise: str):
        return F.when(inbound, F.col(when_inbound)).otherwise(F.col(otherwise))

    return connections.withColumns({
        "direction": F.when(inbound, "inbound").otherwise("outbound"),
        "src_ip": side("remote_address", "local_address"),
        "dst_ip": side("local_address", "remote_address"),
        "src_port": side("remote_port", "local_port").cast("int"),
        "dst_port": side("local_port", "remote_port").cast("int")})


def as_flows(connections: DataFrame) -> DataFrame:
    """A connection seen in a poll is a flow of one packet without bytes."""
    state = F.lower("state")
    zero = F.lit(0).cast("bigint")
    return with_direction(connections).withColumns({
        "timestamp": us_text("ts_us"), "protocol": F.lit("TCP"), "duration_ms": F.lit(0.0),
        "packets": F.lit(1).cast("bigint"), "bytes_sent": zero, "bytes_received": zero,
        "syn_count": state.isin(SYN_STATES).cast("bigint"), "rst_count": zero,
        "failed": state.isin(FAILED_STATES), "label": F.lit(None).cast("string")})


def observations(snapshots: DataFrame) -> DataFrame:
    """New connections as flows with context per (host, source, process, direction).

    Needs ``ts_us``, the poll's time. Connections of one poll keep their key order.
    """
    flows = stage(as_flows(new_connections(snapshots)), "connections")
    return with_context(flows, PROCESS, seq=ORDER, failed=F.col("failed"))
