"""Packets to flows: one row per directional or bidirectional 5-tuple."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.functions.normalize import us_text
from flowrisk.operators.context import with_context
from flowrisk.session import stage

FILE_ORDER = ["file", "pkt_no"]


def with_flow_key(packets: DataFrame, bidirectional: bool = True) -> DataFrame:
    """Add ``lo``, ``hi`` (the endpoints in a fixed order) and ``forward`` (lo sent the packet)."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    if not bidirectional:
        return packets.withColumns({"lo": src, "hi": dst, "forward": F.lit(True)})
    return packets.withColumns({"lo": F.least(src, dst), "hi": F.greatest(src, dst),
                                "forward": src <= dst})


def aggregate_flows(packets: DataFrame, bidirectional: bool = True,
                    order: list[str] = FILE_ORDER) -> DataFrame:
    """Flows whose source is the endpoint of the first packet in arrival ``order``.

    One shuffle on the flow key after map-side aggregation, so a busy flow is one row per map task.
    The sums are kept per direction and named sent and received once the initiator is known.
    """
    forward = F.col("forward")
    place = F.struct(*order)
    keyed = with_flow_key(packets, bidirectional)
    grouped = keyed.groupBy("lo", "hi", "protocol").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("packets"),
        F.sum(F.when(forward, F.col("byte_count")).otherwise(0)).alias("_lo_bytes"),
        F.sum(F.when(forward, 0).otherwise(F.col("byte_count"))).alias("_hi_bytes"),
        F.sum("syn").cast("bigint").alias("syn_count"),
        F.sum("rst").cast("bigint").alias("rst_count"),
        F.min(F.struct(place.alias("at"), forward.alias("forward"))).alias("_first"))
    starts = F.col("_first.forward")
    source = F.when(starts, F.col("lo")).otherwise(F.col("hi"))
    target = F.when(starts, F.col("hi")).otherwise(F.col("lo"))
    sent = F.when(starts, F.col("_lo_bytes")).otherwise(F.col("_hi_bytes"))
    received = F.when(starts, F.col("_hi_bytes")).otherwise(F.col("_lo_bytes"))
    return grouped.select(
        source["ip"].alias("src_ip"), target["ip"].alias("dst_ip"),
        source["port"].alias("src_port"), target["port"].alias("dst_port"), "protocol",
        F.col("first_us").alias("ts_us"),
        ((F.col("last_us") - F.col("first_us")) / 1000.0).alias("duration_ms"), "packets",
        sent.alias("bytes_sent"), received.alias("bytes_received"), "syn_count", "rst_count",
        *[F.col(f"_first.at.{c}").alias(f"first_{c}") for c in order])


def capture_flows(packets: DataFrame, bidirectional: bool = True,
                  order: list[str] = FILE_ORDER) -> DataFrame:
    """Flows with text timestamps and their 60-second context.

    The flows are written once: the context reads them several times, the packets only here.
    """
    flows = stage(aggregate_flows(packets, bidirectional, order), "flows")
    return with_context(flows, ["src_ip"], seq=[f"first_{c}" for c in order]).withColumn(
        "timestamp", us_text("ts_us")).withColumn("label", F.lit(None).cast("string"))
