"""Network views derived from the given tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.operators.context import with_context
from flowrisk.session import configure

EPOCH_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per event, 30 days squeezed into six minutes; no context columns."""
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.expr(f"unix_micros(cast(ts as timestamp)) - {EPOCH_US}").alias("d"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.selectExpr(
        "event_id AS seq",
        f"CAST({EPOCH_US} + d div 7200 AS BIGINT) AS ts_us",
        """CASE WHEN user_id % 10 < 2 THEN '10.0.0.1' WHEN user_id % 10 = 2 THEN '10.0.0.2'
           ELSE '10.0.1.' || CAST(user_id % 200 AS STRING) END AS src_ip""",
        "'198.51.' || CAST(k AS STRING) || '.' || CAST(user_id % 250 AS STRING) AS dst_ip",
        "CAST(40000 + event_id % 20000 AS INT) AS src_port",
        """CAST(CASE event_type WHEN 'error' THEN CASE k % 8 WHEN 0 THEN 21 WHEN 1 THEN 22
             WHEN 2 THEN 23 WHEN 3 THEN 445 WHEN 4 THEN 3389 WHEN 5 THEN 5900 WHEN 6 THEN 4444
             ELSE 5555 END
           WHEN 'signup' THEN 80 WHEN 'click' THEN 443 ELSE 1000 + k END AS INT) AS dst_port""",
        "CASE WHEN event_type = 'view' THEN 'UDP' ELSE 'TCP' END AS protocol",
        "CAST(k * 1000 AS DOUBLE) AS duration_ms",
        "CAST(20 + k AS BIGINT) AS packets",
        """CAST(CASE WHEN event_type = 'purchase' AND k % 10 = 0 THEN floor(value * 4000) * 1000
           ELSE floor(value * 400) END AS BIGINT) AS bytes_sent""",
        "CAST(500 * k AS BIGINT) AS bytes_received",
        "CAST(k % 3 AS BIGINT) AS syn_count",
        """CAST(CASE WHEN event_type = 'error' AND k % 5 = 0 THEN 1 ELSE 0 END AS BIGINT)
           AS rst_count""",
        "CASE WHEN event_type = 'error' THEN 'attack' ELSE 'benign' END AS label")


def context_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_context(flows(spark, sf_dir), ["src_ip"])


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decoded packet per order line; the named order columns give the arrival order."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "unix_micros(cast(l_shipdate as timestamp)) + l_linenumber * 1000000 AS ts_us",
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        """CASE WHEN l_linenumber % 2 = 1 THEN '10.1.0.' || CAST(l_suppkey % 50 AS STRING)
           ELSE '10.2.0.' || CAST(l_orderkey % 40 AS STRING) END AS src_ip""",
        """CASE WHEN l_linenumber % 2 = 1 THEN '10.2.0.' || CAST(l_orderkey % 40 AS STRING)
           ELSE '10.1.0.' || CAST(l_suppkey % 50 AS STRING) END AS dst_ip""",
        "CAST(CASE WHEN l_linenumber % 2 = 1 THEN 50000 ELSE 443 END AS INT) AS src_port",
        "CAST(CASE WHEN l_linenumber % 2 = 1 THEN 443 ELSE 50000 END AS INT) AS dst_port",
        "CASE WHEN l_orderkey % 5 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol",
        "CAST(l_quantity AS BIGINT) + 40 AS byte_count",
        "CAST(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS INT) AS syn",
        """CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS INT)
           AS rst""")


PACKET_ORDER = ["ts_us", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections a host reported in one poll; two hours of events make one poll."""
    return table(spark, sf_dir, "events").selectExpr(
        "'h' || CAST(user_id % 4 AS STRING) AS host",
        f"CAST((unix_micros(cast(ts as timestamp)) - {EPOCH_US}) div 7200000000 AS BIGINT)"
        " AS snapshot_no",
        "'192.168.1.' || CAST(user_id % 40 AS STRING) AS local_address",
        """CAST(CASE WHEN event_type = 'signup' THEN 3389 ELSE 50000 + user_id % 40 END AS INT)
           AS local_port""",
        "'203.0.113.' || CAST(user_id % 7 AS STRING) AS remote_address",
        """CAST(CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'purchase' THEN 8443
           WHEN 'error' THEN 4444 ELSE 51000 END AS INT) AS remote_port""",
        """CASE event_type WHEN 'error' THEN 'Closed' WHEN 'view' THEN 'SynSent'
           ELSE 'Established' END AS state""",
        "CAST(100 + user_id % 9 AS INT) AS pid").distinct()
