"""Queries on packets, flows, context windows and snapshots."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from flowrisk.functions.scoring import with_scores
from flowrisk.operators.context import time_reversals, with_context
from flowrisk.operators.flows import aggregate_flows, capture_flows, with_flow_key
from flowrisk.operators.snapshots import new_connections, observations, with_direction
from flowrisk.plans import fixtures as X
from flowrisk.plans.oracle import (CTX, EPOCH_US, FLOWS, PACKETS, SNAPSHOTS, context, iso, scored,
                                   with_)
from flowrisk.plans.registry import query
from flowrisk.session import shared_path
from flowrisk.sources.captures import decode_packets, read_captures
from flowrisk.sources.connections import name_processes
from flowrisk.sources.order import head_rows, with_file_order


@query("ctx_connections", with_(FLOWS, CTX) +
       "SELECT seq, connections_60s, failed_connections_60s FROM ctx")
def ctx_connections(spark, d):
    return with_context(X.flows(spark, d), ["src_ip"], port=None).select(
        "seq", "connections_60s", "failed_connections_60s")


@query("ctx_unique_ports", with_(FLOWS, CTX) + "SELECT seq, unique_dst_ports_60s FROM ctx")
def ctx_unique_ports(spark, d):
    return X.context_flows(spark, d).select("seq", "unique_dst_ports_60s")


_SHAKEN = """shaken AS (SELECT * REPLACE (CASE WHEN seq % 7 = 0 THEN ts_us - 30000000 ELSE ts_us END
    AS ts_us) FROM flows)"""


@query("time_reversal", with_(FLOWS, _SHAKEN) + """SELECT seq, previous_ts, ts_us < previous_ts AS reversed
  FROM (SELECT seq, ts_us, max(ts_us) OVER (PARTITION BY src_ip ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_ts
        FROM shaken) WHERE ts_us < previous_ts""")
def time_reversal(spark, d):
    """Every seventh flow is dated 30 seconds back."""
    shaken = X.flows(spark, d).withColumn("ts_us", F.when(
        F.col("seq") % 7 == 0, F.col("ts_us") - 30_000_000).otherwise(F.col("ts_us")))
    return time_reversals(shaken.select("src_ip", "ts_us", "seq"), ["src_ip"]).filter(
        "reversed").select("seq", "previous_ts", "reversed")


@query("head_rows", with_(FLOWS) + "SELECT seq, src_ip FROM flows ORDER BY seq LIMIT 500")
def head(spark, d):
    return head_rows(X.flows(spark, d), 500, ["seq"]).select("seq", "src_ip")


@query("head_rows_files", with_(FLOWS) + """SELECT seq, src_ip FROM flows
  ORDER BY seq % 7, seq LIMIT (SELECT count(*) // 2 FROM flows)""")
def head_of_files(spark, d):
    """Half of the lines of seven files, in the order in which the files were written."""
    flows, path = X.flows(spark, d).select("seq", "src_ip"), shared_path(spark, "head")
    for part in range(7):
        rows = flows.filter(F.col("seq") % 7 == part).withColumn("line", F.concat_ws(" ", "seq", "src_ip"))
        rows.repartition(1).sortWithinPartitions("seq").select("line").write.mode("append").text(path)
    lines = with_file_order(spark.read.text(path))
    words = F.split("value", " ")
    return head_rows(lines, flows.count() // 2).select(words[0].cast("bigint").alias("seq"), words[1].alias("src_ip"))


# ------------------------------------------------------------------ packets

_KEYED = """keyed AS (SELECT *, (src_ip, src_port) <= (dst_ip, dst_port) AS forward,
    row_number() OVER (ORDER BY ts_us, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS arrival
  FROM packets),
  sides AS (SELECT *, CASE WHEN forward THEN src_ip ELSE dst_ip END AS lo_ip,
    CASE WHEN forward THEN src_port ELSE dst_port END AS lo_port,
    CASE WHEN forward THEN dst_ip ELSE src_ip END AS hi_ip,
    CASE WHEN forward THEN dst_port ELSE src_port END AS hi_port FROM keyed)"""
_BIDI = """bidi AS (SELECT arg_min(src_ip, arrival) AS src_ip, arg_min(dst_ip, arrival) AS dst_ip,
    arg_min(src_port, arrival) AS src_port, arg_min(dst_port, arrival) AS dst_port, protocol,
    min(ts_us) AS ts_us, (max(ts_us) - min(ts_us)) / 1000.0::DOUBLE AS duration_ms,
    count(*) AS packets,
    CAST(sum(byte_count) FILTER (WHERE forward) AS BIGINT) AS lo_bytes,
    CAST(sum(byte_count) FILTER (WHERE NOT forward) AS BIGINT) AS hi_bytes,
    arg_min(forward, arrival) AS starts, CAST(sum(syn) AS BIGINT) AS syn_count,
    CAST(sum(rst) AS BIGINT) AS rst_count, min(arrival) AS arrival
  FROM sides GROUP BY lo_ip, lo_port, hi_ip, hi_port, protocol),
  agg AS (SELECT * EXCLUDE (lo_bytes, hi_bytes, starts),
    CASE WHEN starts THEN coalesce(lo_bytes, 0) ELSE coalesce(hi_bytes, 0) END AS bytes_sent,
    CASE WHEN starts THEN coalesce(hi_bytes, 0) ELSE coalesce(lo_bytes, 0) END AS bytes_received,
    NULL AS label FROM bidi)"""
_FLOW = ("src_ip, dst_ip, src_port, dst_port, protocol, ts_us, duration_ms, packets, bytes_sent, "
         "bytes_received, syn_count, rst_count")
_CTX_CAPTURE = context("agg", "src_ip",
                       "row_number() OVER (PARTITION BY src_ip, ts_us ORDER BY arrival) - 1",
                       "rst_count > 0", scale=1000)


@query("flow_key", with_(PACKETS, _KEYED) + """SELECT lo_ip || ':' || CAST(lo_port AS VARCHAR) AS lo,
    hi_ip || ':' || CAST(hi_port AS VARCHAR) AS hi, protocol, count(*) AS packets
  FROM sides GROUP BY ALL""")
def flow_key(spark, d):
    def text(side):
        return F.concat(F.col(f"{side}.ip"), F.lit(":"), F.col(f"{side}.port").cast("string"))
    return with_flow_key(X.packets(spark, d)).groupBy(
        text("lo").alias("lo"), text("hi").alias("hi"), "protocol").agg(
        F.count(F.lit(1)).alias("packets"))


@query("flow_aggregate", with_(PACKETS, _KEYED, _BIDI) + f"SELECT {_FLOW} FROM agg")
def flow_aggregate(spark, d):
    return aggregate_flows(X.packets(spark, d), order=X.PACKET_ORDER).select(*_FLOW.split(", "))


@query("flow_aggregate_dir", with_(PACKETS) + """SELECT src_ip, dst_ip, src_port, dst_port, protocol,
    min(ts_us) AS ts_us, (max(ts_us) - min(ts_us)) / 1000.0::DOUBLE AS duration_ms,
    count(*) AS packets, CAST(sum(byte_count) AS BIGINT) AS bytes_sent,
    CAST(0 AS BIGINT) AS bytes_received, CAST(sum(syn) AS BIGINT) AS syn_count,
    CAST(sum(rst) AS BIGINT) AS rst_count
  FROM packets GROUP BY src_ip, dst_ip, src_port, dst_port, protocol""")
def flow_aggregate_dir(spark, d):
    return aggregate_flows(X.packets(spark, d), False, X.PACKET_ORDER).select(*_FLOW.split(", "))


@query("ctx_capture", with_(PACKETS, _KEYED, _BIDI, _CTX_CAPTURE) +
       f"SELECT {_FLOW}, unique_dst_ports_60s, connections_60s, failed_connections_60s FROM ctx")
def ctx_capture(spark, d):
    return capture_flows(X.packets(spark, d), order=X.PACKET_ORDER).select(
        *_FLOW.split(", "), "unique_dst_ports_60s", "connections_60s", "failed_connections_60s")


def _hex(value, digits: int):
    return F.lpad(F.hex(value.cast("bigint")), digits, "0")


def _address(name: str):
    parts = F.split(name, r"\.")
    return F.concat(*[_hex(parts[i], 2) for i in range(4)])


def _ip4_packet():
    """Hex text of an IPv4 packet of ``byte_count`` bytes around a TCP or UDP header."""
    tcp = F.col("protocol") == "TCP"
    head = F.concat(F.lit("4500"), _hex(F.col("byte_count"), 4), F.lit("0001000040"),
                    F.when(tcp, "06").otherwise("11"), F.lit("0000"), _address("src_ip"),
                    _address("dst_ip"))
    ports = F.concat(_hex(F.col("src_port"), 4), _hex(F.col("dst_port"), 4))
    rest = F.when(tcp, F.concat(F.lit("000000000000000050"), _hex(F.col("syn") * 2 + F.col("rst") * 4, 2),
                                F.lit("040000000000"))).otherwise(
        F.concat(_hex(F.col("byte_count") - 20, 4), F.lit("0000")))
    room = F.col("byte_count") - F.when(tcp, 40).otherwise(28)
    return F.concat(head, ports, rest, F.repeat(F.lit("00"), room.cast("int")))


_ETHERNET = "00112233445566778899aabb"
_DECODED = "ts_us, src_ip, dst_ip, src_port, dst_port, protocol, byte_count, syn, rst"
_SEEN = """seen AS (SELECT * REPLACE (CASE WHEN protocol = 'TCP' THEN syn ELSE 0 END AS syn,
    CASE WHEN protocol = 'TCP' THEN rst ELSE 0 END AS rst) FROM packets)"""


def _little(value, size: int):
    """Hex text of a number with its least byte first."""
    text = _hex(value, 2 * size)
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])


@contextmanager
def small_splits(spark, size: str = "2m"):
    """Tasks that read tables take few bytes: a shuffle to many files holds what a task has read."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def capture_files(spark, d, packets_a_file: int = 50_000) -> str:
    """A folder of classic PCAP files, built from the packet view and written to the shared folder.

    A uniform hash of the packet's unique order columns picks the file, so no file grows with skew. A file is
    written as text whose lines end in a zero byte, which is the last byte of the file header and of every frame.
    """
    packets = X.packets(spark, d)
    files = max(1, packets.count() // packets_a_file)
    frame = F.concat(F.lit(_ETHERNET + "0800"), _ip4_packet())
    size = _little(F.length(frame) / 2, 4)
    record = F.concat(_little(F.expr("ts_us div 1000000"), 4), _little(F.col("ts_us") % 1_000_000, 4), size, size, frame)
    head = F.lit("d4c3b2a1" "0200" "0400" "00000000" "00000000" "ffff0000" "01000000")
    which = F.pmod(F.xxhash64(*X.PACKET_ORDER), F.lit(files))
    lines = packets.select(which.alias("f"), *X.PACKET_ORDER, record.alias("r")).unionByName(
        spark.range(files).select(F.col("id").alias("f"), head.alias("r")), allowMissingColumns=True)  # nulls come first
    path = shared_path(spark, "captures")
    with small_splits(spark):  # and one file a task: by a hash of their numbers several would meet in one
        (lines.repartitionById(files, F.col("f").cast("int")).sortWithinPartitions("f", *X.PACKET_ORDER)
         .select("f", F.unhex(F.expr("left(r, length(r) - 2)")).cast("string").alias("value"))
         .write.partitionBy("f").option("lineSep", "\0").text(path))
    return path


@query("capture_scan", with_(PACKETS) + f"""SELECT count(*) AS packets, min(ts_us) AS first_us,
    max(ts_us) AS last_us, CAST(sum(byte_count + 14) AS BIGINT) AS frame_bytes FROM packets""")
def capture_scan(spark, d):
    """Files to raw packets, each file read in ranges of 1 MB."""
    return read_captures(spark, capture_files(spark, d), size=1 << 20).agg(
        F.count(F.lit(1)).alias("packets"), F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"), F.sum(F.length("frame")).alias("frame_bytes"))


@query("packet_decode", with_(PACKETS, _SEEN, """all_packets AS (SELECT ts_us,
    CASE WHEN l_orderkey % 4 = 3 THEN '2001:db8::' || lower(to_hex(l_suppkey + 1)) ELSE src_ip END AS src_ip,
    CASE WHEN l_orderkey % 4 = 3 THEN '2001:db8::ffff' ELSE dst_ip END AS dst_ip,
    src_port, dst_port, protocol,
    byte_count + CASE WHEN l_orderkey % 4 = 3 THEN 28 ELSE 0 END AS byte_count, syn, rst FROM seen
  WHERE l_partkey % 10 <> 0)""") + f"SELECT {_DECODED} FROM all_packets")
def packet_decode(spark, d):
    """Frames of every supported kind: plain Ethernet, stacked VLAN tags, cooked, and raw IPv6 with a
    hop-by-hop header. Every tenth part is a later IPv4 fragment or ESP and drops out."""
    kind, lost = F.col("l_orderkey") % 4, F.col("l_partkey") % 10 == 0
    four = F.when(lost, F.concat(F.substring("ip4", 1, 12), F.lit("0010"), F.expr("substring(ip4, 17)"))
                  ).otherwise(F.col("ip4"))
    upper = F.expr("substring(ip4, 41)")
    protocol = F.when(F.col("protocol") == "TCP", "06").otherwise("11")
    six = F.concat(
        F.lit("60000000"), _hex(F.length(upper) / 2 + 8, 4), F.when(lost, "32").otherwise("00"),
        F.lit("40"), F.lit("20010db8" + "0" * 16), _hex(F.col("l_suppkey") + 1, 8),
        F.lit("20010db8" + "0" * 20 + "ffff"), protocol, F.lit("00" * 7), upper)
    frame = (F.when(kind == 0, F.concat(F.lit(_ETHERNET + "0800"), four))
             .when(kind == 1, F.concat(F.lit(_ETHERNET + "88a8" "0064" "8100" "0005" "0800"), four))
             .when(kind == 2, F.concat(F.lit("00" * 14 + "0800"), four)).otherwise(six))
    link = F.when(kind < 2, 1).when(kind == 2, 113).otherwise(101)
    raw = X.packets(spark, d).withColumn("ip4", _ip4_packet()).select(
        "ts_us", link.cast("int").alias("link_type"), F.unhex(frame).alias("frame"))
    return decode_packets(raw, ["ts_us"]).select(*_DECODED.split(", "))


_PCAP_ORDER = ["ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
_PCAP_KEYED = _KEYED.replace("FROM packets", "FROM seen").replace(
    "ts_us, l_orderkey, l_linenumber, l_partkey, l_suppkey", ", ".join(_PCAP_ORDER))


@query("pcap_flows", with_(PACKETS, _SEEN, _PCAP_KEYED, _BIDI, _CTX_CAPTURE, scored()) + f"""
  SELECT {iso('ts_us')} || 'Z' AS timestamp, {_FLOW.replace('ts_us, ', '')}, unique_dst_ports_60s,
    connections_60s, failed_connections_60s, risk_score, is_alert FROM scored""")
def pcap_flows(spark, d):
    """Capture files to packets to flows to context to scores.

    The files are cut by hash, so the packets' order is their time and addresses, not their place.
    """
    packets = decode_packets(read_captures(spark, capture_files(spark, d)), ["ts_us"])
    return with_scores(capture_flows(packets, order=_PCAP_ORDER)).select(
        "timestamp", *[c for c in _FLOW.split(", ") if c != "ts_us"], "unique_dst_ports_60s",
        "connections_60s", "failed_connections_60s", F.round("p_risk", 4).alias("risk_score"),
        "is_alert")


# ------------------------------------------------------------------ snapshots

_NEW = """new AS (SELECT s.* FROM snapshots s LEFT JOIN snapshots p ON p.host = s.host
    AND p.snapshot_no = s.snapshot_no - 1 AND p.local_address = s.local_address
    AND p.local_port = s.local_port AND p.remote_address = s.remote_address
    AND p.remote_port = s.remote_port AND p.pid = s.pid WHERE p.host IS NULL)"""
_INBOUND = ("local_port IN (21,22,23,25,53,80,110,135,139,143,443,445,1433,3306,3389,5432,5900,6379)"
            " AND remote_port > 1024")
_DIRECTED = f"""directed AS (SELECT *, CASE WHEN {_INBOUND} THEN 'inbound' ELSE 'outbound' END AS direction,
    CASE WHEN {_INBOUND} THEN remote_address ELSE local_address END AS src_ip,
    CASE WHEN {_INBOUND} THEN local_address ELSE remote_address END AS dst_ip,
    CASE WHEN {_INBOUND} THEN remote_port ELSE local_port END AS src_port,
    CASE WHEN {_INBOUND} THEN local_port ELSE remote_port END AS dst_port,
    {EPOCH_US} + snapshot_no * 1000000 AS ts_us FROM new)"""
_OBSERVED = [SNAPSHOTS, _NEW, _DIRECTED, context(
    "directed", "host, src_ip, pid, direction",
    "row_number() OVER (PARTITION BY host, src_ip, pid, direction, ts_us ORDER BY snapshot_no, "
    "local_address, local_port, remote_address, remote_port) - 1",
    "lower(state) IN ('closed', 'deletetcb')", out="observed")]
_CONNECTION = ("host, snapshot_no, local_address, local_port, remote_address, remote_port, state, "
               "pid")
_OBSERVATION = ("host, snapshot_no, src_ip, dst_ip, src_port, dst_port, pid, direction, state, "
                "connections_60s, failed_connections_60s, unique_dst_ports_60s")


def polled(spark, d):
    return X.snapshots(spark, d).withColumn(
        "ts_us", F.lit(X.EPOCH_US) + F.col("snapshot_no") * 1_000_000)


@query("new_connections", with_(SNAPSHOTS, _NEW) + f"SELECT {_CONNECTION} FROM new")
def new_connections_query(spark, d):
    return new_connections(X.snapshots(spark, d)).select(*_CONNECTION.split(", "))


@query("direction", with_(SNAPSHOTS, _NEW.replace("WHERE p.host IS NULL", "AND false"),
       _DIRECTED) + """SELECT host, snapshot_no, pid, src_ip, dst_ip, src_port, dst_port, direction
  FROM directed""")
def direction(spark, d):
    return with_direction(X.snapshots(spark, d)).select(
        "host", "snapshot_no", "pid", "src_ip", "dst_ip", "src_port", "dst_port", "direction")


@query("ctx_process", with_(*_OBSERVED) + f"SELECT {_OBSERVATION} FROM observed")
def ctx_process(spark, d):
    return observations(polled(spark, d)).select(*_OBSERVATION.split(", "))


_PROCESSES = """procs AS (SELECT DISTINCT CAST(100 + user_id % 9 AS INT) AS pid FROM events),
  names AS (SELECT pid, 'proc-' || CAST(pid AS VARCHAR) || '.exe' AS process_name FROM procs
            WHERE pid % 4 <> 0)"""


def process_table(spark, d):
    pid = F.expr("cast(100 + user_id % 9 as int)")
    return X.table(spark, d, "events").select(pid.alias("pid")).distinct().filter(
        "pid % 4 <> 0").withColumn("process_name", F.concat(
            F.lit("proc-"), F.col("pid").cast("string"), F.lit(".exe")))


@query("process_names", with_(SNAPSHOTS, _PROCESSES) + f"""SELECT {_CONNECTION},
    coalesce(process_name, 'unknown') AS process_name FROM snapshots LEFT JOIN names USING (pid)""")
def process_names(spark, d):
    return name_processes(X.snapshots(spark, d), process_table(spark, d), "pid").select(
        *_CONNECTION.split(", "), "process_name")
