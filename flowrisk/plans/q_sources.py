"""Queries on scans and cleaning. Dirty text is written out from the tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowrisk.functions.address import address_text
from flowrisk.constants import FLOW_COLUMNS, UNSW_RAW_COLUMNS
from flowrisk.functions import normalize as N
from flowrisk.functions.normalize import us_text
from flowrisk.plans import fixtures as X
from flowrisk.plans.oracle import ALERTS, CTX, FLOWS, SNAPSHOTS, context, iso, with_
from flowrisk.plans.q_feedback import pending_queue
from flowrisk.plans.q_flows import polled
from flowrisk.plans.q_scoring import alerts
from flowrisk.plans.registry import query
from flowrisk.schema import ALERT, PENDING
from flowrisk.session import shared_path
from flowrisk.sources import connections as C
from flowrisk.sources import datasets as D
from flowrisk.sources.flow_csv import read_flow_csv
from flowrisk.sources.jsonl import feedback_ids, parse_tolerant, read_tolerant
from flowrisk.sources.order import FILE_ORDER

_FLOW_NUMBERS = ("src_port, dst_port, duration_ms, packets, bytes_sent, bytes_received, syn_count, "
                 "rst_count")


@query("flows_scan", with_(FLOWS, CTX) + f"""SELECT {iso('ts_us')} || 'Z' AS timestamp, src_ip,
    dst_ip, {_FLOW_NUMBERS}, protocol, unique_dst_ports_60s, connections_60s,
    failed_connections_60s, CASE WHEN seq % 4 = 0 THEN NULL ELSE label END AS label FROM ctx""")
def flows_scan(spark, d):
    """CSV files with different column orders, lower-case protocols and some empty labels."""
    rows = X.context_flows(spark, d).withColumns({
        "timestamp": us_text("ts_us"), "protocol": F.lower("protocol"),
        "label": F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("label"))})
    columns = sorted(FLOW_COLUMNS)
    folder = csv_files(rows, columns, columns[::-1])
    return read_flow_csv(spark, f"{folder}/*").select(*FLOW_COLUMNS)


def csv_files(rows, *layouts, seq: str = "seq", headers: bool = True) -> str:
    """The rows, dealt by ``seq`` to folders of CSV files, each folder with its own columns."""
    folder = shared_path(rows.sparkSession, "csv")
    for i, names in enumerate(layouts):
        (rows.filter(F.col(seq) % len(layouts) == i).select(*[F.col(f"`{c}`") for c in names])
         .write.options(emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
         .csv(f"{folder}/{i}", header=headers))
    return folder


def cicids_raw(spark, d):
    """The flows in the spelling of the public dataset, with times cut to seconds."""
    ts = F.timestamp_micros("ts_us")
    text = {
        " Source IP": F.col("src_ip"), " Source Port": F.col("src_port").cast("string"),
        " Destination IP": F.col("dst_ip"), " Destination Port": F.col("dst_port").cast("string"),
        " Protocol": F.when(F.col("protocol") == "TCP", "6").otherwise("17.0"),
        " Timestamp": F.date_format(ts, "MM/dd/yyyy HH:mm:ss"),
        " Flow Duration": (F.col("duration_ms") * 1000).cast("bigint").cast("string"),
        " Total Fwd Packets": F.concat((F.col("packets") - 10).cast("string"), F.lit(".0")),
        " Total Backward Packets": F.lit(" 10 "),
        "Total Length of Fwd Packets": F.col("bytes_sent").cast("string"),
        " Total Length of Bwd Packets": F.col("bytes_received").cast("string"),
        " SYN Flag Count": F.col("syn_count").cast("string"),
        " RST Flag Count": F.col("rst_count").cast("string"),
        " Label": F.when(F.col("label") == "benign", "BENIGN").otherwise("SSH-Patator"),
    }
    return X.flows(spark, d).select("seq", *[c.alias(n) for n, c in text.items()])


_SECONDS = "sec AS (SELECT * REPLACE (ts_us // 1000000 * 1000000 AS ts_us) FROM flows)"
_FORMAT = "%m/%d/%Y %H:%M:%S"


@query("cicids_normalize", with_(FLOWS, _SECONDS) + f"""SELECT ts_us, {iso('ts_us')} AS timestamp,
    src_ip, dst_ip, protocol, {_FLOW_NUMBERS}, label, rst_count > 0 AS failed FROM sec""")
def cicids_normalize(spark, d):
    """Files whose columns come in different orders and spellings."""
    rows = cicids_raw(spark, d)
    names = [c for c in rows.columns if c != "seq"]
    rows = rows.withColumns({c.strip().upper(): F.col(f"`{c}`") for c in names})
    raw = D.read_cicids(spark, csv_files(rows, names, [c.strip().upper() for c in names[::-1]]) + "/*")
    return D.strict_rows(D.normalize_cicids(raw, _FORMAT, FILE_ORDER)).drop(*FILE_ORDER)


@query("unsw_normalize", with_(FLOWS, _SECONDS) + f"""SELECT ts_us, {iso('ts_us')} || 'Z' AS timestamp,
    src_ip, dst_ip, protocol, CASE WHEN seq % 5 = 0 THEN 0 ELSE src_port END AS src_port, dst_port,
    duration_ms, packets + 3 AS packets, bytes_sent, bytes_received, CAST(0 AS BIGINT) AS syn_count,
    CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS rst_count,
    label, seq % 3 < 2 AS failed FROM sec""")
def unsw_normalize(spark, d):
    """Epoch seconds, hexadecimal and missing ports, durations in seconds, labels by category; files with
    a header and, in the official layout, without one."""
    def text(column):
        return F.col(column).cast("string")
    state = F.when(F.col("seq") % 3 == 0, "rst").when(F.col("seq") % 3 == 1, "REQ").otherwise("FIN")
    benign = F.col("label") == "benign"
    raw = X.flows(spark, d).select(
        "seq", F.col("src_ip").alias("srcip"),
        F.when(F.col("seq") % 5 == 0, "-").otherwise(
            F.concat(F.lit("0x"), F.hex("src_port"))).alias("sport"),
        F.col("dst_ip").alias("dstip"), text("dst_port").alias("dsport"),
        F.lower("protocol").alias("proto"), state.alias("state"),
        (F.col("duration_ms") / 1000).cast("bigint").cast("string").alias("dur"),
        text("bytes_sent").alias("sbytes"), text("bytes_received").alias("dbytes"),
        text("packets").alias("Spkts"), F.lit("3").alias("Dpkts"),
        F.expr("cast(ts_us div 1000000 as string)").alias("Stime"),
        F.when(benign, "Normal").otherwise("Fuzzers").alias("attack_cat"),
        F.when(F.col("seq") % 2 == 0, "").when(benign, "0").otherwise("1").alias("Label"))
    have = {N.header_key(c): c for c in raw.columns}
    official = raw.select("seq", *[(F.col(have[N.header_key(c)]) if N.header_key(c) in have else F.lit("0"))
                                   .alias(c) for c in UNSW_RAW_COLUMNS])
    folder = csv_files(raw.filter("seq % 2 = 0"), [c for c in raw.columns if c != "seq"])
    plain = csv_files(official.filter("seq % 2 = 1"), UNSW_RAW_COLUMNS, headers=False)
    rows = D.read_unsw(spark, [f"{folder}/*", f"{plain}/*"])
    return D.strict_rows(D.normalize_unsw(rows, FILE_ORDER)).drop(*FILE_ORDER)


@query("convert_dataset", with_(FLOWS, _SECONDS, context("sec", "src_ip", "seq", "rst_count > 0")) + f"""
  SELECT seq, {iso('ts_us')} AS timestamp, src_ip, dst_ip, protocol, {_FLOW_NUMBERS},
    unique_dst_ports_60s, connections_60s, failed_connections_60s, label FROM ctx""")
def convert_dataset(spark, d):
    """Public dataset to flows with context; whole-second times make many equal timestamps."""
    rows = D.strict_rows(D.normalize_cicids(cicids_raw(spark, d), _FORMAT, ["seq"]))
    return D.contextualize(rows, ["seq"]).select("seq", *FLOW_COLUMNS)


@query("row_rejects", with_(FLOWS) + """SELECT seq, CASE WHEN seq % 100 = 1 THEN 'missing src_ip'
    WHEN seq % 100 = 2 THEN 'invalid duration_ms' WHEN seq % 100 = 3 THEN 'invalid dst_port'
    WHEN seq % 100 = 4 THEN 'invalid ts_us' ELSE 'invalid dst_ip' END AS error
  FROM flows WHERE seq % 100 BETWEEN 1 AND 5""")
def row_rejects(spark, d):
    """Five kinds of bad rows among good ones."""
    kind = F.col("seq") % 100
    raw = cicids_raw(spark, d).withColumns({
        " Source IP": F.when(kind == 1, " ").otherwise(F.col(" Source IP")),
        " Flow Duration": F.when(kind == 2, "Infinity").otherwise(F.col(" Flow Duration")),
        " Destination Port": F.when(kind == 3, "65536").otherwise(F.col(" Destination Port")),
        " Timestamp": F.when(kind == 4, "yesterday").otherwise(F.col(" Timestamp")),
        " Destination IP": F.when(kind == 5, "10.0.0.256").otherwise(F.col(" Destination IP"))})
    return D.reject_rows(D.normalize_cicids(raw, _FORMAT, ["seq"]))[1].select("seq", "error")


# ------------------------------------------------------------------ single fields

def _texts(spark, d, **columns):
    """The flows with text columns made from ``k = seq % 10``."""
    rows = X.flows(spark, d).withColumn("k", F.col("seq") % 10)
    return rows.selectExpr("seq", *[f"{sql} AS {name}" for name, sql in columns.items()])


def _case(*pairs, other: str) -> str:
    """One CASE text that both engines read alike."""
    return "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in pairs) + f" ELSE {other} END"


_K = "kf AS (SELECT *, seq % 10 AS k FROM flows)"


@query("alias_coalesce", with_(FLOWS, _K) + """SELECT seq, CASE k WHEN 0 THEN src_ip WHEN 1 THEN src_ip
    WHEN 2 THEN NULL ELSE dst_ip END AS value FROM kf""")
def alias_coalesce(spark, d):
    rows = _texts(spark, d, a=_case((0, "''"), (1, "'  '"), (2, "NULL"), other="' ' || dst_ip"),
                  b=_case((2, "' '"), other="src_ip || ' '"))
    return rows.select("seq", N.first_filled(["a", "b"]).alias("value"))


_NUMBERS = _case((0, "'Infinity'"), (1, "'NaN'"), (2, "'-1'"), (3, "'abc'"), (4, "''"),
                 (5, "cast(packets as string) || '.5'"), (6, "' 2.0 '"), (7, "'1e3'"),
                 other="cast(bytes_sent as string)")


@query("number_validate", with_(FLOWS, _K) + """SELECT seq, CASE WHEN k < 5 THEN NULL
    WHEN k = 5 THEN (packets + 0.5) * 1000 WHEN k = 6 THEN 2000 WHEN k = 7 THEN 1000000
    ELSE bytes_sent * 1000 END::DOUBLE AS value FROM kf""")
def number_validate(spark, d):
    return _texts(spark, d, t=_NUMBERS).select("seq", N.number("t", 1000.0).alias("value"))


@query("integer_validate", with_(FLOWS, _K) + """SELECT seq, CASE WHEN k <= 5 THEN NULL
    WHEN k = 6 THEN 2 WHEN k = 7 THEN 1000 ELSE bytes_sent END::BIGINT AS value FROM kf""")
def integer_validate(spark, d):
    return _texts(spark, d, t=_NUMBERS).select("seq", N.integer("t").alias("value"))


@query("port_parse", with_(FLOWS, _K) + """SELECT seq, CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN NULL
    WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 443 ELSE src_port END::INT AS port FROM kf""")
def port_parse(spark, d):
    rows = _texts(spark, d, t=_case(
        (0, "''"), (1, "'-'"), (2, "'65536'"), (3, "'0xzz'"), (4, "'-5'"), (5, "'443.0'"),
        (6, "'0x' || lower(hex(src_port))"), (7, "'0X' || hex(src_port)"),
        other="cast(src_port as string)"))
    return rows.select("seq", N.port("t").alias("port"))


@query("ipv4_canonical", with_(FLOWS, _K) + """SELECT seq, CASE k WHEN 0 THEN NULL WHEN 1 THEN NULL
    WHEN 2 THEN NULL WHEN 3 THEN '2001:db8::' || lower(to_hex(src_port)) WHEN 4 THEN NULL
    ELSE src_ip END AS ip FROM kf""")
def ipv4_canonical(spark, d):
    """Leading zeros, large octets and short forms are no addresses; IPv6 text is compressed."""
    rows = _texts(spark, d, t=_case(
        (0, "'0' || src_ip"), (1, "'256.1.1.1'"), (2, "'10.0.1'"),
        (3, "'2001:0DB8:0:0:0:0:0:' || hex(src_port)"), (4, "'2001:db8:::1'"), other="src_ip"))
    return rows.select("seq", address_text("t").alias("ip"))


@query("protocol_map", with_(FLOWS, _K) + """SELECT seq, CASE k WHEN 0 THEN 'TCP' WHEN 1 THEN 'TCP'
    WHEN 2 THEN 'UDP' WHEN 3 THEN 'UDP' WHEN 4 THEN 'ICMP' ELSE protocol END AS protocol FROM kf""")
def protocol_map(spark, d):
    rows = _texts(spark, d, t=_case((0, "'6'"), (1, "' 6.0'"), (2, "'17'"), (3, "'17.0 '"),
                                    (4, "' icmp'"), other="lower(protocol)"))
    return rows.select("seq", N.protocol("t").alias("protocol"))


_CLOCK = "tf AS (SELECT event_id AS seq, event_id % 10 AS k, date_trunc('second', ts) AS s FROM events)"


def _stamps(spark, d):
    return X.table(spark, d, "events").select(
        F.col("event_id").alias("seq"), (F.col("event_id") % 10).alias("k"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("s"))


@query("ts_parse_fmt", with_(_CLOCK) + """SELECT seq, CASE WHEN k = 0 THEN NULL ELSE epoch_us(s) END AS us
  FROM tf""")
def ts_parse_fmt(spark, d):
    text = F.when(F.col("k") == 0, F.lit("2024-01-01 00:00:00")).otherwise(
        F.date_format("s", "MM/dd/yyyy HH:mm:ss"))
    return _stamps(spark, d).select("seq", F.unix_micros(N.timestamp(text, _FORMAT)).alias("us"))


@query("ts_parse_multi", with_(_CLOCK, """x AS (SELECT seq, k, s, CASE WHEN k = 0 THEN 'no time'
    WHEN k < 4 THEN strftime(s, '%Y-%m-%dT%H:%M:%S') WHEN k < 6 THEN strftime(s, '%m/%d/%Y %H:%M:%S')
    WHEN k < 8 THEN strftime(s, '%m/%d/%Y %H:%M') WHEN k = 8 THEN strftime(s, '%d/%m/%Y %H:%M:%S')
    ELSE strftime(s, '%d/%m/%Y %H:%M') END AS t FROM tf)""") + """SELECT seq, epoch_us(coalesce(
    try_strptime(t, '%Y-%m-%dT%H:%M:%S'), try_strptime(t, '%m/%d/%Y %H:%M:%S'),
    try_strptime(t, '%m/%d/%Y %H:%M'), try_strptime(t, '%d/%m/%Y %H:%M:%S'),
    try_strptime(t, '%d/%m/%Y %H:%M'))) - CASE WHEN k = 3 THEN 7200000000 ELSE 0 END AS us FROM x""")
def ts_parse_multi(spark, d):
    """ISO with and without zone, then month-first before day-first."""
    k = F.col("k")
    text = (F.when(k == 0, "no time")
            .when(k == 3, F.concat(F.date_format("s", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
            .when(k < 4, F.date_format("s", "yyyy-MM-dd'T'HH:mm:ss"))
            .when(k < 6, F.date_format("s", "M/d/yyyy H:mm:ss"))
            .when(k < 8, F.date_format("s", "MM/dd/yyyy HH:mm"))
            .when(k == 8, F.date_format("s", "dd/MM/yyyy HH:mm:ss"))
            .otherwise(F.date_format("s", "d/M/yyyy H:mm")))
    return _stamps(spark, d).select("seq", F.unix_micros(N.timestamp(text)).alias("us"))


@query("ts_iso_text", """SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S')
    || CASE WHEN event_id % 3 = 0 OR epoch_us(ts) % 1000000 = 0 THEN ''
       ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END
    || CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE '' END AS text FROM events""")
def ts_iso_text(spark, d):
    """Text with a zone keeps one, naive text stays naive; a zero fraction is not printed."""
    ts = F.col("ts").cast("timestamp")
    shown = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    text = F.concat(shown, F.when(F.col("event_id") % 2 == 0, "+00:00").otherwise(""))
    rows = X.table(spark, d, "events").select(F.col("event_id").alias("seq"), text.alias("t"))
    return rows.select("seq", N.timestamp_text(F.col("t"), N.timestamp("t")).alias("text"))


@query("epoch_to_iso", with_(FLOWS) + f"""SELECT seq, {iso('(ts_us // 1000000 * 1000000 + seq % 2 * 250000)')}
    || 'Z' AS text FROM flows""")
def epoch_to_iso(spark, d):
    rows = X.flows(spark, d).selectExpr(
        "seq", "cast(ts_us div 1000000 as string) || if(seq % 2 = 0, '', '.25') AS t")
    return rows.select("seq", N.us_text(N.epoch_us("t")).alias("text"))


@query("failure_flags", with_(SNAPSHOTS) + """SELECT state, count(*) AS rows,
    count(*) FILTER (WHERE lower(state) IN ('closed', 'deletetcb')) AS failed,
    count(*) FILTER (WHERE lower(state) IN ('synsent', 'synreceived')) AS syn
  FROM snapshots GROUP BY state""")
def failure_flags(spark, d):
    from flowrisk.operators.snapshots import as_flows
    return as_flows(polled(spark, d)).groupBy("state").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("failed").alias("failed"),
        F.sum("syn_count").alias("syn"))


_LABELS = _case((0, "'BENIGN'"), (1, "' 0 '"), (2, "'Normal.'"), (3, "'1'"), (4, "'DoS Hulk'"),
                (5, "''"), other="label")


@query("label_binary", with_(FLOWS, _K) + """SELECT seq, CASE WHEN k < 3 THEN 'benign' WHEN k < 6 THEN 'attack'
    ELSE label END AS label FROM kf""")
def label_binary(spark, d):
    return _texts(spark, d, t=_LABELS).select("seq", N.dataset_label("t").alias("label"))


@query("label_to_int", with_(FLOWS, _K) + """SELECT seq, CASE WHEN k IN (0, 1) THEN 0 WHEN k = 3 THEN 1
    WHEN k IN (2, 4, 5) THEN NULL WHEN label = 'attack' THEN 1 ELSE 0 END::INT AS label FROM kf""")
def label_to_int(spark, d):
    return _texts(spark, d, t=_LABELS).select("seq", N.label_int("t").alias("label"))


# ------------------------------------------------------------------ snapshots and logs

_CONN = "local_address, local_port, remote_address, remote_port, state, owning_process, process_name"


@query("snapshot_scan", with_(SNAPSHOTS) + """SELECT host, snapshot_no, local_address,
    CAST(local_port AS BIGINT) AS local_port, remote_address, CAST(remote_port AS BIGINT) AS remote_port,
    CASE WHEN pid % 4 = 0 THEN 'Unknown' ELSE state END AS state,
    CAST(CASE WHEN pid % 4 = 0 THEN 0 ELSE pid END AS BIGINT) AS owning_process,
    CASE WHEN pid % 2 = 0 THEN 'unknown' ELSE 'p' || CAST(pid AS VARCHAR) END AS process_name
  FROM snapshots""")
def snapshot_scan(spark, d):
    """A file per host and poll, each a JSON array: connections, with some keys missing or empty and some ports as text,
    a listening socket, and elements that are no objects."""
    known = F.col("pid") % 4 != 0
    connection = F.struct(
        "local_address", "local_port", "remote_address",
        F.when(known, F.col("remote_port").cast("string")).alias("remote_port"),
        F.when(known, F.col("state")).alias("state"), F.when(known, F.col("pid")).alias("owning_process"),
        F.when(F.col("pid") % 2 == 0, "").otherwise(
            F.concat(F.lit("p"), F.col("pid").cast("string"))).alias("process_name"))
    text = F.when(known, F.to_json(connection)).otherwise(
        F.to_json(connection.withField("remote_port", F.col("remote_port"))))
    rows = X.snapshots(spark, d).select("host", "snapshot_no", text.alias("t"))
    files = rows.groupBy("host", "snapshot_no").agg(F.concat(
        F.lit('\ufeff[{"remote_port":0,"local_port":135},7,"x",'), F.array_join(F.collect_list("t"), ","),
        F.lit("]")).alias("value"))
    folder = shared_path(spark, "snapshots")
    files.write.partitionBy("host", "snapshot_no").option("lineSep", " ").text(folder)
    return C.read_connections(spark, folder).drop("file").withColumn("snapshot_no", F.col("snapshot_no").cast("bigint"))


@query("netstat_parse", with_(SNAPSHOTS) + """SELECT host, snapshot_no,
    CASE WHEN pid % 3 = 0 THEN 'fe80::1' ELSE local_address END AS local_address,
    CAST(local_port AS BIGINT) AS local_port, remote_address, CAST(remote_port AS BIGINT) AS remote_port,
    CASE state WHEN 'SynSent' THEN 'SynSent' WHEN 'Closed' THEN 'Closed' ELSE 'BOUND' END AS state,
    CAST(pid AS BIGINT) AS owning_process
  FROM snapshots WHERE pid % 9 <> 8""")
def netstat_parse(spark, d):
    """Files of netstat lines; listening, UDP and short lines drop out, an unknown state stays."""
    local = F.when(F.col("pid") % 3 == 0, "[fe80::1]").otherwise(F.col("local_address"))
    state = F.when(F.col("state") == "SynSent", "SYN_SENT").when(
        F.col("state") == "Closed", "CLOSED").otherwise("BOUND")
    line = F.concat(F.lit("  TCP    "), local, F.lit(":"), F.col("local_port").cast("string"),
                    F.lit("    "), F.col("remote_address"), F.lit(":"),
                    F.col("remote_port").cast("string"), F.lit("   "),
                    F.when(F.col("pid") % 9 == 8, "LISTENING").otherwise(state), F.lit("   "),
                    F.col("pid").cast("string"))
    lines = X.snapshots(spark, d).select("host", "snapshot_no", F.explode(F.array(
        line, F.lit("  UDP    0.0.0.0:53   *:*    77"), F.lit("Active Connections"))).alias("value"))
    folder = shared_path(spark, "netstat")
    (lines.select("host", F.concat_ws("|", "value", F.col("snapshot_no").cast("string")).alias("value"))
     .write.partitionBy("host").text(f"{folder}/numbered"))
    numbered = spark.read.text(f"{folder}/numbered")
    cut = F.split("value", r"\|")
    return C.parse_netstat(numbered.select("host", cut[1].cast("bigint").alias("snapshot_no"),
                                           cut[0].alias("value")), keep=["host", "snapshot_no"])


@query("process_dim", """SELECT user_id AS pid, 'image' || CAST(max(event_id) AS VARCHAR) AS process_name
  FROM events WHERE event_id % 3 <> 0 GROUP BY user_id""")
def process_dim(spark, d):
    """Process lists written one after the other; the last name of a pid wins, lines without a number
    drop out."""
    events = X.table(spark, d, "events").select(
        "event_id", "user_id", F.concat(F.lit("image"), F.col("event_id").cast("string")).alias("name"),
        F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("pid"))
    folder, half = shared_path(spark, "processes"), events.agg(F.max("event_id")).first()[0] // 2
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        (events.filter(part).repartition("user_id").sortWithinPartitions("event_id").select("name", "pid")
         .write.mode("append").csv(folder))
    return C.read_processes(spark, folder)


@query("alerts_scan", with_(*ALERTS) + """SELECT seq % 10 < 3 AS is_bad,
    CASE WHEN seq % 10 < 3 THEN NULL ELSE severity END AS severity,
    CASE WHEN seq % 10 < 3 THEN NULL ELSE risk_score END AS risk_score,
    CASE WHEN seq % 10 < 3 THEN NULL ELSE array_to_string(rule_list, ',') END AS rule_ids
  FROM alerts WHERE seq % 10 <> 9""")
def alerts_scan(spark, d):
    """Files of alert lines with broken, non-object and blank ones among them."""
    rows = alerts(spark, d)
    k = F.col("seq") % 10
    text = F.to_json(F.struct(*[c for c in rows.columns if c in ALERT.names]))
    line = (F.when(k == 0, "{partial").when(k == 1, "[1]").when(k == 2, '"x"').when(k == 9, "  ")
            .otherwise(text))
    folder = shared_path(spark, "alert-lines")
    rows.select(line.alias("value")).write.text(folder)
    return read_tolerant(spark, folder, ALERT).select(
        "is_bad", "severity", "risk_score", F.array_join("rule_ids", ",").alias("rule_ids"))


@query("feedback_ids", with_(*ALERTS) + "SELECT DISTINCT alert_id FROM alerts WHERE seq % 7 = 0 AND seq % 3 <> 0")
def feedback_ids_query(spark, d):
    """Queue lines, each twice; malformed ids and broken lines are ignored."""
    queue = pending_queue(alerts(spark, d))
    shown = queue.withColumn("alert_id", F.when(
        F.col("seq") % 3 == 0, F.upper(F.concat(F.lit("X"), "alert_id"))).otherwise(F.col("alert_id")))
    text = F.to_json(F.struct(*PENDING.names))
    lines = shown.select(F.explode(F.array(text, text, F.lit("{broken"))).alias("value"))
    return feedback_ids(parse_tolerant(lines, PENDING))
