"""SQL building blocks: the same views and scores as plain DuckDB text, for checking only."""

from __future__ import annotations

EPOCH_US = 1_704_067_200_000_000


FLOWS = f"""
e AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) - {EPOCH_US} AS d,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events),
flows AS (
  SELECT event_id AS seq, CAST({EPOCH_US} + d // 7200 AS BIGINT) AS ts_us,
    CASE WHEN user_id % 10 < 2 THEN '10.0.0.1' WHEN user_id % 10 = 2 THEN '10.0.0.2'
         ELSE '10.0.1.' || CAST(user_id % 200 AS VARCHAR) END AS src_ip,
    '198.51.' || CAST(k AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR) AS dst_ip,
    CAST(40000 + event_id % 20000 AS INT) AS src_port,
    CAST(CASE event_type WHEN 'error' THEN CASE k % 8 WHEN 0 THEN 21 WHEN 1 THEN 22 WHEN 2 THEN 23
           WHEN 3 THEN 445 WHEN 4 THEN 3389 WHEN 5 THEN 5900 WHEN 6 THEN 4444 ELSE 5555 END
         WHEN 'signup' THEN 80 WHEN 'click' THEN 443 ELSE 1000 + k END AS INT) AS dst_port,
    CASE WHEN event_type = 'view' THEN 'UDP' ELSE 'TCP' END AS protocol,
    CAST(k * 1000 AS DOUBLE) AS duration_ms, CAST(20 + k AS BIGINT) AS packets,
    CAST(CASE WHEN event_type = 'purchase' AND k % 10 = 0 THEN floor(value * 4000) * 1000
         ELSE floor(value * 400) END AS BIGINT) AS bytes_sent,
    CAST(500 * k AS BIGINT) AS bytes_received, CAST(k % 3 AS BIGINT) AS syn_count,
    CAST(CASE WHEN event_type = 'error' AND k % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS rst_count,
    CASE WHEN event_type = 'error' THEN 'attack' ELSE 'benign' END AS label
  FROM e)"""

PACKETS = """
packets AS (
  SELECT epoch_us(l_shipdate) + l_linenumber * 1000000 AS ts_us,
    l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_linenumber % 2 = 1 THEN '10.1.0.' || CAST(l_suppkey % 50 AS VARCHAR)
         ELSE '10.2.0.' || CAST(l_orderkey % 40 AS VARCHAR) END AS src_ip,
    CASE WHEN l_linenumber % 2 = 1 THEN '10.2.0.' || CAST(l_orderkey % 40 AS VARCHAR)
         ELSE '10.1.0.' || CAST(l_suppkey % 50 AS VARCHAR) END AS dst_ip,
    CAST(CASE WHEN l_linenumber % 2 = 1 THEN 50000 ELSE 443 END AS INT) AS src_port,
    CAST(CASE WHEN l_linenumber % 2 = 1 THEN 443 ELSE 50000 END AS INT) AS dst_port,
    CASE WHEN l_orderkey % 5 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
    CAST(l_quantity AS BIGINT) + 40 AS byte_count,
    CAST(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS INT) AS syn,
    CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS INT) AS rst
  FROM lineitem)"""

SNAPSHOTS = f"""
snapshots AS (
  SELECT DISTINCT 'h' || CAST(user_id % 4 AS VARCHAR) AS host,
    CAST((epoch_us(ts) - {EPOCH_US}) // 7200000000 AS BIGINT) AS snapshot_no,
    '192.168.1.' || CAST(user_id % 40 AS VARCHAR) AS local_address,
    CAST(CASE WHEN event_type = 'signup' THEN 3389 ELSE 50000 + user_id % 40 END AS INT)
      AS local_port,
    '203.0.113.' || CAST(user_id % 7 AS VARCHAR) AS remote_address,
    CAST(CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'purchase' THEN 8443
         WHEN 'error' THEN 4444 ELSE 51000 END AS INT) AS remote_port,
    CASE event_type WHEN 'error' THEN 'Closed' WHEN 'view' THEN 'SynSent' ELSE 'Established' END
      AS state,
    CAST(100 + user_id % 9 AS INT) AS pid
  FROM events)"""


def context(source: str, keys: str, rank: str, failed: str, out: str = "ctx",
            port: str = "dst_port", scale: int = 1_000_000_000) -> str:
    """Frames [t - 60 s, t] in arrival order. ``rank`` numbers rows with equal time from 0 up."""
    return f"""
{out}_o AS (SELECT *, {rank} AS _n FROM {source}),
{out}_p AS (SELECT *, (ts_us - {EPOCH_US}) * {scale}::BIGINT + _n AS _o FROM {out}_o),
{out} AS (
  SELECT * EXCLUDE (_n, _o), count(*) OVER w AS connections_60s,
    CAST(count(*) FILTER (WHERE {failed}) OVER w AS BIGINT) AS failed_connections_60s,
    count(DISTINCT {port}) OVER w AS unique_dst_ports_60s
  FROM {out}_p
  WINDOW w AS (PARTITION BY {keys} ORDER BY _o
               RANGE BETWEEN ({60_000_000 * scale}::BIGINT + _n) PRECEDING AND CURRENT ROW))"""


CTX = context("flows", "src_ip", "seq", "rst_count > 0")


def iso(us: str) -> str:
    return (f"(strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} % 1000000 = 0 "
            f"THEN '' ELSE '.' || lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0') END)")


_WEIGHTS = [  # feature, mean, scale, weight
    ("duration_ms", "1800.0", "4500.0", "-0.05"), ("packets", "28.0", "65.0", "0.2"),
    ("bytes_total", "45000.0", "5000000.0", "0.18"),
    ("avg_packet_bytes", "720.0", "500.0", "0.04"), ("syn_ratio", "0.12", "0.2", "0.72"),
    ("rst_ratio", "0.02", "0.1", "0.45"), ("unique_dst_ports_60s", "2.0", "8.0", "1.1"),
    ("connections_60s", "12.0", "60.0", "0.92"), ("failed_connections_60s", "0.5", "5.0", "1.05"),
    ("high_risk_port", "0.08", "0.27", "0.28")]
FEATURES = [w[0] for w in _WEIGHTS]

RULES = {
    "PORT_SCAN": ("unique_dst_ports_60s >= 20 AND connections_60s >= 20", "0.92",
                  "60 秒内访问了大量不同目标端口"),
    "BRUTE_FORCE": ("dst_port IN (21,22,23,445,3389,5900) AND failed_connections_60s >= 10", "0.9",
                    "认证类端口出现连续连接失败"),
    "CONNECTION_FLOOD": ("(connections_60s >= 200 OR syn_count >= 100)", "0.96",
                         "短时间连接或 SYN 数量异常"),
    "DATA_SPIKE": ("bytes_sent + bytes_received >= 50000000 AND duration_ms <= 60000", "0.76",
                   "短时间传输数据量异常增大"),
    "SUSPICIOUS_PORT": ("dst_port IN (4444,5555,6667,31337)", "0.67",
                        "连接到常见恶意工具或后门端口"),
}


def features(source: str = "ctx", out: str = "feat") -> str:
    return f"""
{out} AS (
  SELECT *, CAST(duration_ms AS DOUBLE) AS f_duration_ms, CAST(packets AS DOUBLE) AS f_packets,
    CAST(bytes_sent + bytes_received AS DOUBLE) AS f_bytes_total,
    CAST(bytes_sent + bytes_received AS DOUBLE) / greatest(packets, 1) AS f_avg_packet_bytes,
    CAST(syn_count AS DOUBLE) / greatest(packets, 1) AS f_syn_ratio,
    CAST(rst_count AS DOUBLE) / greatest(packets, 1) AS f_rst_ratio,
    CAST(unique_dst_ports_60s AS DOUBLE) AS f_unique_dst_ports_60s,
    CAST(connections_60s AS DOUBLE) AS f_connections_60s,
    CAST(failed_connections_60s AS DOUBLE) AS f_failed_connections_60s,
    CASE WHEN dst_port IN (21,22,23,445,1433,2375,3306,3389,4444,5432,5900,6379) THEN 1.0::DOUBLE
         ELSE 0.0::DOUBLE END AS f_high_risk_port
  FROM {source})"""


def _part(name: str, mean: str, scale: str, weight: str) -> str:
    return f"({weight}::DOUBLE * ((f_{name} - {mean}::DOUBLE) / {scale}::DOUBLE))"


_PARTS = [_part(*w) for w in _WEIGHTS]
_TOP = "list_sort([" + ", ".join(
    f"{{'o': -abs(round({p}, 6)), 'n': '{w[0]}', 'v': round(f_{w[0]}, 6), 'c': round({p}, 6)}}"
    for p, w in zip(_PARTS, _WEIGHTS)) + "])"


def scored(source: str = "ctx", threshold: float = 0.60, out: str = "scored") -> str:
    rule = ", ".join(f"CASE WHEN {c} THEN {s}::DOUBLE ELSE 0.0::DOUBLE END"
                     for c, s, _ in RULES.values())
    ids = " || ".join(f"CASE WHEN {c} THEN ['{r}'] ELSE []::VARCHAR[] END"
                      for r, (c, _, _) in RULES.items())
    why = " || ".join(f"CASE WHEN {c} THEN ['{t}'] ELSE []::VARCHAR[] END"
                      for c, _, t in RULES.values())
    return features(source, f"{out}_f") + f""",
{out}_m AS (SELECT *, -3.2::DOUBLE + ({' + '.join(_PARTS)}) AS _z, greatest({rule}) AS p_rule,
    {_TOP} AS _top, {ids} AS rule_list, {why} AS reason_list FROM {out}_f),
{out}_q AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least(_z, 40.0::DOUBLE), -40.0::DOUBLE))) AS p_model
    FROM {out}_m),
{out}_r AS (SELECT *, least(greatest(greatest(0.7::DOUBLE * p_model + 0.3::DOUBLE * p_rule,
    p_rule * 0.9::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) AS p_risk FROM {out}_q),
{out} AS (SELECT *, CASE WHEN p_risk >= 0.85 THEN 'critical' WHEN p_risk >= 0.7 THEN 'high'
      WHEN p_risk >= {threshold} THEN 'medium' ELSE 'info' END AS severity,
    p_risk >= {threshold} AS is_alert, round(p_model, 4) AS model_score,
    round(p_rule, 4) AS rule_score, round(p_risk, 4) AS risk_score,
    CASE WHEN len(rule_list) > 0 THEN reason_list
         WHEN p_model >= {threshold} THEN ['统计模型发现流量特征偏离正常模式']
         ELSE ['未发现达到告警阈值的异常'] END AS reasons,
    CASE WHEN label = 'attack' THEN 1 ELSE 0 END AS label_int
  FROM {out}_r)"""


def alert_ids(source: str, out: str = "alerts", timestamp: str | None = None,
              where: str = "is_alert") -> str:
    """Alerts with their id; ``timestamp`` defaults to the text of ts_us."""
    stamp = timestamp or f"({iso('ts_us')} || 'Z')"
    scaled = [f"CAST(CAST(round({c} * 10000) AS BIGINT) AS VARCHAR)"
              for c in ("model_score", "rule_score", "risk_score")]
    snap = [f"CAST(CAST(round(round(f_{n}, 6) * 1000000) AS BIGINT) AS VARCHAR)" for n in FEATURES]
    parts = [stamp, "src_ip", "dst_ip", "CAST(dst_port AS VARCHAR)", "protocol", *scaled,
             "severity", "array_to_string(rule_list, ',')", "'0.1.0'", *snap]
    return f"""
{out} AS (SELECT *, {stamp} AS timestamp,
    substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 16) AS alert_id
  FROM {source} WHERE {where})"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


SCORED = [FLOWS, CTX, scored()]
ALERTS = [*SCORED, alert_ids("scored")]
