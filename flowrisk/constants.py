"""Results depend on every one of them, so they are stated plainly here."""

FEATURE_NAMES = [
    "duration_ms", "packets", "bytes_total", "avg_packet_bytes", "syn_ratio", "rst_ratio",
    "unique_dst_ports_60s", "connections_60s", "failed_connections_60s", "high_risk_port",
]

HIGH_RISK_PORTS = [21, 22, 23, 445, 1433, 2375, 3306, 3389, 4444, 5432, 5900, 6379]
AUTH_PORTS = [21, 22, 23, 445, 3389, 5900]
SUSPICIOUS_PORTS = [4444, 5555, 6667, 31337]
SERVER_PORTS = [21, 22, 23, 25, 53, 80, 110, 135, 139, 143, 443, 445, 1433, 3306, 3389, 5432,
                5900, 6379]
FAILED_STATES = ["closed", "deletetcb"]
SYN_STATES = ["synsent", "synreceived"]

# Rule texts and scores.
RULE_SCORES = {
    "PORT_SCAN": 0.92,
    "BRUTE_FORCE": 0.90,
    "CONNECTION_FLOOD": 0.96,
    "DATA_SPIKE": 0.76,
    "SUSPICIOUS_PORT": 0.67,
}
RULE_REASONS = {
    "PORT_SCAN": "60 秒内访问了大量不同目标端口",
    "BRUTE_FORCE": "认证类端口出现连续连接失败",
    "CONNECTION_FLOOD": "短时间连接或 SYN 数量异常",
    "DATA_SPIKE": "短时间传输数据量异常增大",
    "SUSPICIOUS_PORT": "连接到常见恶意工具或后门端口",
}
MODEL_REASON = "统计模型发现流量特征偏离正常模式"
QUIET_REASON = "未发现达到告警阈值的异常"

# Report warnings.
WARN_TEST_ROWS = "独立测试集少于 1000 条；指标置信度有限，不能作为生产发布依据。"
WARN_BENIGN_ROWS = "独立测试集正常样本少于 1000 条；每日误报与 FPR 可能不稳定。"
WARN_TARGET = "当前阈值无法在校准集达到目标误报率。"

# The bootstrap model.
BASELINE_MODEL = {
    "feature_names": FEATURE_NAMES,
    "means": [1800.0, 28.0, 45000.0, 720.0, 0.12, 0.02, 2.0, 12.0, 0.5, 0.08],
    "scales": [4500.0, 65.0, 5000000.0, 500.0, 0.2, 0.1, 8.0, 60.0, 5.0, 0.27],
    "weights": [-0.05, 0.2, 0.18, 0.04, 0.72, 0.45, 1.1, 0.92, 1.05, 0.28],
    "bias": -3.2,
    "metadata": {
        "algorithm": "bootstrap_linear_risk_model",
        "purpose": "Development bootstrap only; replace after training on representative data",
        "version": "0.1.0",
    },
}

# Labels.
ATTACK_LABELS = ["1", "attack", "malicious", "anomaly", "true", "yes"]
BENIGN_LABELS = ["0", "benign", "normal", "false", "no"]
DATASET_BENIGN_LABELS = ["0", "benign", "normal"]

# Flow CSV columns in write order.
FLOW_COLUMNS = [
    "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "duration_ms", "packets",
    "bytes_sent", "bytes_received", "syn_count", "rst_count", "unique_dst_ports_60s",
    "connections_60s", "failed_connections_60s", "label",
]

# Public dataset headers: accepted spellings per field.
CICIDS_ALIASES = {
    "timestamp": ["Timestamp"],
    "src_ip": ["Source IP", "Src IP"],
    "dst_ip": ["Destination IP", "Dst IP"],
    "src_port": ["Source Port", "Src Port"],
    "dst_port": ["Destination Port", "Dst Port"],
    "protocol": ["Protocol"],
    "duration": ["Flow Duration"],
    "fwd_packets": ["Total Fwd Packets", "Tot Fwd Pkts"],
    "bwd_packets": ["Total Backward Packets", "Tot Bwd Pkts"],
    "fwd_bytes": ["Total Length of Fwd Packets", "TotLen Fwd Pkts"],
    "bwd_bytes": ["Total Length of Bwd Packets", "TotLen Bwd Pkts"],
    "syn": ["SYN Flag Count", "SYN Flag Cnt"],
    "rst": ["RST Flag Count", "RST Flag Cnt"],
    "label": ["Label"],
}
UNSW_ALIASES = {
    "timestamp": ["stime", "start time"],
    "src_ip": ["srcip", "src ip", "source ip"],
    "dst_ip": ["dstip", "dst ip", "destination ip"],
    "src_port": ["sport", "src port", "source port"],
    "dst_port": ["dsport", "dst port", "destination port"],
    "protocol": ["proto", "protocol"],
    "duration": ["dur", "duration"],
    "src_packets": ["spkts", "src packets"],
    "dst_packets": ["dpkts", "dst packets"],
    "src_bytes": ["sbytes", "src bytes"],
    "dst_bytes": ["dbytes", "dst bytes"],
    "state": ["state"],
    "label": ["label"],
    "attack_category": ["attack_cat", "attack category"],
}
UNSW_RAW_COLUMNS = (
    "srcip sport dstip dsport proto state dur sbytes dbytes sttl dttl sloss dloss service Sload "
    "Dload Spkts Dpkts swin dwin stcpb dtcpb smeansz dmeansz trans_depth res_bdy_len Sjit Djit "
    "Stime Ltime Sintpkt Dintpkt tcprtt synack ackdat is_sm_ips_ports ct_state_ttl "
    "ct_flw_http_mthd is_ftp_login ct_ftp_cmd ct_srv_src ct_srv_dst ct_dst_ltm ct_src_ltm "
    "ct_src_dport_ltm ct_dst_sport_ltm ct_dst_src_ltm attack_cat Label"
).split()

# netstat state names.
NETSTAT_STATES = {
    "ESTABLISHED": "Established", "SYN_SENT": "SynSent", "SYN_RECEIVED": "SynReceived",
    "TIME_WAIT": "TimeWait", "CLOSE_WAIT": "CloseWait", "FIN_WAIT_1": "FinWait1",
    "FIN_WAIT_2": "FinWait2", "LAST_ACK": "LastAck", "CLOSED": "Closed",
    "DELETE_TCB": "DeleteTcb",
}

# Networks that are never planned for blocking.
DEFAULT_ALLOWLIST = [
    "127.0.0.0/8", "::1/128", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16",
    "fe80::/10", "fc00::/7",
]

ALERT_ID_PATTERN = "^[0-9a-f]{16}$"
SEVERITIES = ["info", "medium", "high", "critical"]

# Capture container formats: magic -> (byte order, ticks per second).
CLASSIC_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
MAX_RECORD_BYTES = 64 * 1024 * 1024
LINK_ETHERNET, LINK_RAW, LINK_SLL = 1, 101, 113
IPV6_MAX_HEADERS = 8
IPV6_MAX_HEADER_BYTES = 2048

WINDOW_US = 60_000_000
