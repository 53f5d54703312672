"""Queries on the review loop: queue, ledger, block plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowrisk.functions.address import ipv4_number
from flowrisk.operators import feedback as B
from flowrisk.operators import response as R
from flowrisk.operators.training import feedback_cap, training_union
from flowrisk.plans import fixtures as X
from flowrisk.plans.oracle import ALERTS, FEATURES, FLOWS, with_
from flowrisk.plans.q_scoring import alerts, scored
from flowrisk.plans.registry import query
from flowrisk.session import shared_path, stage
from flowrisk.sources.allowlist import allowlist_ranges as ranges_of
from flowrisk.sources.allowlist import read_allowlist

REVIEWED_AT = "2024-02-01T00:00:00+00:00"


def pending_queue(rows):
    """Every seventh alert is reported as a false positive."""
    return rows.filter("seq % 7 = 0").select(
        "seq", "alert_id", F.lit("false_positive").alias("label"), F.lit("").alias("note"),
        F.lit("pending").alias("review_status"), F.lit(REVIEWED_AT).alias("created_at"))


def ledger(rows):
    """Every fourteenth alert is approved."""
    return rows.filter("seq % 14 = 0").select(
        "seq", "alert_id", F.lit("approve").alias("decision"), F.lit(0).alias("training_label"),
        F.col("feature_snapshot").alias("features"))


def approved_ledger(spark, d, flows):
    """The ledger of flows with context; alerts that it does not hold are not made."""
    return ledger(alerts(spark, d, "seq", "alert_id", "feature_snapshot", flows=flows.filter("seq % 14 = 0")))


_PENDING = "pending AS (SELECT * FROM alerts WHERE seq % 7 = 0)"
_LEDGER = "ledger AS (SELECT * FROM alerts WHERE seq % 14 = 0)"
# Ids of rows that do not exist.
_ORPHANS = """orphans AS (SELECT substr(sha256('missing|' || CAST(seq AS VARCHAR)), 1, 16) AS alert_id
  FROM flows WHERE seq % 97 = 0)"""


def orphans(spark, d):
    return X.flows(spark, d).filter("seq % 97 = 0").select(F.substring(F.sha2(F.concat(
        F.lit("missing|"), F.col("seq").cast("string")), 256), 1, 16).alias("alert_id"))


@query("alerts_feedback_flag", with_(*ALERTS, _PENDING) + """
  SELECT seq, alert_id, seq % 7 = 0 AS has_feedback FROM alerts""")
def alerts_feedback_flag(spark, d):
    rows = alerts(spark, d)
    return B.flag_feedback(rows.select("seq", "alert_id"), pending_queue(rows)).select(
        "seq", "alert_id", "has_feedback")


@query("review_join", with_(*ALERTS, _PENDING) + "SELECT alert_id, seq, risk_score FROM pending")
def review_join(spark, d):
    rows = alerts(spark, d)
    return B.open_reviews(pending_queue(rows), "seq").select("alert_id").join(
        rows.select("alert_id", "seq", "risk_score"), "alert_id")


@query("review_missing", with_(*ALERTS, _PENDING, _ORPHANS) + """SELECT alert_id FROM (
    SELECT alert_id FROM alerts WHERE seq % 5 = 0 UNION SELECT alert_id FROM orphans)
  WHERE alert_id NOT IN (SELECT alert_id FROM pending)""")
def review_missing(spark, d):
    rows = alerts(spark, d)
    asked = rows.filter("seq % 5 = 0").select("alert_id").unionByName(orphans(spark, d))
    return B.missing_ids(asked, pending_queue(rows))


@query("review_new", with_(*ALERTS, _PENDING) + "SELECT alert_id FROM pending WHERE seq % 14 <> 0")
def review_new(spark, d):
    rows = alerts(spark, d)
    return pending_queue(rows).select("alert_id").join(
        ledger(rows).select("alert_id"), "alert_id", "left_anti")


@query("review_feedback", with_(*ALERTS, _PENDING) + f"""SELECT alert_id,
    'false_positive' AS feedback_label, 'approve' AS decision, 'analyst' AS reviewer,
    '{REVIEWED_AT}' AS reviewed_at, '0.1.0' AS source_model_version, 0 AS training_label,
    round(f_avg_packet_bytes, 6) AS avg_packet_bytes, f_connections_60s AS connections_60s
  FROM pending WHERE seq % 14 <> 0""")
def review_feedback(spark, d):
    rows = alerts(spark, d)
    entries = B.review_entries(rows, B.open_reviews(pending_queue(rows), "seq"), ledger(rows),
                               "approve", " analyst ", REVIEWED_AT)
    return entries.select(
        "alert_id", "feedback_label", "decision", "reviewer", "reviewed_at",
        "source_model_version", "training_label",
        F.col("features.avg_packet_bytes").alias("avg_packet_bytes"),
        F.col("features.connections_60s").alias("connections_60s"))


@query("review_counters", with_(*ALERTS, _PENDING) + """SELECT count(*) AS pending,
    count(*) FILTER (WHERE seq % 3 <> 0) AS selected,
    count(*) FILTER (WHERE seq % 3 <> 0 AND seq % 14 <> 0) AS written,
    count(*) FILTER (WHERE seq % 3 <> 0 AND seq % 14 = 0) AS already_reviewed FROM pending""")
def review_counters(spark, d):
    rows = alerts(spark, d, "seq", "alert_id", "feature_snapshot")
    queue = pending_queue(rows)
    return B.review_counters(queue, queue.filter("seq % 3 <> 0"), ledger(rows))


@query("feedback_new", with_(*ALERTS, _PENDING) + f"""SELECT alert_id, 'false_positive' AS label,
    'note ' || CAST(seq AS VARCHAR) AS note, 'pending' AS review_status,
    '{REVIEWED_AT}' AS created_at FROM alerts WHERE seq % 5 = 0 AND seq % 7 <> 0""")
def feedback_new(spark, d):
    """Requests for every fifth alert and for unknown ids; queued and unknown ones drop out."""
    rows = alerts(spark, d, "seq", "alert_id")
    asked = rows.filter("seq % 5 = 0").select(
        "alert_id", F.concat(F.lit("note "), F.col("seq").cast("string")).alias("note"))
    asked = asked.unionByName(orphans(spark, d).withColumn("note", F.lit("")))
    asked = asked.withColumn("created_at", F.lit(REVIEWED_AT))
    return B.new_feedback(asked, rows, pending_queue(rows))


@query("ledger_duplicates", with_(*ALERTS, _LEDGER) + """
  SELECT alert_id, CAST(2 AS BIGINT) AS copies FROM ledger WHERE seq % 28 = 0""")
def ledger_duplicates(spark, d):
    rows = ledger(alerts(spark, d)).select("seq", "alert_id", "decision")
    return B.ledger_duplicates(rows.unionByName(rows.filter("seq % 28 = 0")))


@query("dedup_last", with_(FLOWS) + """SELECT src_ip, arg_max(seq, seq) AS seq,
    arg_max(dst_ip, seq) AS dst_ip, arg_max(dst_port, seq) AS dst_port FROM flows GROUP BY src_ip""")
def dedup_last(spark, d):
    """The last flow of every source."""
    return B.last_per_key(X.flows(spark, d).select("src_ip", "seq", "dst_ip", "dst_port"),
                          ["src_ip"], "seq")


def _number_text(name: str) -> str:
    """SQL for a double as the shortest decimal text in the layout of Java."""
    plain = f"CAST({name} AS VARCHAR)"
    digits = f"ltrim(replace({plain}, '.', ''), '0')"
    power = (f"CASE WHEN abs({name}) >= 1 THEN length(split_part({plain}, '.', 1)) - 1 "
             f"ELSE length(ltrim(split_part({plain}, '.', 2), '0')) - length(split_part({plain}, '.', 2)) - 1 END")
    long = (f"left({digits}, 1) || '.' || coalesce(nullif(rtrim(substr({digits}, 2), '0'), ''), '0') || 'E' || CAST({power} AS VARCHAR)")
    return f"CASE WHEN {name} <> 0 AND ({name} >= 1e7 OR {name} < 1e-3) THEN {long} ELSE {plain} END"


def _field(name: str, text: str) -> str:
    return f"'{name}=' || strlen({text}) || ':' || {text}"


_FEATURE_TEXT = " || ".join(_field(n, f"({_number_text(f'CAST(round(f_{n}, 6) AS DOUBLE)')})") for n in sorted(FEATURES))


@query("ledger_digest", with_(*ALERTS, _LEDGER, """g AS (SELECT substr(alert_id, 1, 4) AS p,
    count(*) AS n, sha256(string_agg(alert_id, chr(10) ORDER BY alert_id)) AS h
  FROM ledger GROUP BY 1)""", f"""f AS (SELECT alert_id, CAST(seq AS VARCHAR) AS s, {_FEATURE_TEXT} AS t FROM ledger),
  leaves AS (SELECT sha256({_field('alert_id', 'alert_id')} || {_field('decision', "'approve'")} || 'features=' || strlen(t) || ':' || t
    || {_field('seq', 's')} || {_field('training_label', "'0'")}) AS leaf FROM f),
  counted AS (SELECT leaf, count(*) AS n FROM leaves GROUP BY leaf),
  h AS (SELECT substr(leaf, 1, 4) AS p, sum(n) AS n, sha256(string_agg(leaf || ':' || CAST(n AS VARCHAR), chr(10) ORDER BY leaf)) AS h
    FROM counted GROUP BY 1)""") + """SELECT CAST(sum(n) AS BIGINT) AS ids,
    sha256(string_agg(h, chr(10) ORDER BY p)) AS digest, (SELECT CAST(sum(n) AS BIGINT) FROM h) AS rows,
    (SELECT sha256(string_agg(h, chr(10) ORDER BY p)) FROM h) AS ledger_digest FROM g""")
def ledger_digest(spark, d):
    """The digests of the ledger's ids and of its rows."""
    rows = stage(ledger(alerts(spark, d)), "ledger")
    return B.id_digest(rows).crossJoin(B.row_digest(rows).withColumnRenamed("digest", "ledger_digest"))  # one row each


@query("feedback_cap", with_(*ALERTS, _LEDGER) + """SELECT n AS base_rows,
    greatest(1, CAST(floor(n * 0.2) AS BIGINT)) AS allowed, a AS approved,
    a <= greatest(1, CAST(floor(n * 0.2) AS BIGINT)) AS within_cap
  FROM (SELECT count(*) AS n FROM flows), (SELECT count(*) AS a FROM ledger)""")
def feedback_cap_query(spark, d):
    base = X.flows(spark, d).count()
    allowed = feedback_cap(base)
    return ledger(alerts(spark, d)).agg(F.count(F.lit(1)).alias("approved")).select(
        F.lit(base).cast("bigint").alias("base_rows"),
        F.lit(allowed).cast("bigint").alias("allowed"), "approved",
        (F.col("approved") <= allowed).alias("within_cap"))


@query("feedback_union", with_(*ALERTS, _LEDGER, f"""u AS (
    SELECT {', '.join('f_' + n for n in FEATURES)}, label_int FROM scored
    UNION ALL SELECT {', '.join(f'round(f_{n}, 6)' for n in FEATURES)}, 0 FROM ledger)""") + """
  SELECT label_int, count(*) AS rows, round(sum(f_packets), 3) AS packets,
    round(sum(f_connections_60s), 3) AS connections FROM u GROUP BY 1""")
def feedback_union(spark, d):
    both = training_union(X.context_flows(spark, d), ledger(alerts(spark, d)))
    return both.groupBy("label_int").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("f_packets"), 3).alias("packets"),
        F.round(F.sum("f_connections_60s"), 3).alias("connections"))


# ------------------------------------------------------------------ response tables

def allowlist_file(spark, lines):
    """An allowlist written to the shared folder and read as every job reads one."""
    path = shared_path(spark, "allowlist")
    lines.write.text(path)
    return read_allowlist(spark, path)


# Destinations of alerts: 198.51.0.0/18 is allowlisted and covers k < 64; two kinds of local
# addresses are mixed in.
_TARGETS = """targets AS (SELECT DISTINCT CASE WHEN seq % 50 = 0 THEN '127.0.0.' || CAST(seq % 7 AS VARCHAR)
    WHEN seq % 50 = 1 THEN '224.0.0.' || CAST(seq % 7 AS VARCHAR) ELSE dst_ip END AS ip FROM scored
    WHERE is_alert),
  plan AS (SELECT 'flowrisk-block-' || substr(sha256(ip), 1, 16) AS name, ip AS remote_address,
    CAST(600 AS BIGINT) AS duration_seconds, '2024-02-01T00:00:00+00:00' AS created_at,
    '2024-02-01T00:10:00+00:00' AS expires_at FROM targets
    WHERE ip LIKE '198.51.%' AND CAST(split_part(ip, '.', 3) AS INT) >= 64)"""


def plan(spark, d):
    target = (F.when(F.col("seq") % 50 == 0, F.concat(F.lit("127.0.0."), (F.col("seq") % 7).cast("string")))
              .when(F.col("seq") % 50 == 1, F.concat(F.lit("224.0.0."), (F.col("seq") % 7).cast("string")))
              .otherwise(F.col("dst_ip")))
    rows = scored(spark, d).filter("is_alert").select(target.alias("ip"))
    office = spark.createDataFrame([("198.51.7.7/18  # office",)], "line string")
    return R.block_plan(rows, allowlist_file(spark, office), 600,
                        F.lit("2024-02-01 00:00:00").cast("timestamp"), "ip")


@query("block_plan", with_(*ALERTS[:-1], _TARGETS) +
       "SELECT *, name || '-In' AS name_in, name || '-Out' AS name_out FROM plan")
def block_plan(spark, d):
    return plan(spark, d).select(
        "name", "remote_address", "duration_seconds", "created_at", "expires_at",
        F.col("names")[0].alias("name_in"), F.col("names")[1].alias("name_out"))


@query("block_plan_new", with_(*ALERTS[:-1], _TARGETS) + """SELECT name, remote_address FROM plan
  WHERE CAST(split_part(remote_address, '.', 4) AS INT) % 2 = 1""")
def block_plan_new(spark, d):
    """Addresses with an even last octet are blocked already."""
    rows = plan(spark, d)
    active = rows.filter((ipv4_number("remote_address") % 2) == 0)
    return R.new_blocks(rows, active).select("name", "remote_address")


@query("expired_blocks", with_(FLOWS) + """SELECT seq, CASE WHEN seq % 3 = 0 THEN 'other-'
    ELSE 'flowrisk-block-' END || CAST(seq AS VARCHAR) AS name FROM flows
  WHERE seq % 3 <> 0 AND seq % 11 <> 0 AND ts_us + 600 * 1000000 <= 1704067980000000""")
def expired_blocks(spark, d):
    """A ledger row per flow: foreign names and unreadable times stay, the rest expires after ten
    minutes. The clock stands at 13 minutes."""
    from flowrisk.functions.normalize import iso_text
    name = F.concat(F.when(F.col("seq") % 3 == 0, "other-").otherwise(R.RULE_PREFIX),
                    F.col("seq").cast("string"))
    expires = iso_text(F.timestamp_micros(F.col("ts_us") + 600_000_000))
    rows = X.flows(spark, d).select(
        "seq", name.alias("name"), F.array(F.concat(name, F.lit("-In"))).alias("names"),
        F.when(F.col("seq") % 11 == 0, "soon").when(F.col("seq") % 2 == 0, expires).otherwise(
            F.concat(expires, F.lit("+00:00"))).alias("expires_at"))
    now = F.timestamp_micros(F.lit(1_704_067_980_000_000))
    return R.expired_blocks(rows, now).select("seq", "name")


@query("allowlist_ranges", with_(FLOWS, """l AS (SELECT DISTINCT split_part(dst_ip, '.', 3) AS c,
    CAST(split_part(dst_ip, '.', 3) AS BIGINT) AS k FROM flows),
  x AS (SELECT c, k, 198::BIGINT * 16777216 + 51 * 65536 + k * 256 AS base FROM l WHERE k % 9 <> 0),
  usual(version, network, lo, hi) AS (VALUES (4, '127.0.0.0/8', '7f000000', '7fffffff'), (4, '10.0.0.0/8', '0a000000', '0affffff'),
    (4, '172.16.0.0/12', 'ac100000', 'ac1fffff'), (4, '192.168.0.0/16', 'c0a80000', 'c0a8ffff'),
    (4, '169.254.0.0/16', 'a9fe0000', 'a9feffff'), (6, '::1/128', repeat('0', 31) || '1', repeat('0', 31) || '1'),
    (6, 'fe80::/10', 'fe8' || repeat('0', 29), 'febf' || repeat('f', 28)), (6, 'fc00::/7', 'fc' || repeat('0', 30), 'fd' || repeat('f', 30)))""") + """
  SELECT 4 AS version, '198.51.' || c || CASE WHEN k % 4 = 0 THEN '.77/32' ELSE '.0/24' END AS network,
    lower(printf('%08x', base + CASE WHEN k % 4 = 0 THEN 77 ELSE 0 END)) AS lo,
    lower(printf('%08x', base + CASE WHEN k % 4 = 0 THEN 77 ELSE 255 END)) AS hi FROM x
  UNION ALL SELECT 6, '2001:db8:' || printf('%x', k + 1) || '::/48', '20010db8' || printf('%04x', k + 1) || repeat('0', 20),
    '20010db8' || printf('%04x', k + 1) || repeat('f', 20) FROM x
  UNION ALL SELECT * FROM usual""")
def allowlist_ranges(spark, d):
    """An allowlist file with comments, masks and host bits, lines for each destination network of both versions."""
    third = F.split("dst_ip", r"\.")[2]
    k = F.col("c").cast("int")
    four = F.concat(F.lit(" 198.51."), F.col("c"), F.lit(".77"), F.when(k % 4 == 0, "").when(k % 4 == 1, "/255.255.255.0")
                    .otherwise("/24"), F.lit("  # office"))
    six = F.concat(F.lit("2001:0DB8:"), F.hex(k + 1), F.lit(":0:0:0::7/48"))
    rows = X.flows(spark, d).select(third.alias("c")).distinct()
    lines = rows.filter("cast(c as int) % 9 = 0").select(F.concat(F.lit("  # "), F.col("c")).alias("line"))
    rows = rows.filter("cast(c as int) % 9 <> 0")
    lines = lines.union(rows.select(four)).union(rows.select(six)).union(rows.select(F.lit("  ")))
    return ranges_of(allowlist_file(spark, lines))


@query("longest_prefix", with_(FLOWS, """t AS (SELECT DISTINCT dst_ip, CAST(split_part(dst_ip, '.', 3) AS BIGINT) AS k,
    CAST(split_part(dst_ip, '.', 4) AS BIGINT) AS h FROM flows)""") + """
  SELECT dst_ip, CASE WHEN k % 4 = 0 AND h = 77 THEN dst_ip || '/32'
    WHEN k % 4 <> 0 AND k % 9 <> 0 AND h // 64 = 1 THEN '198.51.' || k || '.64/26'
    WHEN k % 9 <> 0 THEN '198.51.' || k || '.0/24' ELSE '198.51.0.0/16' END AS network FROM t""")
def longest_prefix(spark, d):
    """Every destination and the longest of the networks that hold it."""
    flows = X.flows(spark, d)
    rows = flows.select(F.split("dst_ip", r"\.")[2].alias("c")).distinct()
    text = lambda tail: F.concat(F.lit("198.51."), F.col("c"), F.lit(tail))
    lines = (rows.select(F.lit("198.51.9.9/16")).union(rows.filter("cast(c as int) % 4 = 0").select(text(".77")))
             .union(rows.filter("cast(c as int) % 4 <> 0 and cast(c as int) % 9 <> 0").select(text(".64/26")))
             .union(rows.filter("cast(c as int) % 9 <> 0").select(text(".3/24"))))
    seen = flows.select("dst_ip").distinct().withColumn("_bits", R.address_bits("dst_ip"))
    return seen.join(R.longest_matches(seen, allowlist_file(spark, lines)), "_bits").select("dst_ip", "network")
