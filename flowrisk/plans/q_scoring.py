"""Queries on features, rules, scores and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.constants import FEATURE_NAMES
from flowrisk.functions import scoring as S
from flowrisk.functions.model import BASELINE, LinearModel, load_model, save_model
from flowrisk.functions.normalize import us_text
from flowrisk.operators import feedback as B
from flowrisk.plans import fixtures as X
from flowrisk.plans.oracle import ALERTS, CTX, FLOWS, SCORED, features, with_
from flowrisk.plans.registry import query
from flowrisk.session import shared_path, stage

_F = ", ".join(f"round(f_{n}, 6) AS f_{n}" for n in FEATURE_NAMES)
_TOPS = ", ".join(f"_top[{i}].n AS top{i}_name, _top[{i}].v AS top{i}_value, "
                  f"_top[{i}].c AS top{i}_contribution" for i in (1, 2, 3))


def scored(spark, d) -> DataFrame:
    return S.with_scores(X.context_flows(spark, d))


def found(spark, d, flows: DataFrame | None = None) -> DataFrame:
    """Detections of all flows with ``seq`` and ``ts_us``; ``flows`` are those with context, if they are known."""
    flows = (X.context_flows(spark, d) if flows is None else flows).withColumn("timestamp", us_text("ts_us"))
    return S.detections(flows, keep=["seq", "ts_us", "src_port"])


def alerts(spark, d, *columns: str, flows: DataFrame | None = None) -> DataFrame:
    """The alert table with ids, or the named columns of it: written once, as the jobs that follow use it more
    than once. What is not named is not computed."""
    rows = found(spark, d, flows).filter("is_alert").withColumn("alert_id", B.alert_id())
    return stage(rows.select(*columns) if columns else rows, "alerts")


@query("features", with_(FLOWS, CTX, features()) + f"SELECT seq, {_F} FROM feat")
def features_query(spark, d):
    return S.with_features(X.context_flows(spark, d)).select(
        "seq", *[F.round(f"f_{n}", 6).alias(f"f_{n}") for n in FEATURE_NAMES])


@query("model_score", with_(*SCORED) + "SELECT seq, model_score FROM scored")
def model_score(spark, d):
    return scored(spark, d).select("seq", F.round("p_model", 4).alias("model_score"))


@query("top_features", with_(*SCORED) + f"SELECT seq, {_TOPS} FROM scored")
def top_features(spark, d):
    rows = S.with_explanation(S.with_features(X.context_flows(spark, d)), BASELINE, 3)
    return rows.select("seq", *[F.col("top_features")[i][field].alias(f"top{i + 1}_{name}")
                                for i in range(3) for field, name in (
        ("name", "name"), ("value", "value"), ("contribution", "contribution"))])


@query("rule_hits", with_(*SCORED) +
       "SELECT seq, array_to_string(rule_list, ',') AS rule_ids, rule_score FROM scored")
def rule_hits(spark, d):
    return S.with_rules(X.context_flows(spark, d)).select(
        "seq", F.array_join(S.rule_ids(), ",").alias("rule_ids"),
        S.rule_score().alias("rule_score"))


@query("risk_score", with_(*SCORED) + "SELECT seq, risk_score FROM scored")
def risk_score(spark, d):
    return scored(spark, d).select("seq", F.round("p_risk", 4).alias("risk_score"))


@query("severity", with_(*SCORED) + "SELECT seq, severity, is_alert FROM scored")
def severity(spark, d):
    return scored(spark, d).select("seq", "severity", "is_alert")


@query("reasons", with_(*SCORED) + "SELECT seq, array_to_string(reasons, '|') AS reasons FROM scored")
def reasons(spark, d):
    return scored(spark, d).select("seq", F.array_join(S.reasons(0.60), "|").alias("reasons"))


_DETECTION = ("dst_ip, src_ip, dst_port, protocol, model_score, rule_score, risk_score, severity, "
              "is_alert")


@query("detections", with_(*ALERTS[:-1]) + f"""SELECT seq, {_DETECTION},
    array_to_string(reasons, '|') AS reasons, array_to_string(rule_list, ',') AS rule_ids,
    len(rule_list) AS evidence, _top[1].n AS top_name, 'bootstrap_linear_risk_model'
    AS model_algorithm, '0.1.0' AS model_version, round(f_avg_packet_bytes, 6) AS avg_packet_bytes
  FROM scored""")
def detections(spark, d):
    return found(spark, d).select(
        "seq", *_DETECTION.split(", "), F.array_join("reasons", "|").alias("reasons"),
        F.array_join("rule_ids", ",").alias("rule_ids"),
        F.size("rule_evidence").cast("bigint").alias("evidence"),
        F.col("top_features")[0]["name"].alias("top_name"), "model_algorithm", "model_version",
        F.col("feature_snapshot.avg_packet_bytes").alias("avg_packet_bytes"))


@query("alerts_only", with_(*SCORED) + "SELECT seq, risk_score, severity FROM scored WHERE is_alert")
def alerts_only(spark, d):
    return scored(spark, d).filter("is_alert").select(
        "seq", F.round("p_risk", 4).alias("risk_score"), "severity")


@query("alert_id", with_(*ALERTS) + "SELECT seq, alert_id, timestamp FROM alerts")
def alert_id(spark, d):
    return alerts(spark, d, "seq", "alert_id", "timestamp")


@query("alert_search", with_(*ALERTS) + """SELECT seq, alert_id, severity FROM alerts
  WHERE severity = 'critical' AND contains(lower(concat_ws(' ', timestamp, src_ip, dst_ip,
    CAST(src_port AS VARCHAR), CAST(dst_port AS VARCHAR), protocol, severity,
    'bootstrap_linear_risk_model', '0.1.0', array_to_string(reasons, ' '),
    array_to_string(rule_list, ' '))), 'brute_force')""")
def alert_search(spark, d):
    return B.search_alerts(alerts(spark, d), "critical", " BRUTE_FORCE ").select(
        "seq", "alert_id", "severity")


@query("severity_counts", with_(*ALERTS) +
       "SELECT severity, count(*) AS alerts FROM alerts GROUP BY severity")
def severity_counts(spark, d):
    return B.severity_counts(scored(spark, d).filter("is_alert"))


@query("last_alerts", with_(*ALERTS) +
       "SELECT seq, alert_id, severity FROM alerts WHERE severity = 'high' ORDER BY seq DESC LIMIT 50")
def last_alerts(spark, d):
    return B.last_alerts(B.search_alerts(alerts(spark, d), "high"), 50).select(
        "seq", "alert_id", "severity")


@query("expectation_audit", with_(*SCORED, """x AS (SELECT seq, is_alert, rule_list,
    CASE WHEN label = 'benign' THEN NULL WHEN dst_port IN (4444, 5555) THEN 'SUSPICIOUS_PORT'
         ELSE 'BRUTE_FORCE' END AS expected_rule FROM scored)""") + """
  SELECT seq, expected_rule, CASE WHEN expected_rule IS NULL THEN NOT is_alert
    ELSE is_alert AND list_contains(rule_list, expected_rule) END AS passed FROM x""")
def expectation_audit(spark, d):
    """Labelled scenarios name the rule they must raise; unlabelled ones must stay silent."""
    expected = (F.when(F.col("label") == "benign", F.lit(None))
                .when(F.col("dst_port").isin(4444, 5555), "SUSPICIOUS_PORT")
                .otherwise("BRUTE_FORCE"))
    rows = scored(spark, d).select("seq", "is_alert", S.rule_ids().alias("rule_ids"),
                                   expected.alias("expected_rule"))
    return rows.select("seq", "expected_rule", F.when(
        F.col("expected_rule").isNull(), ~F.col("is_alert")).otherwise(
        F.col("is_alert") & F.array_contains("rule_ids", F.col("expected_rule"))).alias("passed"))


@query("model_table", with_(FLOWS, """m AS (SELECT label, avg(duration_ms) AS a, avg(packets) AS b,
    stddev_pop(duration_ms) AS c FROM flows GROUP BY label)""") +
       """SELECT label, round(a, 6) AS mean_duration, round(b, 6) AS mean_packets,
          round(greatest(c, 1e-9), 6) AS scale_duration FROM m""")
def model_table(spark, d):
    """A model for each of the two labels, fitted to its mean flow, saved to a file and loaded again."""
    means = X.flows(spark, d).groupBy("label").agg(
        F.avg("duration_ms").alias("a"), F.avg("packets").alias("b"), F.stddev_pop("duration_ms").alias("c"))
    out = []
    for r in means.collect():  # benign and attack
        path = shared_path(spark, "model")
        save_model(spark, LinearModel([r.a, r.b, *BASELINE.means[2:]], [r.c, *[1.0] * 9], BASELINE.weights, BASELINE.bias), path)
        model = load_model(spark, path)
        out.append((r.label, round(model.means[0], 6), round(model.means[1], 6), round(model.scales[0], 6)))
    return spark.createDataFrame(out, "label string, mean_duration double, mean_packets double, scale_duration double")


@query("analyze", with_(*SCORED) + """SELECT severity, count(*) AS alerts,
    round(avg(risk_score), 6) AS mean_risk, count(DISTINCT src_ip) AS sources
  FROM scored WHERE is_alert GROUP BY severity""")
def analyze(spark, d):
    """Flows to context to scores to alerts, summed up by severity."""
    return scored(spark, d).filter("is_alert").groupBy("severity").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.round(F.avg(F.round("p_risk", 4)), 6).alias("mean_risk"),
        F.count_distinct("src_ip").alias("sources"))


@query("alerts_view", with_(*ALERTS, """p AS (SELECT DISTINCT alert_id FROM alerts WHERE seq % 7 = 0)""")
       + """SELECT severity, count(*) AS alerts, count(p.alert_id) AS with_feedback
  FROM alerts LEFT JOIN p USING (alert_id) GROUP BY severity""")
def alerts_view(spark, d):
    """What the alert page shows: alerts and how many have feedback, by severity."""
    rows = alerts(spark, d, "seq", "alert_id", "severity")
    flagged = B.flag_feedback(rows, rows.filter("seq % 7 = 0"))
    return flagged.groupBy("severity").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if("has_feedback").alias("with_feedback"))
