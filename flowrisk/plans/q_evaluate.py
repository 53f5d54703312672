"""Queries on splits, calibration, metrics, reports and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowrisk.constants import FEATURE_NAMES
from flowrisk.functions.normalize import strict_label_int
from flowrisk.operators import evaluate as E
from flowrisk.operators import training as T
from flowrisk.operators import reports as R
from flowrisk.operators.select import percentiles
from flowrisk.operators.splits import chronological_split, model_split
from flowrisk.plans import fixtures as X
from flowrisk.plans.oracle import CTX, FLOWS, SCORED, features, with_
from flowrisk.plans.q_scoring import scored
from flowrisk.plans.registry import query
from flowrisk.session import stage

_CONFUSION = """count(*) AS rows, count(*) FILTER (WHERE hit AND label_int = 1) AS true_positive,
  count(*) FILTER (WHERE hit AND label_int = 0) AS false_positive,
  count(*) FILTER (WHERE NOT hit AND label_int = 0) AS true_negative,
  count(*) FILTER (WHERE NOT hit AND label_int = 1) AS false_negative"""


def _rates(digits: int) -> str:
    return f"""CASE WHEN true_positive + false_positive > 0
    THEN round(true_positive / (true_positive + false_positive), {digits}) ELSE 0.0 END AS precision,
  CASE WHEN true_positive + false_negative > 0
    THEN round(true_positive / (true_positive + false_negative), {digits}) ELSE 0.0 END AS recall,
  CASE WHEN false_positive + true_negative > 0
    THEN round(false_positive / (false_positive + true_negative), {digits}) ELSE 0.0 END
    AS false_positive_rate"""


_SPLIT2 = """ranked AS (SELECT *, row_number() OVER (ORDER BY ts_us, seq) AS rn,
    count(*) OVER () AS n FROM scored),
  split AS (SELECT *, CASE WHEN rn <= greatest(1, least(n - 1, CAST(floor(n * 0.4::DOUBLE) AS BIGINT)))
    THEN 'calibration' ELSE 'test' END AS split FROM ranked)"""
_CAL = """ben AS (SELECT risk_score AS s FROM split WHERE split = 'calibration' AND label_int = 0),
  cand AS (SELECT DISTINCT s FROM ben UNION SELECT 0.0),
  tried AS (SELECT s, (SELECT count(*) FROM ben WHERE ben.s > cand.s) AS above,
    (SELECT count(*) FROM ben) AS n FROM cand WHERE s < 0.999999),
  cal AS (SELECT CASE WHEN count(*) FILTER (WHERE above / n <= 0.01) > 0
      THEN round(greatest(min(s) FILTER (WHERE above / n <= 0.01), 0.000001), 6)
      ELSE 0.999999 END AS threshold,
    coalesce(min(s) FILTER (WHERE above / n <= 0.01), 0.9999) AS boundary_score,
    round(coalesce(arg_min(above, s) FILTER (WHERE above / n <= 0.01),
      (SELECT count(*) FROM ben WHERE s >= 0.999999)) / max(n), 6)
      AS calibration_false_positive_rate,
    max(n) AS calibration_benign_rows,
    count(*) FILTER (WHERE above / n <= 0.01) > 0 AS target_met FROM tried)"""
# The alert test uses the unrounded risk; the reported threshold is rounded.
_TEST = """test AS (SELECT split.*, p_risk >= threshold AS hit FROM split, cal WHERE split = 'test')"""
_BENCH = [*SCORED, _SPLIT2, _CAL, _TEST]


def split_scored(spark, d):
    return R.split_scores(_real_days(scored(spark, d)), keep=["day_us"])


def _real_days(rows):
    """The fixture squeezes 30 days into six minutes; the daily reports undo that."""
    return rows.withColumn("day_us", F.lit(X.EPOCH_US) + (F.col("ts_us") - F.lit(X.EPOCH_US)) * 7200)


def test_rows(spark, d):
    split = split_scored(spark, d)
    return R.test_rows(split, R.calibration(split).first()["threshold"])


@query("evaluate", with_(*SCORED, f"c AS (SELECT {_CONFUSION} FROM (SELECT *, is_alert AS hit "
                         "FROM scored))") + f"SELECT *, {_rates(4)} FROM c")
def evaluate(spark, d):
    return E.confusion(scored(spark, d).withColumn("label_int", strict_label_int("label")),
                       F.col("is_alert"), 4)


@query("split2", with_(*SCORED, _SPLIT2) + "SELECT seq, split FROM split")
def split2(spark, d):
    return chronological_split(X.flows(spark, d), 0.4).select("seq", "split")


@query("split3", with_(FLOWS, """ranked AS (SELECT *, row_number() OVER (ORDER BY ts_us, seq) AS rn,
    count(*) OVER () AS n FROM flows),
  ends AS (SELECT *, greatest(1, least(n - 2, CAST(floor(n * 0.5::DOUBLE) AS BIGINT))) AS a,
    least(n - 1, CAST(floor(n * (0.5::DOUBLE + 0.2::DOUBLE)) AS BIGINT)) AS b FROM ranked)""") + """
  SELECT seq, CASE WHEN rn <= a THEN 'train' WHEN rn <= greatest(a + 1, b) THEN 'calibration'
    ELSE 'test' END AS split FROM ends""")
def split3(spark, d):
    return model_split(X.flows(spark, d)).select("seq", "split")


@query("calibrate_risk", with_(*SCORED, _SPLIT2, _CAL) + """SELECT threshold, boundary_score,
    0.01::DOUBLE AS target_false_positive_rate, calibration_false_positive_rate,
    calibration_benign_rows, target_met FROM cal""")
def calibrate_risk(spark, d):
    return R.calibration(split_scored(spark, d))


@query("calibrate_raw", with_(*SCORED, """b AS (SELECT round(p_model, 12) AS s,
    row_number() OVER (ORDER BY p_model DESC) AS rn, count(*) OVER () AS n FROM scored
    WHERE label_int = 0)""") + """
  SELECT min(s) AS boundary_score, 0.01::DOUBLE AS target_false_positive_rate,
    max(n) AS calibration_benign_rows, true AS target_met
  FROM b WHERE rn <= CAST(floor(n * 0.01) AS BIGINT) + 1""")
def calibrate_raw(spark, d):
    benign = stage(scored(spark, d).filter("label = 'benign'").select(
        F.col("p_model").alias("score")), "scores")
    return T.reports_frame(spark, [E.calibrate_raw(benign, 0.01)]).select(
        F.round("boundary_score", 12).alias("boundary_score"), "target_false_positive_rate",
        "calibration_benign_rows", "target_met")


@query("metrics6", with_(*_BENCH, f"c AS (SELECT {_CONFUSION} FROM test)") +
       f"SELECT *, {_rates(6)} FROM c")
def metrics6(spark, d):
    return E.confusion(test_rows(spark, d), F.col("hit"), 6)


_DAILY = """daily AS (SELECT CAST(make_timestamp(day_us) AS DATE) AS day, count(*) AS rows,
    count(*) FILTER (WHERE label_int = 0) AS benign_rows,
    count(*) FILTER (WHERE label_int = 1) AS attack_rows,
    count(*) FILTER (WHERE hit AND label_int = 0) AS false_positives
  FROM (SELECT *, {us} AS day_us FROM {source}) GROUP BY 1)"""
_REAL_DAY = "1704067200000000 + (ts_us - 1704067200000000) * 7200"


def daily(spark, d):
    return E.daily_false_positives(test_rows(spark, d), F.col("hit"), "day_us")


@query("daily_fpr", with_(*_BENCH, _DAILY.format(us=_REAL_DAY, source="test")) + """
  SELECT *, CASE WHEN benign_rows > 0 THEN round(false_positives / benign_rows, 6) ELSE 0.0 END
    AS false_positive_rate FROM daily""")
def daily_fpr(spark, d):
    return daily(spark, d)


@query("fp_per_day", with_(*_BENCH, _DAILY.format(us=_REAL_DAY, source="test")) + """
  SELECT count(*) AS days, CAST(sum(false_positives) AS BIGINT) AS false_positive,
    round(sum(false_positives) / greatest(count(*), 1), 6) AS false_positives_per_day FROM daily""")
def fp_per_day(spark, d):
    return E.false_positives_per_day(daily(spark, d))


def report(spark, d):
    return R.benchmark_report(_real_days(scored(spark, d)), day_us="day_us")[0]


_REPORT = [*_BENCH, f"c AS (SELECT {_CONFUSION} FROM test)", f"m AS (SELECT *, {_rates(6)} FROM c)",
           _DAILY.format(us=_REAL_DAY, source="test"),
           """fp AS (SELECT count(*) AS days, round(sum(false_positives) / greatest(count(*), 1), 6)
              AS false_positives_per_day FROM daily)""",
           "report AS (SELECT m.*, fp.*, cal.* FROM m, fp, cal)"]


@query("benchmark", with_(*_REPORT) + "SELECT *, 0.01::DOUBLE AS target_false_positive_rate FROM report")
def benchmark(spark, d):
    return report(spark, d)


@query("bench_warnings", with_(*_REPORT, """w AS (SELECT
    CASE WHEN rows < 1000 THEN ['独立测试集少于 1000 条；指标置信度有限，不能作为生产发布依据。'] ELSE []::VARCHAR[] END
    || CASE WHEN true_negative + false_positive < 1000
       THEN ['独立测试集正常样本少于 1000 条；每日误报与 FPR 可能不稳定。'] ELSE []::VARCHAR[] END
    || CASE WHEN NOT target_met THEN ['当前阈值无法在校准集达到目标误报率。'] ELSE []::VARCHAR[] END
    AS w, rows FROM report)""") + "SELECT rows, array_to_string(w, '|') AS warnings FROM w")
def bench_warnings(spark, d):
    return report(spark, d).select("rows", F.array_join(E.report_warnings(), "|").alias("warnings"))


@query("release_gate", with_(*_REPORT, """prov AS (SELECT n_name AS environment_id,
    CASE WHEN n_nationkey % 5 = 1 THEN ' ' ELSE 'owner approved' END AS authorization_scope,
    'thirty days' AS collection_period,
    CASE WHEN n_nationkey % 7 = 2 THEN NULL ELSE 'manual review' END AS labeling_method,
    n_nationkey % 3 <> 1 AS authorization_confirmed, true AS anonymization_confirmed,
    n_regionkey > 0 AS private_payloads_excluded, true AS independent_holdout_confirmed FROM nation),
  g AS (SELECT environment_id,
    coalesce(trim(environment_id) <> '', false) AS environment_id_given,
    coalesce(trim(authorization_scope) <> '', false) AS authorization_scope_given,
    coalesce(trim(collection_period) <> '', false) AS collection_period_given,
    coalesce(trim(labeling_method) <> '', false) AS labeling_method_given,
    authorization_confirmed AS authorization_confirmed_attested,
    anonymization_confirmed AS anonymization_confirmed_attested,
    private_payloads_excluded AS private_payloads_excluded_attested,
    independent_holdout_confirmed AS independent_holdout_confirmed_attested,
    target_met AS calibration_target_met, days >= 3 AS minimum_independent_days,
    true_negative + false_positive >= 1000 AS minimum_benign_rows,
    false_positive_rate <= 0.05 AS maximum_false_positive_rate,
    false_positives_per_day <= 10 AS maximum_false_positives_per_day,
    recall >= 0.2 AS minimum_recall, days AS independent_days,
    true_negative + false_positive AS benign_rows, false_positive_rate, false_positives_per_day,
    recall FROM report, prov)""") + """
  SELECT *, CASE WHEN environment_id_given AND authorization_scope_given AND collection_period_given
    AND labeling_method_given AND authorization_confirmed_attested
    AND anonymization_confirmed_attested AND private_payloads_excluded_attested
    AND independent_holdout_confirmed_attested AND calibration_target_met
    AND minimum_independent_days AND minimum_benign_rows AND maximum_false_positive_rate
    AND maximum_false_positives_per_day AND minimum_recall THEN 'passed' ELSE 'failed' END AS status
  FROM g""")
def release_gate(spark, d):
    """The gate for one statement of origin per nation, with limits the fixture can meet."""
    provenance = X.table(spark, d, "nation").selectExpr(
        "n_name AS environment_id",
        "CASE WHEN n_nationkey % 5 = 1 THEN ' ' ELSE 'owner approved' END AS authorization_scope",
        "'thirty days' AS collection_period",
        "CASE WHEN n_nationkey % 7 = 2 THEN NULL ELSE 'manual review' END AS labeling_method",
        "n_nationkey % 3 <> 1 AS authorization_confirmed", "true AS anonymization_confirmed",
        "n_regionkey > 0 AS private_payloads_excluded", "true AS independent_holdout_confirmed")
    return E.release_gate(report(spark, d), provenance, max_fpr=0.05, min_recall=0.2)


_STATS = ", ".join(f"round(avg(f_{n}), 6) AS mean_{n}, "
                   f"round(greatest(stddev_pop(f_{n}), 1.0), 6) AS scale_{n}" for n in FEATURE_NAMES)


@query("feature_stats", with_(FLOWS, CTX, features()) + f"SELECT {_STATS} FROM feat")
def feature_stats(spark, d):
    stats = T.feature_stats(T.labelled_features(X.context_flows(spark, d)))
    return stats.select(*[F.round(c, 6).alias(c) for c in stats.columns])


@query("class_counts", with_(FLOWS) + """SELECT count(*) AS training_rows,
    count(*) FILTER (WHERE label = 'attack') AS attack_rows,
    count(*) FILTER (WHERE label = 'benign') AS benign_rows FROM flows""")
def class_counts(spark, d):
    return T.class_counts(X.flows(spark, d).withColumn("label_int", strict_label_int("label")))


@query("latency_percentiles", """SELECT round(avg(value), 6) AS mean,
    round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
    round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM events""")
def latency_percentiles(spark, d):
    """Percentiles with linear interpolation over a table of measurements."""
    return percentiles(X.table(spark, d, "events"), "value", [0.5, 0.95, 0.99])


def training_rows(spark, d):
    return stage(T.labelled_features(X.context_flows(spark, d)).select(
        "seq", "label_int", *[f"f_{n}" for n in FEATURE_NAMES]), "training")


def _confusion_at(scored_rows, cut: float):
    return E.confusion(scored_rows, F.col("score") >= cut, 6)


@query("train_logistic")
def train_logistic(spark, d):
    rows = training_rows(spark, d)
    return _confusion_at(T.score_linear(T.train_logistic(rows), rows), 0.5)


@query("train_gbt")
def train_gbt(spark, d):
    rows = training_rows(spark, d)
    return _confusion_at(T.score_trees(T.train_trees(rows), rows), 0.5)


@query("train_leafwise")
def train_leafwise(spark, d):
    rows = training_rows(spark, d)
    return _confusion_at(T.train_leafwise(rows).score(rows), 0.5)


@query("train_iforest")
def train_iforest(spark, d):
    from flowrisk.operators.iforest import IsolationForest
    rows = training_rows(spark, d)
    model = IsolationForest.fit(rows.filter("label_int = 0"), T.FEATURE_COLUMNS)
    return _confusion_at(model.score(rows), 0.0)


def compared(spark, d):
    return T.compare_models(stage(X.context_flows(spark, d), "flows"), target_fpr=0.01)


@query("compare_models")
def compare_models(spark, d):
    return compared(spark, d)


@query("model_ranking")
def model_ranking(spark, d):
    return compared(spark, d).select("rank", "name", "false_positive_rate", "recall", "precision")


@query("retrain_feedback")
def retrain_feedback(spark, d):
    """Train on the flows and approved feedback, then evaluate on the flows."""
    from flowrisk.plans.q_feedback import approved_ledger
    base = stage(X.context_flows(spark, d), "flows")
    model = T.retrain_with_feedback(base, approved_ledger(spark, d, base))
    return _confusion_at(T.score_linear(model, T.labelled_features(base)), 0.5).withColumns({
        "approved_feedback_rows": F.lit(model.metadata["approved_feedback_rows"]),
        "feedback_fraction": F.lit(model.metadata["feedback_fraction"])})
