"""Threshold calibration, confusion metrics, reports and the release gate."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.constants import WARN_BENIGN_ROWS, WARN_TARGET, WARN_TEST_ROWS
from flowrisk.operators.select import kth_smallest

LOWEST, HIGHEST, BELOW_HIGHEST = 0.000001, 0.999999, 0.9999


def check_target(target_fpr: float) -> None:
    if not 0.0 <= target_fpr <= 0.5:
        raise ValueError("target_fpr must be between 0 and 0.5")


def calibrate_risk(benign: DataFrame, target_fpr: float, score: str = "risk_score") -> DataFrame:
    """One row: the smallest threshold whose false positive rate on benign rows meets the target.

    Scores have four digits, so the histogram has at most 10,001 rows; that bounds the window over
    it. A candidate lies just above a score (or zero) and so passes the strictly higher scores.

    ``threshold`` is rounded to six digits as reports print it, which puts it back on the score.
    ``boundary_score`` is for exact use: alert when the score is strictly greater.
    """
    check_target(target_fpr)
    zero = benign.sparkSession.range(1).select(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    bins = (benign.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"))
            .unionByName(zero).groupBy("s").agg(F.sum("n").alias("n")))
    higher = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = bins.select("s", "n", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("above"),
                         F.sum("n").over(Window.partitionBy()).alias("rows"))
    passes = (F.col("s") < HIGHEST) & (F.col("above") / F.col("rows") <= target_fpr)
    found = ranked.agg(
        F.max("rows").alias("rows"), F.min(F.when(passes, F.col("s"))).alias("s"),
        F.min_by("above", F.when(passes, F.col("s"))).alias("above"),
        F.sum(F.when(F.col("s") >= HIGHEST, F.col("n")).otherwise(0)).alias("top"))
    achieved = F.coalesce("above", "top") / F.col("rows")
    return found.select(
        F.when(F.col("s").isNull(), F.lit(HIGHEST)).otherwise(
            F.round(F.greatest("s", F.lit(LOWEST)), 6)).alias("threshold"),
        F.coalesce("s", F.lit(BELOW_HIGHEST)).alias("boundary_score"),
        F.lit(target_fpr).alias("target_false_positive_rate"),
        F.round(achieved, 6).alias("calibration_false_positive_rate"),
        F.col("rows").alias("calibration_benign_rows"),
        (achieved <= target_fpr).alias("target_met"))


def calibrate_raw(benign: DataFrame, target_fpr: float, score: str = "score") -> dict:
    """The same for unrounded scores: an order statistic, found without sorting.

    Scores strictly above ``boundary_score`` alert; ``threshold`` is the next number after it.
    """
    check_target(target_fpr)
    finite = ~F.isnan(score) & (F.abs(score) < float("inf"))
    rows, bad = benign.agg(F.count(score), F.count_if(~finite)).first()
    if not rows:
        raise ValueError("no benign rows to calibrate on")
    if bad:
        raise ValueError("scores must be finite")
    allowed = int(target_fpr * rows) + 1
    while allowed / rows > target_fpr:
        allowed -= 1
    boundary = kth_smallest(benign, score, rows - allowed)
    above = benign.filter(F.col(score) > F.lit(boundary)).count()
    return {"threshold": math.nextafter(boundary, math.inf), "boundary_score": boundary,
            "target_false_positive_rate": target_fpr,
            "calibration_false_positive_rate": above / rows, "calibration_benign_rows": rows,
            "target_met": above / rows <= target_fpr}


def _ratio(top: Column, bottom: Column, digits: int) -> Column:
    return F.when(bottom > 0, F.round(top / bottom, digits)).otherwise(F.lit(0.0))


def confusion(df: DataFrame, predicted: Column, digits: int, by: list[str] = (),
              label: str = "label_int") -> DataFrame:
    """Counts and rates, one row (per ``by`` group). Rates are 0 without a denominator."""
    hit, actual = predicted, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(hit & actual).alias("true_positive"),
        F.count_if(hit & ~actual).alias("false_positive"),
        F.count_if(~hit & ~actual).alias("true_negative"),
        F.count_if(~hit & actual).alias("false_negative"))
    tp, fp, tn, fn = (F.col(c) for c in (
        "true_positive", "false_positive", "true_negative", "false_negative"))
    return counts.withColumns({
        "precision": _ratio(tp, tp + fp, digits), "recall": _ratio(tp, tp + fn, digits),
        "false_positive_rate": _ratio(fp, fp + tn, digits)})


def daily_false_positives(df: DataFrame, predicted: Column, ts_us: str = "ts_us",
                          label: str = "label_int") -> DataFrame:
    """Per UTC day: rows, classes, false positives and their rate."""
    benign = F.col(label) == 0
    return (df.groupBy(F.to_date(F.timestamp_micros(ts_us)).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(benign).alias("benign_rows"),
        F.count_if(~benign).alias("attack_rows"),
        F.count_if(predicted & benign).alias("false_positives"))
        .withColumn("false_positive_rate",
                    _ratio(F.col("false_positives"), F.col("benign_rows"), 6)))


def false_positives_per_day(daily: DataFrame) -> DataFrame:
    """Days without rows do not count."""
    return daily.agg(F.count(F.lit(1)).alias("days"),
                     F.sum("false_positives").alias("false_positive")).withColumn(
        "false_positives_per_day",
        F.round(F.col("false_positive") / F.greatest("days", F.lit(1)), 6))


def report_warnings() -> Column:
    """Needs ``rows``, ``true_negative``, ``false_positive`` and ``target_met``."""
    cases = [(F.col("rows") < 1000, WARN_TEST_ROWS),
             (F.col("true_negative") + F.col("false_positive") < 1000, WARN_BENIGN_ROWS),
             (~F.col("target_met"), WARN_TARGET)]
    return F.concat(*[F.when(c, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
                      for c, text in cases])


def one_row_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join one-row reports with a small table by a constant key."""
    return left.withColumn("_k", F.lit(1)).join(
        right.withColumn("_k", F.lit(1)), "_k").drop("_k")


TEXT_CHECKS = ["environment_id", "authorization_scope", "collection_period", "labeling_method"]
ATTESTATIONS = ["authorization_confirmed", "anonymization_confirmed", "private_payloads_excluded",
                "independent_holdout_confirmed"]


def release_gate(report: DataFrame, provenance: DataFrame, min_days: int = 3,
                 min_benign_rows: int = 1000, max_fpr: float = 0.01,
                 max_false_positives_per_day: float = 10.0,
                 min_recall: float = 0.80) -> DataFrame:
    """One boolean per check and the status, for every provenance statement.

    ``report`` is the one-row benchmark with ``days`` and ``false_positives_per_day``.
    """
    if min_days < 2 or min_benign_rows < 100:
        raise ValueError("the gate needs at least 2 days and 100 benign rows")
    if not 0 <= max_fpr <= 0.5 or not 0 <= min_recall <= 1:
        raise ValueError("max_fpr or min_recall is out of range")
    benign = F.col("true_negative") + F.col("false_positive")
    checks = {f"{c}_given": F.coalesce(F.trim(c) != "", F.lit(False)) for c in TEXT_CHECKS}
    checks |= {f"{c}_attested": F.coalesce(F.col(c), F.lit(False)) for c in ATTESTATIONS}
    checks |= {
        "calibration_target_met": F.col("target_met"),
        "minimum_independent_days": F.col("days") >= min_days,
        "minimum_benign_rows": benign >= min_benign_rows,
        "maximum_false_positive_rate": F.col("false_positive_rate") <= max_fpr,
        "maximum_false_positives_per_day":
            F.col("false_positives_per_day") <= max_false_positives_per_day,
        "minimum_recall": F.col("recall") >= min_recall,
    }
    joined = one_row_join(report, provenance).withColumns(checks)
    passed = reduce(lambda a, b: a & b, [F.col(c) for c in checks])
    return joined.select(
        "environment_id", *checks, F.when(passed, "passed").otherwise("failed").alias("status"),
        F.col("days").alias("independent_days"), benign.alias("benign_rows"),
        "false_positive_rate", "false_positives_per_day", "recall")


def model_ranking(models: DataFrame) -> DataFrame:
    """Fewest false alarms first, then recall, then precision. One row per compared model."""
    order = Window.orderBy("false_positive_rate", F.desc("recall"), F.desc("precision"), "name")
    return models.withColumn("rank", F.row_number().over(order))
