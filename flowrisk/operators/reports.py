"""The benchmark report: chronological holdout, benign calibration, test metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.operators import evaluate as E
from flowrisk.operators.splits import chronological_split
from flowrisk.session import stage


def split_scores(scored: DataFrame, calibration: float = 0.4, keep: list[str] = ()) -> DataFrame:
    """Scored flows with their split. The columns that reports need are written once."""
    rows = scored.select("seq", "ts_us", "label", "p_risk",
                         F.round("p_risk", 4).alias("risk_score"), *keep)
    return chronological_split(stage(rows, "scored"), calibration)


def calibration(split: DataFrame, target_fpr: float = 0.01) -> DataFrame:
    return E.calibrate_risk(split.filter("split = 'calibration' and label_int = 0"), target_fpr)


def test_rows(split: DataFrame, threshold: float) -> DataFrame:
    """The test period with ``hit``: the unrounded risk reaches the threshold."""
    return split.filter("split = 'test'").withColumn("hit", F.col("p_risk") >= F.lit(threshold))


def benchmark_report(scored: DataFrame, fraction: float = 0.4, target_fpr: float = 0.01,
                     day_us: str = "ts_us") -> tuple[DataFrame, DataFrame]:
    """(one-row report, rows per day) for flows scored by ``with_scores``."""
    keep = [] if day_us == "ts_us" else [day_us]
    split = split_scores(scored, fraction, keep)
    cut = calibration(split, target_fpr).first().asDict()
    rows = test_rows(split, cut["threshold"])
    daily = E.daily_false_positives(rows, F.col("hit"), day_us)
    per_day = E.false_positives_per_day(daily).drop("false_positive")
    report = E.one_row_join(E.confusion(rows, F.col("hit"), 6), per_day).withColumns(
        {name: F.lit(value).cast("bigint") if type(value) is int else F.lit(value)
         for name, value in cut.items()})
    return report, daily
