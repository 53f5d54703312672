"""Training the linear model and comparing it with boosted trees and an isolation forest."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.constants import FEATURE_NAMES
from flowrisk.functions.model import LinearModel
from flowrisk.functions.normalize import strict_label_int
from flowrisk.functions.scoring import FEATURE_COLUMNS, model_probability, with_features
from flowrisk.operators.boosting import LeafwiseTrees, LevelTrees
from flowrisk.operators.evaluate import calibrate_raw, confusion, model_ranking
from flowrisk.operators.feedback import feedback_cap, features_type, id_digest, ledger_duplicates, row_digest
from flowrisk.operators.iforest import IsolationForest
from flowrisk.operators.splits import model_split
from flowrisk.session import stage

L2 = 0.0005
MAX_STEPS = 800


def labelled_features(df: DataFrame) -> DataFrame:
    """``label_int`` and the ten ``f_*`` columns; an unknown label fails the job."""
    return with_features(df).withColumn("label_int", strict_label_int("label"))


def feature_stats(df: DataFrame) -> DataFrame:
    """Mean and population standard deviation (at least 1) per feature, one row."""
    sums = []
    for name in FEATURE_NAMES:
        sums += [F.avg(f"f_{name}").alias(f"mean_{name}"),
                 F.greatest(F.stddev_pop(f"f_{name}"), F.lit(1.0)).alias(f"scale_{name}")]
    return df.agg(*sums)


def class_counts(df: DataFrame, label: str = "label_int") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("training_rows"),
                  F.count_if(F.col(label) == 1).alias("attack_rows"),
                  F.count_if(F.col(label) == 0).alias("benign_rows"))


def _check_training(df: DataFrame) -> dict:
    bad = F.lit(False)
    for c in FEATURE_COLUMNS:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    row = class_counts(df).first().asDict()
    if row["training_rows"] < 4:
        raise ValueError("at least 4 labelled rows are needed")
    if not row["attack_rows"] or not row["benign_rows"]:
        raise ValueError("training needs benign and attack rows")
    if not df.filter(bad).isEmpty():
        raise ValueError("a feature is not a finite number")
    return row


def _vectors(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="features").transform(df)


def train_logistic(df: DataFrame, max_iter: int = MAX_STEPS) -> LinearModel:
    """Fit on ``f_*`` columns and ``label_int``: mean log-loss with L2 on standardised features."""
    from pyspark.ml.classification import LogisticRegression
    if max_iter < 1:
        raise ValueError("max_iter must be positive")
    counts = _check_training(df)
    stats = feature_stats(df).first().asDict()
    means = [stats[f"mean_{n}"] for n in FEATURE_NAMES]
    scales = [stats[f"scale_{n}"] for n in FEATURE_NAMES]
    scaled = df.select("label_int", *[((F.col(c) - m) / s).alias(c)
                                      for c, m, s in zip(FEATURE_COLUMNS, means, scales)])
    fitted = LogisticRegression(
        featuresCol="features", labelCol="label_int", maxIter=max_iter, regParam=L2,
        elasticNetParam=0.0, standardization=False, tol=1e-9).fit(_vectors(scaled))
    return LinearModel(means, scales, [float(w) for w in fitted.coefficients],
                       float(fitted.intercept),
                       {"algorithm": "logistic_regression_lbfgs", "max_iter": max_iter, **counts})


def train_trees(df: DataFrame, rounds: int = 100) -> LevelTrees:
    """Gradient boosted trees grown level by level: up to 16 leaves, learning rate 0.05."""
    return LevelTrees.fit(df, FEATURE_COLUMNS, rounds=rounds, rate=0.05, depth=4)


def train_leafwise(df: DataFrame, rounds: int = 100) -> LeafwiseTrees:
    """Boosted trees grown best leaf first: up to 15 leaves, learning rate 0.05."""
    return LeafwiseTrees.fit(df, FEATURE_COLUMNS, rounds=rounds, rate=0.05, leaves=15)


def score_trees(model: LeafwiseTrees, df: DataFrame) -> DataFrame:
    return model.score(df)


def score_linear(model: LinearModel, df: DataFrame) -> DataFrame:
    return df.withColumn("score", model_probability(model))


def _fitters(train: DataFrame, seed: int, rounds: int, leafwise: bool) -> dict[str, Callable]:
    def logistic():
        model = train_logistic(train)
        return lambda df: score_linear(model, df)

    def isolation():
        model = IsolationForest.fit(train.filter("label_int = 0"), FEATURE_COLUMNS, seed=seed,
                                    key="seq")
        return model.score

    def boosted():
        return (train_leafwise if leafwise else train_trees)(train, rounds).score

    return {"logistic_regression": logistic, "isolation_forest": isolation,
            "boosted_trees": boosted}


def compare_models(flows: DataFrame, train: float = 0.5, calibration: float = 0.2,
                   target_fpr: float = 0.01, seed: int = 42, rounds: int = 100,
                   leafwise: bool = False) -> DataFrame:
    """One row per model: calibration and test metrics on the same time split, timings and rank.

    ``leafwise`` grows the boosted trees best leaf first instead of level by level: about twice the passes.
    """
    split = stage(labelled_features(model_split(flows, train, calibration)).select(
        "seq", "split", "label_int", *FEATURE_COLUMNS), "split")
    spark, reports = flows.sparkSession, []
    for name, fit in _fitters(split.filter("split = 'train'"), seed, rounds, leafwise).items():
        begun = time.perf_counter()
        score = fit()
        fitted = time.perf_counter()
        scored = stage(score(split.filter("split <> 'train'")).select(
            "split", "label_int", "score"), "scores")
        cut = calibrate_raw(scored.filter("split = 'calibration' and label_int = 0"), target_fpr)
        row = confusion(scored.filter("split = 'test'"),
                        F.col("score") > F.lit(cut["boundary_score"]), 6).first().asDict()
        reports.append({"name": name, **row, **cut, "fit_seconds": round(fitted - begun, 6),
                        "score_seconds": round(time.perf_counter() - fitted, 6)})
    return model_ranking(reports_frame(spark, reports))


def reports_frame(spark: SparkSession, reports: list[dict]) -> DataFrame:
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in reports[0].items())
    return spark.createDataFrame([tuple(r.values()) for r in reports], schema)


def feedback_rows(reviewed: DataFrame) -> DataFrame:
    """Approved ledger rows as training rows."""
    known = reviewed.filter("decision = 'approve'").select(
        "training_label", F.col("features").cast(features_type()).alias("features"))
    label = F.when(F.col("training_label").isin(0, 1), F.col("training_label")).otherwise(
        F.raise_error(F.lit("invalid training_label in the ledger")).cast("int"))
    return known.select(*[F.col(f"features.{n}").alias(f"f_{n}") for n in FEATURE_NAMES],
                        label.alias("label_int"))


def training_union(base: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Base rows and approved feedback, duplicates kept."""
    return labelled_features(base).select(*FEATURE_COLUMNS, "label_int").unionByName(
        feedback_rows(reviewed))


def retrain_with_feedback(base: DataFrame, reviewed: DataFrame, max_fraction: float = 0.20,
                          max_iter: int = MAX_STEPS) -> LinearModel:
    """Train on base and approved feedback; too much feedback for the base is refused."""
    base_rows = base.count()
    allowed = feedback_cap(base_rows, max_fraction)
    approved = reviewed.filter("decision = 'approve'")
    count = approved.count()
    if not count:
        raise ValueError("the ledger holds no approved feedback")
    if not ledger_duplicates(reviewed).isEmpty():
        raise ValueError("the ledger approves an id twice")
    if count > allowed:
        raise ValueError(f"{count} approved rows exceed the cap of {allowed}")
    model = train_logistic(training_union(base, reviewed), max_iter)
    model.metadata.update({
        "base_training_rows": base_rows, "approved_feedback_rows": count,
        "feedback_fraction": round(count / base_rows, 6),
        "review_ledger_digest": row_digest(reviewed).first()["digest"],
        "reviewed_alert_ids_digest": id_digest(approved).first()["digest"],
        "training_policy": "explicitly_approved_feedback_only"})
    return model
