import math
import random

import pytest
from pyspark.sql import functions as F

from flowrisk.functions.scoring import FEATURE_COLUMNS, with_scores
from flowrisk.operators import evaluate as E
from flowrisk.operators import training as T
from flowrisk.operators.iforest import IsolationForest
from flowrisk.operators.reports import benchmark_report
from flowrisk.operators.splits import chronological_split, model_split

FLOW = ("seq bigint, ts_us bigint, dst_port int, duration_ms double, packets bigint, "
        "bytes_sent bigint, bytes_received bigint, syn_count bigint, rst_count bigint, "
        "unique_dst_ports_60s bigint, connections_60s bigint, failed_connections_60s bigint, "
        "label string")
START = 1_767_225_600_000_000


def flows(spark, n, step_us):
    """Alternating quiet and noisy flows, newest first."""
    quiet, noisy = (443, 1200.0, 12, 900, 500, 1, 0, 1, 3, 0), (22, 120.0, 120, 9000, 500, 80, 20,
                                                               35, 60, 25)
    data = [(i, START + i * step_us, *(noisy if i % 2 else quiet), "attack" if i % 2 else "benign")
            for i in reversed(range(n))]
    return spark.createDataFrame(data, FLOW)


def test_splits_are_exact_and_stable_on_ties(spark):
    split = chronological_split(flows(spark, 20, 43_200_000_000), 0.4)
    assert [r.split for r in split.orderBy("seq").collect()] == ["calibration"] * 8 + ["test"] * 12
    tied = chronological_split(flows(spark, 20, 0), 0.4)
    assert [r.split for r in tied.orderBy("seq").collect()] == ["calibration"] * 8 + ["test"] * 12
    three = model_split(flows(spark, 60, 60_000_000))
    assert [r.split for r in three.orderBy("seq").collect()] == (
        ["train"] * 30 + ["calibration"] * 12 + ["test"] * 18)


def test_split_arguments(spark):
    with pytest.raises(ValueError, match="at least 8"):
        chronological_split(flows(spark, 6, 1))
    with pytest.raises(ValueError, match="at least 20"):
        model_split(flows(spark, 19, 1))
    for call in (lambda f: chronological_split(f, 0.05), lambda f: model_split(f, 0.1, 0.2),
                 lambda f: model_split(f, 0.7, 0.3)):
        with pytest.raises(ValueError, match="fraction"):
            call(flows(spark, 30, 1))
    with pytest.raises(ValueError, match="test period lacks"):
        chronological_split(flows(spark, 30, 1).filter("seq < 6 or label = 'benign'"))
    with pytest.raises(Exception, match="unsupported label"):
        chronological_split(flows(spark, 30, 1).withColumn("label", F.lit("odd")))


def scan(scores, target, low=-math.inf, high=math.inf):
    """Every candidate in turn."""
    candidates = sorted({min(max(math.nextafter(s, math.inf), low), high) for s in scores}
                        | ({low, high} if low > -math.inf else set()))
    for c in candidates:
        rate = sum(s >= c for s in scores) / len(scores)
        if rate <= target:
            return c, rate
    return candidates[-1], sum(s >= candidates[-1] for s in scores) / len(scores)


@pytest.mark.parametrize("seed", range(4))
def test_calibration_equals_the_scan_of_all_candidates(spark, seed):
    rng = random.Random(seed)
    scores = [rng.choice([0.0, 1.0, round(rng.random(), 4), round(rng.random(), 1)])
              for _ in range(200)]
    scores = [s for s in scores if seed != 1 or s] if seed < 3 else [1.0] * 9
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    for target in (0.0, 0.01, 0.3, 0.5):
        cut, rate = scan(scores, target, 0.000001, 0.999999)
        got = E.calibrate_risk(df, target, "s").first()
        assert (got.threshold, got.calibration_false_positive_rate, got.calibration_benign_rows,
                got.target_met) == (round(cut, 6), round(rate, 6), len(scores), rate <= target)
        raw, rate = scan(scores, target)
        got = E.calibrate_raw(df, target, "s")
        assert (got["threshold"], got["calibration_false_positive_rate"]) == (raw, rate)
    with pytest.raises(ValueError, match="target_fpr"):
        E.calibrate_risk(df, 0.6, "s")


def test_benchmark_report(spark):
    report, daily = benchmark_report(with_scores(flows(spark, 20, 43_200_000_000)), 0.4, 0.0)
    row = report.withColumn("warnings", E.report_warnings()).first()
    assert (row.rows, row.true_positive, row.false_positive, row.true_negative) == (12, 6, 0, 6)
    assert (row.days, row.false_positives_per_day, row.target_met) == (6, 0.0, True)
    assert len(row.warnings) == 2 and daily.count() == 6


def gate(spark, **changes):
    report = spark.createDataFrame([(1200, 4, 0.003322, 1.333333, 0.9, 3, True)],
                                   "true_negative int, false_positive int, false_positive_rate double, "
                                   "false_positives_per_day double, recall double, days int, "
                                   "target_met boolean")
    statement = {c: "given" for c in E.TEXT_CHECKS} | {c: True for c in E.ATTESTATIONS} | changes
    provenance = spark.createDataFrame([tuple(statement.values())], ", ".join(
        f"{c} {'string' if c in E.TEXT_CHECKS else 'boolean'}" for c in statement))
    return E.release_gate(report, provenance).first()


def test_release_gate(spark):
    assert gate(spark).status == "passed"
    refused = gate(spark, authorization_confirmed=False)
    assert refused.status == "failed" and not refused.authorization_confirmed_attested
    assert gate(spark, labeling_method=" ").status == "failed"
    assert gate(spark, anonymization_confirmed=None).status == "failed"
    with pytest.raises(ValueError, match="2 days"):
        E.release_gate(None, None, min_days=1)


def test_model_comparison(spark):
    """Sixty alternating flows: both supervised models separate the classes."""
    found = {r.name: r for r in T.compare_models(flows(spark, 60, 60_000_000), target_fpr=0.0,
                                                 seed=7, rounds=5).collect()}
    assert set(found) == {"logistic_regression", "isolation_forest", "boosted_trees"}
    for name in ("logistic_regression", "boosted_trees"):
        r = found[name]
        assert (r.true_positive, r.false_positive, r.true_negative, r.false_negative) == (9, 0, 9, 0)
    assert found["isolation_forest"].rows == 18 and found["isolation_forest"].false_positive == 0
    assert sorted(r.rank for r in found.values()) == [1, 2, 3]


def test_leafwise_trees_in_the_comparison(spark):
    found = {r.name: r for r in T.compare_models(flows(spark, 60, 60_000_000), target_fpr=0.0, rounds=5,
                                                 leafwise=True).collect()}
    r = found["boosted_trees"]
    assert (r.true_positive, r.false_positive, r.true_negative, r.false_negative) == (9, 0, 9, 0)


def test_training_checks(spark):
    rows = T.labelled_features(flows(spark, 10, 1))
    with pytest.raises(ValueError, match="at least 4"):
        T.train_logistic(rows.limit(3))
    with pytest.raises(ValueError, match="benign and attack"):
        T.train_logistic(rows.filter("label_int = 0"))
    with pytest.raises(ValueError, match="finite"):
        T.train_logistic(rows.withColumn("f_packets", F.lit(float("nan"))))


def test_isolation_forest_finds_the_odd_rows_and_repeats(spark):
    rng = random.Random(1)
    data = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)] + [(900, 9.0, -8.0)]
    df = spark.createDataFrame(data, "seq bigint, a double, b double")
    forest = IsolationForest.fit(df, ["a", "b"], trees=20)
    scores = {r.seq: r.score for r in forest.score(df).collect()}
    assert max(scores, key=scores.get) == 900 and scores[900] > 0.1
    again = IsolationForest.fit(df.repartition(7), ["a", "b"], trees=20)
    assert again.nodes.equals(forest.nodes)
    assert len(FEATURE_COLUMNS) == 10
