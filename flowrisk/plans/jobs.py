"""End-to-end jobs on files. Each one reads, transforms and writes; outputs are never their inputs
and are replaced only on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowrisk.functions.model import BASELINE, LinearModel, save_model
from flowrisk.functions.normalize import strict_label_int
from flowrisk.functions.scoring import detections, with_scores
from flowrisk.operators import evaluate as E
from flowrisk.operators import feedback as B
from flowrisk.operators import training as T
from flowrisk.operators.flows import capture_flows
from flowrisk.operators.reports import benchmark_report
from flowrisk.operators.response import block_plan
from flowrisk.schema import ALERT, PENDING, REVIEWED
from flowrisk.session import stage
from flowrisk.sources.allowlist import default_networks, read_allowlist
from flowrisk.sources.captures import decode_packets, read_captures
from flowrisk.sources.datasets import read_dataset
from flowrisk.sources.flow_csv import read_flow_csv, write_flow_csv
from flowrisk.sources.jsonl import (append_jsonl, check_output, path_exists, read_strict,
                                    read_tolerant, write_jsonl)
from flowrisk.sources.order import FILE_ORDER
from flowrisk.streaming.monitor import monitor, open_snapshots
from flowrisk.streaming.state import epochs, newest_epochs


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def _write_alerts(flows: DataFrame, output: str, model: LinearModel, threshold: float,
                  all_rows: bool, overwrite: bool) -> dict:
    """Score and write in one pass, counting on the way."""
    seen = Observation()
    scored = detections(flows, model, threshold).observe(
        seen, F.count(F.lit(1)).alias("flows"), F.count_if("is_alert").alias("alerts"))
    write_jsonl(scored if all_rows else scored.filter("is_alert"), output, overwrite)
    return dict(seen.get)


def analyze(spark: SparkSession, source: str, output: str, model: LinearModel = BASELINE,
            threshold: float = 0.60, all_rows: bool = False, overwrite: bool = False) -> dict:
    """Flow CSV to alerts."""
    check_output(source, output)
    return _write_alerts(read_flow_csv(spark, source), output, model, threshold, all_rows, overwrite)


def captures(spark: SparkSession, source: str, output: str, alerts: str | None = None,
             max_packets: int | None = None, bidirectional: bool = True,
             model: LinearModel = BASELINE, threshold: float = 0.60,
             overwrite: bool = False) -> dict:
    """Capture files to flow CSV and, if asked for, alerts."""
    check_output(source, output)
    packets = decode_packets(read_captures(spark, source, max_packets))
    flows = capture_flows(packets, bidirectional)
    if alerts is None:
        return {"flows": write_flow_csv(flows, output, _mode(overwrite))}
    flows = stage(flows, "flows")
    write_flow_csv(flows, output, _mode(overwrite))
    return _write_alerts(flows, alerts, model, threshold, False, overwrite)


def convert_dataset(spark: SparkSession, dataset: str, source: str, output: str,
                    timestamp_format: str | None = None, max_rows: int | None = None,
                    overwrite: bool = False) -> int:
    """Public dataset to flow CSV with context."""
    check_output(source, output)
    return write_flow_csv(read_dataset(spark, dataset, source, timestamp_format, max_rows), output,
                          _mode(overwrite))


def evaluate(spark: SparkSession, source: str, model: LinearModel = BASELINE,
             threshold: float = 0.60) -> DataFrame:
    flows = read_flow_csv(spark, source).withColumn("label_int", strict_label_int("label"))
    return E.confusion(with_scores(flows, model, threshold), F.col("is_alert"), 4)


def train(spark: SparkSession, source: str, output: str, max_iter: int = T.MAX_STEPS,
          overwrite: bool = False) -> LinearModel:
    check_output(source, output)
    model = T.train_logistic(T.labelled_features(read_flow_csv(spark, source)), max_iter)
    save_model(spark, model, output, _mode(overwrite))
    return model


def benchmark(spark: SparkSession, source: str, output: str, model: LinearModel = BASELINE,
              calibration_fraction: float = 0.4, target_fpr: float = 0.01,
              overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """Writes ``output/report`` and ``output/per_day`` as JSON."""
    check_output(source, output)
    report, daily = benchmark_report(with_scores(read_flow_csv(spark, source), model),
                                     calibration_fraction, target_fpr)
    report = report.withColumns({
        "warnings": E.report_warnings(), "source": F.lit(source), "schema_version": F.lit("1.0"),
        "method": F.lit("chronological_holdout_with_benign_threshold_calibration")})
    report.write.mode(_mode(overwrite)).json(f"{output}/report")
    daily.write.mode(_mode(overwrite)).json(f"{output}/per_day")
    return report, daily


def compare_models(spark: SparkSession, source: str, output: str, train_fraction: float = 0.5,
                   calibration_fraction: float = 0.2, target_fpr: float = 0.01, seed: int = 42,
                   rounds: int = 100, leafwise: bool = False, overwrite: bool = False) -> DataFrame:
    check_output(source, output)
    report = T.compare_models(stage(read_flow_csv(spark, source), "flows"), train_fraction,
                              calibration_fraction, target_fpr, seed, rounds, leafwise)
    report.write.mode(_mode(overwrite)).json(output)
    return report


def release_gate(report: DataFrame, provenance: DataFrame, output: str, overwrite: bool = False,
                 **limits) -> DataFrame:
    gate = E.release_gate(report, provenance, **limits)
    gate.write.mode(_mode(overwrite)).json(output)
    return gate


def review_feedback(spark: SparkSession, alerts: str, pending: str, reviewed: str, decision: str,
                    reviewer: str, reviewed_at: str, alert_ids: DataFrame | None = None) -> dict:
    """Append decisions to the ledger; returns the four counters. Doing it twice adds nothing."""
    if len({alerts, pending, reviewed}) != 3:
        raise ValueError("alerts, queue and ledger must be three different paths")
    found = read_strict(spark, alerts, ALERT).withColumn("alert_id", B.alert_id())
    queue = read_strict(spark, pending, PENDING, keep=FILE_ORDER)
    queue = B.open_reviews(queue, F.struct(*FILE_ORDER))
    ledger = read_strict(spark, reviewed, REVIEWED, may_not_exist=True)
    selected = queue if alert_ids is None else alert_ids
    if alert_ids is not None:
        missing = B.missing_ids(selected, queue).count()
        if missing:
            raise ValueError(f"{missing} selected ids are not pending")
    entries = stage(B.review_entries(found, queue, ledger, decision, reviewer, reviewed_at,
                                     alert_ids), "entries")
    counters = B.review_counters(queue, selected.select("alert_id").distinct(), ledger)
    counters = counters.first().asDict()
    if counters["written"]:
        append_jsonl(entries, reviewed, "alert_id")
    return counters


def retrain_feedback(spark: SparkSession, base: str, reviewed: str, output: str,
                     max_iter: int = T.MAX_STEPS, max_feedback_fraction: float = 0.20,
                     overwrite: bool = False) -> LinearModel:
    check_output(base, output)
    model = T.retrain_with_feedback(read_flow_csv(spark, base),
                                    read_strict(spark, reviewed, REVIEWED),
                                    max_feedback_fraction, max_iter)
    save_model(spark, model, output, _mode(overwrite))
    return model


def record_false_positives(spark: SparkSession, requests: DataFrame, alerts: str,
                           pending: str) -> int:
    """Queue requests (alert_id, note, created_at) that are new. An invalid one, or one for no current
    alert, fails the job before anything is written."""
    found = read_tolerant(spark, alerts, ALERT).filter("not is_bad").withColumn(
        "alert_id", B.alert_id())
    queue = read_strict(spark, pending, PENDING, may_not_exist=True)
    bad = B.rejected_feedback(requests, found).select("alert_id", "error").first()
    if bad:
        raise ValueError(f"{bad.error}: {bad.alert_id}")
    rows = stage(B.new_feedback(requests, found, queue), "requests")
    count = rows.count()
    if count:
        append_jsonl(rows, pending, "alert_id")
    return count


def alert_view(spark: SparkSession, alerts: str, pending: str | None = None, severity: str = "",
               query: str = "", limit: int = 500) -> tuple[DataFrame, int]:
    """(newest matching alerts with their feedback flag, skipped lines).

    ``alerts`` are JSON lines, newest file last, or the monitor's table, newest batch last. Of the table only as many
    of the newest epochs are read as hold ``limit`` matching alerts.
    """
    if epochs(spark, alerts):
        def enough(rows: DataFrame) -> bool:
            return B.search_alerts(rows, severity, query).limit(limit).count() == limit

        good, order, skipped = newest_epochs(spark, alerts, enough), ["epoch", "ts_us", "alert_id"], 0
    else:
        order = FILE_ORDER
        rows = read_tolerant(spark, alerts, ALERT, keep=FILE_ORDER)
        skipped = rows.filter("is_bad").count()
        good = rows.filter("not is_bad").drop("is_bad")
    shown = B.last_alerts(B.search_alerts(good, severity, query), limit, order)
    shown = shown.withColumn("alert_id", B.alert_id())
    if pending is None:
        return shown.withColumn("has_feedback", F.lit(False)), skipped
    return B.flag_feedback(shown, read_tolerant(spark, pending, PENDING)), skipped


def plan_blocks(spark: SparkSession, alerts: str, output: str, duration: int, created_at: str,
                allowlist: str | None = None, address: str = "src_ip", overwrite: bool = False) -> int:
    """Alerts and an allowlist file to the table of proposed blocks; returns their number."""
    check_output(alerts, output)
    networks = read_allowlist(spark, allowlist) if allowlist else default_networks(spark)
    targets = read_strict(spark, alerts, ALERT).select(address)
    plan = block_plan(targets, networks, duration, F.to_timestamp(F.lit(created_at)), address)
    seen = Observation()
    write_jsonl(plan.observe(seen, F.count(F.lit(1)).alias("rows")), output, overwrite)
    return seen.get["rows"]


def monitor_snapshots(spark: SparkSession, source: str, folder: str, model: LinearModel = BASELINE,
                      threshold: float = 0.60, interval: str | None = None):
    """Collected polls (JSON files under ``host=.../snapshot_no=.../ts_us=...``) to ``folder/alerts``."""
    return monitor(open_snapshots(spark, source), folder, model, threshold, interval=interval)
