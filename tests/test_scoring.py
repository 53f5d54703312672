from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from flowrisk.constants import FEATURE_NAMES
from flowrisk.functions.model import BASELINE, LinearModel, load_model, save_model
from flowrisk.functions.scoring import detections, with_explanation, with_features
from flowrisk.sources.flow_csv import parse_flow_rows, read_flow_csv, write_flow_csv
from tests.conftest import rows

# Fixed values: (port, model, rule, risk, severity, rules).
GOLDEN = [
    (443, 0.0231, 0.0, 0.0162, "info", []),
    (53, 0.0137, 0.0, 0.0096, "info", []),
    (22, 1.0, 0.92, 0.976, "critical", ["PORT_SCAN", "BRUTE_FORCE"]),
    (3389, 0.9988, 0.90, 0.9691, "critical", ["BRUTE_FORCE"]),
    (443, 0.9998, 0.96, 0.9879, "critical", ["CONNECTION_FLOOD"]),
    (4444, 0.9993, 0.76, 0.9275, "critical", ["DATA_SPIKE", "SUSPICIOUS_PORT"]),
]


def test_sample_scores(spark, sample):
    found = rows(detections(read_flow_csv(spark, sample)), "timestamp")
    assert [(r["dst_port"], r["model_score"], r["rule_score"], r["risk_score"], r["severity"],
             r["rule_ids"]) for r in found] == GOLDEN
    assert [r["is_alert"] for r in found] == [False, False, True, True, True, True]
    scan = found[2]
    assert (scan["model_version"], scan["model_algorithm"]) == ("0.1.0",
                                                                 "bootstrap_linear_risk_model")
    assert scan["rule_evidence"][0]["rule_id"] == "PORT_SCAN"
    assert [(t["name"], t["contribution"]) for t in scan["top_features"]] == [
        ("failed_connections_60s", 7.245), ("unique_dst_ports_60s", 5.5), ("syn_ratio", 1.882286)]
    assert list(scan["feature_snapshot"]) == FEATURE_NAMES
    assert found[0]["reasons"] == ["未发现达到告警阈值的异常"]


def test_suspicious_port_alone_reaches_the_threshold(spark, sample):
    one = read_flow_csv(spark, sample).filter("dst_port = 443 and packets = 24").withColumns({
        "dst_port": F.lit(4444), "bytes_sent": F.lit(16), "bytes_received": F.lit(0),
        "packets": F.lit(5), "syn_count": F.lit(1), "unique_dst_ports_60s": F.lit(1),
        "connections_60s": F.lit(1)})
    found = detections(one).first()
    assert found.is_alert and found.rule_ids == ["SUSPICIOUS_PORT"]
    assert (found.risk_score, found.severity) == (0.603, "medium")


def test_model_only_alert_is_explained(spark, sample):
    model = replace(BASELINE, bias=8.0, metadata={"algorithm": "test_linear", "version": "test-1"})
    found = detections(read_flow_csv(spark, sample), model).orderBy("timestamp").first()
    assert found.is_alert and found.rule_ids == [] and found.rule_evidence == []
    assert found.model_version == "test-1" and len(found.top_features) == 3
    assert found.reasons == ["统计模型发现流量特征偏离正常模式"]


def test_arguments_are_checked(spark, sample):
    flows = read_flow_csv(spark, sample)
    for threshold in (0.0, 1.0):
        with pytest.raises(ValueError, match="threshold"):
            detections(flows, threshold=threshold)
    with pytest.raises(ValueError, match="limit"):
        with_explanation(with_features(flows), BASELINE, 0)
    with pytest.raises(ValueError, match="dst_ip, packets"):
        parse_flow_rows(flows.drop("packets", "dst_ip"))


def test_scoring_is_one_generated_stage(spark, sample):
    plan = detections(read_flow_csv(spark, sample))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "lambda" not in plan


def test_bad_number_fails(spark, tmp_path, sample):
    path = tmp_path / "bad.csv"
    path.write_text(open(sample, encoding="utf-8-sig").read().replace(",24,", ",many,"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_flow_csv(spark, str(path)).collect()


def test_flow_csv_round_trip(spark, tmp_path, sample):
    flows = read_flow_csv(spark, sample).withColumn(
        "label", F.when(F.col("dst_port") != 53, F.col("label")))
    out = str(tmp_path / "out")
    assert write_flow_csv(flows, out) == 6
    again = read_flow_csv(spark, out)
    assert rows(again.drop("seq"), "timestamp") == rows(flows.drop("seq"), "timestamp")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_flow_csv(flows, out)
    assert write_flow_csv(flows.limit(2), out, "overwrite") == 2


def test_model_round_trip_and_version(spark, tmp_path):
    path = str(tmp_path / "model")
    save_model(spark, replace(BASELINE, scales=[0.0] + BASELINE.scales[1:]), path)
    loaded = load_model(spark, path)
    assert loaded.scales[0] == 1e-9 and loaded.version == "0.1.0"
    plain = LinearModel(BASELINE.means, BASELINE.scales, BASELINE.weights, BASELINE.bias)
    assert plain.version.startswith("sha256:") and len(plain.version) == 19
    with pytest.raises(ValueError, match="features"):
        LinearModel.from_rows([("packets", 0.0, 1.0, 1.0)], 0.0)
