import pytest
from pyspark.sql import functions as F

from flowrisk.operators import feedback as B
from flowrisk.operators.training import retrain_with_feedback
from flowrisk.plans import jobs
from flowrisk.schema import ALERT, PENDING, REVIEWED
from flowrisk.sources.flow_csv import read_flow_csv
from flowrisk.sources.jsonl import read_strict, read_tolerant

AT = "2026-08-14T00:00:00+00:00"


@pytest.fixture
def places(spark, tmp_path, sample):
    """Scored sample flows, the first of them queued as a false positive."""
    alerts, pending, reviewed = (str(tmp_path / n) for n in ("alerts", "pending", "reviewed"))
    assert jobs.analyze(spark, sample, alerts, all_rows=True) == {"flows": 6, "alerts": 4}
    shown, skipped = jobs.alert_view(spark, alerts, severity="info", query="142.250")
    assert skipped == 0 and shown.count() == 1
    one = shown.select("alert_id", F.lit("checked").alias("note"), F.lit(AT).alias("created_at"))
    assert jobs.record_false_positives(spark, one, alerts, pending) == 1
    assert jobs.record_false_positives(spark, one, alerts, pending) == 0
    return alerts, pending, reviewed


def test_review_and_retrain(spark, places, sample, tmp_path):
    alerts, pending, reviewed = places
    first = jobs.review_feedback(spark, *places, "approve", "tester", AT)
    assert first == {"pending": 1, "selected": 1, "written": 1, "already_reviewed": 0}
    assert jobs.review_feedback(spark, *places, "approve", "tester", AT) == {
        "pending": 1, "selected": 1, "written": 0, "already_reviewed": 1}
    text = spark.read.text(reviewed).collect()
    assert len(text) == 1 and "src_ip" not in text[0][0] and "142.250" not in text[0][0]
    entry = read_strict(spark, reviewed, REVIEWED).first()
    assert entry.training_label == 0 and entry.features.packets == 24.0
    view, _ = jobs.alert_view(spark, alerts, pending)
    assert view.filter("has_feedback").count() == 1
    model = jobs.retrain_feedback(spark, sample, reviewed, str(tmp_path / "model"), max_iter=50)
    assert model.metadata["approved_feedback_rows"] == 1
    assert model.metadata["training_policy"] == "explicitly_approved_feedback_only"
    ledger = read_strict(spark, reviewed, REVIEWED)
    base = read_flow_csv(spark, sample)
    with pytest.raises(ValueError, match="approves an id twice"):
        retrain_with_feedback(base, ledger.union(ledger))
    other = ledger.withColumn("alert_id", F.lit("0" * 16))
    with pytest.raises(ValueError, match="exceed the cap of 1"):
        retrain_with_feedback(base, ledger.union(other))


def test_rejection_and_detached_feedback(spark, places, sample, tmp_path):
    alerts, pending, reviewed = places
    with pytest.raises(ValueError, match="1 selected ids are not pending"):
        jobs.review_feedback(spark, *places, "reject", "t", AT,
                             spark.createDataFrame([("f" * 16,)], "alert_id string"))
    jobs.review_feedback(spark, *places, "reject", "t", AT)
    entry = read_strict(spark, reviewed, REVIEWED).first()
    assert entry.features is None and entry.training_label is None
    with pytest.raises(ValueError, match="no approved feedback"):
        jobs.retrain_feedback(spark, sample, reviewed, str(tmp_path / "m"))
    cut = read_tolerant(spark, alerts, ALERT).drop("is_bad").withColumn(
        "feature_snapshot", F.lit(None).cast(ALERT["feature_snapshot"].dataType))
    cut.write.json(str(tmp_path / "cut"))
    with pytest.raises(Exception, match="no alert for this feedback"):
        jobs.review_feedback(spark, str(tmp_path / "cut"), pending, str(tmp_path / "r2"),
                             "approve", "t", AT)
    found = cut.withColumn("alert_id", B.alert_id())
    queue = found.limit(1).select("alert_id", F.lit("false_positive").alias("label"))
    with pytest.raises(Exception, match="lacks a complete feature snapshot"):
        B.review_entries(found, queue, queue.limit(0), "approve", "t", AT).collect()
    for decision, reviewer in (("maybe", "t"), ("approve", " "), ("approve", "x" * 81)):
        with pytest.raises(ValueError):
            B.review_entries(found, queue, queue, decision, reviewer, AT)


def test_tolerant_and_strict_lines(spark, tmp_path):
    path = tmp_path / "alerts.jsonl"
    path.write_text('{"severity":"critical","rule_ids":["PORT_SCAN"],"process_name":"Scanner"}\n'
                    '\n{"severity":"info","dst_port":3389}\n[1]\n"x"\n{partial', encoding="utf-8")
    rows = read_tolerant(spark, str(path), ALERT)
    assert rows.count() == 5 and rows.filter("is_bad").count() == 3
    good = rows.filter("not is_bad")
    assert B.search_alerts(good, "CRITICAL", "port_scan").count() == 1
    assert B.search_alerts(good, query="3389").first().severity == "info"
    assert B.search_alerts(good, query="scanner").count() == 1
    with pytest.raises(Exception, match="bad line"):
        read_strict(spark, str(path), ALERT).collect()
    assert read_strict(spark, str(tmp_path / "none"), PENDING, may_not_exist=True).count() == 0
    for call in (lambda: B.search_alerts(good, "loud"), lambda: B.search_alerts(good, "", "x" * 101),
                 lambda: B.last_alerts(good, 0), lambda: B.last_alerts(good, 5001),
                 lambda: B.feedback_cap(10, 0.6)):
        with pytest.raises(ValueError):
            call()


def test_row_digest_tells_every_change(spark):
    kind = "id string, n int, f struct<a: double, b: array<string>>"
    data = [("x", 1, (0.5, ["p", None])), ("y", None, None), ("y", None, None), ("z", 2, (None, []))]
    digest = lambda rows_, schema=kind: tuple(B.row_digest(spark.createDataFrame(rows_, schema)).first())
    assert digest(data) == digest(data[::-1]) and digest(data)[0] == 4
    turned = spark.createDataFrame(data, kind).select("f", "id", "n").repartition(3)
    assert tuple(B.row_digest(turned).first()) == digest(data)
    others = [data[:3], data + data[1:2], [("x", 1, (0.5, ["p", ""])), *data[1:]], [("x", 1, (0.5000000001, ["p", None])), *data[1:]],
              [*data[:3], ("z", 2, (None, None))], [*data[:3], ("z", 2, None)], []]
    found = [digest(o)[1] for o in [data, *others]]
    assert len(set(found)) == len(found)


def test_retraining_makes_the_context_once(spark, monkeypatch):
    from flowrisk.plans import fixtures, q_evaluate
    made = []
    monkeypatch.setattr(fixtures, "context_flows", lambda *a, call=fixtures.context_flows: made.append(1) or call(*a))
    row = q_evaluate.retrain_feedback(spark, "/root/testdata/sf0.001").first()
    assert len(made) == 1 and row["approved_feedback_rows"] > 0
