"""Snapshots of connections, from files to the monitor's alerts."""

import json

import pytest
from pyspark.sql import functions as F

from flowrisk.functions.scoring import detections
from flowrisk.operators.snapshots import as_flows, new_connections, observations
from flowrisk.plans import jobs
from flowrisk.schema import ALERT
from flowrisk.sources.connections import (name_processes, parse_netstat, read_connections, read_netstat,
                                          read_processes, read_snapshots)
from flowrisk.streaming.context import StreamingConnections, StreamingContext
from flowrisk.streaming.monitor import monitor, open_folder, stream_new_connections
from flowrisk.streaming.state import StateTable, compact_epochs, epochs, newest_epochs, write_epoch
from tests.conftest import rows

POLL = ("host string, snapshot_no bigint, local_address string, local_port int, "
        "remote_address string, remote_port int, state string, pid int")


def link(port, **changes):
    return {"local_address": "172.16.0.4", "local_port": 49000 + int(port), "remote_address": "172.16.7.7",
            "remote_port": port, "state": "CloseWait", "owning_process": 31, "process_name": "agent"} | changes


def test_connection_json(spark, tmp_path):
    (tmp_path / "one.json").write_text("﻿" + json.dumps(link(25)), encoding="utf-8")
    (tmp_path / "many.json").write_text(json.dumps(
        [link(0), 17, "text", None, ["x"], link("8443", local_port="77"), {"remote_port": 9, "state": None, "more": {}}]))
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "blank.json").write_text(" \n")
    found = rows(read_connections(spark, str(tmp_path)).drop("file"), "remote_port")
    assert found == [{"local_address": "", "local_port": 0, "remote_address": "", "remote_port": 9,
                      "state": "Unknown", "owning_process": 0, "process_name": "unknown"},
                     link(25), link(8443, local_port=77)]


@pytest.mark.parametrize("text", ['[{"remote_port": 5}', '[{"remote_port": "many"}]', "no json"])
def test_broken_connection_json_fails(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED|CAST_INVALID|Malformed"):
        read_connections(spark, str(tmp_path)).collect()


def test_netstat_and_process_list(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "z.csv").write_text('"old.exe","31","Services"\n"idle","none"\n"alone"\n')
    import os

    os.utime(tmp_path / "p" / "z.csv", (1_000_000, 1_000_000))
    (tmp_path / "p" / "a.csv").write_text('"mid.exe","31"\n"new.exe","31","Console"\n"other","5"\n')
    assert {r.pid: r.process_name for r in read_processes(spark, str(tmp_path / "p")).collect()} == {
        31: "new.exe", 5: "other"}
    lines = ["  TCP    172.16.0.4:49001    172.16.7.7:8443    TIME_WAIT    31",
             "  TCP    [::1]:445    [::]:0    LISTENING    4", "Proto  Local  Foreign  State  PID",
             "  TCP    [fe80::7%2]:6000    [2001:db8::5]:993    LAST_ACK    8",
             "  TCP    1.2.3.4:y    172.16.7.7:80    ESTABLISHED    31", "  UDP    0.0.0.0:53    *:*    9"]
    (tmp_path / "n" / "host=h").mkdir(parents=True)
    (tmp_path / "n" / "host=h" / "a.txt").write_text("\n".join(lines))
    found = rows(name_processes(read_netstat(spark, str(tmp_path / "n")),
                                read_processes(spark, str(tmp_path / "p"))), "remote_port")
    assert [(r["host"], r["local_address"], r["remote_port"], r["state"], r["process_name"]) for r in found] == [
        ("h", "fe80::7%2", 993, "LastAck", "unknown"), ("h", "172.16.0.4", 8443, "TimeWait", "new.exe")]
    assert parse_netstat(spark.createDataFrame([("TCP a:1 b:2 X 3",)], "value string")).first().state == "X"


def polls(spark, data):
    return spark.createDataFrame(data, POLL).withColumn(
        "ts_us", F.lit(1_650_000_000_000_000) + F.col("snapshot_no") * 2_000_000)


SSH = ("10.1.1.1", 22, "10.2.2.2", 60022, "Established", 3)
MAIL = ("10.1.1.1", 50025, "10.3.3.3", 25, "SynReceived", 4)


def test_direction_and_returning_connections(spark):
    data = polls(spark, [("a", 5, *SSH), ("a", 5, *MAIL), ("a", 6, *MAIL), ("a", 7, *SSH), ("a", 7, *MAIL),
                         ("b", 6, *SSH)])
    assert sorted((r.host, r.snapshot_no, r.pid) for r in new_connections(data).collect()) == [
        ("a", 5, 3), ("a", 5, 4), ("a", 7, 3), ("b", 6, 3)]
    inbound, outbound = rows(as_flows(data.filter("host = 'a' and snapshot_no = 5")), "pid")
    assert (inbound["direction"], inbound["src_ip"], inbound["dst_port"], inbound["syn_count"]) == (
        "inbound", "10.2.2.2", 22, 0)
    assert (outbound["direction"], outbound["dst_ip"], outbound["syn_count"]) == ("outbound", "10.3.3.3", 1)


def test_windows_belong_to_one_process(spark):
    data = [("a", 1, "10.1.1.1", 50000 + i, "10.3.3.3", 2000 + i % 3, "Established", i % 5) for i in range(30)]
    found = observations(polls(spark, data)).collect()
    assert {r.pid: 0 for r in found}.keys() == set(range(5))
    for pid in range(5):
        own = [r for r in found if r.pid == pid]
        assert max(r.connections_60s for r in own) == 6 and max(r.unique_dst_ports_60s for r in own) == 3


def swarm():
    return [("h", poll, "10.5.5.5", 42000 + poll * 11 + i, "10.6.6.6", 900 + i * poll % 40,
             "Closed" if i % 4 else "SynSent", 12) for poll in range(1, 8) for i in range(11)]


KEEP = ["host", "ts_us", "src_port", "direction"]


def test_monitor_stream_equals_batch(spark, tmp_path):
    frame = polls(spark, swarm())
    for part in ("snapshot_no < 3", "snapshot_no = 3", "snapshot_no > 3"):
        frame.filter(part).write.mode("append").parquet(str(tmp_path / "in"))
        monitor(open_folder(spark, str(tmp_path / "in"), frame.schema), str(tmp_path / "run"),
                alerts_only=False).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "run" / "alerts"))
    assert set(got.columns) == {*ALERT.names, "host", "ts_us", "alert_id", "epoch"}
    want = detections(observations(frame), keep=KEEP)
    assert rows(got.select(want.columns), "ts_us", "src_port") == rows(want, "ts_us", "src_port")
    assert got.filter("is_alert").count() > 10
    assert len(list((tmp_path / "run" / "stage-connections").iterdir())) <= 2


def test_a_host_that_lags_behind_is_not_late(spark, tmp_path):
    slow = [("slow", poll, *r[2:]) for poll, r in enumerate(swarm()[:4], 1)]
    fast = [("fast", 200 + i, *r[2:]) for i, r in enumerate(swarm()[:4])]
    frame = polls(spark, slow + fast)
    for part in ("host = 'fast'", "host = 'slow' and snapshot_no < 3", "host = 'slow' and snapshot_no >= 3"):
        frame.filter(part).write.mode("append").parquet(str(tmp_path / "in"))
        monitor(open_folder(spark, str(tmp_path / "in"), frame.schema), str(tmp_path / "run"),
                alerts_only=False).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "run" / "alerts"))
    want = detections(observations(frame), keep=KEEP)
    assert rows(got.select(want.columns), "host", "ts_us") == rows(want, "host", "ts_us")


def test_a_snapshot_in_two_batches(spark, tmp_path):
    frame = polls(spark, [("h", 1, *SSH), ("h", 1, *MAIL), ("h", 2, *SSH), ("h", 2, *MAIL), ("h", 2, *MAIL[:1], 50026, *MAIL[2:])])
    for part in ("snapshot_no = 1", "snapshot_no = 2 and pid = 3", "snapshot_no = 2 and pid = 4"):
        frame.filter(part).write.mode("append").parquet(str(tmp_path / "in"))
        stream_new_connections(open_folder(spark, str(tmp_path / "in"), frame.schema), str(tmp_path / "run")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "run" / "rows")).collect()
    assert sorted((r.snapshot_no, r.local_port) for r in got) == [(1, 22), (1, 50025), (2, 50026)]


def drive(spark, frame, order, folder, **how):
    """Feeds the polls of ``frame`` one batch each in the given order; returns (new, late) as (host, poll, pid)."""
    connections, out = StreamingConnections(folder, **how), ([], [])
    for epoch, part in enumerate([*order, None]):
        batch = frame.filter(part) if part else frame.limit(0)
        for found, part_rows in zip(out, connections.process(batch, epoch, close=part is None)):
            found += [(r.host, r.snapshot_no, r.pid) for r in part_rows.collect()]
    return sorted(out[0]), sorted(out[1])


def shuffled():
    return [("a", n, *(SSH if pid == 3 else MAIL)) for n in range(1, 9) for pid in (3, 4) if (n, pid) not in ((2, 3), (6, 4), (7, 4))]


@pytest.mark.parametrize("order", [(1, 2, 4, 5, 3, 6, 7, 8), (3, 1, 2, 6, 4, 5, 8, 7), (1, 2, 3, 4, 5, 6, 7, 8)])
def test_polls_out_of_order_within_the_delay(spark, tmp_path, order):
    frame = polls(spark, shuffled())
    want = sorted((r.host, r.snapshot_no, r.pid) for r in new_connections(frame).collect())
    assert drive(spark, frame, [f"snapshot_no = {n}" for n in order], str(tmp_path / "n"), delay=3) == (want, [])
    halves = [f"snapshot_no = {n} and pid = {p}" for n, p in [(1, 3), (2, 4), (3, 3), (1, 4), (3, 4), (4, 4), (4, 3)]]
    got = drive(spark, frame.filter("snapshot_no < 5"), halves, str(tmp_path / "h"), time="ts_us", delay=6_000_000)
    assert got == ([w for w in want if w[1] < 5], [])


def test_polls_behind_the_delay_are_no_news(spark, tmp_path):
    frame = polls(spark, shuffled())
    new, late = drive(spark, frame, [f"snapshot_no = {n}" for n in (1, 2, 4, 5, 3, 6, 7, 8)], str(tmp_path / "s"))
    assert late == [("a", 3, 3), ("a", 3, 4)] and all(n[1] != 3 for n in new)


def test_silent_hosts_leave_the_state(spark, tmp_path):
    frame = polls(spark, [("gone", 1, *SSH), ("gone", 2, *SSH), ("gone", 2, *MAIL)]
                  + [("a", n, *SSH) for n in range(1, 40)])
    connections = StreamingConnections(str(tmp_path / "c"), delay=1, expire=10)
    out = []
    for epoch, part in enumerate(["snapshot_no < 3", "snapshot_no between 3 and 10", "snapshot_no between 11 and 20", "snapshot_no > 20"]):
        news, _ = connections.process(frame.filter(part), epoch)
        out += [(r.host, r.snapshot_no, r.pid) for r in news.collect()]
        hosts = {r.host for r in connections.state.before(spark, epoch + 1).select("host").distinct().collect() if r.host}
        assert hosts == ({"a", "gone"} if epoch < 2 else {"a"})
    assert sorted(out) == [("a", 1, 3), ("gone", 1, 3), ("gone", 2, 4)]
    assert connections.state.before(spark, 4).count() <= 5


def test_context_of_silent_and_late_clocks(spark, tmp_path):
    flows = spark.createDataFrame([("a", 0, 0, 80), ("gone", 1_000_000, 1, 80), ("a", 50_000_000, 2, 81), ("a", 20_000_000, 3, 82),
                                   ("a", 400_000_000, 4, 80), ("gone", 2_000_000, 5, 80)], "host string, ts_us bigint, seq bigint, dst_port int")
    context, failed = StreamingContext(str(tmp_path / "x"), ["host"], ["seq"], check_order=False, clock=["host"],
                                       delay_us=10_000_000, expire_us=100_000_000), F.lit(False)
    got, behind = {}, []
    for epoch in range(6):
        rows_, late = context.process(flows.filter(F.col("seq") == epoch), epoch, failed)
        got |= {r.seq: r.connections_60s for r in rows_.collect()}
        behind += [r.seq for r in late.collect()]
        if epoch == 4:
            assert {r.host for r in context.state.before(spark, 5).collect()} == {"a", None}
    assert got == {0: 1, 1: 1, 2: 2, 4: 1, 5: 1} and behind == [3]


def test_monitor_takes_late_polls(spark, tmp_path):
    frame = polls(spark, swarm())
    for part in ("snapshot_no in (1, 3)", "snapshot_no in (2, 5)", "snapshot_no in (4, 6, 7)", "snapshot_no = 1"):
        frame.filter(part).write.mode("append").parquet(str(tmp_path / "in"))
        monitor(open_folder(spark, str(tmp_path / "in"), frame.schema), str(tmp_path / "run"),
                alerts_only=False, delay_us=4_000_000).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "run" / "alerts"))
    want = detections(observations(frame), keep=KEEP).filter("ts_us <= 1650000000000000 + 5 * 2000000")
    assert rows(got.select(want.columns), "ts_us", "src_port") == rows(want, "ts_us", "src_port")
    assert spark.read.parquet(str(tmp_path / "run" / "late")).count() == 11


def test_missing_state_fails(spark, tmp_path):
    state = StateTable(str(tmp_path / "s"))
    assert state.before(spark, 0) is None
    with pytest.raises(ValueError, match="missing"):
        state.before(spark, 4)


def test_from_collected_files_to_the_alert_view(spark, tmp_path):
    source, folder = tmp_path / "polls", str(tmp_path / "run")
    for poll in range(1, 4):
        path = source / "host=desk" / f"snapshot_no={poll}" / f"ts_us={1_650_000_000_000_000 + poll * 1_000_000}"
        path.mkdir(parents=True)
        (path / "c.json").write_text(json.dumps(
            [link(4444, local_port=50_000 + poll * 40 + i, state="Closed", process_name="Updater") for i in range(30)]))
        jobs.monitor_snapshots(spark, str(source), folder).awaitTermination()
    assert read_snapshots(spark, str(source)).count() == 90
    view, skipped = jobs.alert_view(spark, f"{folder}/alerts", query="updater", limit=5)
    shown = view.collect()
    assert skipped == 0 and len(shown) == 5
    assert {(r.process_id, r.process_name, r.connection_state, r.host, r.epoch) for r in shown} == {
        (31, "Updater", "Closed", "desk", 2)}


def test_the_view_reads_the_newest_epochs_and_old_ones_are_compacted(spark, tmp_path):
    folder = str(tmp_path / "alerts")
    one = detections(observations(polls(spark, swarm()[:4])), keep=KEEP).limit(2).withColumns(
        {c: F.lit(None).cast(t.dataType) for c, t in ((f.name, f) for f in ALERT.fields) if c not in (*KEEP,)}).withColumn("alert_id", F.lit("0" * 16))
    one = spark.createDataFrame(one.collect(), one.schema).withColumn("severity", F.lit("high")).cache()
    for epoch in range(40):
        write_epoch(one.withColumn("ts_us", F.lit(epoch).cast("bigint")), folder, epoch)
    view, _ = jobs.alert_view(spark, folder, limit=5)
    assert sorted(r.epoch for r in view.collect()) == [37, 38, 38, 39, 39]
    assert len({f.split("epoch=")[1].split("/")[0] for f in newest_epochs(spark, folder, lambda rows_: rows_.count() >= 5).inputFiles()}) == 8
    before = sorted(r.ts_us for r in spark.read.parquet(folder).collect())
    compact_epochs(spark, folder)
    assert epochs(spark, folder) == [23, *range(24, 40)]
    assert sorted(r.ts_us for r in spark.read.parquet(folder).collect()) == before
    view, _ = jobs.alert_view(spark, folder, limit=78)
    assert min(r.ts_us for r in view.collect()) == 1
    # A run that ended between deleting and renaming is finished, one that ended before is undone.
    (tmp_path / "alerts" / "epoch=23").rename(tmp_path / "alerts" / "_merged-0-23")
    (tmp_path / "alerts" / "_merged-24-30").mkdir()
    compact_epochs(spark, folder)
    assert epochs(spark, folder) == [23, *range(24, 40)] and not list((tmp_path / "alerts").glob("_merged*"))
    assert sorted(r.ts_us for r in spark.read.parquet(folder).collect()) == before
