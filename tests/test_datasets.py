"""Public datasets: own rows, made by a small generator, in files of several shapes."""

import csv

import pytest

from flowrisk.constants import FLOW_COLUMNS, UNSW_RAW_COLUMNS
from flowrisk.functions.normalize import header_map, spark_pattern
from flowrisk.operators.splits import chronological_split
from flowrisk.plans import jobs
from flowrisk.sources.datasets import read_dataset, read_dataset_with_rejects
from flowrisk.sources.flow_csv import read_flow_csv
from flowrisk.sources.order import FILE_ORDER, head_rows, with_file_order
from tests.conftest import SAMPLE, rows

FORMAT = "%d.%m.%Y %H:%M:%S"


def cic(second=0, src="10.9.0.1", port=8080, rst=0, label="BENIGN", **changes):
    row = {"Source IP": src, "Source Port": 41000 + second, "Destination IP": "10.9.9.9",
           "Destination Port": port, "Protocol": 17, "Timestamp": f"03.02.2021 04:05:{second:02}",
           "Flow Duration": 1500 * (second + 1), "Total Fwd Packets": 7, "Total Backward Packets": 4,
           "Total Length of Fwd Packets": 90, "Total Length of Bwd Packets": 33,
           "SYN Flag Count": 2, "RST Flag Count": rst, "Label": label}
    return row | changes


def unsw(second=0, src="10.8.0.1", **changes):
    row = {"srcip": src, "sport": "0x1F90", "dstip": "10.8.8.8", "dsport": "-", "proto": "udp",
           "state": "REQ", "dur": "2.5", "sbytes": "11", "dbytes": "22", "Spkts": "3", "Dpkts": "5",
           "stime": str(1_600_000_000 + second), "attack_cat": "Worms", "Label": "1"}
    return row | changes


def write(path, data, header=True, names=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    names = names or list(data[0])
    with path.open("w", encoding="utf-8", newline="") as handle:
        out = csv.writer(handle)
        if header:
            out.writerow(names)
        out.writerows([[row.get(n, "") for n in names] for row in data])
    return str(path)


def test_cicids_units_labels_and_context(spark, tmp_path):
    source = write(tmp_path / "a.csv", [cic(0), cic(20, port=22, rst=3, label="Bot"), cic(59, src="10.9.0.2")])
    a, b, c = rows(read_dataset(spark, "cicids2017", source, FORMAT), "timestamp")
    assert (a["duration_ms"], a["packets"], a["bytes_sent"], a["protocol"]) == (1.5, 11, 90, "UDP")
    assert (a["label"], b["label"], b["timestamp"]) == ("benign", "attack", "2021-02-03T04:05:20")
    context = ["unique_dst_ports_60s", "connections_60s", "failed_connections_60s"]
    assert [[r[k] for k in context] for r in (a, b, c)] == [[1, 1, 0], [2, 2, 1], [1, 1, 0]]
    assert read_dataset(spark, "cicids2017", source, FORMAT, max_rows=2).count() == 2


def test_files_with_other_headers_are_read_by_name(spark, tmp_path):
    names = list(cic())
    write(tmp_path / "in" / "a.csv", [cic(0)])
    write(tmp_path / "in" / "b.csv", [cic(1)], names=names[::-1])
    spelled = [f" {n.upper()}" for n in names]
    write(tmp_path / "in" / "c.csv", [dict(zip(spelled, cic(2).values()))])
    found = read_dataset(spark, "cicids2017", f"{tmp_path}/in/*.csv", FORMAT).collect()
    assert sorted((r.src_ip, r.dst_ip, r.dst_port, r.duration_ms) for r in found) == [
        ("10.9.0.1", "10.9.9.9", 8080, 1.5 * (i + 1)) for i in range(3)]


def test_unsw_with_and_without_header(spark, tmp_path):
    write(tmp_path / "in" / "a.csv", [unsw(0)])
    write(tmp_path / "in" / "b.csv", [{c: unsw(1).get(c, unsw(1)["stime"] if c == "Stime" else "0") for c in UNSW_RAW_COLUMNS}],
          header=False)
    out = str(tmp_path / "flows")
    assert jobs.convert_dataset(spark, "unsw-nb15", f"{tmp_path}/in", out) == 2
    flows = rows(read_flow_csv(spark, out), "timestamp")
    assert [(f["src_port"], f["dst_port"], f["duration_ms"], f["packets"], f["label"]) for f in flows] == [
        (8080, 0, 2500.0, 8, "attack")] * 2
    assert [f["failed_connections_60s"] for f in flows] == [1, 2]
    assert spark.read.csv(out, header=True).columns == FLOW_COLUMNS
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        jobs.convert_dataset(spark, "unsw-nb15", f"{tmp_path}/in", out)
    with pytest.raises(ValueError, match="same path"):
        jobs.convert_dataset(spark, "unsw-nb15", out, out, overwrite=True)
    with pytest.raises(ValueError, match="49"):
        read_dataset(spark, "unsw-nb15", write(tmp_path / "x.csv", [{"p": 1, "q": 2, "r": 3}], header=False))


def test_bad_rows_fail_or_are_returned(spark, tmp_path):
    source = write(tmp_path / "a.csv", [
        cic(50), cic(10), cic(20), cic(30), cic(55), cic(56, **{"Flow Duration": "NaN"}), cic(57, src=""),
        cic(58, **{"Timestamp": "soon"}), cic(58, **{"Destination Port": 70000})])
    with pytest.raises(Exception, match="invalid duration_ms"):
        read_dataset(spark, "cicids2017", source, FORMAT).collect()
    flows, rejects = read_dataset_with_rejects(spark, "cicids2017", source, FORMAT)
    # Every row before the newest accepted one is reversed, not only the first of them.
    assert [(r["timestamp"][-2:], r["connections_60s"]) for r in rows(flows, "timestamp")] == [("50", 1), ("55", 2)]
    assert sorted(r.error for r in rejects.collect()) == sorted(
        ["time runs backwards in source 10.9.0.1"] * 3 + ["invalid duration_ms", "missing src_ip", "invalid ts_us",
                                                          "invalid dst_port"])
    backwards = write(tmp_path / "b.csv", [cic(9), cic(3, src="10.9.0.2"), cic(8)])
    with pytest.raises(ValueError, match="backwards in source 10.9.0.1"):
        read_dataset(spark, "cicids2017", backwards, FORMAT)


def test_wrong_arguments(spark, tmp_path):
    source = write(tmp_path / "a.csv", [cic(0)])
    lacking = write(tmp_path / "b.csv", [cic(0)], names=[n for n in cic() if n != "Protocol"])
    for match, call in (("protocol", lambda: read_dataset(spark, "cicids2017", lacking)),
                        ("duplicate", lambda: header_map(["Label", "x", " LABEL"])),
                        ("unknown dataset", lambda: read_dataset(spark, "other", source)),
                        ("max_rows", lambda: read_dataset(spark, "cicids2017", source, max_rows=-1)),
                        ("cicids2017 only", lambda: read_dataset(spark, "unsw-nb15", source, FORMAT))):
        with pytest.raises(ValueError, match=match):
            call()


def test_flow_csv_refuses_holes(spark, tmp_path):
    header, first, second = SAMPLE.splitlines()[:3]
    names, cells = header.lstrip("﻿").split(","), first.split(",")
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.csv").write_text(f"{header}\n{first}\n")
    (good / "b.csv").write_text(",".join(names[::-1]) + "\n" + ",".join(second.split(",")[::-1]) + "\n")
    found = rows(read_flow_csv(spark, str(good)), "timestamp")
    assert [(r["src_ip"], r["dst_ip"], r["dst_port"]) for r in found] == [
        ("192.168.1.10", "142.250.72.14", 443), ("192.168.1.10", "1.1.1.1", 53)]
    for name, value in (("packets", ""), ("dst_port", "x"), ("timestamp", "later"), ("src_ip", "")):
        bad = [value if n == name else c for n, c in zip(names, cells)]
        (tmp_path / "bad.csv").write_text(f"{','.join(names)}\n{','.join(bad)}\n")
        with pytest.raises(Exception, match="lacks|CAST_INVALID|no time|malformed"):
            read_flow_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "short.csv").write_text(f"{','.join(names)}\n{','.join(cells[:8])}\n")
    with pytest.raises(Exception, match="lacks"):
        read_flow_csv(spark, str(tmp_path / "short.csv")).collect()


def test_rows_without_time_have_no_period(spark):
    data = [(i, None if i % 3 == 0 else i, "benign" if i % 2 else "attack") for i in range(20)]
    with pytest.raises(ValueError, match="no time"):
        chronological_split(spark.createDataFrame(data, "seq bigint, ts_us bigint, label string"))


def test_strptime_formats():
    assert spark_pattern("%d.%m.%Y %H:%M:%S") == "d.M.yyyy H:m:s"
    assert spark_pattern("%Y-%m-%dT%H") == "yyyy-M-d'T'H"
    with pytest.raises(ValueError):
        spark_pattern("%j")


def test_the_cap_is_a_cut(spark, tmp_path):
    for part in range(4):
        spark.range(part * 100, part * 100 + [30, 1, 50, 7][part]).selectExpr("cast(id as string)").repartition(1).write.mode("append").text(str(tmp_path))
    lines = with_file_order(spark.read.text(str(tmp_path)))
    everything = [r.value for r in lines.orderBy(*FILE_ORDER).collect()]
    for rows_ in (1, 29, 30, 31, 32, 60, 81, 87, 88, 500):
        got = head_rows(lines, rows_)
        assert [r.value for r in got.orderBy(*FILE_ORDER).collect()] == everything[:rows_]
    assert "Limit" not in head_rows(lines, 40)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="positive"):
        head_rows(lines, 0)
