import os
import random
import struct

import pytest

from flowrisk.operators.flows import capture_flows
from flowrisk.plans.jobs import captures
from flowrisk.sources import captures as sources
from flowrisk.sources.captures import decode_frames, decode_packets, read_captures, scan_captures
from flowrisk.schema import ALERT
from flowrisk.sources.flow_csv import read_flow_csv
from flowrisk.sources.jsonl import read_tolerant
from tests.conftest import rows

MAC = bytes(12)
CLIENT, SERVER = bytes([10, 0, 0, 5]), bytes([192, 168, 1, 10])
SIX = struct.pack("!IIII", 0x20010DB8, 0, 0, 1) + struct.pack("!IIII", 0x20010DB8, 0, 0, 2)


def tcp(sport=50000, dport=443, flags=2):
    return struct.pack("!HHLLBBHHH", sport, dport, 0, 0, 5 << 4, flags, 1024, 0, 0)


def udp(sport=53000, dport=53):
    return struct.pack("!HHHH", sport, dport, 8, 0)


def ip4(payload, src=CLIENT, dst=SERVER, proto=6, fragment=0):
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(payload), 1, fragment, 64, proto, 0,
                       src, dst) + payload


def eth4(payload, *args, **kwargs):
    return MAC + b"\x08\x00" + ip4(payload, *args, **kwargs)


def eth6(following, payload):
    return MAC + b"\x86\xdd" + struct.pack("!IHBB", 6 << 28, len(payload), following, 64) + SIX + payload


def pcap(frames, order="<", magic=0xA1B2C3D4, fraction=0, link=1):
    out = struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, link)
    for i, frame in enumerate(frames):
        out += struct.pack(order + "IIII", 1_700_000_000 + i, fraction, len(frame), len(frame)) + frame
    return out


def block(kind, body):
    body += bytes(-len(body) % 4)
    return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))


def pcapng(frame, resolution=6):
    ticks = 1_700_000_000 * 10 ** resolution
    return (block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
            + block(1, struct.pack("<HHIHHB3xHH", 1, 0, 65535, 9, 1, resolution, 0, 0))
            + block(5, bytes(8))
            + block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(frame),
                                   len(frame)) + frame))


def read(spark, tmp_path, data, **options):
    (tmp_path / "x.cap").write_bytes(data)
    return rows(capture_flows(decode_packets(read_captures(spark, str(tmp_path / "x.cap"))),
                              **options), "ts_us", "dst_port")


def test_two_ports_make_two_flows(spark, tmp_path):
    a, b = read(spark, tmp_path, pcap([eth4(tcp(dport=22)), eth4(tcp(dport=23))]))
    assert (a["src_ip"], a["protocol"], a["timestamp"]) == ("10.0.0.5", "TCP",
                                                            "2023-11-14T22:13:20Z")
    assert (b["unique_dst_ports_60s"], b["connections_60s"]) == (2, 2)


def test_reverse_packets_merge(spark, tmp_path):
    data = pcap([eth4(tcp()), eth4(tcp(443, 50000, 0x16), SERVER, CLIENT)])
    merged, = read(spark, tmp_path, data)
    assert (merged["src_ip"], merged["packets"], merged["bytes_sent"], merged["bytes_received"],
            merged["syn_count"], merged["rst_count"], merged["duration_ms"]) == (
        "10.0.0.5", 2, 40, 40, 2, 1, 1000.0)
    assert len(read(spark, tmp_path, data, bidirectional=False)) == 2


def test_formats(spark, tmp_path):
    for data, us in ((pcapng(eth4(tcp())), 0), (pcapng(eth4(tcp()), 9), 0),
                     (pcap([eth4(tcp())], ">", 0xA1B2C3D4, 7), 7),
                     (pcap([eth4(tcp())], "<", 0xA1B23C4D, 7999), 7),
                     (pcap([ip4(tcp())], link=101), 0),
                     (pcap([bytes(14) + b"\x08\x00" + ip4(tcp())], link=113), 0)):
        flow, = read(spark, tmp_path, data)
        assert (flow["ts_us"], flow["bytes_sent"]) == (1_700_000_000_000_000 + us, 40)


@pytest.mark.parametrize("data, problem", [
    (b"not a capture", "neither classic PCAP nor PCAPNG"),
    (pcap([eth4(tcp())])[:-5], "truncated packet"),
    (pcap([eth4(tcp())], link=147), "unsupported link type 147"),
    (pcapng(eth4(tcp()))[:-2], "bad block length")])
def test_bad_files_fail(spark, tmp_path, data, problem):
    with pytest.raises(Exception, match=problem):
        read(spark, tmp_path, data)


def decoded(*frames, link=1):
    out = decode_frames(list(frames), [link] * len(frames))
    return [tuple(r) if ok else None for ok, r in zip(
        out["ok"], out[["dst_port", "protocol", "byte_count"]].itertuples(index=False))]


def test_ipv6_extension_headers():
    hop, to_tcp = bytes([60, 0]) + bytes(6), bytes([6, 0]) + bytes(6)
    routing, auth = bytes([51, 0]) + bytes(6), bytes([17, 1]) + bytes(10)
    first, later = struct.pack("!BBHI", 6, 0, 1, 123), struct.pack("!BBHI", 6, 0, 8, 123)
    chain = b"".join(bytes([60 if i < 8 else 6, 0]) + bytes(6) for i in range(9))
    assert decoded(
        eth6(0, hop + to_tcp + tcp()), eth6(43, routing + auth + udp()),
        eth6(44, first + tcp()), eth6(44, later + bytes(20)), eth6(60, bytes([6, 1]) + bytes(6)),
        eth6(60, chain + tcp()), eth6(50, bytes(24)), eth6(59, b""), eth6(60, hop[:0] + bytes([0, 0])
        + bytes(6) + to_tcp + tcp()), eth6(60, chain[8:] + tcp())) == [
        (443, "TCP", 76), (53, "UDP", 68), (443, "TCP", 68), None, None, None, None, None, None,
        (443, "TCP", 124)]
    out = decode_frames([eth6(6, tcp())], [1])
    assert (out["src6"][0], out["dst6"][0]) == ("2001:db8::1", "2001:db8::2")


def test_ipv4_frames():
    tagged = MAC + b"\x88\xa8\x00\x01\x81\x00\x00\x02\x08\x00" + ip4(udp(), proto=17)
    assert decoded(tagged, eth4(tcp(), fragment=5), eth4(tcp()[:19]), eth4(tcp(), proto=1),
                   MAC + b"\x08\x06" + bytes(28), b"", MAC + b"\x81\x00", eth4(tcp()) + bytes(6),
                   ) == [(53, "UDP", 28), None, None, None, None, None, None, (443, "TCP", 40)]


def test_packet_cap_and_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = pcap([eth4(tcp(dport=p)) for p in range(1000, 1030)])
    (tmp_path / "in" / "a.pcap").write_bytes(data)
    source = str(tmp_path / "in")
    assert read_captures(spark, source, 7).count() == 7
    out = captures(spark, source, str(tmp_path / "flows"), str(tmp_path / "alerts"))
    assert out["flows"] == 30
    alerts = read_tolerant(spark, str(tmp_path / "alerts"), ALERT)
    assert alerts.count() == out["alerts"]
    assert alerts.filter("array_contains(rule_ids, 'PORT_SCAN')").count() == 11
    assert read_flow_csv(spark, str(tmp_path / "flows")).count() == 30


def capture_bytes(seed, ng, order="<"):
    """A capture whose payloads hold captures, runs of zeros and line ends."""
    rng = random.Random(seed)
    inner = pcap([eth4(tcp(dport=p)) for p in range(20)], order)
    frames = []
    for _ in range(250):
        payload = rng.choice([rng.randbytes(rng.randint(0, 90)), bytes(rng.randint(0, 300)), inner[24:], inner, b"\n" * 30])
        frames.append(eth4(tcp() + payload) if rng.random() < .9 else b"")
    if not ng:
        return pcap(frames, order, fraction=7)
    out = b""
    for part in range(3):  # sections with interfaces of their own
        out += block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
        for i in range(1 + part):
            out += block(1, struct.pack("<HHIHHB3xHH", 1, 0, 65535, 9, 1, 6 + i, 0, 0))
        for i, frame in enumerate(frames[part::3]):
            if i == 40:
                out += block(1, struct.pack("<HHIHH", 101, 0, 65535, 0, 0)) + block(5, bytes(8))
            ticks = (1_700_000_000 + i) * 10 ** 6
            which = rng.randrange(1 + part + (i >= 40))
            out += block(6, struct.pack("<IIIII", which, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame)
    return out


@pytest.mark.parametrize("ng, order, size", [(False, "<", 200), (False, ">", 9000), (True, "<", 7000)])
def test_ranges_equal_the_whole_file(spark, tmp_path, ng, order, size):
    data = [capture_bytes(seed, ng, order) for seed in (1, 2)] + [pcap([eth4(tcp())]), pcap([])]
    if size < 500:
        data = [d[:24] + d[24:3000] for d in data[:1]] + data[2:]
        data[0] = whole_records(data[0], order)
    for i, content in enumerate(data):
        (tmp_path / f"{i} x.cap").write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    for cap in (None, 100):
        want = sorted(map(tuple, scan_captures(files, cap).collect()))
        assert sorted(map(tuple, read_captures(spark, str(tmp_path), cap, size).collect())) == want
    assert read_captures(spark, str(tmp_path), None, size).rdd.getNumPartitions() > 2


def whole_records(data, order):
    at = 24
    while at + 16 <= len(data) and at + 16 + struct.unpack_from(order + "I", data, at + 8)[0] <= len(data):
        at += 16 + struct.unpack_from(order + "I", data, at + 8)[0]
    return data[:at]


def test_a_false_entry_is_walked_again(spark, tmp_path, monkeypatch):
    """Every range but the first begins in a place where a look alone goes wrong."""
    monkeypatch.setattr(sources._Walk, "enter", lambda self, start: setattr(self, "at", start) or True)
    data = pcap([eth4(tcp(dport=p) + struct.pack("<IIII", 9, 9, 9, 9) * 8) for p in range(60)])
    (tmp_path / "a.pcap").write_bytes(data)
    want = sorted(map(tuple, scan_captures(spark.read.format("binaryFile").load(str(tmp_path))).collect()))
    assert sorted(map(tuple, read_captures(spark, str(tmp_path), None, 3000).collect())) == want


@pytest.mark.parametrize("data, problem", [
    (pcap([eth4(tcp())] * 100)[:-5], "truncated packet"), (pcapng(eth4(tcp())) * 30 + bytes(3), "truncated block"),
    (pcapng(eth4(tcp())) * 30 + struct.pack("<II", 6, 10) + bytes(900), "bad block length")])
def test_bad_ranges_fail_where_they_are_read(spark, tmp_path, data, problem):
    (tmp_path / "x.cap").write_bytes(data)
    with pytest.raises(Exception, match=problem):
        read_captures(spark, str(tmp_path / "x.cap"), None, 600).count()
    assert read_captures(spark, str(tmp_path / "x.cap"), 10, 600).count() == 10


def test_a_store_that_python_cannot_open(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "_can_open", lambda path: False)
    (tmp_path / "x.cap").write_bytes(pcap([eth4(tcp())] * 50))
    assert read_captures(spark, str(tmp_path / "x.cap"), None, 100).count() == 50


def test_capture_files_hold_little_at_a_time(spark, tmp_path, monkeypatch):
    """A file a task, tables read in small splits, and the session's setting as before."""
    from flowrisk.plans import fixtures, q_flows
    (spark.range(4000).selectExpr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id) as l_shipdate", "id as l_orderkey",
                                  "cast(id % 7 as int) as l_linenumber", "id as l_partkey", "id as l_suppkey",
                                  "cast(id % 50 as double) as l_quantity", "'A' as l_returnflag", "'F' as l_linestatus")
     .write.parquet(str(tmp_path / "lineitem.parquet")))
    name, seen = "spark.sql.files.maxPartitionBytes", []
    usual = spark.conf.get(name)
    monkeypatch.setattr(q_flows, "small_splits", lambda s, call=q_flows.small_splits: seen.append(1) or call(s))
    path = q_flows.capture_files(spark, str(tmp_path), packets_a_file=100)
    folders = [f for f in os.listdir(path) if f.startswith("f=")]
    assert len(folders) == 40 and all(len([x for x in os.listdir(f"{path}/{f}") if x.startswith("part-")]) == 1 for f in folders)
    tasks = {x.split("-")[1] for f in folders for x in os.listdir(f"{path}/{f}") if x.startswith("part-")}
    assert len(tasks) == 40 and seen and spark.conf.get(name) == usual
    assert read_captures(spark, path).count() == fixtures.packets(spark, str(tmp_path)).count()
