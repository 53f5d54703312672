import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from flowrisk.operators.context import time_reversals, with_context
from flowrisk.operators.running import max_before
from flowrisk.operators.select import kth_smallest, order_statistics, percentiles
from flowrisk.streaming.context import StreamingContext

SCHEMA = "src_ip string, ts_us bigint, seq bigint, dst_port int, rst_count bigint"


def brute(data):
    """The sliding window, one row at a time in arrival order."""
    windows, out = defaultdict(deque), {}
    for src, ts, seq, port, rst in sorted(data, key=lambda r: (r[1], r[2])):
        window = windows[src]
        while window and window[0][0] < ts - 60_000_000:
            window.popleft()
        window.append((ts, port, rst > 0))
        out[seq] = (len(window), sum(w[2] for w in window), len({w[1] for w in window}))
    return out


def context(spark, data, **options):
    df = with_context(spark.createDataFrame(data, SCHEMA), ["src_ip"], **options)
    return {r.seq: (r.connections_60s, r.failed_connections_60s, r.unique_dst_ports_60s)
            for r in df.collect()}


def test_frame_bounds_and_ties(spark):
    data = [("a", 0, 0, 80, 0), ("a", 60_000_000, 1, 80, 0), ("a", 60_000_000, 2, 22, 0),
            ("a", 120_000_000, 3, 22, 0), ("a", 120_000_001, 4, 81, 0)]
    got = context(spark, data)
    assert [got[i][0] for i in range(5)] == [1, 2, 3, 3, 2]
    assert [got[i][2] for i in range(5)] == [1, 1, 2, 2, 2]


@pytest.mark.parametrize("limit", [4_000_000, 40, 2])
def test_equals_brute_force_however_far_cells_are_split(spark, limit):
    """One source holds most rows, many of them at the same instant."""
    rng = random.Random(limit)
    data = []
    for seq in range(1500):
        src = "hot" if rng.random() < 0.7 else f"s{rng.randrange(20)}"
        ts = rng.choice([rng.randrange(200_000_000), 90_000_000, 150_000_000,
                         1_000_000 * rng.randrange(200)])
        data.append((src, ts, seq * 50, rng.randrange(6), rng.randrange(2)))
    assert context(spark, data, limit=limit) == brute(data)


def test_hot_instant_is_split_by_row_number(spark):
    data = [("a", 5, seq * 40_000, seq % 3, 1) for seq in range(60)]
    assert context(spark, data, limit=4) == brute(data)


def test_no_window_partition_is_a_whole_source(spark):
    df = with_context(spark.createDataFrame([("a", 1, 1, 1, 0)], SCHEMA), ["src_ip"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window [sum(" in plan and "hashpartitioning(src_ip" in plan
    final = [line for line in plan.splitlines() if "_start" in line and "Sort [" in line][0]
    assert "_d0" in final


def test_reversals_and_running_maximum_cross_blocks(spark):
    rng = random.Random(5)
    data = [(f"s{rng.randrange(3)}", rng.randrange(100), seq, 1, 0) for seq in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    top, want = {}, {}
    for src, ts, seq, *_ in data:
        want[seq] = top.get(src)
        top[src] = max(ts, top.get(src, ts))
    checked = time_reversals(df, ["src_ip"], block=["seq div 7"]).collect()
    assert {r.seq: r.previous_ts for r in checked} == want
    assert all(r.reversed == (r.previous_ts is not None and r.ts_us < r.previous_ts) for r in checked)
    seen = max_before(df, ["src_ip"], ["seq"], "ts_us", "top", ["seq div 7"])
    assert {r.seq: r.top for r in seen.collect()} == want


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(v,) for v in (4.0, 1.0, 1.0, 2.0, 10.0, 3.0)], "v double")
    row = percentiles(df, "v", [0.0, 0.5, 0.95, 1.0]).first()
    assert (row.mean, row.p0, row.p50, row.p95, row.p100, row.max) == (3.5, 1.0, 2.5, 8.5, 10.0, 10.0)


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_order_statistic(spark, kind):
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1e6), 7.0, 1e-9 * rng.random()]) for _ in range(500)]
    values = [int(v * 1000) if kind == "bigint" else float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    ordered = sorted(values)
    for k in (1, 2, 250, 499, 500):
        assert kth_smallest(df, "v", k) == ordered[k - 1]
    with pytest.raises(ValueError):
        kth_smallest(df, "v", 501)


def test_order_statistics_of_extreme_and_tied_values(spark):
    values = [-1e308, 0.0, 1e308, -5e-324, 5e-324] + [3.0] * 5000 + [10.0 ** -i for i in range(300)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    ordered = sorted(values)
    ranks = [1, 2, 3, 150, 303, 304, 5000, len(values)]
    assert order_statistics(df, [(F.col("v"), k) for k in ranks]) == [ordered[k - 1] for k in ranks]


def test_stream_equals_batch_and_sets_late_rows_aside(spark, tmp_path):
    rng = random.Random(9)
    data = [(f"s{rng.randrange(4)}", i * 700_000, i, rng.randrange(5), rng.randrange(2))
            for i in range(400)]
    late = [("s0", 100_000_000, 300_000, 1, 0)]
    stream = StreamingContext(str(tmp_path), ["src_ip"], ["seq"])
    got, lost = {}, []
    for epoch, part in enumerate([data[:150], data[150:151], data[151:300] + late, data[300:]]):
        batch = spark.createDataFrame(part, SCHEMA)
        found, dropped = stream.process(batch, epoch, F.col("rst_count") > 0)
        lost += [r.seq for r in dropped.collect()]
        if epoch == 2:  # a batch that is run again gives the same rows
            found, _ = stream.process(batch, epoch, F.col("rst_count") > 0)
        got |= {r.seq: (r.connections_60s, r.failed_connections_60s, r.unique_dst_ports_60s)
                for r in found.collect()}
    assert lost == [300_000]
    assert got == brute(data)
