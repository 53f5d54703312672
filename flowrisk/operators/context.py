"""60-second per-source context: connections, failures and distinct destination ports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from flowrisk.constants import WINDOW_US
from flowrisk.operators.running import CELL_LIMIT, max_before, minute, running_sums, union_all
from flowrisk.session import stage

# A row at time t is still inside the window of a row at t + 60 s and leaves one microsecond later.
LEAVES_AFTER = WINDOW_US + 1
SEQ_BLOCK = 65_536


def _minutes(df: DataFrame, keys: list[str], ts: str, seq: list[str], port: str | None) -> DataFrame:
    """Per source, port and minute: rows and failures, those of its last microsecond, first row and last time.

    One map-side-combined table that tells when ports are live, what the sums at the start of a minute are, and
    whether a minute is too large for one task.
    """
    last = F.expr(f"pmod({ts}, {WINDOW_US}) = {WINDOW_US - 1}")
    first = F.min(F.struct(F.col(ts).alias("t"), *[F.col(s).alias(f"s{i}") for i, s in enumerate(seq)]))
    failed = F.coalesce("_failed", F.lit(0))
    return (df.groupBy(*keys, *([port] if port else []), minute(ts).alias("_m"))
            .agg(F.count(F.lit(1)).alias("_n"), F.sum(failed).alias("_f"), F.count_if(last).alias("_n1"),
                 F.sum(F.when(last, failed).otherwise(0)).alias("_f1"), first.alias("_first"), F.max(ts).alias("_last")))


def _totals(minutes: DataFrame, ports: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, minute, measures): what the events of each minute add up to.

    A row enters in its minute and leaves 60 s and a microsecond later: in the next one, or the one after if it was the
    minute's last microsecond.
    """
    def moved(by: int, conns: Column, fails: Column) -> DataFrame:
        return minutes.select(*keys, (F.col("_m") + by).alias("minute"), conns.alias("_conns"), fails.alias("_fails"))

    n, f, n1, f1 = map(F.col, ("_n", "_f", "_n1", "_f1"))
    parts = [moved(0, n, f), moved(1, n1 - n, f1 - f), moved(2, -n1, -f1).filter("_conns <> 0")]
    if ports is not None:
        parts = [p.withColumn("_ports", F.lit(0).cast("bigint")) for p in parts]
        zero = F.lit(0).cast("bigint")
        parts.append(ports.select(*keys, minute("_t").alias("minute"), zero.alias("_conns"), zero.alias("_fails"), "_ports"))
    everything = union_all(parts)
    return everything.groupBy(*keys, "minute").agg(*[F.sum(m).alias(m) for m in everything.columns[len(keys) + 1:]])


def _port_events(minutes: DataFrame, keys: list[str], seq: list[str], port: str) -> DataFrame:
    """+1 when a port becomes live for a source, -1 when it has been silent for 60 seconds.

    A port is live from its first row until 60 s after its last one, as long as no gap is longer
    than 60 s. Rows of one minute can have no such gap, so first and last row per minute are enough
    and the map side reduces a busy port to one row per minute.
    """
    along = Window.partitionBy(*keys, port).orderBy("_m")
    gap_before = F.col("_first.t") - F.lag("_last").over(along)
    gap_after = F.lead("_first.t").over(along) - F.col("_last")
    spans = minutes.select(
        *keys, "_first", "_last",
        F.coalesce(gap_before > WINDOW_US, F.lit(True)).alias("_starts"),
        F.coalesce(gap_after > WINDOW_US, F.lit(True)).alias("_ends"))
    starting = F.col("_phase") == 1
    return (spans.filter("_starts or _ends")
            .withColumn("_phase", F.explode(F.array(F.lit(0), F.lit(1))))
            .filter(F.when(starting, F.col("_starts")).otherwise(F.col("_ends")))
            .select(*keys, "_phase", F.lit(0).alias("_row"),
                    F.when(starting, F.col("_first.t")).otherwise(F.col("_last") + LEAVES_AFTER)
                    .alias("_t"),
                    *[F.when(starting, F.col(f"_first.s{i}")).alias(f"_s{i}")
                      for i in range(len(seq))],
                    F.when(starting, F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
                    .alias("_ports")))


def with_context(df: DataFrame, keys: list[str], ts: str = "ts_us", seq: list[str] = ("seq",),
                 port: str | None = "dst_port", failed: Column | None = None,
                 limit: int = CELL_LIMIT) -> DataFrame:
    """Add the context columns for the frame [t - 60 s, t] of rows that arrived up to this one.

    ``keys`` name the source; ``seq`` gives the arrival order among rows with equal ``ts``: a row
    number, or columns of which all but the last also number bounded blocks of rows. Every row enters the running
    sums once and leaves them once, so the work is linear in the rows. The input is read twice, for the minutes only a
    few columns of it; one that is costly to read, or numbered while it is read, belongs in ``stage`` before.
    """
    failed = F.col("rst_count") > 0 if failed is None else failed
    seq = list(seq)
    columns, kinds = df.columns, dict(df.dtypes)
    df = df.withColumn("_failed", failed.cast("bigint"))
    ties = [f"coalesce(_s0 div {SEQ_BLOCK}, -1)"] if len(seq) == 1 else [
        f"coalesce(_s{i}, {'-1' if kinds[s] != 'string' else repr('')})" for i, s in enumerate(seq[:-1])]
    if len(seq) > 1 and kinds[seq[-1]] in ("int", "bigint"):
        ties.append(f"coalesce(_s{len(seq) - 1} div {SEQ_BLOCK}, -1)")
    entering = F.col("_enter") == 1
    both = df.withColumn("_enter", F.explode(F.array(F.lit(0), F.lit(1))))
    sign = F.when(entering, F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    payload = [c for c in columns if c not in keys]
    moves = both.select(
        *keys, *[F.when(entering, F.col(c)).alias(c) for c in payload],
        F.when(entering, F.col(ts)).otherwise(F.col(ts) + LEAVES_AFTER).alias("_t"),
        F.col("_enter").alias("_phase"), F.col("_enter").alias("_row"),
        *[F.when(entering, F.col(s)).alias(f"_s{i}") for i, s in enumerate(seq)],
        sign.alias("_conns"), (sign * F.coalesce("_failed", F.lit(0))).alias("_fails"))
    measures, events, ports = ["_conns", "_fails"], moves, None
    seen = Observation()
    minutes = stage(_minutes(df, keys, ts, seq, port).observe(seen, F.sum("_n").alias("rows")), "minutes")
    if port:
        measures.append("_ports")
        ports = _port_events(minutes, keys, seq, port)
        events = union_all([moves.withColumn("_ports", F.lit(0).cast("bigint")), ports])
        events = events.fillna(0, ["_conns", "_fails"])
    order = ["_t", "_phase", *[f"_s{i}" for i in range(len(seq))], "_row"]
    # A minute's events are at most its own rows and the last minute's, each with one port event.
    busy = minutes.groupBy(*keys, "_m").agg(F.sum("_n").alias("n")).filter(F.col("n") > limit // 4)
    calm = (seen.get["rows"] or 0) <= limit // 4 or busy.isEmpty()  # a minute holds no more than all
    totals = _totals(minutes, ports, keys) if calm else None
    summed = running_sums(events, keys, "_t", order, measures, ties, limit, totals)
    context = {"connections_60s": F.col("_conns"), "failed_connections_60s": F.col("_fails")}
    if port:
        context["unique_dst_ports_60s"] = F.col("_ports")
    kept = [c for c in columns if c not in context]
    return summed.filter(F.col("_row") == 1).select(
        *kept, *[column.alias(name) for name, column in context.items()])


def time_reversals(df: DataFrame, keys: list[str], ts: str = "ts_us", seq: list[str] = ("seq",),
                   block: list[str] | None = None) -> DataFrame:
    """Add ``previous_ts`` and ``reversed``: the row is older than the newest row before it in its source.

    Reversed rows never are the newest, so that is the newest accepted row, however many are reversed.
    """
    block = block or [f"{seq[0]} div {1 << 20}"]
    seen = max_before(df, keys, list(seq), ts, "previous_ts", block)
    return seen.withColumn("reversed", F.coalesce(F.col(ts) < F.col("previous_ts"), F.lit(False)))
