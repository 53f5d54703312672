"""The 60-second context and new connections over micro-batches, equal to the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.constants import WINDOW_US
from flowrisk.operators.context import with_context
from flowrisk.operators.running import max_before
from flowrisk.operators.snapshots import KEY
from flowrisk.streaming.state import StateTable, staged


class StreamingContext:
    """Adds the context to each batch from its rows and the still relevant earlier ones.

    Rows older than the watermark (newest time of earlier batches minus ``delay_us``) or older than
    an earlier row of their source are late and go to the second result. The tail that is kept
    covers 60 s before the watermark, so it is bounded by the rate of the feed, not its length.
    """

    def __init__(self, path: str, keys: list[str], seq: list[str], port: str = "dst_port",
                 ts: str = "ts_us", delay_us: int = WINDOW_US, check_order: bool = True,
                 clock: list[str] | None = None, expire_us: int | None = None):
        """``clock``: columns (among the keys) whose rows share a clock, such as the host. Each clock then
        has its own watermark and tail, and one feed may lag behind another as long as it likes. A clock that sent
        nothing while the feed as a whole moved on by ``expire_us`` leaves the state."""
        self.state = StateTable(f"{path.rstrip('/')}/tail")
        self.stage_path, self.clock = f"{path.rstrip('/')}/stage-context", clock
        self.keys, self.seq, self.port, self.ts = keys, list(seq), port, ts
        self.delay, self.check_order, self.expire = delay_us, check_order, expire_us

    def process(self, batch: DataFrame, epoch: int, failed: Column) -> tuple[DataFrame, DataFrame]:
        """(rows with context, late rows); saves the state of this epoch."""
        spark = batch.sparkSession
        slim = [*self.keys, self.ts, *self.seq, self.port, "_failed", "_epoch", "_mark", "_stamp"]
        empty = F.lit(None).cast("bigint")
        new = batch.withColumns({"_failed": failed, "_epoch": F.lit(epoch).cast("bigint"),
                                 "_old": F.lit(False), "_mark": empty, "_stamp": empty})
        tail = self.state.before(spark, epoch)
        mark = None
        if tail is not None:
            mark = tail.agg(F.max("_mark")).first()[0]
            kept = tail.filter(F.col("_mark").isNull()).withColumn("_old", F.lit(True))
            new = kept.unionByName(new, allowMissingColumns=True).select(*new.columns)
        if self.check_order:
            order = ["_epoch", *self.seq]
            block = ["_epoch", f"{self.seq[0]} div 1048576"]
            new = max_before(new, self.keys, order, self.ts, "_seen", block)
            late = F.coalesce(F.col(self.ts) < F.col("_seen"), F.lit(False))
        else:
            new, late = new.withColumn("_seen", empty), F.lit(False)
        if self.clock and tail is not None:
            new = with_host_facts(new, self.clock, _low=F.max(F.when(F.col("_old"), F.col(self.ts))) - self.delay)
            late = late | F.coalesce(F.col(self.ts) < F.col("_low"), F.lit(False))
        elif mark is not None and not self.clock:
            late = late | (F.col(self.ts) < mark)
        helpers = ["_failed", "_epoch", "_old", "_seen", "_mark", "_late", "_stamp", "_low"]
        new = staged(new.withColumn("_late", late & ~F.col("_old")), self.stage_path, epoch)
        late = F.col("_late")
        newest = batch.agg(F.max(self.ts)).first()[0]
        mark = max([m for m in (mark, None if newest is None else newest - self.delay)
                    if m is not None], default=None)
        good = new.filter(~late).drop("_seen", "_late", "_low")
        result = with_context(good, self.keys, self.ts, ["_epoch", *self.seq], self.port,
                              F.col("_failed")).filter(~F.col("_old")).drop(*helpers)
        now = None if mark is None else mark + self.delay
        if self.clock:
            facts = {"_newest": F.max(self.ts), "_last": F.max(F.when(F.col("_old"), F.col("_stamp")).otherwise(F.lit(now)))}
            rest = with_host_facts(good, self.clock, **facts).filter(F.col(self.ts) >= F.col("_newest") - self.delay - WINDOW_US)
            if self.expire is not None and now is not None:
                rest = rest.filter(F.col("_last") >= now - self.expire)
            rest = rest.withColumn("_stamp", F.col("_last"))
        else:
            rest = good.filter(F.col(self.ts) >= mark - WINDOW_US) if mark is not None else good
        marker = spark.range(1).select(F.lit(mark).cast("bigint").alias("_mark"))
        self.state.save(rest.select(*slim).unionByName(marker, allowMissingColumns=True), epoch)
        return result, new.filter(late).drop(*helpers)


def with_host_facts(rows: DataFrame, host: list[str], **facts: Column) -> DataFrame:
    """Adds aggregates of each host's rows to them."""
    return rows.join(rows.groupBy(*host).agg(*[fact.alias(name) for name, fact in facts.items()]), host)


class StreamingConnections:
    """Connections of each batch that the host's previous snapshot did not list, as in the batch operator.

    A host's watermark is the time of its newest snapshot minus ``delay``. Rows that come behind it are late and go
    to the second result. Others may come in any order and a snapshot in several batches: what a snapshot has new
    is told when the watermark reaches it, that is at once without a delay. The state holds the snapshots that
    are not told yet, and of the others those from the watermark on and the one before. A host that
    sent nothing while the feed as a whole moved on by ``expire`` leaves the state, and what it held is told.

    ``time`` gives a snapshot's time, all its rows the same; by default it is its number.
    """

    def __init__(self, path: str, key: list[str] = KEY, time: str = "snapshot_no", delay: int = 0,
                 expire: int | None = None):
        self.state, self.key, self.time = StateTable(f"{path.rstrip('/')}/snapshots"), key, time
        self.stage_path, self.delay, self.expire = f"{path.rstrip('/')}/stage-snapshots", delay, expire

    def process(self, batch: DataFrame, epoch: int, close: bool = False) -> tuple[DataFrame, DataFrame]:
        """(new connections, late rows); saves the state of this epoch. ``close`` tells all that is held."""
        spark, time = batch.sparkSession, F.col(self.time)
        empty = F.lit(None).cast("bigint")
        rows = batch.withColumns({"_held": F.lit(True), "_old": F.lit(False), "_stamp": empty, "_mark": empty})
        before = self.state.before(spark, epoch)
        now = batch.agg(F.max(self.time)).first()[0]
        if before is not None:
            now = max((m for m in (now, before.agg(F.max("_mark")).first()[0]) if m is not None), default=None)
            old = before.filter(F.col("_mark").isNull()).withColumn("_old", F.lit(True))
            rows = rows.unionByName(old, allowMissingColumns=True).select(*rows.columns)
        low = F.max(F.when(F.col("_old"), time)) - self.delay
        rows = with_host_facts(rows, ["host"], _low=low)
        late = ~F.col("_old") & F.coalesce(time < F.col("_low"), F.lit(False))
        rows = staged(rows.withColumn("_late", late).drop("_low"), self.stage_path, epoch)
        good = rows.filter("not _late").drop("_late")
        helpers = ["_held", "_old", "_stamp", "_mark"]
        good = with_host_facts(good, ["host"], _until=F.max(time) - self.delay,
                               _last=F.max(F.when(F.col("_old"), F.col("_stamp")).otherwise(F.lit(now).cast("bigint"))))
        gone = F.lit(False)
        if self.expire is not None and now is not None:
            gone = F.col("_last") < now - self.expire
        told = F.lit(close) | gone | (time <= F.col("_until"))
        slim = ["host", "snapshot_no", *self.key]
        listed = good.select("host", (F.col("snapshot_no") + 1).alias("snapshot_no"), *self.key)
        news = (good.filter(F.col("_held") & told).join(listed, slim, "left_anti")
                .drop(*helpers, "_until", "_last"))
        left = good.filter(~gone).withColumn("_stamp", F.col("_last"))
        closed = F.max(F.when(time < F.col("_until"), F.col("snapshot_no")))
        past = (with_host_facts(left.filter(~F.col("_held") | told), ["host"], _closed=closed)
                .filter((time >= F.col("_until")) | (F.col("snapshot_no") == F.col("_closed")))
                .select(*slim, *({self.time} - set(slim)), F.lit(False).alias("_held"), "_stamp").distinct())
        held = left.filter(F.col("_held") & ~told).drop("_old", "_mark", "_until", "_last")
        marker = spark.range(1).select(F.lit(now).cast("bigint").alias("_mark"))
        self.state.save(held.unionByName(past, allowMissingColumns=True).unionByName(marker, allowMissingColumns=True), epoch)
        return news, rows.filter("_late").drop(*helpers, "_late")
