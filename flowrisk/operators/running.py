"""Exact running sums that stay parallel when one group holds a large share of the rows.

A plain window over the group sorts a hot group in one task. Here the time line of a group is cut
into cells (minutes). A cell's starting value is the sum of the earlier cells of its group, which
needs only the small table of cell totals; inside a cell an ordinary window adds the rows up. Cells
that still hold too many rows are cut again, by millisecond, then by instant and block of row
numbers, so the largest window partition is bounded by ``limit`` whatever the skew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.session import shared_dir

CELL_LIMIT = 4_000_000


def minute(time: str) -> Column:
    return F.expr(f"({time} - pmod({time}, 60000000)) div 60000000")


def _digits(time: str, ties: list[str]) -> list[tuple[str, Column]]:
    """Cell numbers, coarse to fine. Each one refines the last and follows the row order."""
    digits = [minute(time), F.expr(f"{time} div 1000"), F.col(time)]
    digits += [F.expr(tie) for tie in ties]
    return [(f"_d{i}", digit) for i, digit in enumerate(digits)]


def assign_cells(events: DataFrame, group: list[str], time: str, ties: list[str] = (),
                 limit: int = CELL_LIMIT) -> tuple[DataFrame, list[str]]:
    """Add the cell columns; a finer one is added only for cells with more than ``limit`` rows.

    At most rows / limit cells can be hot; the optimizer broadcasts that table if its size allows it.
    """
    shared_dir(events.sparkSession)
    digits = _digits(time, ties)
    cells = events.withColumn(*digits[0])
    used = ["_d0"]
    for name, digit in digits[1:]:
        parent = used[-1]
        hot = (cells.filter(F.col(parent).isNotNull()).groupBy(*group, *used).count()
               .filter(F.col("count") > limit).drop("count"))
        if hot.isEmpty():
            break
        hot = hot.withColumn("_hot", F.lit(True)).checkpoint()
        cells = (cells.join(hot, [*group, *used], "left")
                 .withColumn(name, F.when(F.col("_hot"), digit)).drop("_hot"))
        used.append(name)
    return cells, used


def _offsets(cells: DataFrame, group: list[str], used: list[str], measures: list[str]) -> DataFrame:
    """The value of each running sum at the start of every cell."""
    sums = [F.sum(m).alias(m) for m in measures]
    totals = cells.groupBy(*group, *used).agg(*sums)
    kinds = dict(totals.dtypes)
    start = None
    for depth, name in enumerate(used):
        parent = [*group, *used[:depth]]
        level = totals.filter(F.col(name).isNotNull())
        if depth < len(used) - 1:
            level = level.groupBy(*parent, name).agg(*sums)
        if start is not None:
            level = level.unionByName(start.withColumn(name, F.lit(None).cast(kinds[name])))
        before = (Window.partitionBy(*parent).orderBy(F.col(name).asc_nulls_first())
                  .rowsBetween(Window.unboundedPreceding, -1))
        start = level.select(*parent, name, *[
            F.when(F.col(name).isNull(), F.col(m)).otherwise(
                F.coalesce(F.sum(m).over(before), F.lit(0))).cast("bigint").alias(m)
            for m in measures])
    return start


def running_sums(events: DataFrame, group: list[str], time: str, order: list[str],
                 measures: list[str], ties: list[str] = (), limit: int = CELL_LIMIT,
                 totals: DataFrame | None = None) -> DataFrame:
    """Replace each measure by its running total within ``group`` along ``order``.

    ``order`` must start with ``time``. ``ties`` are expressions that number blocks of rows with
    equal time, coarse to fine and in row order; rows where they are NULL come first. ``totals`` are the sums of each
    group's ``minute``, if they are known already; giving them states that no minute exceeds the limit.
    """
    if totals is None:
        cells, used = assign_cells(events, group, time, ties, limit)
        starts = _offsets(cells, group, used, measures)
    else:
        used = ["_d0"]
        cells = events.withColumn("_d0", minute(time))
        before = Window.partitionBy(*group).orderBy("_d0").rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.withColumnRenamed("minute", "_d0").select(
            *group, "_d0", *[F.coalesce(F.sum(m).over(before), F.lit(0)).cast("bigint").alias(m) for m in measures])
    rows = cells.withColumn("_start", F.lit(0)).unionByName(starts.withColumn("_start", F.lit(1)), allowMissingColumns=True)
    upto = (Window.partitionBy(*group, *used).orderBy(F.desc("_start"), *order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.select("*", *[F.sum(m).over(upto).alias(f"_sum_{m}") for m in measures])
            .filter(F.col("_start") == 0)
            .withColumns({m: F.col(f"_sum_{m}") for m in measures})
            .drop("_start", *used, *[f"_sum_{m}" for m in measures]))


def max_before(df: DataFrame, group: list[str], order: list[str], value: str, out: str,
               block: list[str]) -> DataFrame:
    """The largest ``value`` among a group's earlier rows along ``order``, in bounded blocks."""
    names = [f"_b{i}" for i in range(len(block))]
    pieces = df.withColumns({n: F.expr(e) for n, e in zip(names, block)})
    before = (Window.partitionBy(*group).orderBy(*names)
              .rowsBetween(Window.unboundedPreceding, -1))
    top = (pieces.groupBy(*group, *names).agg(F.max(value).alias("_top"))
           .select(*group, *names, F.max("_top").over(before).alias(value)))
    rows = pieces.withColumn("_start", F.lit(0)).unionByName(
        top.withColumn("_start", F.lit(1)), allowMissingColumns=True)
    along = (Window.partitionBy(*group, *names).orderBy(F.desc("_start"), *order)
             .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn(out, F.max(value).over(along))
            .filter(F.col("_start") == 0).drop("_start", *names))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
