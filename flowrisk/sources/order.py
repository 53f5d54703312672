"""Where a row stands in the files it was read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.operators.select import kth_smallest

FILE_ORDER = ["written", "file", "file_block", "file_pos"]


def with_file_order(df: DataFrame) -> DataFrame:
    """Add when the file was written, its name, the offset of its split and a number that rises within it.

    Sorting by the four gives the order of the lines, appended files last, without numbering them globally.
    """
    return df.select("*", F.unix_micros("_metadata.file_modification_time").alias("written"),
                     F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("file_block"),
                     F.monotonically_increasing_id().alias("file_pos"))


def head_rows(df: DataFrame, rows: int, order: list[str] = FILE_ORDER) -> DataFrame:
    """The first ``rows`` rows in file order: the row cap for safe trials.

    ``order`` tells rows apart; its last column is a number, those before it name a split of a file. Splits are
    counted, the one that crosses the cap is found among the counts, and the number of the last row in there. What
    is left is a filter, so any cap keeps the parallelism of the read.
    """
    if rows <= 0:
        raise ValueError("the row cap must be positive")
    *split, number = order
    kinds, inside, need = dict(df.dtypes), df, rows

    def place(values: list) -> Column:
        return F.struct(*[F.lit(v).cast(kinds[name]).alias(name) for name, v in zip(order, values)])

    if split:
        along = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # one row a split
        counts = df.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min(number).alias("_first"), F.max(number).alias("_last"))
        cut = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0)))
               .filter(F.col("_before") + F.col("_n") > rows).orderBy("_before").first())
        if cut is None:
            return df
        need = rows - cut["_before"]
        for name in split:
            inside = inside.filter(F.col(name).eqNullSafe(F.lit(cut[name])))
        if need == 0:
            return df.filter(F.struct(*split) < place([cut[name] for name in split]))
        values = [cut[name] for name in split]
        if cut["_last"] - cut["_first"] + 1 == cut["_n"]:  # no gaps: the number follows from the first one
            values.append(cut["_first"] + need - 1)
    else:
        if df.count() <= rows:
            return df
        values = []
    if len(values) < len(order):
        values.append(kth_smallest(inside, number, need))
    return df.filter(F.struct(*order) <= place(values))
