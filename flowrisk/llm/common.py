"""What the operators share: words, tables, batches of bounded size, ranks without hot groups."""

from __future__ import annotations

import re
import sys
import types

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel in Arrow batches, so these hold fewer rows than the default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def plain_text(text: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, so that later tasks find what earlier ones made."""
    return vars(sys.modules.setdefault("flowrisk_worker_cache", types.ModuleType("flowrisk_worker_cache")))


def ranked(df: DataFrame, group: list[str], order: list, rank: str, buckets: int = 1024) -> DataFrame:
    """Adds the rank from 0 within ``group``; a hot group is ranked in ``buckets`` parts.

    Rows are dealt to buckets by the hash of ``order`` (the names of columns that tell rows apart), so the
    ranks are gapless and repeatable but follow ``order`` only inside a bucket.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)],
                          F.col("_bucket").alias("_kb"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = dealt["_bucket"] == starts["_kb"]
    for i, c in enumerate(group):
        same = same & dealt[c].eqNullSafe(starts[f"_k{i}"])
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (dealt.withColumn("_in", F.row_number().over(inside)).join(starts, same)
            .withColumn(rank, F.col("_start") + F.col("_in") - 1)
            .drop("_bucket", "_kb", "_start", "_in", *[f"_k{i}" for i in range(len(group))]))
