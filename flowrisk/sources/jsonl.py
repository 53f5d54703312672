"""JSON-lines files: alerts (tolerant), review ledgers (strict), feedback queues, and sinks."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.constants import ALERT_ID_PATTERN
from flowrisk.functions.barrier import computed_once
from flowrisk.sources.order import with_file_order


def parse_tolerant(lines: DataFrame, schema: T.StructType, column: str = "value",
                   keep: list[str] = ()) -> DataFrame:
    """One row per non-blank line; ``is_bad`` marks lines that hold no JSON object."""
    text = F.col(column)
    full = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    is_object = F.col("_row._corrupt").isNull() & F.trim(text).startswith("{")
    rows = lines.filter(F.trim(text) != "").select(*keep, text, parsed.alias("_row"))
    return (computed_once(rows).select(*keep, *[F.when(is_object, F.col(f"_row.{f.name}")).alias(f.name)
                             for f in schema], (~is_object).alias("is_bad")))


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType, keep: list[str] = ()) -> DataFrame:
    """``keep``: columns of FILE_ORDER to add."""
    return parse_tolerant(with_file_order(spark.read.text(path)), schema, keep=keep)


def read_strict(spark: SparkSession, path: str, schema: T.StructType,
                may_not_exist: bool = False, keep: list[str] = ()) -> DataFrame:
    """Every line must be a JSON object, otherwise the job fails."""
    if may_not_exist and not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = read_tolerant(spark, path, schema, keep)
    return rows.filter(F.when(~F.col("is_bad"), F.lit(True)).otherwise(
        F.raise_error(F.lit(f"bad line in {path}")).cast("boolean"))).drop("is_bad")


def feedback_ids(pending: DataFrame) -> DataFrame:
    """The distinct well-formed alert ids."""
    return pending.select("alert_id").filter(F.col("alert_id").rlike(ALERT_ID_PATTERN)).distinct()


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def check_output(source: str, target: str) -> None:
    """An output must not be its own input."""
    if urlparse(source).path.rstrip("/") == urlparse(target).path.rstrip("/"):
        raise ValueError("output and input are the same path")


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Refuses an existing path unless told otherwise. The new table is written beside the old one and
    takes its place when it is complete, so a failed job leaves the old one, here or set aside."""
    spark = df.sparkSession
    if not overwrite or not path_exists(spark, path):
        df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
        return
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.option("ignoreNullFields", False).json(beside)
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{beside}.old")
    if not files.rename(old, aside) or not files.rename(new, old):
        raise OSError(f"{beside} is complete but could not be renamed to {path}; the old table is there or in {aside}")
    files.delete(aside, True)


def append_jsonl(df: DataFrame, path: str, key: str) -> None:
    """Append to a ledger, ordered by ``key`` within the new files."""
    df.sortWithinPartitions(key).write.mode("append").option("ignoreNullFields", True).json(path)
