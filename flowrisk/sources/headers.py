"""CSV files whose headers may differ: every header is a group that is read by its own column names."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def header_groups(spark: SparkSession, path) -> dict[tuple[str, ...], list[str]]:
    """Header -> files. One row per file comes to the driver, which has listed them anyway."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"),
        F.col("_metadata.file_block_start").alias("block")).filter("block = 0")
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, first in lines.groupBy("file").agg(F.min_by("value", "n")).collect():
        header = tuple(next(csv.reader([first.lstrip("﻿")]), ()))
        groups.setdefault(header, []).append(unquote(file))
    if not groups:
        raise ValueError("the CSV has no header")
    return groups


def read_group(spark: SparkSession, files: list[str]) -> DataFrame:
    """Text columns of files with one header."""
    return spark.read.csv(sorted(files), header=True, inferSchema=False)
