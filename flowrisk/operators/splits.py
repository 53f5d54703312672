"""Chronological splits at exact row counts, stable on equal timestamps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.functions.normalize import strict_label_int
from flowrisk.operators.select import order_statistics
from flowrisk.session import stage


def _first_rows(df: DataFrame, sizes: list[int], ts: str, seq: str) -> list[Column]:
    """For each size, a predicate for that many first rows in (ts, seq) order; all found together."""
    times = order_statistics(df, [(F.col(ts), n) for n in sizes])
    before = df.agg(*[F.count_if(F.col(ts) < F.lit(t)) for t in times]).first()
    last = order_statistics(df, [(F.when(F.col(ts) == F.lit(t), F.col(seq)), n - b)
                                 for t, n, b in zip(times, sizes, before)])
    return [(F.col(ts) < F.lit(t)) | ((F.col(ts) == F.lit(t)) & (F.col(seq) <= F.lit(s)))
            for t, s in zip(times, last)]


def _slim(df: DataFrame, ts: str, seq: str) -> tuple[DataFrame, int]:
    """What the passes need, written once, and the number of rows; one without a time belongs to no period."""
    rows = stage(df.select(ts, seq, strict_label_int("label").alias("label_int")), "split")
    n, timed = rows.agg(F.count(F.lit(1)), F.count(ts)).first()
    if timed < n:
        raise ValueError(f"{n - timed} rows have no time")
    return rows, n


def _check(rows: DataFrame, split: Column, needs: dict[str, tuple[str, bool]]) -> None:
    """Every period needs benign rows, some need attacks, too: one pass for all."""
    counts = {r[0]: r for r in rows.groupBy(split.alias("split")).agg(
        F.count_if(F.col("label_int") == 0), F.count_if(F.col("label_int") == 1)).collect()}
    for key, (name, both) in needs.items():
        _, benign, attacks = counts.get(key, (key, 0, 0))
        if not benign or (both and not attacks):
            raise ValueError(f"the {name} period lacks {'a class' if both else 'benign rows'}")


def split_points(n: int, fractions: list[float]) -> list[int]:
    if len(fractions) == 1:
        return [max(1, min(n - 1, math.floor(n * fractions[0])))]
    first = max(1, min(n - 2, math.floor(n * fractions[0])))
    return [first, max(first + 1, min(n - 1, math.floor(n * (fractions[0] + fractions[1]))))]


def chronological_split(df: DataFrame, calibration: float = 0.4, ts: str = "ts_us",
                        seq: str = "seq") -> DataFrame:
    """Add ``split``: 'calibration' for the first part, 'test' for the rest.

    The boundary is found with sketches and counts and applied as a plain comparison: no sort, no shuffle.
    """
    if not 0.1 <= calibration <= 0.9:
        raise ValueError("the calibration fraction must be between 0.1 and 0.9")
    rows, n = _slim(df, ts, seq)
    if n < 8:
        raise ValueError("at least 8 labelled rows are needed")
    [inside] = _first_rows(rows, split_points(n, [calibration]), ts, seq)
    split = F.when(inside, "calibration").otherwise("test")
    _check(rows, split, {"calibration": ("calibration", False), "test": ("test", True)})
    return df.withColumns({"split": split, "label_int": strict_label_int("label")})


def model_split(df: DataFrame, train: float = 0.5, calibration: float = 0.2, ts: str = "ts_us",
                seq: str = "seq") -> DataFrame:
    """Add ``split``: 'train', then 'calibration', then 'test'."""
    if not 0.2 <= train <= 0.7:
        raise ValueError("the training fraction must be between 0.2 and 0.7")
    if not 0.1 <= calibration <= 0.4 or train + calibration > 0.9:
        raise ValueError("the calibration fraction must be 0.1 to 0.4, both together at most 0.9")
    rows, n = _slim(df, ts, seq)
    if n < 20:
        raise ValueError("at least 20 labelled rows are needed")
    in_train, in_both = _first_rows(rows, split_points(n, [train, calibration]), ts, seq)
    split = F.when(in_train, "train").when(in_both, "calibration").otherwise("test")
    _check(rows, split, {"train": ("training", True), "calibration": ("calibration", False),
                         "test": ("test", True)})
    return df.withColumns({"split": split, "label_int": strict_label_int("label")})
