"""Operator 1. Packing by non-negative least squares on the histogram of lengths.

Documents become ids plus an end id and are cut into full windows and one remainder. The remainders'
lengths are binned; every way to fill a window with up to three bins is a column of a least-squares
problem whose non-negative solution says how often each is used. The counts are rounded down, and what is
left of the histogram is packed greedily, largest first. All of that happens on the histogram, which has
at most window / bin rows; pieces only learn their place from their rank within their bin.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.llm.common import plain_text, ranked
from flowrisk.llm.tokens import encoder
from flowrisk.session import stage

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, path: str, window: int, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The pieces of every document, in one pass over the texts."""

    def pieces(batches):
        encode = encoder(path)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode.packed(text) + end
                n = len(ids) // 4
                rows += [(doc, s, min(window, n - s), zlib.crc32(ids[4 * s:4 * (s + window)]), n)
                         for s in range(0, n, window)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(key).cast("long"), plain_text(text)).mapInArrow(pieces, PIECES)


def combinations(bins: int) -> np.ndarray:
    """Every multiset of one to three bin sizes that fills ``bins`` exactly, as columns of counts."""
    found = [(bins,)] + [(a, bins - a) for a in range(1, bins // 2 + 1)]
    found += [(a, b, bins - a - b) for a in range(1, bins // 3 + 1) for b in range(a, (bins - a) // 2 + 1)]
    columns = np.zeros((bins + 1, len(found)))
    for j, parts in enumerate(found):
        for part in parts:
            columns[part, j] += 1
    return columns


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """min |a x - b| over x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * a.shape[0] + 10):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        if n == 0 or gain.max() <= tolerance * max(1.0, np.abs(b).max()):
            break
        free[int(gain.argmax())] = True
        while True:
            index = np.flatnonzero(free)
            solved = np.linalg.lstsq(a[:, index], b, rcond=None)[0]
            if solved.size == 0 or solved.min() > 0:
                x[:] = 0
                x[index] = solved
                break
            down = index[solved <= 0]
            target = np.zeros(n)
            target[index] = solved
            with np.errstate(divide="ignore", invalid="ignore"):
                steps = x[down] / (x[down] - target[down])
            step = float(np.nan_to_num(steps, nan=0.0).min())
            x += step * (target - x) * free
            free[down[np.nan_to_num(steps, nan=0.0) <= step]] = False
            x[~free] = 0
    return x


def plan(histogram: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(bins in a sequence, descending; number of sequences) that use up the histogram exactly."""
    bins, left = len(histogram) - 1, histogram.astype(np.int64).copy()
    out = []

    def take(counts: np.ndarray, times: int):
        if times > 0:
            left[:] -= counts * times
            out.append((np.repeat(np.arange(bins + 1), counts)[::-1], times))

    whole = np.zeros(bins + 1, np.int64)
    whole[bins] = 1
    take(whole, int(left[bins]))
    columns = combinations(bins)
    scale = max(1.0, float(left.sum()))
    x = nnls(columns[1:], left[1:] / scale) * scale
    for j in np.argsort(-x, kind="stable")[:bins + 1]:
        counts = columns[:, j].astype(np.int64)
        used = counts > 0
        take(counts, int(min(np.floor(x[j] + 1e-6), (left[used] // counts[used]).min())))
    while left.any():
        room, counts = bins, np.zeros(bins + 1, np.int64)
        while room:
            fits = np.flatnonzero((left - counts)[:room + 1] > 0)
            if not len(fits):
                break
            part = int(fits[-1])
            more = int(min((left - counts)[part], room // part))
            counts[part] += more
            room -= more * part
        used = counts > 0
        take(counts, int((left[used] // counts[used]).min()))
    return out


def places(steps: list[tuple[np.ndarray, int]], bins: int) -> dict[str, np.ndarray]:
    """For each bin, which ranks go to which sequences; sorted by (bin, first rank)."""
    used, first, rows = np.zeros(bins + 1, np.int64), 0, []
    for parts, times in steps:
        for part in np.unique(parts):
            each = int((parts == part).sum())
            rows.append((int(part), int(used[part]), each, first))
            used[part] += each * times
        first += times
    rows.sort()
    return {n: np.array(c, np.int64) for n, c in zip(("bin", "rank", "each", "first"), zip(*rows) if rows else [()] * 4)}


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, bin_size: int = 8,
         text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    Null text is empty, so it is the end id alone. Rows that repeat a key are documents of their own. Extra
    columns are ignored; an empty table gives no rows. Ties (pieces of one length) are ordered by a hash of
    their row, so a rerun gives the same sequences. ``bin_size`` divides ``window``.
    """
    pieces = stage(cut(docs, path, window, end_id, text, key), "pieces")
    binned = pieces.withColumn("bin", F.ceil(F.col("length") / bin_size).cast("int"))
    histogram = np.zeros(window // bin_size + 1, np.int64)
    for row in binned.groupBy("bin").count().collect():  # at most window / bin_size rows
        histogram[row[0]] = row[1]
    where = places(plan(histogram), len(histogram) - 1)

    def place(batches):
        key_of = where["bin"] * (1 << 48) + where["rank"]
        for batch in batches:
            bins, ranks = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("bin", "rank"))
            at = np.searchsorted(key_of, bins * (1 << 48) + ranks, side="right") - 1
            sequence = where["first"][at] + (ranks - where["rank"][at]) // where["each"][at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in batch.schema.names], pa.array(sequence, pa.int64())],
                [*batch.schema.names, "sequence_id"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    order = [c for c in columns]
    buckets = max(1024, int(histogram.sum()) >> 16)  # about 65,536 pieces in each, if all are of one length
    dealt = ranked(binned, ["bin"], order, "rank", buckets).select(*columns, F.col("bin").cast("long").alias("bin"), "rank")
    placed = dealt.mapInArrow(place, f"{PIECES}, bin long, rank long, sequence_id long")
    # A sequence holds at most window / 1 pieces, so its window is bounded.
    inside = (Window.partitionBy("sequence_id").orderBy(F.col("bin").desc(), "rank")
              .rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(*columns, "sequence_id",
                         F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
