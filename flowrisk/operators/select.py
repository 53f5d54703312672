"""Exact order statistics without a global sort: brackets that close in on all answers together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bracket loses all but about two in GRID of its rows with every round, whatever the distribution.
GRID = 4096


def _around(v: Column, low: Column, high: Column) -> list[Column]:
    """Where the rows lie: next value and rows below, at low, next above low, rows in between, next below high,
    at high, next beyond."""
    return [F.max(F.when(v < low, v)), F.count_if(v < low), F.count_if(v == low), F.min(F.when(v > low, v)),
            F.count_if(v.between(low, high)), F.max(F.when(v < high, v)), F.count_if(v == high),
            F.min(F.when(v > high, v))]


def order_statistics(df: DataFrame, targets: list[tuple[Column, int]]) -> list:
    """For each (numeric column, k): its k-th smallest value (from 1), NULLs ignored.

    A round takes two passes for all targets: quantile sketches name a smaller bracket for each one, and
    exact counts say on which side of it the rank lies. Nothing but a few numbers leaves the executors.
    """
    columns = [c for c, _ in targets]
    first = df.agg(*[x for c in columns for x in (F.min(c), F.max(c), F.count(c))]).first()
    # lo, hi: the value is in between; below, inside: rows under lo, rows from lo to hi.
    state = []
    for i, (_, k) in enumerate(targets):
        lo, hi, n = first[3 * i:3 * i + 3]
        if not 1 <= k <= n:
            raise ValueError(f"rank {k} is outside 1..{n}")
        state.append([lo, hi, 0, n])
    while still := [i for i, s in enumerate(state) if s[0] != s[1]]:
        part = {i: F.when(columns[i].between(F.lit(state[i][0]), F.lit(state[i][1])), columns[i]) for i in still}
        sketches = []
        for i in still:
            at = (targets[i][1] - state[i][2] - 0.5) / state[i][3]
            grid = [min(1.0, max(0.0, at + d / GRID)) for d in (-1, 1)]
            sketches.append(F.percentile_approx(part[i], grid, 4 * GRID))
        cuts = dict(zip(still, df.agg(*sketches).first()))
        found = df.agg(*[x for i in still for x in _around(part[i], *map(F.lit, cuts[i]))]).first()
        for j, i in enumerate(still):
            upto, under, at_low, above_low, middle, below_high, at_high, beyond = found[8 * j:8 * j + 8]
            (lo, hi, below, inside), (low, high) = state[i], cuts[i]
            k = targets[i][1] - below
            if k <= under:
                state[i] = [lo, upto, below, under]
            elif k > under + middle:
                state[i] = [beyond, hi, below + under + middle, inside - under - middle]
            elif k <= under + at_low:
                state[i] = [low, low, below, at_low]
            elif k > under + middle - at_high:
                state[i] = [high, high, below, at_high]
            else:  # strictly inside, so that every round leaves two values less at least
                state[i] = [above_low, below_high, below + under + at_low, middle - at_low - at_high]
    return [s[0] for s in state]


def kth_smallest(df: DataFrame, column: str, k: int):
    """The k-th smallest value (from 1) of a numeric column, NULLs ignored."""
    return order_statistics(df, [(F.col(column), k)])[0]


def percentiles(df: DataFrame, column: str, points: list[float]) -> DataFrame:
    """One row: mean, the given percentiles with linear interpolation, and the maximum.

    Each percentile lies between two neighbouring order statistics; no task holds the values.
    """
    n, mean, top = df.agg(F.count(column), F.avg(column), F.max(column)).first()
    if not n:
        raise ValueError("no values")
    places = [(n - 1) * p for p in points]
    ranks = sorted({r for place in places for r in (int(place) + 1, min(n, int(place) + 2))})
    found = dict(zip(ranks, order_statistics(df, [(F.col(column), r) for r in ranks])))
    row = {"mean": mean}
    for p, place in zip(points, places):
        rank, part = int(place) + 1, place - int(place)
        row[f"p{round(p * 100)}"] = found[rank] * (1.0 - part) + found[min(n, rank + 1)] * part
    row["max"] = top
    return df.sparkSession.range(1).select(*[F.round(F.lit(float(v)), 6).alias(k) for k, v in row.items()])
