"""Isolation forest: small random samples grow trees in parallel, all rows are scored in batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, SAMPLE = 100, 256
EULER = 0.5772156649015329
_NODES = "tree int, node int, feature int, cut double, left int, right int, length double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random tree of n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(points: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    """Append the subtree of ``points``; returns its node number."""
    me = len(nodes)
    spread = np.flatnonzero(points.max(axis=0) > points.min(axis=0)) if len(points) > 1 else []
    if depth >= limit or not len(spread):
        nodes.append([me, -1, 0.0, -1, -1, depth + average_path(len(points))])
        return me
    feature = int(rng.choice(spread))
    column = points[:, feature]
    cut = float(rng.uniform(column.min(), column.max()))
    nodes.append([me, feature, cut, 0, 0, 0.0])
    below = column <= cut
    nodes[me][3] = _grow(points[below], rng, depth + 1, limit, nodes)
    nodes[me][4] = _grow(points[~below], rng, depth + 1, limit, nodes)
    return me


class IsolationForest:
    """At most 100 trees of at most 511 nodes: that bounds what scoring ships to the executors."""

    def __init__(self, nodes: pd.DataFrame, features: list[str], sample: int):
        self.nodes, self.features, self.sample = nodes, features, sample

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], seed: int = 42, key: str = "seq",
            trees: int = TREES, sample: int = SAMPLE) -> IsolationForest:
        """Rows are drawn by a hash of ``key``, so the same data gives the same forest.

        A tree's sample is the rows with the lowest hashes for that tree. Rows whose hash is far above what
        a full sample needs are left out before the rows of the trees are made.
        """
        rows = df.count()
        if rows == 0:
            raise ValueError("no rows to fit on")
        wanted = min(sample, rows)
        bound = min(2 ** 31, math.ceil((4 * wanted + 100) / rows * 2 ** 31))
        near = F.expr(f"filter(transform(sequence(0, {trees - 1}), t -> struct(cast(t as int) as tree, "
                      f"xxhash64({key}, t, {seed}) as _h)), x -> pmod(x._h, {2 ** 31}) < {bound})")
        drawn = df.select(*features, F.inline(near)).withColumn(
            "_h", F.expr(f"struct(pmod(_h, {2 ** 31}), _h)"))
        place = Window.partitionBy("tree").orderBy("_h")
        sampled = (drawn.withColumn("_order", F.row_number().over(place))
                   .filter(F.col("_order") <= wanted).drop("_h"))
        limit = max(1, math.ceil(math.log2(max(wanted, 2))))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            nodes: list = []
            points = pdf.sort_values("_order")[features].to_numpy(float)
            _grow(points, np.random.default_rng([seed, tree]), 0, limit, nodes)
            out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "length"])
            out.insert(0, "tree", tree)
            return out

        grown = sampled.groupBy("tree").applyInPandas(grow, _NODES).toPandas()
        return cls(grown.sort_values(["tree", "node"]).reset_index(drop=True), features, wanted)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score``: above 0 is more isolated than average."""
        tables = [(t["feature"].to_numpy(), t["cut"].to_numpy(), t["left"].to_numpy(),
                   t["right"].to_numpy(), t["length"].to_numpy())
                  for _, t in self.nodes.groupby("tree")]
        shared = df.sparkSession.sparkContext.broadcast(tables)
        norm = average_path(self.sample) or 1.0

        @F.pandas_udf("double")
        def isolation(*columns: pd.Series) -> pd.Series:
            points = np.column_stack([c.to_numpy(float) for c in columns])
            total = np.zeros(len(points))
            for feature, cut, left, right, length in shared.value:
                at = np.zeros(len(points), int)
                inner = feature[at] >= 0
                while inner.any():
                    rows = np.flatnonzero(inner)
                    here = at[rows]
                    below = points[rows, feature[here]] <= cut[here]
                    at[rows] = np.where(below, left[here], right[here])
                    inner = feature[at] >= 0
                total += length[at]
            return pd.Series(2.0 ** (-(total / len(shared.value)) / norm) - 0.5)

        return df.withColumn("score", isolation(*self.features))
