"""Gradient boosted trees for two classes on histograms, grown best leaf first or level by level.

Every feature is cut into bins once. The binned rows are kept as blocks of numpy arrays in a persisted RDD, with the
margin that the trees so far give them; blocks that do not fit in memory go to local disk. A pass is one job of one
stage that sums gradients per (node, feature, bin): each task adds its blocks up, the sums of the tasks are added in a
tree. What a task adds up and what reaches the driver is bounded by nodes * features * bins, whatever the number of
rows. A pass serves all leaves that may still be split, so a tree takes about as many passes as it has levels, not one
for each of its splits; of two children only the smaller one is summed, the other is the rest of its parent. Children
that are not split again need no pass: their totals are known from their parent.

Gradients are summed as integers (units of 2^-26), so sums do not depend on the order of rows or tasks: the same
cuts give the same trees, also when an executor is lost. Sums hold for 2^37 rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.session import shared_dir, stage

UNIT = 2 ** 26
BINS = 255
REWRITE = 25  # trees until the blocks are written to the shared folder: bounds what a lost block costs
BLOCK = 2 ** 16  # rows of a block, about
ROWS = 2 ** 15  # a task of a pass takes at least that many rows, if there are
WIDE = 64  # tasks from which their sums are added on the executors first
MIN_HESSIAN = 1e-3
LISTED = 32  # values of a feature that may each get a bin of their own, whatever their number of rows


@dataclass(eq=False)
class Node:
    """A node of a tree: count, gradient and hessian in all (``total``) and per (feature, bin), if looked into."""
    total: np.ndarray
    sums: np.ndarray | None = None
    gain: float = -math.inf
    feature: int = -1
    bin: int = -1
    left: Node | None = None
    right: Node | None = None
    split: bool = False
    value: float = 0.0


def best_split(node: Node, min_leaf: int) -> None:
    """The split of the largest gain; equal gains: the first feature, then the lowest bin."""
    below = node.sums.cumsum(axis=1)[:, :-1]
    total = node.total
    above = total - below
    (nl, gl, hl), (nr, gr, hr) = (np.moveaxis(x, 2, 0).astype(float) for x in (below, above))
    allowed = (nl >= min_leaf) & (nr >= min_leaf) & (np.minimum(hl, hr) >= MIN_HESSIAN * UNIT)
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = (gl * gl / hl + gr * gr / hr - float(total[1]) ** 2 / float(total[2])) / UNIT
    gains = np.where(allowed, gains, -math.inf)
    if gains.size and gains.max() > 1e-12:
        node.feature, node.bin = (int(i) for i in np.unravel_index(gains.argmax(), gains.shape))
        node.gain = float(gains[node.feature, node.bin])


def _open_leaves(root: Node, max_leaves: int) -> tuple[list[Node], bool]:
    """Split the best leaf again and again; returns the leaves to look into before the next choice is known.

    Also, whether their children may be split in turn.
    """
    leaves = [root]
    root.split = False
    while len(leaves) < max_leaves:
        best = max(leaves, key=lambda n: n.gain)
        if best.gain == -math.inf:
            break
        if best.left is None:
            hopeful = sorted((n for n in leaves if n.left is None and n.gain > -math.inf), key=lambda n: -n.gain)
            left = max_leaves - len(leaves)
            return hopeful[:left], left > 1
        at = leaves.index(best)
        best.split, best.left.split, best.right.split = True, False, False
        leaves[at:at + 1] = [best.left, best.right]
    return [], False


def _open_level(root: Node, depth: int) -> tuple[list[Node], bool]:
    """Split all nodes of the lowest level that gain by it, and whether their children may be split in turn."""
    level = [root]
    for below in range(depth - 1, -1, -1):
        level = [n for n in level if n.gain > -math.inf]
        if any(n.left is None for n in level):
            for node in level:
                node.split = True
            return level, below > 0
        level = [child for n in level for child in (n.left, n.right)]
    return [], False


def _places(root: Node, wanted: list[Node] | None = None) -> tuple[list[tuple[int, int, int, int]], list[Node]]:
    """A tree as splits (slot, feature, bin, new slot), a parent's before its children's, and the nodes in the slots.

    Rows begin in slot 0; a split moves those above its bin to the new slot. With ``wanted`` the tree reaches down to
    these nodes, whether the splits above them are chosen or not.
    """
    splits, nodes = [], [root]

    def add(node: Node, slot: int) -> None:
        nodes[slot] = node
        if node.split if wanted is None else node.left is not None and node not in wanted:
            new = len(nodes)
            nodes.append(node.right)
            splits.append((slot, node.feature, node.bin, new))
            add(node.left, slot)
            add(node.right, new)
    add(root, 0)
    return splits, nodes


def _slots(splits: list[tuple[int, int, int, int]], bins: np.ndarray) -> np.ndarray:
    """The slot of every row (features by rows)."""
    at = np.zeros(bins.shape[1], np.uint8 if len(splits) < 256 else np.int32)
    for slot, feature, cut, new in splits:
        at[(at == slot) & (bins[feature] > cut)] = new
    return at


def _steps(root: Node) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    splits, nodes = _places(root)
    return splits, np.array([n.value for n in nodes])


def _finish(node: Node, rate: float) -> None:
    """State the values of the leaves, drop sums and what was looked at in vain."""
    if node.split:
        _finish(node.left, rate)
        _finish(node.right, rate)
    else:
        node.value = -rate * float(node.total[1]) / float(node.total[2]) if node.total[2] > 0 else 0.0
        node.left = node.right = None
    node.sums = None


def _edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Ascending cuts per feature, at most ``bins`` - 1: between all values where they are few, else quantiles."""
    few = df.agg(*[F.approx_count_distinct(c).alias(c) for c in features]).first()
    points, listed = [i / bins for i in range(1, bins)], {c for c in features if few[c] < max(bins / 2, 2 * LISTED)}
    found = df.agg(*[F.collect_set(c).alias(f"set_{c}") for c in listed],
                   *[F.percentile_approx(c, points, max(4 * bins, 1020)).alias(c) for c in features]).first()
    cuts = []
    for c in features:
        values = np.unique(np.array(found[f"set_{c}"] if c in listed else [], dtype=float) + 0.0)
        if c in listed and len(values) <= max(bins / 2, min(bins, LISTED)):
            # halfway, but never at the lower value: a row at a cut goes right
            values = np.maximum(values[:-1] / 2 + values[1:] / 2, np.nextafter(values[:-1], math.inf))
        else:
            values = np.unique(np.array(found[c], dtype=float) + 0.0)
        cuts.append(values[:bins - 1])
    return cuts


class LeafwiseTrees:
    """Trees with their cuts: ``score`` adds the probability of class 1.

    A model is at most ``rounds`` * ``leaves`` numbers. A row at a cut goes right. Null and NaN features fail the
    fit; in ``score`` they give a null score.
    """

    def __init__(self, features: list[str], cuts: list[np.ndarray], base: float, trees: list[Node]):
        self.features, self.cuts, self.base, self.trees = features, cuts, base, trees

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], label: str = "label_int", rounds: int = 100,
            rate: float = 0.05, leaves: int = 15, min_leaf: int | None = None, bins: int = BINS) -> LeafwiseTrees:
        """Fit on finite ``features`` and a ``label`` of 0 and 1; without a class or rows it fails.

        ``min_leaf`` defaults to a tenth of the rows, at least 2 and at most 20. Equal rows count each; other
        columns are not read. Features with a single value are never split.
        """
        if rounds < 1 or leaves < 2 or not 2 <= bins <= 32767:
            raise ValueError("rounds, leaves or bins out of range")
        rows, attacks = _checked(df, features, label)
        min_leaf = max(2, min(20, rows // 10)) if min_leaf is None else min_leaf
        base = math.log(attacks / (rows - attacks))
        return cls._boost(df, features, label, rows, bins, base, [rate] * rounds, True, min_leaf,
                          lambda root: _open_leaves(root, leaves))

    @classmethod
    def _boost(cls, df: DataFrame, features: list[str], label: str, rows: int, bins: int, base: float, rates: list[float],
               newton: bool, min_leaf: int, opened: Callable[[Node], tuple[list[Node], bool]]) -> LeafwiseTrees:
        """A tree for each of ``rates``; without ``newton`` every row has a hessian of one."""
        slim = df.select(F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(f"x{i}")
                                                    for i, c in enumerate(features)])
        cuts = _edges(slim, [f"x{i}" for i in range(len(features))], bins)
        shared_dir(df.sparkSession)
        blocks, before, trees = _blocks(slim, cuts, base, rows).persist(StorageLevel.MEMORY_AND_DISK), None, []
        for turn, rate in enumerate(rates):
            root = _grow(blocks, cuts, newton, min_leaf, opened)
            _finish(root, rate)
            trees.append(root)
            if before:
                before.unpersist()  # its successor was kept by the first pass
            if newton and not root.split or turn + 1 == len(rates):
                break  # no split gains: the margin has its value, later trees would add the same nothing
            before, blocks = blocks, _moved(blocks, root).persist(StorageLevel.MEMORY_AND_DISK)
            if (turn + 1) % REWRITE == 0:
                blocks.checkpoint()
        blocks.unpersist()
        return cls(features, cuts, base, trees)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the probability of class 1."""
        cuts, base, steps = self.cuts, self.base, [_steps(t) for t in self.trees]

        @F.pandas_udf("double")
        def probability(rows: pd.DataFrame) -> pd.Series:
            values = rows.to_numpy(dtype=float).T
            bins = _bins(cuts, values)
            margin = base + sum(value[_slots(splits, bins)] for splits, value in steps)
            return pd.Series(1 / (1 + np.exp(-margin))).where(~np.isnan(values).any(axis=0))

        return df.withColumn("score", probability(F.struct(*[
            F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)])))

    def leaf_counts(self) -> list[int]:
        def count(node: Node) -> int:
            return count(node.left) + count(node.right) if node.split else 1
        return [count(t) for t in self.trees]


class LevelTrees(LeafwiseTrees):
    """Trees grown level by level, with the loss, steps and leaf values of Spark's ``GBTClassifier``.

    A leaf's value is the mean of what is left to explain, a split's gain the variance that it takes away. Cuts are
    quantiles of all rows, where ``GBTClassifier`` looks at about 10,000 of them.
    """

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], label: str = "label_int", rounds: int = 100,
            rate: float = 0.05, depth: int = 4, min_leaf: int | None = None, bins: int = 32) -> LevelTrees:
        """As for trees grown best leaf first, to ``depth`` levels of splits; one class is enough."""
        if rounds < 1 or depth < 1 or not 2 <= bins <= 32767:
            raise ValueError("rounds, depth or bins out of range")
        rows, _ = _checked(df, features, label, False)
        min_leaf = max(2, min(20, rows // 10)) if min_leaf is None else min_leaf
        # In log odds F the loss 2 * log(1 + exp(-F * sign)) leaves 8 * (y - p) to a full step; the first tree takes the signs.
        return cls._boost(df, features, label, rows, bins, 0.0, [4.0] + [8 * rate] * (rounds - 1), False, min_leaf,
                          lambda root: _open_level(root, depth))


def _checked(df: DataFrame, features: list[str], label: str, both: bool = True) -> tuple[int, int]:
    """The number of rows and of those of class 1; fails where training is impossible."""
    bad = F.lit(False)
    for c in features:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == math.inf)
    rows, attacks, wrong = df.agg(
        F.count(F.lit(1)), F.count_if(F.col(label) == 1),
        F.count_if(bad | F.col(label).isNull() | ~F.col(label).isin(0, 1))).first()
    if wrong:
        raise ValueError("a feature is not a finite number, or a label is neither 0 nor 1")
    if not rows or both and attacks in (0, rows):
        raise ValueError("training needs rows of both classes")
    return rows, attacks


def _bins(cuts: list[np.ndarray], values) -> np.ndarray:
    """The number of cuts that are not above the value, features by rows."""
    kind = np.uint8 if max(map(len, cuts)) < 256 else np.int16
    return np.stack([np.searchsorted(cut, x, side="right").astype(kind) for cut, x in zip(cuts, values)])


def _blocks(slim: DataFrame, cuts: list[np.ndarray], base: float, rows: int) -> RDD:
    """Blocks (labels, margins, bins) of the rows, dealt over the cores."""
    features = len(cuts)

    def block(held):
        y, bins = (np.concatenate(x, axis=-1) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()), pa.array([bins.tobytes()], pa.binary())], ["y", "bins"])

    def binned(batches):
        held, n = [], 0
        for batch in batches:
            held.append((batch.column("y").to_numpy().astype(np.uint8),
                         _bins(cuts, [batch.column(f"x{i}").to_numpy() for i in range(features)])))
            n += batch.num_rows
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    tasks = max(1, min(rows // ROWS, slim.sparkSession.sparkContext.defaultParallelism))
    kind = np.uint8 if max(map(len, cuts)) < 256 else np.int16

    def arrays(row):
        y = np.frombuffer(row.y, np.uint8)
        return y, np.full(len(y), base), np.frombuffer(row.bins, kind).reshape(features, -1)

    return stage(slim.mapInArrow(binned, "y binary, bins binary").repartition(tasks), "binned").rdd.map(arrays)


def _moved(blocks: RDD, root: Node) -> RDD:
    """The blocks with a tree's steps in their margins."""
    splits, value = _steps(root)
    return blocks.map(lambda b: (b[0], b[1] + value[_slots(splits, b[2])], b[2]))


def _sums(blocks: RDD, cuts: list[np.ndarray], newton: bool, root: Node | None = None,
          wanted: list[Node] | None = None) -> np.ndarray:
    """Count, gradient and hessian per (wanted node, feature, bin); without ``wanted`` of all rows as one node.

    A task adds its rows up in one array of nodes * features * bins.
    """
    features, width, nodes = len(cuts), max(map(len, cuts)) + 1, len(wanted or [root])
    splits, places = _places(root, wanted) if wanted else ([], [])
    number = np.array([wanted.index(n) if n in wanted else -1 for n in places], dtype=np.int64)
    size = nodes * width

    def cells(part):
        total = np.zeros((features, size, 3), dtype=np.int64)
        for y, margin, bins in part:
            first = np.zeros(len(y), np.int64)
            if splits:
                node = number[_slots(splits, bins)]
                inside = np.flatnonzero(node >= 0)
                y, margin, bins, first = y[inside], margin[inside], bins[:, inside], node[inside] * width
            p = 1 / (1 + np.exp(-margin))
            # whole numbers: a block's sums stay below 2^53 and are exact as doubles
            weights = [None, np.rint((p - y) * UNIT)] + [np.rint(p * (1 - p) * UNIT)] * newton
            for i, b in enumerate(bins):
                cell = first + b
                for j, weight in enumerate(weights):
                    total[i, :, j] += np.bincount(cell, weight, size).astype(np.int64)
        yield total

    out = blocks.mapPartitions(cells).treeReduce(np.add, 1 if blocks.getNumPartitions() < WIDE else 2)
    if not newton:
        out[:, :, 2] = out[:, :, 0] * UNIT
    return out.reshape(features, nodes, width, 3).swapaxes(0, 1)


def _grow(blocks: RDD, cuts: list[np.ndarray], newton: bool, min_leaf: int,
          opened: Callable[[Node], tuple[list[Node], bool]]) -> Node:
    sums = _sums(blocks, cuts, newton)[0]
    root = Node(sums[0].sum(axis=0), sums)
    best_split(root, min_leaf)
    while True:
        parents, deeper = opened(root)
        if not parents:
            return root
        for parent in parents:
            below = parent.sums[parent.feature, :parent.bin + 1].sum(axis=0)
            parent.left, parent.right = Node(below), Node(parent.total - below)
        if not deeper:
            continue
        smaller = [min(p.left, p.right, key=lambda n: n.total[0]) for p in parents]
        for parent, child, found in zip(parents, smaller, _sums(blocks, cuts, newton, root, smaller)):
            other = parent.right if child is parent.left else parent.left
            child.sums, other.sums = found, parent.sums - found
            best_split(child, min_leaf)
            best_split(other, min_leaf)
