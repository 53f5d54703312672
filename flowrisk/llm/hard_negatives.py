"""Operator 12. Hard negatives from scores of anchor and candidate tiles, multiplied by Strassen's recursion.

Anchors and candidates are dealt to blocks of bounded size; a pair of blocks is a tile. Its scores are an exact
integer matrix product: seven products of half the size instead of eight, down to small leaves, with a row
or column of zeros where a half is odd. In the first round every tile offers each anchor its best rows of the
same label; these heaps are merged into the anchor's positives. In the second every tile offers each pair of anchor and
positive its best rows of other labels whose score lies in the positive's window; these are merged, too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.session import stage

#: Anchors and candidates of a tile, anchors multiplied at a time, smallest side that is halved.
ANCHORS, CANDIDATES, ROWS, LEAF = 4096, 8192, 512, 16
SCALE = 256


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64; sums modulo 2^64, so the result is exact wherever it fits in an int64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    p, q, r = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    if (2 * p, 2 * q) != (m, k):
        a = np.pad(a, ((0, 2 * p - m), (0, 2 * q - k)))
    if (2 * q, 2 * r) != (k, n):
        b = np.pad(b, ((0, 2 * q - k), (0, 2 * r - n)))
    a11, a12, a21, a22 = a[:p, :q], a[:p, q:], a[p:, :q], a[p:, q:]
    b11, b12, b21, b22 = b[:q, :r], b[:q, r:], b[q:, :r], b[q:, r:]
    both = strassen(a11 + a22, b11 + b22, leaf)
    low = strassen(a21 + a22, b11, leaf)
    right = strassen(a11, b12 - b22, leaf)
    down = strassen(a22, b21 - b11, leaf)
    top = strassen(a11 + a12, b22, leaf)
    out = np.empty((2 * p, 2 * r), np.int64)
    out[:p, :r] = both + down - top + strassen(a12 - a22, b21 + b22, leaf)
    out[:p, r:] = right + top
    out[p:, :r] = low + down
    out[p:, r:] = both - low + right + strassen(a21 - a11, b11 + b12, leaf)
    return out[:m, :n]


def integer_rows(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v, ref): floor(256 x) of each component as long; ref tells rows that repeat a key apart."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad)
            .select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"),
                    F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("v")))
    length = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return rows.where(length < 2.0**62).withColumn("ref", F.monotonically_increasing_id())


def matrix(column, width: int) -> np.ndarray:
    """Rows of int64; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties in their order."""
    at = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.sort(np.append(above, np.flatnonzero(scores == least)[:k - len(above)]))
    return at[np.argsort(-scores[at], kind="stable")]


def tile_scores(anchors: pa.Table, candidates: pa.Table):
    """Pairs (anchor's place, its scores) and the candidates (ids, refs, labels), ascending by id."""
    candidates = candidates.take(pa.array(np.lexsort([candidates[c].to_numpy() for c in ("ref", "id")])))
    width = max(max(len(v) for v in t["v"].combine_chunks()) for t in (anchors, candidates))
    a, b = matrix(anchors["v"], width), np.ascontiguousarray(matrix(candidates["v"], width).T)

    def scores():
        for start in range(0, len(a), ROWS):
            yield from enumerate(strassen(a[start:start + ROWS], b), start)

    return scores(), [candidates[c].to_numpy() for c in ("id", "ref")], np.array(candidates["label"].to_pylist(), object)


def offered(rows: list, names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def positive_heap(anchors: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """Each anchor's k best other rows of its label in this tile."""
    out = []
    if len(anchors) and len(candidates):
        scores, (ids, refs), labels = tile_scores(anchors, candidates)
        own, label = anchors["ref"].to_pylist(), anchors["label"].to_pylist()
        places = {name: np.flatnonzero(labels == name) for name in set(label)}
        for i, row in scores:
            at = places[label[i]]
            at = at[refs[at] != own[i]]
            out += [(own[i], int(refs[j]), int(ids[j]), int(row[j])) for j in at[best(row[at], k)]]
    return offered(out, ["anchor", "positive", "positive_id", "positive_score"])


def window_heap(anchors: pa.Table, candidates: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """For each anchor and positive the k best rows of other labels in the window in this tile."""
    out = []
    if len(anchors) and len(candidates):
        scores, (ids, refs), labels = tile_scores(anchors, candidates)
        own, label, positives = (anchors[c].to_pylist() for c in ("ref", "label", "positives"))
        places = {name: np.flatnonzero(labels != name) for name in set(label)}
        for i, row in scores:
            other = places[label[i]]
            mine = row[other]
            for p in positives[i]:
                least, most = -(-low * p["score"] // 100), high * p["score"] // 100
                at = other[(mine >= least) & (mine <= most)]
                out += [(own[i], p["ref"], int(ids[j]), int(refs[j]), int(row[j])) for j in at[best(row[at], k)]]
    return offered(out, ["anchor", "positive", "negative_id", "negative", "negative_score"])


def tiles(anchors: DataFrame, candidates: DataFrame, sizes: tuple[int, int], blocks: tuple[int, int], work, schema: str) -> DataFrame:
    """``work`` on every pair of an anchor block and a candidate block."""
    anchor_blocks, candidate_blocks = (max(1, -(-n // size)) for n, size in zip(sizes, blocks))
    own = lambda parts: F.pmod(F.xxhash64("ref"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = anchors.withColumn("ab", own(anchor_blocks)).withColumn("cb", every(candidate_blocks))
    c = candidates.withColumn("cb", own(candidate_blocks)).withColumn("ab", every(anchor_blocks))
    return a.groupBy("ab", "cb").cogroup(c.groupBy("ab", "cb")).applyInArrow(work, schema)


def mine(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         key: str = "vec_id", vector: str = "embedding", label: str = "label", anchor_block: int = ANCHORS,
         candidate_block: int = CANDIDATES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``. A score is the integer inner product; positives are an anchor's
    best other rows of its label; negatives of a pair are the best rows of other labels whose score is ``low`` to
    ``high`` percent of the positive's. Ties go to the smaller key; fewer rows than asked for give all. Rows with a null
    key or label, a null vector, a null or non-finite component take no part, nor do rows whose product with themselves
    exceeds 2^62 (components beyond 10^6): with them a score might not fit in a long. Rows that repeat a key are rows
    of their own. Shorter vectors are padded with zeros. An empty table gives no rows; extra columns are ignored.
    """
    rows = stage(integer_rows(vectors, key, vector, label), "vectors")
    sizes = rows.agg(F.coalesce(F.sum(is_anchor.cast("int")), F.lit(0)), F.count(F.lit(1))).first()
    anchors, blocks = rows.where(is_anchor), (anchor_block, candidate_block)
    candidates = rows.select(*[F.col(c).alias(c) for c in ("id", "ref", "label", "v")])  # columns of its own, for the cogroup
    found = tiles(anchors.select("id", "ref", "label", "v"), candidates, sizes, blocks,
                  lambda a, c: positive_heap(a, c, positives), "anchor long, positive long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    chosen = stage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives).drop("rank"), "positives")
    heaps = chosen.groupBy("anchor").agg(
        F.collect_list(F.struct(F.col("positive").alias("ref"), F.col("positive_score").alias("score"))).alias("positives"))
    asked = anchors.join(heaps, F.col("ref") == F.col("anchor")).select("id", "ref", "label", "v", "positives")
    found = tiles(asked, candidates, sizes, blocks, lambda a, c: window_heap(a, c, negatives, low, high),
                  "anchor long, positive long, negative_id long, negative long, negative_score long")
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id", "negative")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = anchors.select(F.col("id").alias("anchor_id"), F.col("ref").alias("anchor"))
    return (ranked.join(chosen, ["anchor", "positive"]).join(names, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


#: The query's rows in DuckDB.
ORACLE = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM given a JOIN given c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scores USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""
