"""Operator 3. Exact top-k by inner product with Fagin's threshold algorithm, block by block.

Queries and candidates are dealt to blocks of bounded size; each pair of blocks is one group. There every
dimension is a list of the block's vectors sorted by their component. A query reads its lists from the end
that its sign favours, scores every vector it meets, and stops as soon as no vector that it has not met can
beat its k-th score: the sum over dimensions of its component times the next list entry bounds them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.session import stage

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8192
SCALE = 256


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, copy, v): floor(256 x) of each component; copy tells rows that repeat a key apart.

    Null vectors, null or non-finite components and null keys leave the row out. Components are taken as
    doubles; scores are exact while every partial sum stays below 2^53.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad).select(F.col(key).alias("id"), whole.alias("v"))
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("v"))))


def matrix(column, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors count as ending in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def threshold_search(query: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, down: np.ndarray, k: int):
    """Rows of the k best (score, smaller id first) of ``x`` without ``own``; ``down``: lists, largest first."""
    n, width = x.shape
    seen = np.zeros(n, bool)
    seen[own] = True
    rows, scores = np.zeros(0, np.int64), np.zeros(0)
    dims = np.flatnonzero(query)
    up, low = dims[query[dims] > 0], dims[query[dims] < 0]  # lists read from their large and from their small end

    def bound(t: int) -> float:
        """The most that a vector can score whose entries all stand at depth t or deeper."""
        return float(x[down[up, t], up] @ query[up] + x[down[low, n - 1 - t], low] @ query[low])

    depth, start, left = 0, 16, n - len(own)
    while depth < n and left:
        end = min(n, start)
        if len(rows) >= k:
            first, beyond = depth, n  # the first depth whose bound is strictly below the k-th score
            while first < beyond:
                t = (first + beyond) // 2
                first, beyond = (first, t) if bound(t) < scores[-1] else (t + 1, beyond)
            if first <= depth:
                break
            end = min(end, first)
        met = np.zeros(n, bool)
        if len(dims):
            met[down[up, depth:end]] = True
            met[down[low, n - end:n - depth]] = True
        else:
            met[:] = True
        fresh = np.flatnonzero(met & ~seen)
        seen[fresh] = True
        left -= len(fresh)
        rows, scores = np.append(rows, fresh), np.append(scores, x[fresh] @ query)
        best = np.lexsort((ids[rows], -scores))[:k]
        rows, scores = rows[best], scores[best]
        depth, start = end, end * 4
    return rows, scores


def search_blocks(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    out = []
    if len(queries) and len(candidates):
        width = max(max(len(v) for v in t["v"].combine_chunks()) for t in (queries, candidates))
        q, x = matrix(queries["v"], width), matrix(candidates["v"], width)
        ids, copies = (candidates[c].to_numpy() for c in ("id", "copy"))
        down = np.argsort(-x, axis=0, kind="stable").T.copy()
        for row, i, c in zip(q, queries["id"].to_pylist(), queries["copy"].to_pylist()):
            rows, scores = threshold_search(row, np.flatnonzero((ids == i) & (copies == c)), x, ids, down, k)
            out += [(i, c, int(ids[r]), int(copies[r]), int(s)) for r, s in zip(rows, scores)]
    columns = list(zip(*out)) or [()] * 5
    return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "query_copy", "vec_id", "copy", "score"), columns)})


def top_k(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding",
          query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates, ties to the smaller key.

    ``is_query`` is a condition on the column ``id``. A query meets every row but its own; a row that repeats
    its key is another row. Rows that ``integer_vectors`` leaves out take no part; shorter vectors are padded with
    zeros. Fewer than k candidates give all of them; an empty table gives no rows.
    """
    rows = stage(integer_vectors(vectors, key, vector), "vectors")
    n, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_query.cast("int")), F.lit(0))).first()
    query_blocks, blocks = max(1, -(-asked // query_block)), max(1, -(-n // candidate_block))
    own = lambda parts: F.pmod(F.xxhash64("id", "copy"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = rows.where(is_query).withColumn("qb", own(query_blocks)).withColumn("cb", every(blocks))
    candidates = rows.withColumn("cb", own(blocks)).withColumn("qb", every(query_blocks))
    found = (queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb"))
             .applyInArrow(lambda q, c: search_blocks(q, c, k),
                           "query_id long, query_copy long, vec_id long, copy long, score long"))
    order = Window.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), "vec_id", "copy")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
