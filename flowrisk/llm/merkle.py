"""Operator 13. Merkle manifest of a dataset: few levels are kept, the others computed again for proofs.

Leaves are placed by a range sort, whose partitions give each run its offset. A tree then grows by aligned
subtrees: 2^STEP consecutive nodes become one, and only every STEP-th level is written. For proofs each kept node's
subtree is regenerated from its kept descendants; the siblings on every leaf's way are emitted, followed by those that
the level above has found for the subtree's root, and the inner nodes are forgotten again.

There is a tree for each group (``tree``), and one over the groups' roots.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowrisk.session import shared_path

#: Levels between two kept ones; rows of a range partition.
STEP, RANGE = 8, 500_000
#: A sibling in a path: a byte for its side (0: left, 1: right, 2: the node has none), then its digest.
SIBLING = 33


def digest(parts: list[bytes]) -> bytes:
    """H of digests: sha256 of their hex texts one after the other."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def levels(nodes: list[bytes], height: int) -> list[list[bytes]]:
    """The nodes and the levels above them, ``height`` of them; a node without a neighbour is hashed alone."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([digest(below[i:i + 2]) for i in range(0, len(below), 2)])
    return out


def siblings(tree: list[list[bytes]], at: int) -> bytes:
    """The path of base node ``at`` up to the top of ``tree``."""
    out = []
    for level in tree[:-1]:
        other = at ^ 1
        out.append(b"\x02" + bytes(32) if other >= len(level) else bytes([other > at]) + level[other])
        at >>= 1
    return b"".join(out)


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give."""
    for i in range(0, len(path), SIBLING):
        side, other = path[i], path[i + 1:i + SIBLING]
        leaf = digest([leaf] if side == 2 else [leaf, other] if side else [other, leaf])
    return leaf


def proof(path: bytes) -> bytes:
    """H of a path's siblings, from the leaf to the root."""
    return digest([path[i + 1:i + SIBLING] for i in range(0, len(path), SIBLING) if path[i] != 2])


def height_below(n, level: int):
    """How many levels a subtree has whose base is ``level`` of a tree of ``n`` leaves (a Column)."""
    whole = F.length(F.bin(n - 1)) - (n == 1).cast("int")  # the bits of n - 1
    return F.greatest(F.least(whole - level, F.lit(STEP)), F.lit(0))


def leaf_hash(*fields):
    """H of fields in order, as binary: '-' for null, else UTF-8 byte count, ':' and value (a Column)."""
    texts = [F.col(f) if isinstance(f, str) else f for f in fields]
    written = [F.coalesce(F.concat(F.octet_length(t.cast("string")).cast("string"), F.lit(":"), t.cast("string")), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*written), 256))


def placed(rows: DataFrame, group: str, order: list[str], path: str) -> DataFrame:
    """Adds pos, the row's place from 0 within its group, and n, the group's rows; null is a group, and first in order.

    Rows that agree in everything are split by their number in the input, so no value can fill a range partition.
    """
    spark = rows.sparkSession
    rows.withColumn("salt", F.monotonically_increasing_id()).write.parquet(f"{path}/unsorted")
    rows = spark.read.parquet(f"{path}/unsorted")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE))
    keys = [group, *order, "salt"]
    (rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
     .withColumn("place", F.monotonically_increasing_id()).drop("salt").write.parquet(f"{path}/sorted"))
    rows = spark.read.parquet(f"{path}/sorted").withColumn("part", F.shiftright("place", 33))
    runs = rows.groupBy("part", F.col(group).alias("_group")).agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("size"))
    within = Window.partitionBy("_group")
    before = within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("part").alias("_part"), "_group", "low", F.sum("size").over(within).alias("n"),
                       F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return (rows.join(runs, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
            .withColumn("pos", F.col("place") - F.col("low") + F.col("start")).drop("part", "place", "_part", "_group", "low", "start"))


def subtrees(nodes: DataFrame, level: int, *payload: str) -> DataFrame:
    """(tree, n, pos, height, nodes): the aligned subtrees over a kept level; pos is that of their root."""
    return (nodes.groupBy("tree", "n", F.shiftright("pos", STEP).alias("pos"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *payload))).alias("nodes"))
            .withColumn("height", height_below(F.col("n"), level)))


def grow(leaves: DataFrame, path: str) -> list[str]:
    """Writes the kept levels of trees (tree, n, pos, digest, ...); the last has one node a tree, its root."""
    spark = leaves.sparkSession
    leaves.write.parquet(f"{path}/0")
    kept = [f"{path}/0"]
    most = spark.read.parquet(kept[0]).agg(F.max("n")).first()[0] or 1
    for level in range(0, (most - 1).bit_length(), STEP):

        def root(batches):
            for batch in batches:
                tops = [levels([x["digest"] for x in nodes], height)[-1][0]
                        for height, nodes in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tops, pa.binary())], ["tree", "n", "pos", "digest"])

        base = spark.read.parquet(kept[-1]).select("tree", "n", "pos", "digest")
        kind = base.schema["tree"].dataType.simpleString()
        above = (subtrees(base, level).select("tree", "n", "pos", "height", "nodes")
                 .mapInArrow(root, f"tree {kind}, n long, pos long, digest binary"))
        kept.append(f"{path}/{level + STEP}")
        above.write.parquet(kept[-1])
    return kept


def paths(kept: list[str], tails: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, pos, digest, path, payload) of every leaf; ``tails`` (tree, path) lead on from each tree's root."""
    spark = tails.sparkSession
    found = (spark.read.parquet(kept[-1]).join(tails.withColumnRenamed("tree", "_tree"), F.col("tree").eqNullSafe(F.col("_tree")))
             .drop("_tree", "n"))
    for i in reversed(range(len(kept) - 1)):
        extra = payload if i == 0 else []
        nodes = spark.read.parquet(kept[i])
        below = subtrees(nodes, i * STEP, *extra).withColumnsRenamed({"tree": "_tree", "pos": "_pos"})
        both = below.join(found.select("tree", "pos", "path"), F.col("_tree").eqNullSafe(F.col("tree")) & (F.col("_pos") == F.col("pos")))

        def emit(batches):
            for batch in batches:
                bases, ways = [], []
                for height, nodes, tail in zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)]):
                    tree = levels([x["digest"] for x in nodes], height)
                    bases.append(len(nodes))
                    ways += [siblings(tree, at) + tail for at in range(len(nodes))]
                flat = batch.column(2).flatten()
                tree = batch.column(0).take(pa.array([j for j, size in enumerate(bases) for _ in range(size)], pa.int64()))
                yield pa.RecordBatch.from_arrays([tree, *flat.flatten(), pa.array(ways, pa.binary())],
                                                 ["tree", "pos", "digest", *extra, "path"])

        fields = ["tree", "pos", "digest", *extra]
        schema = ", ".join(f"{f} {nodes.schema[f].dataType.simpleString()}" for f in fields) + ", path binary"
        found = both.select("tree", "height", "nodes", "path").mapInArrow(emit, schema)
    return found


@dataclass(frozen=True)
class Manifest:
    """The kept levels of all trees, of the tree over their roots, and the root (hex; None of an empty dataset)."""

    trees: list[str]
    top: list[str]
    root: str | None

    def roots(self, spark: SparkSession) -> DataFrame:
        """(tree, subroot) of every tree, hex."""
        return spark.read.parquet(self.trees[-1]).select("tree", F.lower(F.hex("digest")).alias("subroot"))

    def proofs(self, spark: SparkSession, payload: list[str]) -> DataFrame:
        """(tree, pos, digest, path, payload columns) of every leaf."""
        none = spark.range(1).select(F.lit(0).alias("tree"), F.lit(b"").alias("path"))
        above = paths(self.top, none, ["member"])
        return paths(self.trees, above.select(F.col("member").alias("tree"), "path"), payload)


def build(leaves: DataFrame, tree: str, order: list[str], path: str | None = None) -> Manifest:
    """The manifest of leaves (digest, a column that names the tree, columns that order it, others to carry along).

    It is written to ``path``, or to the shared folder. Trees are ordered by name, null first. An empty table has
    no root.
    """
    spark = leaves.sparkSession
    path = path or shared_path(spark, "manifest")
    rows = placed(leaves.withColumnRenamed(tree, "tree"), "tree", order, f"{path}/leaves")
    trees = grow(rows, f"{path}/trees")
    subroots = spark.read.parquet(trees[-1]).select(F.lit(0).alias("tree"), F.col("tree").alias("member"), "digest")
    top = grow(placed(subroots, "tree", ["member"], f"{path}/subroots"), f"{path}/top")
    root = spark.read.parquet(top[-1]).select(F.lower(F.hex("digest"))).first()
    return Manifest(trees, top, root and root[0])


def verified(proofs: DataFrame, leaf: str, keep: list[str], root: str | None) -> DataFrame:
    """(keep..., proof_sha256, folded_root, verified): folds the digests in column ``leaf`` along their paths."""

    def check(batches):
        for batch in batches:
            leaves, ways = (c.to_pylist() for c in batch.columns[-2:])
            folded = [fold(d, p).hex() for d, p in zip(leaves, ways)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array([proof(p).hex() for p in ways], pa.string()), pa.array(folded, pa.string()),
                 pa.array([f == root for f in folded], pa.bool_())], [*keep, "proof_sha256", "folded_root", "verified"])

    kinds = "".join(f"{k} {proofs.schema[k].dataType.simpleString()}, " for k in keep)
    return (proofs.select(*keep, F.col(leaf).alias("_leaf"), "path")
            .mapInArrow(check, kinds + "proof_sha256 string, folded_root string, verified boolean"))


def tamper_check(docs: DataFrame, every: int = 7) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document.

    One tree a lang, leaves by doc_id; rows with the same doc_id follow by leaf, null comes first. Where ``every``
    divides crc32 of the doc_id, the leaf that is folded is one whose n_chars is larger by one (null stays). Texts of any
    length are hashed where they are read; null and empty text differ. An empty table gives no rows; extra columns are ignored.
    """
    altered = (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
               & F.col("n_chars").isNotNull())
    fields = ["doc_id", "source", "lang"]
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    leaves = docs.select("lang", "doc_id", leaf_hash(*fields, "n_chars", "text").alias("digest"),
                         F.when(altered, leaf_hash(*fields, more, "text")).alias("altered"))
    spark = docs.sparkSession
    manifest = build(leaves, "lang", ["doc_id", "digest"])
    proofs = manifest.proofs(spark, ["doc_id", "altered"]).withColumn("folded", F.coalesce("altered", "digest"))
    checked = verified(proofs, "folded", ["tree", "doc_id", "digest"], manifest.root)
    roots = manifest.roots(spark).withColumnRenamed("tree", "_tree")
    return (checked.join(roots, F.col("tree").eqNullSafe(F.col("_tree")))
            .select("doc_id", F.lower(F.hex("digest")).alias("leaf"), "subroot", F.lit(manifest.root).alias("root"),
                    "proof_sha256", "folded_root", "verified"))


def _written(n_chars: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


#: crc32 of a short text in DuckDB, bit by bit.
_CRC = """
crc AS (
  SELECT doc_id, s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, s, i + 1, list_reduce([xor(c, ascii(s[i + 1])), 0, 0, 0, 0, 0, 0, 0, 0],
         lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
  FROM crc WHERE i < length(s)),
altered AS (SELECT doc_id, xor(c, 4294967295) % 7 = 0 AS alter FROM crc WHERE i = length(s))"""

#: The query's rows in DuckDB.
ORACLE = f"""
WITH RECURSIVE {_CRC.strip()},
leaves AS (
  SELECT doc_id, lang, {_written('n_chars')} AS leaf,
         CASE WHEN coalesce(alter, false) AND n_chars IS NOT NULL THEN {_written('CAST(n_chars AS HUGEINT) + 1')} ELSE {_written('n_chars')} END AS folded
  FROM documents d LEFT JOIN (SELECT doc_id AS id, alter FROM altered) ON doc_id = id),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT 0 AS level, lang, pos, n, leaf AS d FROM placed
  UNION ALL
  SELECT level + 1, lang, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, lang, pos // 2),
subroots AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, d FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2),
lower AS (
  SELECT p.doc_id, p.lang, p.leaf, p.pos AS place, p.folded, 0 AS level, p.pos, p.n, p.folded AS f, '' AS proof FROM placed p
  UNION ALL
  SELECT l.doc_id, l.lang, l.leaf, l.place, l.folded, l.level + 1, l.pos // 2, (l.n + 1) // 2,
         sha256(CASE WHEN s.d IS NULL THEN f WHEN l.pos % 2 = 0 THEN f || s.d ELSE s.d || f END), proof || coalesce(s.d, '')
  FROM lower l LEFT JOIN nodes s ON s.level = l.level AND s.lang IS NOT DISTINCT FROM l.lang AND s.pos = xor(l.pos, 1) WHERE l.n > 1),
upper AS (
  SELECT l.doc_id, l.leaf, s.d AS subroot, 0 AS level, s.pos, s.n, l.f, l.proof FROM lower l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang WHERE l.n = 1
  UNION ALL
  SELECT u.doc_id, u.leaf, u.subroot, u.level + 1, u.pos // 2, (u.n + 1) // 2,
         sha256(CASE WHEN s.d IS NULL THEN f WHEN u.pos % 2 = 0 THEN f || s.d ELSE s.d || f END), proof || coalesce(s.d, '')
  FROM upper u LEFT JOIN top s ON s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1)
SELECT doc_id, leaf, subroot, (SELECT d FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, f AS folded_root,
       f = (SELECT d FROM top WHERE n = 1) AS verified
FROM upper WHERE n = 1
"""
