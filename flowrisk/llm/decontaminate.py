"""Operator 11. Benchmark decontamination by a broadcast set of hashed word windows.

The benchmark's words are cut into pieces and dealt to parts of bounded size. A part is broadcast as text;
each Python worker hashes its windows once. The documents are scanned part by part (one part is the rule): every
window of a text is looked up in a bit table, then among the sorted hashes, and a hit counts only if its words
equal the benchmark's. Hits become runs of words with the items they stem from, and runs or documents go.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import plain_text, worker_cache
from flowrisk.llm.grams import mixed
from flowrisk.session import stage

#: Words in a window, words in a piece of an item, bytes of text that one broadcast holds, bytes scanned at a time.
WINDOW, PIECE, PART, SEGMENT = 10, 4096, 16 << 20, 4 << 20
#: A-Z in lower case; every byte that belongs to no word becomes a space.
_CLEAN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_TURN = np.random.default_rng(11).integers(1, 2**63, 1 << 10, np.uint64) | np.uint64(1)

RUNS = "runs array<struct<first: long, last: long>>, items array<string>"


def normal(data: bytes) -> bytes:
    """The text's bytes, one for one, with words in lower case and spaces between."""
    return data.translate(_CLEAN)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(of_words: np.ndarray, size: int) -> np.ndarray:
    n = len(of_words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = mixed(total * _TURN[k % len(_TURN)] + of_words[k:k + n])
    return total


def pieces(benchmark: DataFrame, window: int, text: str, key: str) -> DataFrame:
    """(item, words): every item's words in runs of PIECE windows, which overlap by a window less one word."""

    def cut(batches):
        for batch in batches:
            items, parts = [], []
            for item, data in zip(*[c.to_pylist() for c in batch.columns]):
                words = normal(data).split()
                for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE):
                    items.append(item), parts.append(b" ".join(words[at:at + PIECE + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(parts, pa.binary())], ["item", "words"])

    return (benchmark.select(F.col(key).cast("string").alias("item"), plain_text(text).cast("binary").alias("t"))
            .mapInArrow(cut, "item string, words binary").distinct())


def dealt(table: DataFrame, part: int) -> tuple[DataFrame, int]:
    """The pieces with a part number; no part holds much more than ``part`` bytes, which is measured."""
    size = F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0))
    table = table.withColumn("size", size)
    total, rows = table.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, -(-total // part))
    while True:
        out = table.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(parts)).cast("int"))
        most = out.groupBy("part").agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] or 0
        if most <= 2 * part or parts >= rows:
            return out, parts
        parts *= 2


class Index:
    """The windows of one part: their hashes, their words and the items that hold them."""

    def __init__(self, part: list[tuple[str | None, bytes]], window: int):
        self.items = sorted({item for item, _ in part if item is not None})
        number = {item: i for i, item in enumerate(self.items)} | {None: -1}
        self.text = b" ".join(words for _, words in part)
        found, begin = {}, 0
        for item, joined in part:
            words = joined.split(b" ")
            size = min(window, len(words))
            ends = begin + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([begin], ends[:-1] + 1))
            n = len(words) - size + 1
            found.setdefault(size, []).append((window_hashes(hashes(words), size), starts[:n], ends[size - 1:], np.full(n, number[item])))
            begin += len(joined) + 1
        self.sizes = {size: self.sort(*[np.concatenate(c) for c in zip(*rows)]) for size, rows in found.items()}

    @staticmethod
    def sort(h, starts, ends, items):
        """Bit table, its shift, the distinct hashes, where each one's windows begin, and the windows by hash."""
        order = np.argsort(h, kind="stable")
        h, starts, ends, items = h[order], starts[order], ends[order], items[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        bits = max(10, (16 * len(h)).bit_length())
        shift = np.uint64(64 - bits)
        bit = np.zeros(1 << bits, bool)
        bit[h >> shift] = True
        return bit, shift, h[first], np.append(first, len(h)), starts, ends, items

    def scan(self, data: bytes, window: int) -> tuple[int, np.ndarray, set]:
        """(words, hit runs as rows (first, last), items) of a text's normal bytes."""
        runs, items, count, begin, tail = [], set(), 0, 0, []
        while begin < len(data):
            end = data.find(b" ", begin + SEGMENT)
            end = len(data) if end < 0 else end
            fresh = data[begin:end].split()
            words, base = tail + fresh, count - len(tail)
            of_words = hashes(words)
            for size, (bit, shift, distinct, first, starts, ends, owner) in self.sizes.items():
                h = window_hashes(of_words, size)
                at = np.flatnonzero(bit[h >> shift])
                if not len(at):
                    continue
                spot = np.minimum(np.searchsorted(distinct, h[at]), len(distinct) - 1)
                known = distinct[spot] == h[at]
                at, spot = at[known], spot[known]
                equal = {}  # the windows of a hash by their words
                for g in np.unique(spot).tolist():
                    same = equal.setdefault(g, {})
                    for j in range(first[g], first[g + 1]):
                        same.setdefault(self.text[starts[j]:ends[j]], set()).add(int(owner[j]))
                for i, g in zip(at.tolist(), spot.tolist()):
                    owners = equal[g].get(b" ".join(words[i:i + size]))
                    if owners is not None:
                        runs.append((base + i, base + i + size))
                        items |= owners
            count += len(fresh)
            tail = words[-(window - 1):] if window > 1 else []
            begin = end
        return count, np.array(runs, np.int64).reshape(-1, 2), {self.items[i] for i in items if i >= 0}


def union(runs: np.ndarray) -> np.ndarray:
    """Disjoint ascending runs that cover the same words."""
    if not len(runs):
        return runs
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    new = np.append(True, runs[1:, 0] > reach[:-1])
    return np.stack((runs[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(runs) - 1)]), 1)


def without(data: bytes, runs: list[dict]) -> bytes:
    """The text without the bytes from the first to the last word of each run."""
    edges = iter([(r["first"], r["last"]) for r in runs])
    kept, at, (first, last) = [], 0, next(edges, (-1, -1))
    for i, word in enumerate(re.finditer(rb"[^ ]+", normal(data))):
        if i == first:
            kept.append(data[at:word.start()])
        if i == last - 1:
            at = word.end()
            first, last = next(edges, (-1, -1))
    return b"".join(kept) + data[at:]


def scanned(rows: DataFrame, part: list, window: int, more: bool) -> DataFrame:
    """Adds a part's hits to (row, t, runs, items); t stays if other parts follow or the text is to be cut."""
    shared = rows.sparkSession.sparkContext.broadcast(part)

    def scan(batches):
        cache = worker_cache()
        if cache.get("benchmark", (None, None))[0] != (shared.value, window):
            cache["benchmark"] = (shared.value, window), Index(shared.value, window)
        index = cache["benchmark"][1]
        for batch in batches:
            counts, out, names = [], [], []
            for data, before, items in zip(*[c.to_pylist() for c in batch.columns[1:4]]):
                n, runs, found = index.scan(normal(data), window)
                old = np.array([(r["first"], r["last"]) for r in before], np.int64).reshape(-1, 2)
                counts.append(n)
                out.append([{"first": a, "last": b} for a, b in union(np.concatenate((old, runs))).tolist()])
                names.append(sorted(found.union(items)))
            columns = [batch.column(0), pa.array(out, batch.schema.field("runs").type), pa.array(names, pa.list_(pa.string())),
                       pa.array(counts, pa.int64())] + ([batch.column(1)] if more else [])
            yield pa.RecordBatch.from_arrays(columns, ["row", "runs", "items", "n_words"] + (["t"] if more else []))

    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "t", "runs", "items").mapInArrow(
        scan, f"row {kind}, {RUNS}, n_words long" + (", t binary" if more else ""))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id",
         item_text: str = "text", part: int = PART, keep_text: bool = False) -> DataFrame:
    """(row, runs, items, n_words) of every document; row is the document itself, with any columns it has.

    runs are disjoint hit runs of word numbers, last excluded; items the ids (as text, sorted) of benchmark items with
    a window in the document. An item of fewer words than a window is one window, one without words none. Words are runs
    of letters a-z (A-Z in lower case), digits and code points from 128. Null text has no words. Items without an id
    hit words but are not listed; repeated items count once. Repeated documents are judged alike. Empty tables: no rows,
    or documents without hits. Texts of any length are scanned 4 MB at a time. ``keep_text`` adds the text's bytes t.
    """
    table, parts = dealt(stage(pieces(benchmark, window, item_text, item), "benchmark"), part)
    rows = docs.select(F.struct(*docs.columns).alias("row"), plain_text(text).cast("binary").alias("t"),
                       F.expr("array()").cast("array<struct<first: long, last: long>>").alias("runs"),
                       F.expr("array()").cast("array<string>").alias("items"))
    for i in range(parts):
        held = table.where(F.col("part") == i).select("item", "words").toArrow()  # at most 2 x part bytes, or one piece
        listed = sorted(zip(held["item"].to_pylist(), held["words"].to_pylist()), key=lambda r: (r[0] or "", r[1]))
        last = i + 1 == parts
        rows = scanned(rows, listed, window, keep_text or not last)
        if not last:
            rows = stage(rows, "scanned")
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", window: int = WINDOW, text: str = "text",
                  item: str = "item_id", item_text: str = "text", part: int = PART) -> DataFrame:
    """The documents without benchmark text, with the columns they had.

    "spans" removes each hit run from its first to its last word and keeps the document; "documents" drops
    documents with a hit. Documents without hits are returned as they are, nulls included.
    """
    if mode not in ("spans", "documents"):
        raise ValueError("mode is spans or documents")
    found = hits(docs, benchmark, window, text, item, item_text, part, keep_text=mode == "spans")
    if mode == "documents":
        return found.where(F.size("runs") == 0).select("row.*")

    def cut(batches):
        for batch in batches:
            kept = [without(data, runs).decode("utf-8", "replace") if runs else None
                    for data, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["row", "kept"])

    kind = found.schema["row"].dataType.simpleString()
    out = found.select("row", "t", "runs").mapInArrow(cut, f"row {kind}, kept string")
    return out.select(*[F.coalesce("kept", F.col("row")[c]).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + r["last"] - r["first"])
    return (hits(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), benchmark, text="text", **how)
            .select(F.col("row.key").alias(key), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated")))


#: The same rows in DuckDB.
ORACLE = r"""
WITH words AS (
  SELECT rowid AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS size
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS shingle
  FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT d, i, size, array_to_string(w[i:i + size - 1], ' ') AS shingle
  FROM (SELECT d, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
found AS (SELECT d, i, size, item FROM doc_windows JOIN item_windows USING (size, shingle)),
covered AS (SELECT d, count(DISTINCT i + k) AS n_hit FROM (SELECT d, i, unnest(range(size)) AS k FROM found) GROUP BY d),
listed AS (SELECT d, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT d, item FROM found WHERE item IS NOT NULL) GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN covered USING (d) LEFT JOIN listed USING (d)
"""
