"""Operator 8. Removing every byte of strings that start in two places or more.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere. Sorting all suffixes column by
column needs as many rounds as the longest document has bytes, each over the whole transform, so columns are
inserted only around anchors, where equal strings line up:

1. Anchors. Of the hashed grams in a string the smallest is its anchor (the first, if several), so equal strings
   hold equal anchors at the same place. Anchors whose gram occurs once are dropped. One anchor stands for
   the strings around it, which all lie in its context.
2. Anchors with the same context: all strings in there repeat. Nothing else needs to be known.
3. Columns. The contexts that are left are lined up at the anchor and sorted from their last column to their
   first. Each round inserts one symbol in front of every context: a stable sort by symbol turns the order of
   the suffixes one column further into that of this column (what the Burrows-Wheeler transform of that column
   records), and the common prefix of two neighbours is one more than the least between them before. A
   neighbour with a common prefix of ``length`` bytes is a second start.

Contexts travel in shuffle and Parquet files; a task holds one batch of groups. Groups above a limit are not
sorted but decided by counting the hash of every string in them, which needs no group in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import plain_text, worker_cache
from flowrisk.session import stage

LENGTH, GRAM = 400, 128
#: Bytes hashed at one time; contexts sorted at one time; contexts in a group that is sorted.
SEGMENT, BATCH, LIMIT = 1 << 20, 50_000, 1 << 16
_BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and the powers of the base and of its inverse modulo 2^64."""
    cache = worker_cache()
    if len(cache.get("powers", (0, ()))[1]) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        values = np.random.default_rng(8).integers(0, 2**64, 256, np.uint64)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        cache["powers"] = values, np.cumprod(up), np.cumprod(down)
    return cache["powers"]


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all strings of ``length`` bytes."""
    width = length - gram + 1  # grams in a string
    found, hashes = [], []
    for start in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[start:start + SEGMENT + length - 1]
        values, up, down = powers(len(part) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[part] * up[:len(part)])))
        n = len(part) - gram + 1
        h = (total[gram:] - total[:n]) * down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        low = np.uint64((1 << 22) - 1)
        marked = np.full(-(-n // width) * width, ~np.uint64(0))
        marked[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
        blocks = marked.reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        strings = n - width + 1
        best = np.minimum(after[:strings], before[width - 1:width - 1 + strings])
        at = (best[np.append(True, best[1:] != best[:-1])] & low).astype(np.int64)
        found.append(at + start)
        hashes.append(h[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(found), return_index=True)
    return at, np.concatenate(hashes)[first]


def find_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, digest, at, size, gram, context) of every anchor; context is a hash of its bytes and place."""

    def find(batches):
        for batch in batches:
            ids, digests, texts = (c.to_pylist() for c in batch.columns)
            rows, ats, sizes, grams, contexts = [], [], [], [], []
            for row, text in enumerate(texts):
                data = text.encode("utf-8", "replace")
                if len(data) < length:
                    continue
                at, h = anchors(np.frombuffer(data, np.uint8), length, gram)
                n = len(data)
                rows += [row] * len(at)
                ats.append(at), grams.append(h), sizes.append(np.full(len(at), n))
                digest = xxhash.xxh64_intdigest
                contexts += [digest(data[max(0, a - length + gram):a + length], min(a, length - gram) * (length + 1) + min(n - a, length))
                             for a in at.tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[r] for r in rows], batch.schema.field(0).type), pa.array([digests[r] for r in rows], pa.int64()),
                     pa.array(np.concatenate(ats)), pa.array(np.concatenate(sizes)),
                     pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.array(contexts, np.uint64).view(np.int64))],
                    ["id", "digest", "at", "size", "gram", "context"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "digest", "t").mapInArrow(
        find, f"id {kind}, digest long, at long, size long, gram long, context long")


def repeated_starts(contexts: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray, length: int,
                    left: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last column (from the anchor) of a string that starts in another context of the group, too.

    contexts: one column per context, lined up so that row ``left`` is the anchor; a context has bytes in rows
    low <= row < high. ``group`` ascends. Rows without a repeated string get (1, -left - 1).
    """
    n = len(group)
    order, prefix = np.arange(n), np.zeros(n, np.int64)
    first, last = np.full(n, 1), np.full(n, -left - 1)
    of = group * 512  # groups keep their places in the order
    for row in range(left + length - 1, -1, -1):
        inside = (row >= low) & (row < high)
        symbol = np.where(inside, contexts[row].astype(np.int64), 256)[order]  # beyond a document's ends: a symbol of its own
        perm = np.argsort(of + symbol, kind="stable")
        new = order[perm]
        keys = (of + symbol)[perm]
        same = np.zeros(n, bool)
        same[1:] = (keys[1:] == keys[:-1]) & inside[new[1:]]
        least = np.zeros(n, np.int64)
        t = np.flatnonzero(same)
        near = perm[t] == perm[t - 1] + 1
        least[t[near]] = prefix[perm[t[near]]]
        far = t[~near]
        if len(far):
            ends = np.stack((perm[far - 1] + 1, perm[far] + 1), 1).ravel()
            least[far] = np.minimum.reduceat(np.append(prefix, 0), ends)[::2]
        prefix = np.where(same, least + 1, 0)
        order = new
        if row <= left:
            full = prefix >= length
            hit = order[full | np.append(full[1:], False)]
            first[hit] = row - left
            last[hit] = np.maximum(last[hit], row - left)
    return first, last


def sort_groups(batches, length: int, gram: int):
    """Spans (id, digest, start, end) from rows (group, id, digest, at, size, context bytes) sorted by group."""
    left = length - gram
    kind = None

    def work(rows: list):
        group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1].astype(np.int64)
        order = np.argsort(group, kind="stable")
        rows, group = [rows[i] for i in order], group[order]
        at, size = (np.array([r[i] for r in rows], np.int64) for i in (3, 4))
        low, high = np.maximum(left - at, 0), np.minimum(left + size - at, left + length)
        lined = np.zeros((len(rows), left + length), np.uint8)
        for i, r in enumerate(rows):
            lined[i, low[i]:high[i]] = np.frombuffer(r[5], np.uint8)
        first, last = repeated_starts(np.ascontiguousarray(lined.T), low, high, group, length, left)
        hit = np.flatnonzero(first <= last)
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][1] for i in hit], kind), pa.array([rows[i][2] for i in hit], pa.int64()),
             pa.array(at[hit] + first[hit]), pa.array(at[hit] + last[hit] + length)], ["id", "digest", "start", "end"])

    held: list = []
    for batch in batches:
        kind = batch.schema.field(1).type
        held += zip(*[c.to_pylist() for c in batch.columns])
        while len(held) > BATCH:
            cut = BATCH
            while cut < len(held) and held[cut][0] == held[cut - 1][0]:
                cut += 1
            if cut == len(held):
                break
            yield work(held[:cut])
            held = held[cut:]
    if held:
        yield work(held)


def with_bytes(places: DataFrame, docs: DataFrame, length: int, gram: int, every: bool = False) -> DataFrame:
    """The places (group, id, digest, at, size) with the bytes around them; if ``every``, one row per string and its hash."""
    listed = (places.groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
              .agg(F.collect_list(F.struct("group", "at")).alias("places")))
    texts = docs.select("id", "digest", "t").where(F.octet_length("t") >= length)
    both = listed.join(texts, F.col("id").eqNullSafe(F.col("_id")) & F.col("digest").eqNullSafe(F.col("_digest")))

    def cut(batches):
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for doc, digest, text, where in zip(*[c.to_pylist() for c in batch.columns]):
                data = text.encode("utf-8", "replace")
                for w in where:
                    a, n = w["at"], len(data)
                    if not every:
                        out.append((w["group"], doc, digest, a, n, data[max(0, a - length + gram):a + length]))
                        continue
                    for s in range(max(0, a - length + gram), min(a, n - length) + 1):
                        out.append((s - a, doc, digest, a, n, xxhash.xxh3_128_digest(data[s:s + length])))
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["group", "id", "digest", "at", "size", "bytes"])

    kind = docs.schema["id"].dataType.simpleString()
    # Rows that repeat key and text share their places; such a context occurs twice, so all its strings do.
    return (both.select("id", "digest", "t", "places")
            .mapInArrow(cut, f"group long, id {kind}, digest long, at long, size long, bytes binary"))


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """(id, digest, start, end): bytes to remove, overlapping, of documents (id, digest, t)."""
    found = stage(find_anchors(docs, length, gram), "anchors")
    # Counts are written before they are joined: only a join of two plain shuffles is split at a hot gram.
    grams = stage(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    shared = stage(found.join(grams, "gram"), "shared")
    place = F.struct("id", "digest", "at", "size")
    contexts = stage(shared.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")), "contexts")
    around = [F.greatest(F.col("at") - (length - gram), F.lit(0)).alias("start"), F.least(F.col("at") + length, "size").alias("end")]
    whole = (shared.join(contexts.where("n > 1").select("gram", "context"), ["gram", "context"])
             .select("id", "digest", *around))
    groups = stage(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
                   .where("kinds > 1 and least = 1").select("gram", "kinds"), "groups")
    members = stage(contexts.join(groups, "gram").select(F.col("gram").alias("group"), "kinds", "place.*"), "members")
    small = with_bytes(members.where(F.col("kinds") <= limit).select("group", "id", "digest", "at", "size"), docs, length, gram)
    sort = small.repartition("group").sortWithinPartitions("group")
    kind = docs.schema["id"].dataType.simpleString()
    sorted_spans = sort.mapInArrow(lambda b: sort_groups(b, length, gram), f"id {kind}, digest long, start long, end long")
    large = members.where(F.col("kinds") > limit)
    out = whole.union(sorted_spans)
    if large.limit(1).count():
        each = stage(with_bytes(large.select("group", "id", "digest", "at", "size"), docs, length, gram, every=True), "strings")
        start = F.col("at") + F.col("group")
        spot = F.struct("id", "digest", start.alias("start"))  # a string may be listed by several anchors
        twice = (each.groupBy("bytes").agg(F.min(spot).alias("low"), F.max(spot).alias("high"))
                 .where(~F.col("low").eqNullSafe(F.col("high"))).select("bytes"))
        out = out.union(each.join(twice, "bytes").select("id", "digest", start.alias("start"), (start + length).alias("end")))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = LIMIT, text: str = "text",
                   key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every row; kept is the text's remaining bytes.

    Strings are bytes of UTF-8 and never cross documents; a cut may split a character, so kept is binary. Null
    text is empty. Rows that repeat key and text hold each other's strings twice. An empty table gives no rows;
    extra columns are ignored.
    """
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("digest"), plain_text(text).alias("t"))
    found = (spans(rows, length, gram, limit).groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
             .agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    both = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & F.col("digest").eqNullSafe(F.col("_digest")), "left")

    def cut(batches):
        for batch in batches:
            out = []
            for text, pairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode("utf-8", "replace")
                kept, at, gone, runs = [], 0, 0, 0
                for start, end in sorted((p["start"], p["end"]) for p in pairs or ()):
                    if start > at or not runs:
                        kept.append(data[at:start])
                        runs, gone = runs + 1, gone + end - start
                    elif end > at:
                        gone += end - at
                    at = max(at, end)
                out.append((len(data), gone, runs, b"".join(kept) + data[at:]))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]],
                                              pa.array(columns[3], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return (both.select("id", "t", "spans").mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
            .withColumnRenamed("id", key))
