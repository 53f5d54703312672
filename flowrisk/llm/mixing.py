"""Operator 10. Mixing sources to target weights, with DataFrame functions only.

Each source's documents form a stream of words, cut into blocks of fixed length. Targets become slots of one
block each. A permutation of all slots deals them to output shards: the sources' counts in a shard are
multinomial draws given the totals, so that every source meets its target exactly. Slot number i of a source
is mapped through the source's own pseudorandom permutation to a block, pass by pass, and joined with it;
the last slot may be cut short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.functions.barrier import computed_once
from flowrisk.llm.common import WORD_SQL, plain_text
from flowrisk.session import stage

WEIGHTS = (5, 2, 1)
#: Words in a block, slots in an output shard, rounds of a permutation, least number of buckets of a source's stream,
#: documents in a bucket if all are of one source, and slots that one row unfolds into.
BLOCK, SHARD, ROUNDS, BUCKETS, BUCKET, CHUNK = 512, 4096, 32, 1024, 1 << 16, 1 << 14
SEED = 20240601


def permuted(df: DataFrame, value: str, size: str, key: str, backwards: bool = False) -> DataFrame:
    """Replaces ``value`` (0 <= value < size) by its image under a permutation chosen by ``key``.

    The swap-or-not shuffle: each round pairs values that add up to a round key modulo the size and swaps a
    pair or not by a hash bit, so it is a permutation for any size. ``backwards`` gives the inverse.
    """
    for r in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
        turn = F.xxhash64(F.lit(SEED + r), F.col(key))
        df = df.withColumn("_other", F.pmod(F.pmod(turn, F.col(size)) - F.col(value), F.col(size)))
        swap = F.xxhash64(F.lit(r), F.col(key), F.greatest(value, "_other")).bitwiseAND(1) == 1
        df = df.withColumn(value, F.when(swap, F.col("_other")).otherwise(F.col(value)))
    return df.drop("_other")


def source_plan(sized: DataFrame, weights: tuple = WEIGHTS, most: int = 3) -> DataFrame:
    """One row per source: no, source, source_size, target, and how its words are taken.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; a target stops at ``most``
    times its source, and the excess is shared again by weight until none is above. That is one water level:
    in the order of cap / weight a source is capped if, with the level at its own cap, all fits in the total.
    One row per source, so its windows are small.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    number = Window.orderBy(F.col("source").asc_nulls_last())
    rows = (sources.withColumn("no", F.row_number().over(number) - 1)
            .withColumn("weight", F.array(*map(F.lit, weights))[(F.col("no") % len(weights)).cast("int")].cast("long"))
            .withColumn("cap", most * F.col("source_size"))
            .withColumn("total", F.sum("source_size").over(everything)))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "no")
    below = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("capped", below * F.col("weight") + F.col("cap") * above <= F.col("total") * F.col("weight"))
    capped = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    free = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (F.col("total") - capped) * F.col("weight") / free)
    words = F.floor(F.col("target"))
    rows = (rows.withColumn("target", target)
            .withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
            .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0))
            .withColumn("rest", words - F.col("passes") * F.col("source_size"))
            .withColumn("short", BLOCK - (F.col("source_size") - (F.col("blocks") - 1) * BLOCK))
            .withColumn("key", F.xxhash64("no", "passes"))
            .withColumn("rank", F.col("blocks") - 1))
    # Where the short last block comes in the last pass decides how many slots that pass has.
    rows = permuted(rows.withColumn("n", F.greatest("blocks", F.lit(1)))
                    .withColumn("rank", F.greatest("rank", F.lit(0))), "rank", "n", "key", backwards=True)
    before = F.ceil(F.col("rest") / BLOCK)
    more = F.when(F.col("rank") < before, F.ceil((F.col("rest") + F.col("short")) / BLOCK)).otherwise(before)
    rows = rows.withColumn("more", more)
    missing = F.when(F.col("rank") < F.col("more") - 1, F.col("short")).otherwise(0)
    return rows.select("no", "source", "source_size", "target", "blocks", "passes", "more",
                       (F.col("rest") - ((F.col("more") - 1) * BLOCK - missing)).alias("last"))


def slots(plan: DataFrame, shard: int = SHARD) -> DataFrame:
    """(no, pass, block, words, shard, place): every block that the mix takes, and where it goes."""
    slot_count = F.col("passes") * F.col("blocks") + F.col("more")
    before = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    rows = (plan.withColumn("slots", slot_count).withColumn("start", F.coalesce(F.sum("slots").over(before), F.lit(0)))
            .withColumn("all", F.sum("slots").over(Window.partitionBy())).where("slots > 0"))
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / CHUNK))))
    # The chunks are few and small until they unfold, so their number, not their size, says how many tasks.
    parts = plan.agg(F.sum(F.ceil(slot_count / CHUNK))).first()[0] or 1
    each = (chunks.repartition(int(min(parts, 10_000)), "no", "chunk")
            .withColumn("i", F.explode(F.sequence(F.col("chunk") * CHUNK,
                                                  F.least((F.col("chunk") + 1) * CHUNK, "slots") - 1))))
    each = (each.withColumn("pass", F.floor(F.col("i") / F.col("blocks")))
            .withColumn("rank", F.col("i") - F.col("pass") * F.col("blocks"))
            .withColumn("words", F.when((F.col("pass") == F.col("passes")) & (F.col("rank") == F.col("more") - 1), F.col("last"))
                        .otherwise(BLOCK))
            .withColumn("key", F.xxhash64("no", "pass")).withColumn("block", F.col("rank"))
            .withColumn("place", F.col("start") + F.col("i")).withColumn("whole", F.lit(-1)))
    each = permuted(permuted(each, "block", "blocks", "key"), "place", "all", "whole")
    return each.select("no", "pass", "block", "words", F.floor(F.col("place") / shard).alias("shard"),
                       (F.col("place") % shard).alias("place"))


def sizes(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(key, source, size, tie): words of each text; tie is a digest of the text, for rows that repeat a key."""
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"),
                       F.regexp_count(plain_text(text), F.lit(WORD_SQL)).cast("long").alias("size"),
                       F.xxhash64(text).alias("tie"))


def positions(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds no and start: each document's place in its source's stream, in buckets so that no source is one group."""
    names = plan.select("no", F.col("source").alias("_source"))
    buckets = max(BUCKETS, -(-sized.count() // BUCKET))
    rows = (sized.join(names, sized["source"].eqNullSafe(names["_source"])).drop("_source")
            .withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), F.col("key"), F.col("tie")), F.lit(buckets))))
    first = Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("no", "bucket").agg(F.sum("size").alias("n"))
              .select("no", "bucket", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("bucket_start")))
    inside = Window.partitionBy("no", "bucket").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(starts, ["no", "bucket"])
            .withColumn("start", F.col("bucket_start") + F.col("inside")).drop("bucket", "inside", "bucket_start"))


def taken_pieces(docs: DataFrame, weights: tuple = WEIGHTS, most: int = 3, **columns) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with their place in the streams, the plan, and the pieces of blocks that the mix takes.

    A piece is (no, start, key, pass, block, shard, place, first, words): of the document that starts there, words
    first to first + words.
    """
    sized = stage(sizes(docs, **columns), "sizes")
    plan = stage(source_plan(sized, weights, most), "sources")
    placed = stage(positions(sized, plan), "positions")
    taken = stage(slots(plan), "slots")
    end = F.col("start") + F.col("size")
    held = (placed.where("size > 0")
            .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK))))
            .withColumn("low", F.greatest("start", F.col("block") * BLOCK))
            .withColumn("high", F.least(end, (F.col("block") + 1) * BLOCK)))
    cut = F.least("high", F.col("block") * BLOCK + F.col("words"))
    pieces = (held.join(taken, ["no", "block"]).withColumn("cut", cut).where("cut > low")
              .select("no", "start", "key", "pass", "block", "shard", "place",
                      (F.col("low") - F.col("start")).alias("first"), (F.col("cut") - F.col("low")).alias("words")))
    return placed, plan, pieces


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = 3, **columns) -> DataFrame:
    """(key, size, source_size, target, taken, n_shards, first_shard, first_place) of every row.

    taken is the words that the mix takes of it, repeats counted; n_shards the output shards that hold some of
    them; first_shard and first_place where the first of these stand (null if none). The draw decides the latter three.
    Null text has no words and is not taken. A null source is a source, the last one. Rows that repeat a key are
    documents of their own. Ties in a stream's order are broken by a digest of the text. Reruns agree. An empty
    table gives no rows; extra columns are ignored.
    """
    placed, plan, pieces = taken_pieces(docs, weights, most, **columns)
    words = pieces.groupBy("no", "start").agg(F.sum("words").alias("taken"), F.count_distinct("shard").alias("n_shards"),
                                              F.min(F.struct("shard", "place")).alias("at"))
    return (placed.join(plan.select("no", "source_size", "target"), "no")
            .join(words.withColumnsRenamed({"no": "_no", "start": "_start"}),
                  (F.col("no") == F.col("_no")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
            .select(F.col("key").alias(columns.get("key", "doc_id")), "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).alias("n_shards"),
                    F.col("at.shard").cast("long").alias("first_shard"), F.col("at.place").cast("long").alias("first_place")))


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, most: int = 3, text: str = "text", source: str = "source",
            key: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """The mix as rows of ``docs``: one for each pass that takes words of a document, with the words taken.

    Rows are dealt by output shard, a shard whole in one partition, and stand there in the order of their first
    places, so files written from the result are the shards in the order that the draw gives.
    A pass that takes a document whole leaves its text as it is; else the text is the taken words with the white
    space before each, and ``n_chars``, if there is one, is its length.
    """
    placed, plan, pieces = taken_pieces(docs, weights, most, text=text, source=source, key=key)
    shards = plan.agg(F.ceil(F.sum(F.col("passes") * F.col("blocks") + F.col("more")) / SHARD)).first()[0] or 1
    copy = Window.partitionBy("key", "tie").orderBy("start")
    places = placed.where("size > 0").select("no", "start", "key", "tie", "size", F.row_number().over(copy).alias("copy"))
    parts = (pieces.groupBy("no", "start", "pass")
             .agg(F.sum("words").alias("taken"), F.min(F.struct("shard", "place", "start")).alias("at"),
                  F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts")))
    wanted = parts.join(places, ["no", "start"])
    own = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_tie"),
                      F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = own.withColumn("_copy", F.row_number().over(Window.partitionBy("_key", "_tie").orderBy(F.lit(0))))
    rows = own.join(wanted, F.col("_key").eqNullSafe(F.col("key")) & (F.col("_tie") == F.col("tie")) & (F.col("_copy") == F.col("copy")))
    part = F.col("taken") < F.col("size")
    worded = F.regexp_extract_all(F.col("row")[text], F.lit(r"[\x20\x09-\x0D]*" + WORD_SQL), F.lit(0))
    # The barrier keeps the list of words from being made again for every part.
    rows = computed_once(rows.select("row", "at", "parts", "taken", "size", F.when(part, worded).alias("word")))
    chosen = F.flatten(F.transform("parts", lambda p: F.slice(F.col("word"), (p["first"] + 1).cast("int"), p["words"].cast("int"))))
    rows = computed_once(rows.select("row", "at", F.when(part, F.array_join(chosen, "")).alias("cut")))
    row = F.col("row").withField(text, F.coalesce("cut", F.col("row")[text]))
    if n_chars in docs.columns:
        row = row.withField(n_chars, F.coalesce(F.length("cut").cast(docs.schema[n_chars].dataType), F.col("row")[n_chars]))
    rows = rows.select(row.alias("row"), "at").repartition(int(min(shards, 100_000)), F.col("at.shard")).sortWithinPartitions("at")
    return rows.select("row.*")
