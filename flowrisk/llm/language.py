"""Operator 4. Language identification by bit-sliced Bloom filters of character n-grams.

Every slot of the filter holds one bit per language, so one lookup (the AND of an n-gram's slots) gives
all languages that contain the n-gram. A text's language is the one whose bits are set most often once
the expected false positives of its filter are taken off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowrisk.llm.common import plain_text
from flowrisk.llm.grams import _ODD, char_grams, code_points, letters, mixed

#: Log2 of the n-gram ids and of the filter's slots; slots an n-gram sets; languages that share a word of bits.
ID_BITS, SLOT_BITS, PROBES, LANGS = 20, 21, 2, 63
GRAM = 3
#: A language holds an n-gram if its share there is at least this part of the largest share in any language,
#: and at least this share of its own n-grams.
RIVAL, LEAST = 0.25, 2e-6


def gram_ids(text: str) -> np.ndarray:
    """Ids of the n-grams of the lower-cased text, with every run of other characters as one space."""
    points = code_points(f" {text.lower()} ")
    points = np.where(letters()[points], points, 32)
    space = points == 32
    points = points[np.append(True, ~(space[1:] & space[:-1]))]
    return (char_grams(points, GRAM) >> np.uint64(64 - ID_BITS)).astype(np.int64)


def slots(ids: np.ndarray) -> list[np.ndarray]:
    """The filter's slots of each n-gram id."""
    wide = ids.astype(np.uint64) + np.uint64(1)
    return [(mixed(wide * _ODD[50 + k]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for k in range(PROBES)]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text); each task adds up what it reads first."""

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def out():
            for lang, counts in held.items():
                grams = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()),
                                                  pa.array(counts[grams], pa.int64())], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in held and len(held) >= 16:
                    yield from out()
                counts = held.setdefault(lang, np.zeros(1 << ID_BITS, np.int64))
                ids = gram_ids(text)
                if len(ids) > 1 << 14:
                    counts += np.bincount(ids, minlength=1 << ID_BITS)
                else:
                    np.add.at(counts, ids, 1)
        yield from out()

    return (docs.mapInArrow(count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """The languages, by code point, and the filter: a word of bits per slot for each 63 languages.

    Learns from every row with a language and a text whose crc32(key) mod 3 is not 1. Counts, shares and
    filter bits are made on Spark; at most 2^SLOT_BITS words for each 63 languages come to the driver.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key))
    counts = gram_counts(rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"))).persist()
    try:
        langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
        number = F.create_map(*[F.lit(x) for i, n in enumerate(langs) for x in (n, i)]) if langs else F.lit(None)
        totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        share = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
        best = share.withColumn("best", F.max("share").over(Window.partitionBy("gram")))
        chosen = best.where((F.col("share") >= RIVAL * F.col("best")) & (F.col("share") >= LEAST) & (F.col("n") > 1))
        filters = np.zeros((max(1, -(-len(langs) // LANGS)), 1 << SLOT_BITS), np.uint64)
        if not langs:
            return langs, filters
        bits = chosen.select("gram", number[F.col("lang")].alias("i"))

        def spread(batches):
            for batch in batches:
                i = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                for at in slots(batch.column(0).to_numpy(zero_copy_only=False)):
                    yield pa.RecordBatch.from_arrays([pa.array(i // LANGS), pa.array(at), pa.array(1 << (i % LANGS))],
                                                     ["word", "slot", "bits"])

        words = (bits.mapInArrow(spread, "word long, slot long, bits long")
                 .groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")).toArrow())
        filters[words["word"].to_numpy(), words["slot"].to_numpy()] = words["bits"].to_numpy().astype(np.uint64)
        return langs, filters
    finally:
        counts.unpersist()


def held_out(key: str = "doc_id"):
    """Whether crc32 of the key as text leaves 1 when divided by 3; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, langs: list[str], filters: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row.

    ``und`` with score 0 for a null text, one without a letter, or if no language was learned. The score is
    the share of the text's n-grams that the language holds, false positives taken off. Ties go to the
    language first by code point. Repeated rows are judged alike. An empty table gives no rows; other columns
    are ignored. A text is judged whole, so one row's ids and slots must fit in a task.
    """
    spark = docs.sparkSession
    wrong = np.array([(filters[i // LANGS] >> np.uint64(i % LANGS) & np.uint64(1)).mean() ** PROBES
                      for i in range(len(langs))])
    shared = spark.sparkContext.broadcast(filters)  # 16 MB for each 63 languages

    def judge(batches):
        words = shared.value
        for batch in batches:
            names, scores = [], []
            for t in batch.column(1).to_pylist():
                name, score = "und", 0.0
                if langs and any(map(str.isalpha, t)):
                    at = slots(gram_ids(t))
                    n = len(at[0])
                    hits = np.zeros(len(langs))
                    for w in range(len(words)):
                        masks = words[w][at[0]]
                        for more in at[1:]:
                            masks &= words[w][more]
                        for i in range(w * LANGS, min(len(langs), (w + 1) * LANGS)):
                            hits[i] = np.count_nonzero(masks & np.uint64(1 << (i % LANGS)))
                    share = np.clip((hits / n - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1) if n else hits
                    best = int(share.argmax())
                    name, score = langs[best], float(share[best])
                names.append(name), scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()),
                                              pa.array(scores, pa.float64())], ["_key", "held_out", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("_key"), plain_text(text).alias("_text"), held_out(key).alias("held_out"))
            .mapInArrow(judge, f"_key {kind}, held_out boolean, lang_pred string, score double")
            .withColumnRenamed("_key", key))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Learn from the rows that are not held out, then judge every row by its text alone.

    An empty table gives no rows, one without a language ``und`` for all. A task counts 2^20 ids (8 MB) for each of
    up to 16 languages at a time, and languages become literals of the plan: meant for tens of them, not thousands.
    """
    langs, filters = learn(docs, text, lang, key)
    return predict(docs, langs, filters, text, key)
