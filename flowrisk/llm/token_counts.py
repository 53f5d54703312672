"""Operator 2. Token counts through a digest cache.

Texts are named by the SHA-256 of their content (null is the empty text; the tokenizer has no other
normal form, so content is taken as it is) and tokenizers by the SHA-256 of their file. Stored counts are
joined by both digests; only distinct texts without one are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import plain_text
from flowrisk.llm.tokens import encoder

CACHE = "tokenizer binary, digest binary, n_tokens long"


def digest(text: str = "text"):
    return F.unhex(F.sha2(F.encode(plain_text(text), "UTF-8"), 256))


def file_digest(path: str) -> bytes:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).digest()


def stored_counts(spark, cache: str, version: bytes) -> DataFrame:
    """One row per digest, even if two jobs have stored the same text."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    return (spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == F.lit(version))
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def encode_misses(docs: DataFrame, cache: str, path: str, text: str = "text") -> None:
    """Encode the distinct texts that the cache lacks and append their counts.

    A text that many rows hold is reduced to one in the map tasks, before the shuffle.
    """
    spark, version = docs.sparkSession, file_digest(path)
    distinct = (docs.select(digest(text).alias("digest"), plain_text(text).alias("text"))
                .groupBy("digest").agg(F.first("text").alias("text")))
    misses = distinct.join(stored_counts(spark, cache, version).select("digest"), "digest", "left_anti")

    def encode(batches):
        encode_texts = encoder(path)
        for batch in batches:
            counts = [len(encode_texts.ids(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts), pa.binary()), batch.column(0), pa.array(counts, pa.int64())],
                ["tokenizer", "digest", "n_tokens"])

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, cache: str, path: str, over: int = 512, text: str = "text",
                 key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row.

    Null text counts as empty: no bytes, no tokens. Repeated rows and null keys each keep their row. Extra
    columns are ignored. An empty table gives no rows. The cache folder is made if it is not there.
    """
    encode_misses(docs, cache, path, text)
    counts = stored_counts(docs.sparkSession, cache, file_digest(path))
    rows = docs.select(F.col(key), F.octet_length(plain_text(text)).cast("long").alias("n_bytes"),
                       digest(text).alias("digest"))
    return rows.join(counts, "digest").select(key, "n_bytes", "n_tokens",
                                              (F.col("n_tokens") > over).alias("over_limit"))
