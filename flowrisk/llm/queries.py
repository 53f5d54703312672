"""The operators as named queries over whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.llm import (chat, decontaminate, hard_negatives, language, line_dedup, merkle, mixing, packing, quality, simhash,
                          substring_dedup, token_counts, topk)
from flowrisk.llm.common import small_batches, table
from flowrisk.llm.tokens import tokenizer_path
from flowrisk.session import shared_path, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return register


@query("op1_packing")
def op1(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))


@query("op2_token_counts")
def op2(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), shared_path(spark, "token_counts"),
                                     tokenizer_path(VOCABULARY))


@query("op4_language")
def op4(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query("op5_quality_rules")
def op5(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_simhash")
def op6(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_top_k")
def op3(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op9_chat_formatting", chat.ORACLE)
def op9(spark, sf_dir):
    forged = spark.createDataFrame([(-7, 0, "user", chat.FORGED), (-7, 1, "assistant", chat.FORGED)],
                                   "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(forged)
    return chat.digest(stage(chat.format_chats(rows), "formatted"))


@query("op10_mixing")
def op10(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query("op7_line_dedup", line_dedup.ORACLE)
def op7(spark, sf_dir):
    return (line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
            .select("row.doc_id", "n_lines", "n_removed", F.length("kept").cast("long").alias("kept_chars"),
                    F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256")))


@query("op8_substring_dedup")
def op8(spark, sf_dir):
    return (substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                    F.octet_length("kept").cast("long").alias("n_kept")))


@query("op11_decontamination", decontaminate.ORACLE)
def op11(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_hard_negatives", hard_negatives.ORACLE)
def op12(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 100 == 0)


@query("op13_merkle", merkle.ORACLE)
def op13(spark, sf_dir):
    return merkle.tamper_check(table(spark, sf_dir, "documents"))
