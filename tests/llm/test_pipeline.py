from pyspark.sql import functions as F

import corpus_pipeline
from flowrisk.llm import quality
from flowrisk.session import stage
from tests.llm.helpers import WORD, awkward, frame

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, left = docs.columns, {0: docs.count()}
    for i, (name, apply) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        docs = stage(apply(spark, docs, FOLDER), "test")
        assert docs.columns == columns
        left[i + 1] = docs.count()
        if name == "quality rules":
            assert all(not quality.base_failed(quality.base_counts(r.text)) for r in docs.collect())
        if name == "near duplicates":
            assert docs.join(before, columns, "left_anti").count() == 0
    assert left[0] > left[1] > left[2] >= left[3] > 0
    words = sum(len(WORD.findall(r.text)) for r in before.collect())
    assert abs(sum(len(WORD.findall(r.text)) for r in docs.collect()) - words) <= 20
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    total = packed.agg({"length": "sum"}).first()[0]
    assert total == sum(r.doc_tokens for r in packed.where("start = 0").collect())
    assert corpus_pipeline.run(spark, FOLDER).count() == packed.count()


def test_awkward_rows_pass_through(spark):
    docs = frame(spark, awkward())
    for table in (docs, docs.limit(0)):
        for _, apply in corpus_pipeline.STAGES[:-1]:
            out = apply(spark, table, FOLDER)
            assert out.columns == docs.columns and out.count() <= 2 * table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, FOLDER).count() >= table.count()


def test_clashing_columns_and_a_very_long_text(spark):
    """Extra columns named like the stages' own stay with their rows; a text of 3 MB passes whole."""
    extra = ["copy", "row", "name", "size", "node", "kept", "shard", "place", "_key", "_id", "bin", "start", "digest"]
    long = " ".join(f"w{i * 7919 % 400_009}" for i in range(400_000))
    docs = frame(spark, [*awkward(n=8), (900, long, "aa", "s1", len(long))])
    docs = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in extra])
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = stage(apply(spark, docs, FOLDER), "test")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        for r in out.where("doc_id is not null").collect():
            assert [r[c] for c in extra] == [f"{c} {r.doc_id}" for c in extra], name
        if name in ("line dedup", "near duplicates"):
            assert out.where("doc_id = 900").first().text == long
    packed = corpus_pipeline.STAGES[-1][1](spark, docs.where("doc_id = 900"), FOLDER).collect()
    assert sum(r.length for r in packed) == packed[0].doc_tokens
    assert sorted(r.start for r in packed)[0] == 0 and all(r.offset + r.length <= 2048 for r in packed)
