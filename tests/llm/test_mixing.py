import random

import pytest
from pyspark.sql import functions as F

from flowrisk.llm import mixing
from tests.llm.helpers import WORD, awkward, frame, words

SCHEMA = "doc_id long, text string, source string, n_chars long, size string"


def targets(sizes, weights=(5, 2, 1)):
    """Shares by repeated capping, over sources in order."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: float(fixed.get(s, level * weight[s])) for s in order}
        fixed.update({s: 3 * sizes[s] for s in over})


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_permutations(spark, n):
    rows = spark.range(n).select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(n).cast("long").alias("n"), F.lit(3).alias("key"))
    there = mixing.permuted(rows, "x", "n", "key")
    assert sorted(r.x for r in there.collect()) == list(range(n))
    assert all(r.x == r.y for r in mixing.permuted(there, "x", "n", "key", backwards=True).collect())


@pytest.mark.parametrize("block", [512, 7])
def test_shares(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i, " ".join(words(rng, rng.choice([0, 3, 40, 300]))), rng.choice(["a", "b", "b", "c", "c", "c", "é", None]), 0, "x")
            for i in range(150)]
    rows += [(500, "w " * 900, "tiny", 0, ""), (501, None, "none", 0, ""), (502, "one", "solo", 0, "")]
    rows += [rows[4], rows[4], (4, "other text", "a", 0, ""), (None, "x y z", None, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(docs).collect()
    assert sorted(map(tuple, mixing.mixed(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    n = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + n(t)
    want = targets(sizes)
    assert sorted(((r[0], n(r[1]), sizes[r[2]], round(want[r[2]], 6)) for r in rows), key=str) == \
        sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in got), key=str)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    plan = {r.source: r for r in mixing.source_plan(mixing.sizes(docs)).collect()}
    _, _, pieces = mixing.taken_pieces(docs)
    by = {r.no: r.n for r in pieces.groupBy("no").agg(F.sum("words").alias("n")).collect()}
    assert all(abs(by.get(p.no, 0) - want[s]) < 1 for s, p in plan.items())
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    texts = {}
    for r in out.collect():
        assert r.n_chars in (len(r.text), 0)
        texts[r.doc_id] = texts.get(r.doc_id, 0) + n(r.text)
    taken = {}
    for r in got:
        if r.taken:
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert texts == taken


def test_shards_are_multinomial_draws(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    plan = mixing.source_plan(mixing.sizes(docs))
    shards = mixing.slots(plan, shard=20).groupBy("shard").pivot("no", [0, 1]).count().collect()
    share = sum(r["0"] or 0 for r in shards) / sum((r["0"] or 0) + (r["1"] or 0) for r in shards)
    assert abs(share - 5 / 7) < 0.01 and len({r["0"] for r in shards}) > 3


def shard_order(spark, docs):
    """What the mixture's partitions hold, each in its order."""
    rows = mixing.mixture(docs).select("doc_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")).collect()
    return [[r.doc_id for r in sorted(rows, key=lambda r: r.i) if r.p == p] for p in sorted({r.p for r in rows})]


def test_results_follow_the_draw(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 8)
    monkeypatch.setattr(mixing, "slots", lambda plan, inner=mixing.slots: inner(plan, 8))
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 700)), "ab"[i % 2], 0, "") for i in range(120)], SCHEMA)
    got = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    pieces = mixing.taken_pieces(docs)[2].select("key", "shard", "place").collect()
    spots = {}
    for r in pieces:
        spots.setdefault(r.key, []).append((r.shard, r.place))
    for doc, r in got.items():
        mine = spots.get(doc, [])
        assert r.n_shards == len({s for s, _ in mine})
        assert (r.first_shard, r.first_place) == (min(mine) if mine else (None, None))
    orders = shard_order(spark, docs)
    first = {doc: (r.first_shard, r.first_place) for doc, r in got.items()}
    single = {doc for doc in spots if sum(d == doc for part in orders for d in part) == 1}
    for part in orders:  # shards one after the other, each in the order of its places
        here = [first[d] for d in part if d in single]
        assert here == sorted(here)
    drawn = mixing.permuted
    monkeypatch.setattr(mixing, "permuted", lambda df, value, size, key, **how: df if key == "whole" else drawn(df, value, size, key, **how))
    without = {r.doc_id: (r.n_shards, r.first_shard, r.first_place) for r in mixing.mixed(docs).collect()}
    assert without != {d: (r.n_shards, r.first_shard, r.first_place) for d, r in got.items()}
    assert shard_order(spark, docs) != orders


def test_awkward_rows_and_none(spark):
    docs = frame(spark, awkward())
    assert mixing.mixed(docs).count() == len(awkward())
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mixture(docs.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mixed(docs.where("text is null or text = ''")).collect())
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
