"""Boosted trees against a plain version that looks at every row for every split."""
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowrisk.operators.boosting import LeafwiseTrees, LevelTrees


def plain_trees(x, y, rounds, rate, leaves, min_leaf):
    """Margins after boosting: the leaf with the best split is split first, cuts lie at the distinct values."""
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    counts = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def split(inside):
            best = (0.0, None)
            for f in range(x.shape[1]):
                for v in np.unique(x[inside, f])[:-1]:
                    left, right = inside & (x[:, f] <= v), inside & (x[:, f] > v)
                    if min(left.sum(), right.sum()) < min_leaf or min(h[left].sum(), h[right].sum()) < 1e-3:
                        continue
                    gain = (g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum()
                            - g[inside].sum() ** 2 / h[inside].sum())
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
            return best

        grown = [(np.ones(len(y), bool), split(np.ones(len(y), bool)))]
        while len(grown) < leaves:
            i = max(range(len(grown)), key=lambda k: grown[k][1][0])
            if grown[i][1][1] is None:
                break
            grown[i:i + 1] = [(part, split(part)) for part in grown[i][1][1]]
        for inside, _ in grown:
            margin[inside] -= rate * g[inside].sum() / h[inside].sum()
        counts.append(len(grown))
    return margin, counts


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(40) / 7, float(rng.randrange(6)), rng.randrange(200) - 100.0, 3.0) for i in range(500)]
    rows = [(*r, int((r[1] > 2.5) ^ (r[2] > 3) ^ (abs(r[3]) > 60) if rng.random() < 0.9 else rng.random() < 0.5))
            for r in rows]
    return rows, spark.createDataFrame(rows, "seq int, a double, b double, c double, flat double, label_int int")


def test_trees_equal_plain_ones(data):
    rows, df = data
    x, y = np.array([r[1:5] for r in rows]), np.array([r[5] for r in rows], dtype=float)
    margin, counts = plain_trees(x, y, 4, 0.3, 7, 20)
    model = LeafwiseTrees.fit(df, ["a", "b", "c", "flat"], rounds=4, rate=0.3, leaves=7)
    assert model.leaf_counts() == counts == [7] * 4
    found = {r.seq: r.score for r in model.score(df).collect()}
    assert max(abs(found[r[0]] - 1 / (1 + math.exp(-m))) for r, m in zip(rows, margin)) < 1e-6


def test_order_of_rows_and_rewritten_margins_change_nothing(data, monkeypatch):
    _, df = data
    features = ["a", "b", "c"]
    once = LeafwiseTrees.fit(df, features, rounds=4, leaves=4)
    monkeypatch.setattr("flowrisk.operators.boosting.REWRITE", 2)
    again = LeafwiseTrees.fit(df.orderBy(F.rand(3)).repartition(5), features, rounds=4, leaves=4)
    scores = [{r.seq: r.score for r in m.score(df).collect()} for m in (once, again)]
    assert max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-12


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(4000).select((F.col("id") * 0.5 - 900).alias("x"), (F.col("id") % 4000 >= 2500).cast("int").alias("label_int"))
    model = LeafwiseTrees.fit(df, ["x"], rounds=20, rate=0.3)
    assert len(model.cuts[0]) <= 254
    wrong = model.score(df).filter("(score >= 0.5) <> (label_int = 1)").count()
    assert wrong <= 4000 / 255 * 1.5  # at most what lies in the bin of the border


def test_edges(spark, data):
    _, df = data
    with pytest.raises(ValueError, match="both classes"):
        LeafwiseTrees.fit(df.filter("label_int = 1"), ["a"])
    with pytest.raises(ValueError, match="both classes"):
        LeafwiseTrees.fit(df.limit(0), ["a"])
    for bad in (None, float("nan"), float("inf")):
        odd = df.limit(1).withColumn("a", F.lit(bad).cast("double"))
        with pytest.raises(ValueError, match="finite"):
            LeafwiseTrees.fit(df.union(odd), ["a"])
    flat = LeafwiseTrees.fit(df, ["flat"], rounds=3)
    assert flat.leaf_counts() == [1]
    odd = df.limit(1).select("seq", F.lit(None).cast("double").alias("flat"))
    assert flat.score(odd).first().score is None
    assert flat.score(df.withColumnRenamed("label_int", "margin")).count() == 500


def jobs(spark, name, call):
    """The number of Spark jobs of a call."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        call()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    time.sleep(1)  # jobs are told to the tracker in the background
    return len(context.statusTracker().getJobIdsForGroup(name))


def test_a_pass_is_one_job_and_last_children_need_none(spark, data):
    _, df = data
    few, more = (jobs(spark, f"stumps {n}", lambda: LeafwiseTrees.fit(df, ["a", "b", "c"], rounds=n, leaves=2)) for n in (5, 15))
    assert more - few == 10
    few, more = (jobs(spark, f"levels {n}", lambda: LevelTrees.fit(df, ["a", "b", "c"], rounds=n, depth=2)) for n in (5, 15))
    assert more - few == 20


def test_level_trees_equal_those_of_spark(spark, data):
    """On features with few values, where both have a bin for each."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    _, df = data
    df = df.withColumn("c", F.floor(F.col("c") / 20).cast("double")).withColumn("a", F.floor("a"))
    names = ["a", "b", "c", "flat"]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    plain = GBTClassifier(labelCol="label_int", maxIter=8, stepSize=0.05, maxDepth=4, minInstancesPerNode=20).fit(rows)
    wanted = {r[0]: r[1] for r in plain.transform(rows).select("seq", vector_to_array("probability")[1]).collect()}
    found = {r.seq: r.score for r in LevelTrees.fit(df, names, rounds=8).score(df).collect()}
    assert max(abs(found[k] - wanted[k]) for k in wanted) < 1e-6
    one = LevelTrees.fit(df.withColumn("label_int", F.lit(1)), names, rounds=3).score(df)
    assert one.filter("score <= 0.5").count() == 0
    with pytest.raises(ValueError):
        LevelTrees.fit(df.limit(0), names)
