import math
import random

from pyspark.sql import functions as F

from flowrisk.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i % 3 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(good) if b != a)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def check(spark, rows, k=4, **blocks):
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") % 3 == 0, k, **blocks).collect()
    assert sorted(map(tuple, got)) == brute(rows, k)


def single(v):
    import numpy as np

    return [float(np.float32(x)) for x in v]


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, single([rng.gauss(0, 0.2) for _ in range(8)]), "x") for i in range(90)]
    rows += [(200 + i, single([rng.choice([0, 0.25, -0.25]) for _ in range(8)]), None) for i in range(60)]  # ties
    rows += [rows[0], rows[3], (300, None, ""), (303, [0.5] * 7 + [None], ""), (306, [float("nan")] + [0.1] * 7, ""),
             (309, [float("inf")] + [0.1] * 7, ""), (None, [0.5] * 8, ""), (312, [0.0] * 8, ""), (315, [1.0, -1.0], ""), (318, [], "")]
    check(spark, rows)
    check(spark, rows, k=7, query_block=8, candidate_block=11)


def test_few_and_none(spark):
    check(spark, [(0, [1.0], "")])
    check(spark, [(0, [1.0], ""), (1, [-1.0], ""), (3, [2.0], "")])
    check(spark, [])


def test_stops_before_the_end():
    import numpy as np

    x = np.zeros((1000, 2))
    x[:, 0] = np.arange(1000)
    rows, scores = topk.threshold_search(np.array([1.0, 0.0]), np.array([], int), x, np.arange(1000),
                                         np.argsort(-x, axis=0, kind="stable").T.copy(), 3)
    assert rows.tolist() == [999, 998, 997] and scores.tolist() == [999, 998, 997]
