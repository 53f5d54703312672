import math
import random

import numpy as np
from pyspark.sql import functions as F

from flowrisk.llm import hard_negatives
from tests.llm.test_topk import single

SCHEMA = "vec_id long, embedding array<float>, label int, ref string, anchor int"


def brute(rows, k=5, every=5):
    good = [(i, [math.floor(256 * float(x)) for x in v], y) for i, v, y, *_ in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(good):
        if i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), j, b) for b, (j, w, _) in enumerate(good) if b != a]
        for s, p, b in sorted(t for t in scored if good[t[2]][2] == y)[:k]:
            fit = sorted((t, j) for t, j, c in scored if good[c][2] != y and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(fit)]
    return sorted(out)


def check(spark, rows, **how):
    k = how.get("positives", 5)
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % 5 == 0, negatives=k, **how).collect()
    assert sorted(map(tuple, got)) == brute(rows, k)


def test_strassen_equals_the_product():
    rng = np.random.default_rng(3)
    for m, k, n in [(1, 1, 1), (2, 3, 5), (7, 7, 7), (17, 64, 33), (65, 31, 130), (0, 4, 3), (5, 0, 4), (100, 1, 100)]:
        a, b = rng.integers(-2**20, 2**20, (m, k)), rng.integers(-2**20, 2**20, (k, n))
        for leaf in (1, 2, 16):
            assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()
    a, b = np.full((4, 4), 2**30), np.full((4, 4), -(2**30))  # sums inside may wrap, the result does not
    assert (hard_negatives.strassen(a, b, 1) == a @ b).all()


def test_best_is_stable():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 40):
        s = rng.integers(0, 4, n)
        for k in (1, 3, 50):
            assert hard_negatives.best(s, k).tolist() == sorted(range(n), key=lambda i: (-s[i], i))[:k]


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, single([abs(rng.gauss(0.1, 0.1)) for _ in range(7)]), rng.choice([0, 1, 2]), "x", 1) for i in range(80)]
    rows += [(100 + i, single([rng.choice([0, 0.25, 0.5]) for _ in range(7)]), 1, None, None) for i in range(50)]  # ties, a hot label
    rows += [rows[0], rows[5], rows[7], (5, rows[9][1], 2, "", 0), (300, None, 1, "", 0), (305, [0.5] * 6 + [None], 1, "", 0),
             (310, [float("nan")] + [0.1] * 6, 1, "", 0), (315, [float("inf")] + [0.1] * 6, 1, "", 0), (None, [0.5] * 7, 1, "", 0),
             (320, [0.5] * 7, None, "", 0), (325, [0.0] * 7, 1, "", 0), (330, [1.0, 0.5], 0, "", 0), (335, [], 1, "", 0),
             (340, [-0.5] * 7, 0, "", 0), (341, [-0.4] * 7, 0, "", 0), (345, [0.5] * 7, 9, "", 0)]
    check(spark, rows)
    check(spark, rows, positives=3, anchor_block=7, candidate_block=11)


def test_few_and_none(spark):
    check(spark, [])
    check(spark, [(0, [1.0], 1, "", 0)])
    check(spark, [(0, [1.0], 1, "", 0), (1, [1.0], 1, "", 0), (2, [0.9], 2, "", 0), (3, [0.7], 2, "", 0)])
    big = [(0, [1e15], 1, "", 0), (5, [1.0], 1, "", 0), (6, [1.0], 1, "", 0), (7, [1.0], 2, "", 0)]
    got = hard_negatives.mine(spark.createDataFrame(big, SCHEMA), F.col("id") % 5 == 0).collect()
    assert [tuple(r) for r in got] == [(5, 6, 1, 7, 65536, 65536)]  # the first row's products might not fit
