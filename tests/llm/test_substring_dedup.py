import random

import numpy as np
import pytest

from flowrisk.llm import substring_dedup
from tests.llm.helpers import awkward, frame, prose


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    starts = {}
    for a, d in enumerate(data):
        for i in range(len(d) - length + 1):
            starts.setdefault(d[i:i + length], []).append((a, i))
    cover = [bytearray(len(d)) for d in data]
    for places in starts.values():
        if len(places) > 1:
            for a, i in places:
                cover[a][i:i + length] = b"\1" * length
    out = []
    for d, c in zip(data, cover):
        runs = sum(1 for i, x in enumerate(c) if x and not (i and c[i - 1]))
        out.append((len(d), sum(c), runs, bytes(x for x, y in zip(d, c) if not y)))
    return out


def check(spark, rows, length, gram, limit):
    docs = frame(spark, [(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, start int")
    got = substring_dedup.remove_repeats(docs, length, gram, limit).collect()
    want = [(r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows], length))]
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("length, gram, limit", [(400, 128, 20_000), (40, 13, 20_000), (40, 13, 3), (24, 24, 20_000)])
def test_against_brute_force(spark, length, gram, limit):
    rng = random.Random(length)
    passage = prose(rng, 150)
    rows = awkward()
    for i in range(25):  # a passage in different surroundings, a few bytes changed in some
        text = prose(rng, rng.randint(0, 60)) + passage[rng.randint(0, 200):] + "\x00\x00" * rng.randint(0, 30)
        at = rng.randrange(len(text))
        rows.append((100 + i, text if i % 3 else text[:at] + "é" + text[at:], None, None, 0))
    rows += [(200, "\x00" * 500, None, None, 0), (201, "ab" * 700, None, None, 0), (202, "ab" * 300 + "c" + "ab" * 300, None, None, 0)]
    check(spark, rows, length, gram, limit)


def test_nothing(spark):
    check(spark, [], 40, 13, 10)
    check(spark, [(1, None, None, None, 0), (2, "short", None, None, 0)], 40, 13, 10)


def test_anchors_do_not_depend_on_segments(monkeypatch):
    data = np.frombuffer(prose(random.Random(1), 3000).encode(), np.uint8)
    whole = substring_dedup.anchors(data, 400, 128)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 1000)
    parts = substring_dedup.anchors(data, 400, 128)
    assert all((a == b).all() for a, b in zip(whole, parts))
