import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from flowrisk.llm import merkle
from tests.llm.helpers import awkward, frame

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, tree int, pos string, n string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc, text, lang, source, n):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, order = {}, {}
    for lang in langs:
        order[lang] = sorted([r for r in rows if r[2] == lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[lang] = tree([leaf_of(*r) for r in order[lang]])
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for place, lang in enumerate(langs):
        for at, row in enumerate(order[lang]):
            n = row[4] if row[4] is None or row[0] is None or zlib.crc32(str(row[0]).encode()) % 7 else row[4] + 1
            folded, others = leaf_of(*row[:4], n), []
            for levels, i in ((trees[lang], at), (top, place)):
                for level in levels[:-1]:
                    pair = level[i // 2 * 2:i // 2 * 2 + 2]
                    others += [x for j, x in enumerate(pair) if j != i % 2]
                    pair[i % 2] = folded
                    folded, i = h(*pair), i // 2
            out.append((row[0], leaf_of(*row), trees[lang][-1][0], top[-1][0], h(*others), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def documents(seed):
    rng = random.Random(seed)
    rows = [tuple(r) for r in awkward(seed)]
    hot = [(rng.randrange(10**6), f"text {i}", "hot", rng.choice(["s", None]), i) for i in range(700)]
    return rows + hot + [hot[0]] * 40 + [(i, "é", f"l{i}", "s", i) for i in range(6)] + [(3, "", "lone", None, 2**63 - 1)]


@pytest.mark.parametrize("step", [8, 3, 1])
def test_against_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(merkle, "STEP", step)
    rows = documents(step)
    got = merkle.tamper_check(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert 0 < sum(not r["verified"] for r in got) < len(got)


def test_small_and_empty(spark):
    for rows in ([], [(1, "a", "x", "s", 1)], [(None, None, None, None, None)], [(14, "a", None, None, 3), (14, "a", None, None, 3)]):
        got = merkle.tamper_check(frame(spark, rows)).collect()
        assert sorted(map(tuple, got), key=repr) == (brute(rows) if rows else [])


def test_clashing_columns(spark):
    rows = documents(5)[:60]
    wide = frame(spark, [(*r, "x", "y", 0, None, "z") for r in rows], EXTRA)
    assert sorted(map(tuple, merkle.tamper_check(wide).collect()), key=repr) == brute(rows)


def test_few_levels_are_kept(spark):
    rows = spark.range(5000).select("id", F.lit("one").alias("part"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    manifest = merkle.build(rows, "part", ["id"])
    assert [spark.read.parquet(p).count() for p in manifest.trees] == [5000, 20, 1]
    proofs = manifest.proofs(spark, ["id"])
    good = merkle.verified(proofs, "digest", ["id"], manifest.root)
    assert good.where("verified").count() == 5000
    swapped = proofs.withColumn("digest", F.unhex(F.reverse(F.hex("digest"))))
    assert merkle.verified(swapped, "digest", ["id"], manifest.root).where("verified").count() == 0


def test_order_does_not_matter(spark):
    rows = documents(6)
    one = merkle.tamper_check(frame(spark, rows)).first()["root"]
    random.Random(1).shuffle(rows)
    assert merkle.tamper_check(frame(spark, rows).repartition(7)).first()["root"] == one


def test_a_very_long_text(spark):
    rows = [(1, "ä" * 20_000_000, "x", None, 20_000_000), (2, "b", "x", None, 1)]
    assert sorted(map(tuple, merkle.tamper_check(frame(spark, rows)).collect())) == brute(rows)
