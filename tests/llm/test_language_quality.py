import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowrisk.llm import language, quality
from tests.llm.helpers import WORD, awkward, frame

DATA = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == set(held) and len(got) == len(truth)
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_depends_on_text_alone(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    langs, filters = language.learn(docs)
    assert langs == ["de", "en", "es", "fr"]
    some = docs.limit(50)
    changed = some.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")).withColumn("doc_id", -F.col("doc_id"))
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(some, langs, filters).collect()}
    b = {-r.doc_id: (r.lang_pred, r.score) for r in language.predict(changed, langs, filters).collect()}
    assert a == b


def exact_grams(text):
    kept = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    kept = re.sub(" +", " ", kept)
    return [kept[i:i + 3] for i in range(len(kept) - 2)]


def test_filter_and_popcounts_against_exact_sets(spark):
    """Exact sets of trigrams: none is missing from the filter, few are added, scores follow the exact shares."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if r.text is not None]
    counts = {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts.setdefault(r.lang, Counter()).update(exact_grams(r.text))
    share = {n: {g: c / sum(found.values()) for g, c in found.items()} for n, found in counts.items()}
    best = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    # a little inside the bounds, as ids of 20 bits may add a rare gram to another
    sure = {n: {g for g, v in s.items() if v >= 1.05 * language.RIVAL * best[g] and v >= 1.05 * language.LEAST
                and counts[n][g] > 1} for n, s in share.items()}
    exact = {n: {g for g, v in s.items() if v >= language.RIVAL * best[g] and v >= language.LEAST
                 and counts[n][g] > 1} for n, s in share.items()}
    langs, filters = language.learn(docs)
    assert langs == sorted(exact)
    grams = sorted(best)
    ids = np.array([int(language.char_grams(language.code_points(g), 3)[0] >> np.uint64(64 - language.ID_BITS)) for g in grams])
    first, *more = [filters[0][at] for at in language.slots(ids)]
    for word in more:
        first = first & word
    for i, n in enumerate(langs):
        holds = {g for g, bits in zip(grams, first) if int(bits) >> i & 1}
        assert len(sure[n] - holds) <= 0.01 * len(sure[n])  # only where ids of two grams meet
        assert len(holds - exact[n]) <= 0.03 * len(grams)
    got = {r.doc_id: r for r in language.predict(docs, langs, filters).collect()}
    for r in rows:
        own = exact_grams(r.text)
        if len(own) >= 200:
            shares = {n: sum(g in exact[n] for g in own) / len(own) for n in langs}
            assert abs(got[r.doc_id].score - max(shares.values())) < 0.03
            assert shares[got[r.doc_id].lang_pred] > max(shares.values()) - 0.03


def test_language_of_awkward_rows(spark):
    rows = [(*r, "held") for r in awkward()]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, held_out string")
    got = language.identify(docs).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"aa", "bb", "und"}
    texts = Counter((r[0], any(map(str.isalpha, r[1] or ""))) for r in rows)
    assert Counter((r.doc_id, r.lang_pred != "und") for r in got) == texts
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language.identify(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(5)
    rows = []
    for i in range(70):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzäöüßñéèçøåæ", 6)
        rows += [(i * 10 + k, " ".join("".join(rng.choices(letters, k=5)) for _ in range(60)), f"l{i:02}") for k in range(6)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    truth = {r[0]: r[2] for r in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.9


def brute_base(text):
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered))


def test_base_rules_by_brute_force():
    rng = random.Random(4)
    texts = [r[1] or "" for r in awkward()] + [" ".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(200)]
    for text in texts:
        want = brute_base(text)
        assert quality.base_counts(text) == want
        assert quality.base_failed(want) == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_quality_on_rows_the_model_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    unseen = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels.where(~unseen)).collect()}
    test = labels.where(unseen).collect()
    judged = [(got[r.doc_id].kept, r.quality == 1) for r in test if not got[r.doc_id].base_failed]
    assert sum(a == b for a, b in judged) / len(judged) > 0.95
    assert sum(k for k, good in judged if good) / sum(good for _, good in judged) > 0.98


def test_quality_of_awkward_rows(spark):
    rng = random.Random(9)
    rows = [(*r, 3.5) for r in awkward()]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(1, 0, 0), (None, 1, 0), (7, None, 0), (999, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs, labels).collect()
    want = sorted([(i, *brute_base(t or "")) for i, t, *_ in rows], key=str)
    assert sorted([tuple(r)[:6] for r in got], key=str) == want
    assert all(not r.kept for r in got if r.base_failed)
    none = quality.quality_rules(docs, labels.limit(0)).collect()  # no model: the base rules decide
    assert all(r.score is None and r.kept != r.base_failed for r in none)
    passed = quality.passing(docs, labels.limit(0))
    assert passed.columns == docs.columns
    assert passed.count() == sum(r.kept for r in none) and {r.score for r in passed.collect()} == {3.5}
    assert quality.quality_rules(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("margins", [[-3, -2, -1, 1, 2, 3], [-3, -1, 1, 2, -2, 3]])
def test_calibration(margins):
    import numpy as np

    z, y = np.array(margins, float), np.array([0, 0, 0, 1, 1, 1])
    a, b = quality.platt(z, y)
    p = 1 / (1 + np.exp(-(a * z + b)))
    assert a > 0 and abs(p.mean() - 0.5) < 0.05


def test_training_task_gets_bounded_rows_of_a_repeated_id(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["one", "two", "three", "four"], k=30)) + f" {i}" for i in range(300)]
    docs = spark.createDataFrame([(i if i < 20 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    seen, plain = [], type(docs).repartition

    def repartition(self, *args):
        seen.append(self.count())
        return plain(self, *args)

    monkeypatch.setattr(type(docs), "repartition", repartition)
    quality.train(docs, labels, sample=10)
    assert seen == [20]
