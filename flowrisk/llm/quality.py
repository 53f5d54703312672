"""Operator 5. Quality rules: fixed base rules, then a hashed n-gram logistic regression.

The model sees the mean weight of a text's hashed words and hashed character n-grams. It is trained on a
bounded sample of labelled rows in one task, calibrated on a quarter of that sample that training does not
see, and scored over every text in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.llm.common import WORD, plain_text
from flowrisk.llm.grams import _ODD, char_grams, code_points, mixed, word_hashes

#: Hashed features of each kind, how many labelled rows of each class a model is fitted to, and how many
#: different features these rows may have in all (320 MB); rows beyond that are left out of the sample.
BITS, SAMPLE, ENTRIES = 16, 2048, 1 << 24
GRAM = 4
THRESHOLD = 0.5
SYMBOLS = re.compile(r"[#*$%&|<>]")
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[str], window: int = 8) -> int:
    """How many words lie in a window of ``window`` words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = mixed(np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64))
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys += h[k:k + n] * _ODD[k]
    _, inverse, counts = np.unique(mixed(keys), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), dup, repeat_words(words)


def base_failed(counts: tuple) -> bool:
    return counts[0] < 20 or 100 * counts[4] > 30 * counts[0]


def feature_ids(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and hashed character n-grams, repeats included, in two ranges of ids."""
    points = code_points(text)
    shift = np.uint64(64 - BITS)
    return ((word_hashes(points) >> shift).astype(np.int64),
            (char_grams(points, GRAM) >> shift).astype(np.int64) + (1 << BITS))


def margin(weights: np.ndarray, text: str) -> float:
    return float(sum(weights[ids].mean() if len(ids) else 0.0 for ids in feature_ids(text))) + float(weights[-1])


def fit(texts: list[str], quality: np.ndarray, steps: int = 120, rate: float = 0.3, decay: float = 1e-5) -> np.ndarray:
    """Weights, bias, and the slope and offset of the calibration, in one array.

    Rows whose place is divisible by four calibrate; the others train, by full-batch Adam.
    """
    size = 2 << BITS
    held = np.arange(len(texts)) % 4 == 0
    ids, share, row = [], [], []
    chosen, entries = np.flatnonzero(~held), 0
    for i, at in enumerate(chosen):
        if entries > ENTRIES:
            chosen = chosen[:i]
            break
        for part in feature_ids(texts[at]):
            if len(part):
                unique, count = np.unique(part, return_counts=True)
                entries += len(unique)
                ids.append(unique), share.append((count / len(part)).astype(np.float32))
                row.append(np.full(len(unique), i))
    ids, share, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, share, row))
    y, w = quality[chosen].astype(float), np.zeros(size + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(row, share * w[ids], len(y)) + w[-1]
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        slope = np.append(np.bincount(ids, share * error[row], size), error.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    z = np.array([margin(w, texts[i]) for i in np.flatnonzero(held)])
    a, b = platt(z, quality[held])
    return np.concatenate((w, [a, b]))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability that fits held-out margins, by Newton steps on smoothed targets."""
    good, bad = int((y == 1).sum()), int((y == 0).sum())
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, ab = np.stack((z / max(1e-9, np.abs(z).max()), np.ones_like(z))), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -30, 30)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        ab -= np.linalg.solve(hessian, x @ (p - target))
    return float(ab[0] / max(1e-9, np.abs(z).max())), float(ab[1])


def probability(model: np.ndarray, text: str) -> float:
    z = model[-2] * margin(model[:-2], text) + model[-1]
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text",
          key: str = "doc_id") -> np.ndarray | None:
    """The model; None if a class has no labelled text. A document labelled both ways counts as bad.

    The sample are the rows of the ``sample`` keys of each class that hash lowest. Where rows repeat keys, the
    2 * sample rows with the lowest hashes of key and text stay, which bounds the broadcast and the one training task.
    """
    marked = (labels.where(F.col(key).isNotNull() & F.col("quality").isin(0, 1))
              .groupBy(F.col(key).alias("_key")).agg(F.min("quality").cast("int").alias("quality")))
    order = [F.xxhash64("_key"), F.col("_key")]
    chosen = (marked.where("quality = 0").orderBy(*order).limit(sample)
              .union(marked.where("quality = 1").orderBy(*order).limit(sample)))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(chosen), "_key").select(F.xxhash64("_key", "text").alias("place"), "text", "quality")
    rows = rows.orderBy("place", F.xxhash64("text")).limit(2 * sample)  # rows that repeat a key

    def fitted(batches):
        rows = sorted(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        quality = np.array([r[2] for r in rows])
        if len(set(quality)) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([fit([r[1] for r in rows], quality).tobytes()], pa.binary())],
                                             ["model"])

    found = rows.repartition(1).mapInArrow(fitted, "model binary").collect()  # one row, 1 MB
    return np.frombuffer(found[0][0]) if found else None


def judged(docs: DataFrame, labels: DataFrame, threshold: float, text: str, keep: tuple, sample: int,
           key: str) -> tuple[DataFrame, list[str]]:
    """The ``keep`` columns under names of their own, which come second, and the verdicts."""
    model = train(docs, labels, sample, text, key)
    names = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], plain_text(text).alias("_text"))

    def score(batches):
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            counts = [base_counts(t) for t in texts]
            failed = [base_failed(c) for c in counts]
            scores = [None if model is None else probability(model, t) for t in texts]
            kept = [not f and (s is None or s >= threshold) for f, s in zip(failed, scores)]
            numbers = list(zip(*counts)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], *[pa.array(c, pa.int64()) for c in numbers],
                 pa.array(failed, pa.bool_()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())],
                [*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                 "score", "kept"])

    verdict = T._parse_datatype_string(f"{BASE}, base_failed boolean, score double, kept boolean")
    return rows.mapInArrow(score, T.StructType(rows.schema.fields[:-1] + verdict.fields)), names


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text",
                  keep: tuple = ("doc_id",), sample: int = SAMPLE, key: str = "doc_id") -> DataFrame:
    """``keep`` columns, the base counts, base_failed, score and kept of every row.

    Null text has no words, so it fails the base rules; so does an empty text. Without labelled rows of
    both classes the base rules alone decide and the score is null. Repeated rows are judged alike; an empty
    table gives no rows. Columns outside ``keep`` are ignored, whatever their names.
    """
    rows, names = judged(docs, labels, threshold, text, keep, sample, key)
    return rows.withColumnsRenamed(dict(zip(names, keep)))


def passing(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text",
            sample: int = SAMPLE, key: str = "doc_id") -> DataFrame:
    """The rows that pass, with all their columns."""
    rows, names = judged(docs, labels, threshold, text, tuple(docs.columns), sample, key)
    return rows.where("kept").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
