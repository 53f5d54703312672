import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from flowrisk.llm import packing, token_counts
from flowrisk.llm.tokens import LONG_WORD, Encoder, encoder, tokenizer_path
from flowrisk.session import shared_path
from tests.llm.helpers import awkward, frame

PATH = tokenizer_path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "a", "b", "é", "'s", "'ll", "1", "!", "<|endoftext|>", " ", "　", "x y", " \n", "\x1c",
         "the", "ing", "日本", "😀", "²", "\x85", " "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_fast_encoder_equals_the_library(library):
    rng, own = random.Random(1), Encoder(PATH)
    assert own.fast is not None
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 15))) for _ in range(3000)]
    texts += ["".join(rng.choices("etaoinshrdlu ", k=rng.randint(0, 80))) for _ in range(3000)]
    texts += ["ab" * LONG_WORD, " " * (LONG_WORD + 5) + "a", "a" * LONG_WORD]
    for text in texts:
        assert own.ids(text) == expected(library, text), repr(text[:60])


def test_other_kinds_of_files(library):
    pieces = Encoder(tokenizer_path("piece_bpe_32k.model"))
    assert pieces.fast is None and len(pieces.ids("Hello there")) > 0 and pieces.ids("") == []
    lower = Encoder(tokenizer_path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert lower.fast is None and lower.ids("Hello there") == whole.encode("Hello there", add_special_tokens=False).ids


def test_token_counts_and_cache(spark, library):
    rows = awkward()
    docs = frame(spark, [(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, digest int")
    cache = shared_path(spark, "cache")
    got = token_counts.token_counts(docs, cache, PATH).collect()
    want = [(i, len((t or "").encode()), len(expected(library, t)), len(expected(library, t)) > 512) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t, *_ in rows})
    more = frame(spark, [(100, "quite new", None, None, 0), (101, rows[0][1], None, None, 0)])
    token_counts.token_counts(more, cache, PATH).collect()
    assert spark.read.parquet(cache).count() == stored + 1  # only the miss was encoded
    other = tokenizer_path("word_bpe_49k.json")
    assert token_counts.token_counts(more, cache, other).count() == 2
    assert spark.read.parquet(cache).count() == stored + 3  # counts belong to a tokenizer
    assert token_counts.token_counts(docs.limit(0), shared_path(spark, "cache"), PATH).count() == 0


def test_packing(spark, library):
    rows = [(*r, 7, 8) for r in awkward()] + [(900 + i, "tok " * (5 * i), None, None, 0, 7, 8) for i in range(40)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, length int, bin int")
    got = packing.pack(docs, PATH, window=256, bin_size=8).collect()
    assert sorted(map(tuple, packing.pack(docs, PATH, window=256, bin_size=8).collect()), key=str) == sorted(map(tuple, got), key=str)
    pieces = sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=str)
    want = []
    for i, t, *_ in rows:
        ids = [*expected(library, t), 1]
        want += [(i, s, min(256, len(ids) - s), zlib.crc32(np.array(ids[s:s + 256], "<u4").tobytes()), len(ids))
                 for s in range(0, len(ids), 256)]
    assert pieces == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r.length for r in got) / (256 * len(sequences)) > 0.9
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_non_negative_least_squares():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, x = rng.random((6, 15)), np.maximum(rng.standard_normal(15), 0)
        found = packing.nnls(a, a @ x)
        assert found.min() >= 0 and np.abs(a @ found - a @ x).max() < 1e-6
    assert packing.nnls(np.eye(2), np.array([1.0, -1.0])).tolist() == [1.0, 0.0]


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for histogram in (rng.integers(0, 50, 33), np.eye(33, dtype=int)[20] * 1000, np.zeros(33, int), np.eye(33, dtype=int)[1] * 7):
        histogram[0] = 0
        left = histogram.copy()
        for parts, times in packing.plan(histogram):
            assert parts.sum() <= 32
            left -= np.bincount(parts, minlength=33) * times
        assert not left.any()


def test_worker_keeps_its_encoder():
    assert encoder(PATH) is encoder(PATH)
