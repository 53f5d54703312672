import hashlib
import random
import re

import pytest

from flowrisk.llm import decontaminate
from tests.llm.helpers import DOCS, awkward, frame, words

ITEMS = "item_id long, text string, doc_id string"


def split(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute(docs, items, n):
    windows = {}
    for item, text, _ in items:
        w = split(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = []
    for doc, text, *_ in docs:
        w, hit, found = split(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                owners = windows.get(tuple(w[i:i + size]))
                if owners is not None:
                    hit |= set(range(i, i + size))
                    found |= owners - {None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(5)
    shared = words(rng, 40)
    items = [(i, " ".join(words(rng, 30)), "") for i in range(20)]
    items += [(20, " ".join(shared), ""), (21, " ".join(shared[5:]), ""), (21, " ".join(shared[5:]), ""), (100, " ".join(shared), ""),
              (22, None, ""), (23, "", ""), (24, " .;! ", ""), (25, "only Four wörds here", ""), (26, "rare-single!", ""), (27, "zz", ""),
              (None, " ".join(words(rng, 12)), None)]
    docs = awkward(3)
    texts = [" ".join(words(rng, 9)) + " " + items[0][1].upper().replace(" ", ", ") + "; the end", " ".join(shared[:10]),
             " ".join(shared[:9]), "x " + " ".join(shared) + " y " + " ".join(shared[3:20]), items[-1][1], "Only four WÖRDS here",
             "only four wörds here zz", "rare Single zz", " ".join(shared[:6] + shared[7:]), " ".join(shared[:10] * 3)]
    return docs + [(1000 + i, t, "aa", "s", 1) for i, t in enumerate(texts)], items


@pytest.mark.parametrize("window, part, segment", [(10, 1 << 20, 1 << 20), (3, 300, 50), (1, 200, 7)])
def test_against_brute_force(spark, monkeypatch, window, part, segment):
    docs, items = cases()
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    got = decontaminate.report(frame(spark, docs), frame(spark, items, ITEMS), window=window, part=part).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items, window)


def test_pieces_and_segments_do_not_matter(monkeypatch):
    docs, items = cases()
    part = [(str(i), b" ".join(w.encode() for w in split(t))) for i, t, _ in items if split(t)]
    whole = decontaminate.Index(part, 10)
    expected = [whole.scan(decontaminate.normal((t or "").encode()), 10) for _, t, *_ in docs]
    monkeypatch.setattr(decontaminate, "SEGMENT", 60)
    for (_, t, *_), (n, runs, found) in zip(docs, expected):
        count, other, same = whole.scan(decontaminate.normal((t or "").encode()), 10)
        assert (n, found) == (count, same)
        assert decontaminate.union(runs).tolist() == decontaminate.union(other).tolist()


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "window_hashes", lambda h, size: h[:max(0, len(h) - size + 1)] & decontaminate.np.uint64(1))
    index = decontaminate.Index([("1", b"a b c"), ("2", b"d e f"), ("3", b"d e f g")], 3)
    n, runs, found = index.scan(b"x d e f y", 3)
    assert (n, runs.tolist(), found) == (5, [[1, 4]], {"2", "3"})


def test_a_long_item_is_cut_into_pieces(spark):
    rng = random.Random(9)
    long = words(rng, 9000, 10**6)
    docs = [(i, " ".join(long[at:at + 15]), None, None, 0) for i, at in enumerate([0, 4080, 4090, 4096, 8190, 8985])] + [(9, " ".join(long), "", "", 0)]
    items = [(7, " ".join(long), "")]
    got = decontaminate.report(frame(spark, docs), frame(spark, items, ITEMS), part=10_000).collect()
    assert sorted(map(tuple, got)) == brute(docs, items, 10)


def test_spans_and_documents_go(spark):
    docs, items = cases()
    clean = decontaminate.decontaminate(frame(spark, docs), frame(spark, items, ITEMS))
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    before = {d[0]: d[1] for d in docs}
    assert clean.count() == len(docs)
    assert texts[1000] == " ".join(before[1000].split(" ")[:9]) + " ; the end"
    assert texts[1001] == "" and texts[1002] == before[1002] and texts[1003] == "x  y "
    assert texts[1007] == ""  # two runs side by side
    hit = {r[0] for r in brute(docs, items, 10) if r[5]}
    assert {d: t for d, t in texts.items() if d not in hit and d != 5} == {d: t for d, t in before.items() if d not in hit and d != 5}
    left = decontaminate.decontaminate(frame(spark, docs), frame(spark, items, ITEMS), "documents")
    expected = [tuple(d) for d, r in zip(docs, map(lambda d: brute([d], items, 10)[0], docs)) if not r[5]]
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(expected, key=repr)


def test_empty_tables(spark):
    docs, items = cases()
    assert decontaminate.report(frame(spark, []), frame(spark, items, ITEMS)).count() == 0
    got = decontaminate.report(frame(spark, docs), frame(spark, [], ITEMS)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, [], 10)


def test_a_very_long_text(spark):
    text = "word " * 3_000_000 + "only four wörds here " + "x" * 9_000_000
    got = decontaminate.report(frame(spark, [(1, text, None, None, 0)]), frame(spark, [(25, "only four wörds here", "")], ITEMS)).first()
    assert tuple(got)[:4] == (1, 3_000_005, 4, 1)
