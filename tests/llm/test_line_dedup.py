import random

import duckdb
import pytest
from pyspark.sql import functions as F

from flowrisk.llm import line_dedup
from tests.llm.helpers import WORD, awkward, frame, prose


def brute(rows, least):
    """Removes every maximal run of lines of ``least`` words or more that occurs earlier; rows in document order."""
    docs = [[(line, len(WORD.findall(line))) for line in (t or "").split("\n")] for t in rows]
    worded = [[i for i, (_, w) in enumerate(d) if w] for d in docs]
    places = {}
    for a, (d, idx) in enumerate(zip(docs, worded)):
        for s, i in enumerate(idx):
            places.setdefault(d[i][0], []).append((a, s))
    gone = [set() for _ in docs]
    for line, spots in places.items():
        for n, (a, s) in enumerate(spots):
            for b, t in spots[:n]:
                m = 0
                while s + m < len(worded[a]) and t + m < len(worded[b]) and docs[a][worded[a][s + m]][0] == docs[b][worded[b][t + m]][0]:
                    m += 1
                if sum(docs[a][worded[a][s + k]][1] for k in range(m)) >= least:
                    gone[a].update(worded[a][s:s + m])
    out = []
    for d, idx, g in zip(docs, worded, gone):
        kept = "" if g and len(g) == len(idx) else "\n".join(line for i, (line, _) in enumerate(d) if i not in g)
        out.append((kept, len(idx), len(g)))
    return out


@pytest.mark.parametrize("least", [50, 12, 1])
def test_against_brute_force(spark, least):
    rng = random.Random(least)
    pool = [prose(rng, rng.randint(1, 25)).replace("\n", " ") for _ in range(40)]
    texts = ["\n".join(rng.choice(["", " "]) if rng.random() < 0.1 else rng.choice(pool) for _ in range(rng.randint(0, 30)))
             for _ in range(60)]
    texts += ["\n".join([pool[0]] * 70), "\n".join(pool[:2] * 20), "\n".join(pool), "\n".join(pool), None, "", "\n\n"]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, id long, p string")
    got = {r.row.doc_id: (r.kept, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs, least).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, least)


def test_awkward_rows(spark):
    rows = awkward()
    docs = frame(spark, rows).withColumn("digest", F.lit("d"))
    got = line_dedup.dedup_lines(docs, 20).collect()
    assert len(got) == len(rows)
    order = sorted(range(len(got)), key=lambda i: (got[i].row.doc_id is not None, got[i].row.doc_id or 0))
    ids = [got[i].row.doc_id for i in order]
    assert ids.count(5) == 3 and ids.count(None) == 2
    total = lambda texts: sum(len(WORD.findall(t or "")) for t in texts)
    assert total(r.kept for r in got) < total(r[1] for r in rows)
    same = [r for r in got if r.row.doc_id == 5 and r.row.text == rows[5][1]]
    assert sorted(r.kept == "" for r in same) == [False, True]  # a repeated row is a later copy
    out = line_dedup.without_repeats(docs, 20)
    assert out.columns == docs.columns
    assert all(r.n_chars in (len(r.text or ""), None) for r in out.collect() if r.text not in [x[1] for x in rows])
    assert out.count() == sum(r.n_removed == 0 or r.n_removed < r.n_lines for r in got)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    from flowrisk.llm.queries import QUERIES

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    cursor = db.execute(line_dedup.ORACLE)
    names = [c[0] for c in cursor.description]
    assert sorted(cursor.fetchall()) == sorted(map(tuple, QUERIES["op7_line_dedup"](spark, folder).select(names).collect()))
