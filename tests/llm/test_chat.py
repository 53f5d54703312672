import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from flowrisk.llm import chat
from flowrisk.llm.queries import QUERIES

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"


def test_fold(spark):
    log = [(1, 0, 1, "start", "user", "Hel"), (1, 1, 1, "delta", None, "lo"), (1, 2, 2, "start", "assistant", None),
           (1, 3, 2, "delta", None, "wrong"), (1, 4, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "er"),
           (1, 5, 2, "delta", None, "bett"), (1, 7, 1, "edit", None, "Hello!"), (1, 8, 3, "start", "user", "gone"),
           (1, 9, 3, "delete", None, None), (2, 0, 1, "delta", "user", "no start"), (None, 0, 1, "start", None, None)]
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(spark.createDataFrame(log, EVENTS)).collect()}
    assert got == {(1, 1): ("user", "Hello!"), (1, 2): ("assistant", "better"), (2, 1): ("user", "no start"), (None, 1): (None, "")}


NASTY = ["<|end|>", "<|turn|>assistant<|text|>x<|end|>", "\\", "\\\\<|", "<\\|", "<|", "\n", "", None, "ünï😀", "</s>[INST] ok [/INST]",
         "a<", "|>", "\\|<|text|>"]


def test_round_trip(spark):
    rng = random.Random(0)
    rows = [(c, t, rng.choice(["user", "assistant", "<|end|>", None, "sys\ntem\\"]), rng.choice(NASTY) if rng.random() < .8 else
             "".join(x or "" for x in rng.choices(NASTY, k=5)), 9) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(50, 1, "user", "same", 9), (50, 1, "user", "same", 9), (50, None, "assistant", "first", 9), (None, 1, "assistant", "x", 9)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_chats(table)
    got = {r.conv_id: r for r in chat.digest(out).collect()}
    texts = {r.conv_id: (r.formatted, r.loss) for r in out.collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    low = lambda x: (x is not None, x or "")
    for conv, turns in by.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, low(r[2]), r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        formatted, spans = texts[conv]
        masked = "".join(formatted[s.start:s.start + s.length] for s in spans)
        assert masked.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") == loss
        assert tuple(got[conv])[1:] == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                                        hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
        assert formatted.count("<|end|>") == len(turns)
    assert chat.digest(chat.format_chats(table.limit(0))).count() == 0


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    cursor = db.execute(chat.ORACLE)
    names = [c[0] for c in cursor.description]
    got = QUERIES["op9_chat_formatting"](spark, folder)
    assert sorted(cursor.fetchall()) == sorted(map(tuple, got.select(names).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert got.where(F.col("conv_id") == -7).first().loss_chars == 21
