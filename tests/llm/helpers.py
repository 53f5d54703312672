"""Fixtures of awkward rows that every operator must take."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice(["", "n", "r", "st"]) + str(rng.randrange(size))
            for _ in range(n)]


def prose(rng, n):
    """n words in lines of 5 to 20."""
    left, out = words(rng, n), []
    while left:
        k = rng.randint(5, 20)
        out.append(" ".join(left[:k]))
        left = left[k:]
    return "\n".join(out)


def awkward(seed=0, n=30):
    """Rows (doc_id, text, lang, source, n_chars): nulls, empty, blank, long, copied, near copies, repeated ids."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(n)]
    near = base[0].split(" ")
    near[len(near) // 2] = "changed"
    texts = [*base, base[1], base[1], " ".join(near), None, "", "  \n\t\n", "one", "Zwei Wörter", "a\n\na\n\na",
             "x " * 20_000, base[2] + "\n" + base[3], "<|endoftext|> mid <|endoftext|>", "日本 語\x00\x0b é",
             base[4] + "\n" + prose(rng, 30) + "\n" + base[4]]
    rows = [(i, t, rng.choice(["aa", "bb", None]), rng.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], (5, "another text under a used id", "aa", "s1", 3), (None, base[6], None, None, None),
                   (None, None, None, None, None)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)
