"""Operator 7. Removing repeated runs of lines, with DataFrame functions only.

Lines become ids and the documents sequences of ids. Suffixes are ranked by their first 1, 2, 4 ... lines by
prefix doubling: the rank of twice as many lines is the order of the pair (rank here, rank that many lines
further). Ranks are positions in the suffix array, so suffixes of one rank are an interval whose longest
common prefix is at least that many lines; intervals of one suffix are dropped, for nothing there repeats.

A run counts if it holds at least ``least_words`` words. A maximal repeated run is the union of its shortest
windows of that many words, those that start and those that end at some line, so windows are what is looked
up: a window of m lines is known by its ranks at depth 2^k <= m at its start and 2^k before its end. No window
is longer than ``least_words`` lines, so the number of rounds is bounded. All windows of an interval but the
first in document order are later copies, and their lines go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.functions.barrier import computed_once
from flowrisk.llm.common import WORD_SQL
from flowrisk.session import stage

LEAST_WORDS = 50


#: What names a document; none of it is null, so that joins and windows share their exchanges.
DOC = ["known", "id", "digest"]


def named(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(known, id, digest, row): rows that agree in the first three are copies of one row; row holds all columns.

    known is 0 and id stands for nothing where the key is null; a key that is no number is taken as text.
    """
    kind = docs.schema[key].dataType
    number = isinstance(kind, T.NumericType)
    own = F.coalesce(F.col(key), F.lit(0).cast(kind)) if number else F.coalesce(F.col(key).cast("string"), F.lit(""))
    return docs.select(F.col(key).isNotNull().cast("int").alias("known"), own.alias("id"),
                       F.xxhash64(text).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def text_of(text: str):
    """The text inside a row, null as empty: rows are shuffled with one copy of it."""
    return F.coalesce(F.col("row")[text], F.lit(""))


def lines(rows: DataFrame, least_words: int, text: str) -> DataFrame:
    """(id, digest, p, h1, h2, forward, backward) of every line with a word, counted by p from 0.

    forward and backward are the lines of the shortest window of ``least_words`` words that starts or ends there;
    0 if the document has too few.
    """
    each = (rows.select(*DOC, F.posexplode(F.split(text_of(text), "\n")).alias("line", "s"))
            .select(*DOC, "line", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(7), F.col("s")).alias("h2"),
                    F.regexp_count("s", F.lit(WORD_SQL)).alias("w"))
            .where("w > 0"))
    # One exchange on the document serves the removal of copied rows and the windows; a document is one row.
    each = each.repartition(*DOC).dropDuplicates([*DOC, "line"])
    doc = Window.partitionBy(*DOC)
    order = doc.orderBy("line")
    each = (each.withColumn("p", F.row_number().over(order) - 1).withColumn("upto", F.sum("w").over(order))
            .withColumn("total", F.sum("w").over(doc)).withColumn("from", F.col("upto") - F.col("w")))
    ahead = F.count(F.lit(1)).over(doc.orderBy("from").rangeBetween(1, least_words - 1)) + 1
    behind = F.count(F.lit(1)).over(doc.orderBy("upto").rangeBetween(1 - least_words, -1)) + 1
    return each.select(*DOC, "p", "h1", "h2",
                       F.when(F.col("total") - F.col("from") >= least_words, ahead).otherwise(0).cast("int").alias("forward"),
                       F.when(F.col("upto") >= least_words, behind).otherwise(0).cast("int").alias("backward"))


def in_order(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, rank): the position in the suffix array at which the suffixes of each pair (a, b, n) begin.

    A global running sum over range partitions: sums inside a partition, plus the totals of those before it,
    one row each. A pair is one row however often it occurs.
    """
    dealt = pairs.repartitionByRange(a, b).withColumn("part", F.spark_partition_id())
    dealt = stage(dealt, "ranks")
    inside = Window.partitionBy("part").orderBy(a, b).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (dealt.groupBy("part").agg(F.sum("n").alias("m"))
              .select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset")))
    return (dealt.withColumn("rank", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, "part")
            .select(a, b, (F.col("rank") + F.col("offset")).alias("rank")))


def ranked_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose pair (a, b) occurs twice or more, with its rank in place of the pair."""
    repeated = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(in_order(repeated, a, b), [a, b]).drop(a, b)


def doubled(level: DataFrame, step: int) -> DataFrame:
    """From (id, digest, p, rank) at depth ``step`` to the same at twice the depth."""
    further = level.select(*DOC, (F.col("p") - step).alias("p"), F.col("rank").alias("next"))
    return ranked_pairs(joined(level.withColumnRenamed("rank", "near"), further), "near", "next")


def joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on the place of a line."""
    return left.join(right, [*DOC, "p"])


def later_copies(rows: DataFrame) -> DataFrame:
    """(id, digest, p, m): windows of m lines from line p that begin with an equal window earlier in document order."""
    level = stage(ranked_pairs(rows, "h1", "h2"), "level")
    windows = (level.where("forward > 0").select(*DOC, "p", F.col("forward").alias("m"))
               .union(level.where("backward > 0").select(*DOC, (F.col("p") - F.col("backward") + 1).alias("p"),
                                                         F.col("backward").alias("m"))))
    windows = stage(windows.distinct(), "windows")
    longest = windows.agg(F.max("m")).first()[0] or 0
    level, depth = level.select(*DOC, "p", "rank"), 1
    found = windows.where("false")
    while depth <= longest:
        mine = windows.where((F.col("m") >= depth) & (F.col("m") < 2 * depth))
        starts = joined(mine, level).withColumn("start", F.col("p"))
        longer = starts.where(F.col("m") > depth).withColumn("p", F.col("p") + F.col("m") - depth)
        both = (starts.where(F.col("m") == depth).withColumn("last", F.col("rank"))
                .unionByName(joined(longer, level.withColumnRenamed("rank", "last")))
                .select("m", "rank", "last", F.struct(*DOC, F.col("start").alias("p")).alias("place")))
        both = stage(both, "both")
        first = (both.groupBy("m", "rank", "last").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
                 .where("n > 1").drop("n"))
        found = found.union(both.join(first, ["m", "rank", "last"]).where(~F.col("place").eqNullSafe(F.col("first")))
                            .select("place.known", "place.id", "place.digest", "place.p", "m"))
        depth *= 2
        if depth <= longest:
            level = stage(doubled(level, depth // 2), "level")
    return found


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row, kept, n_lines, n_removed): each row as a struct, the text that is left, lines with a word, and those gone.

    Document order is the key's, nulls first, then a digest of the text. Rows that repeat key and text count as
    documents one after the other. Lines end at ``\\n``; lines without a word take no part and stay, unless no
    other line of their document does. A null text counts as empty. An empty table gives no rows. Extra columns
    stay in ``row``, whatever their names.
    """
    rows = named(docs, text, key)
    copies = later_copies(stage(lines(rows, least_words, text), "lines"))
    gone = (copies.select(*DOC, F.explode(F.sequence("p", F.col("p") + F.col("m") - 1)).alias("p"))
            .groupBy(*DOC).agg(F.collect_set("p").alias("gone")))
    copy = F.row_number().over(Window.partitionBy(*DOC).orderBy(F.lit(0)))
    out = (rows.withColumn("copy", copy)
           .join(gone, DOC, "left")
           .select("row", text_of(text).alias("t"), "copy", "gone", F.split(text_of(text), "\n").alias("line"),
                   F.regexp_count(text_of(text), F.lit(WORD_SQL)).alias("words")))
    # The barriers keep the split lines from being computed again for every element below.
    out = computed_once(out)
    worded = F.filter(F.sequence(F.lit(0), F.size("line") - 1), lambda i: F.col("line")[i].rlike(WORD_SQL))
    out = computed_once(out.withColumn("worded", worded))
    whole = (F.col("copy") > 1) & (F.col("words") >= least_words)
    left = F.array_except(F.sequence(F.lit(0), F.size("line") - 1), F.transform("gone", lambda p: F.col("worded")[p]))
    n_removed = F.when(whole, F.size("worded")).otherwise(F.coalesce(F.array_size("gone"), F.lit(0)))
    kept = (F.when(n_removed == 0, F.col("t")).when(n_removed == F.size("worded"), F.lit(""))
            .otherwise(F.array_join(F.transform(left, lambda i: F.col("line")[i]), "\n")))
    return out.select("row", kept.alias("kept"), F.size("worded").cast("long").alias("n_lines"),
                      n_removed.cast("long").alias("n_removed"))


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, text: str = "text", key: str = "doc_id",
                    n_chars: str = "n_chars") -> DataFrame:
    """The rows with the text that is left and its length in ``n_chars``, if there is one; rows of which nothing is left go."""
    rows = dedup_lines(docs, least_words, text, key).where("n_removed = 0 or n_removed < n_lines")
    row = F.col("row").withField(text, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row")[text]))
    if n_chars in docs.columns:
        row = row.withField(n_chars, F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema[n_chars].dataType))
                            .otherwise(F.col("row")[n_chars]))
    return rows.select(row.alias("row")).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM d),
v AS (SELECT *, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS w FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS p, sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS upto
      FROM v WHERE w > 0),
pairs AS (SELECT a.doc_id, a.p AS s, b.p AS e FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 49
          WHERE b.upto - a.upto + a.w >= 50),
win AS (SELECT doc_id, s, min(e) AS e FROM pairs GROUP BY doc_id, s
        UNION SELECT doc_id, max(s) AS s, e FROM pairs GROUP BY doc_id, e),
body AS (SELECT win.doc_id, win.s, win.e, string_agg(o.s, chr(10) ORDER BY o.p) AS body
         FROM win JOIN o ON o.doc_id = win.doc_id AND o.p BETWEEN win.s AND win.e GROUP BY win.doc_id, win.s, win.e),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS k FROM body) WHERE k > 1),
gone AS (SELECT DISTINCT o.doc_id, o.line FROM o JOIN later ON o.doc_id = later.doc_id AND o.p BETWEEN later.s AND later.e),
m AS (SELECT v.*, gone.line IS NOT NULL AS gone FROM v LEFT JOIN gone ON v.doc_id = gone.doc_id AND v.line = gone.line),
t AS (SELECT doc_id, count(*) FILTER (WHERE w > 0) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS left_text FROM m GROUP BY doc_id),
k AS (SELECT doc_id, n_lines, n_removed, CASE WHEN n_removed > 0 AND n_removed = n_lines THEN '' ELSE left_text END AS kept FROM t)
SELECT doc_id, n_lines, n_removed, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM k
"""
