"""Lines that several documents share stay only where they are first.

A text is split at \\n; a line's key is the line without blanks ([\\x20\\x09-\\x0D]) at both ends, A-Z lower-cased, hashed to 128 bits.
1. Lines are exploded and their keys hashed, and hashes and positions are written once; documents are counted by (key, document) and then by key, so that a key of very many lines is
   never in one task.
2. A key of at least `least` code points that is in `documents` or more different documents loses its lines in all but the smallest doc_id.
   Keys that hold over a thousandth of all lines go to every task, the others are shuffled.
3. Dropped positions are gathered for each text and the text is put together again from the other positions. Only this last join shuffles texts.

Rows of one doc_id are one document when documents are counted; each row has its own result. Rows without a doc_id are together one
document, after all others. A null or empty text is one empty line; blank and short lines always stay. Equal rows have equal results.
A very long text is one row throughout, its lines and positions are handled in linear time. Other columns of docs are not looked at, and an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, matched

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = 2**63 - 1  #: the place of rows without a doc_id


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def drop_shared_lines(docs: DataFrame, least: int = 10, documents: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): a row for each row of docs(doc_id, text)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a text's rows are known by these three, equal rows together
    text = text.withColumns({"at": F.coalesce("doc_id", F.lit(LAST)), "t0": F.xxhash64("text"), "t1": F.xxhash64(F.lit(1), "text")})
    split = F.split("text", "\n", -1)
    line = text.select("at", "t0", "t1", F.posexplode(split).alias("pos", "line")).select("at", "t0", "t1", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    line = cut(line.select("at", "t0", "t1", "pos", F.xxhash64("key").alias("k0"), F.xxhash64(F.lit(1), "key").alias("k1")), "lines")
    each = line.groupBy("k0", "k1", "at").agg(F.count("*").alias("n"))
    shared = each.groupBy("k0", "k1").agg(F.count("*").alias("documents"), F.min("at").alias("first"), F.sum("n").alias("n")).where(F.col("documents") >= documents)
    shared = cut(shared.select("k0", "k1", "first", "n"), "shared")
    gone = matched(line, shared, ["k0", "k1"]).where("at > first").groupBy("at", "t0", "t1").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = cut(gone, "gone")
    # false up to each dropped position, true there
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("gone", i - 1))
    marks = gone.withColumn("mark", F.flatten(F.transform("gone", lambda p, i: F.concat(F.array_repeat(F.lit(False), p - before(i) - 1), F.array(F.lit(True))))))
    kept = F.array_join(F.filter(split, lambda x, i: ~F.coalesce(F.get("mark", i), F.lit(False))), "\n")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n_dropped = F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_dropped")
    whole = F.col("mark").isNull()
    return text.join(marks, ["at", "t0", "t1"], "left").select("doc_id", n_lines.cast("long").alias("n_lines"), n_dropped, F.when(whole, F.col("text")).otherwise(kept).alias("kept_text"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST}) AS place, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, place, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, min(place) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT place) >= 2)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (place > first))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first IS NULL OR place = first), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY r
"""
