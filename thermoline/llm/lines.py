"""Line deduplication: lines that many documents hold stay in one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoline.llm.common import SPACES, fold_ascii, sheltered
from thermoline.session import materialize

MADE = ["text", "n_lines", "n_dropped"]


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Drop each line whose key at least `min_docs` documents hold, except in the greatest doc_id.

    A line's key is the line without white space at both ends, A-Z in lower case; keys below
    `min_chars` code points are never dropped. Keys are compared by 128 bits of hash. Each row
    keeps its other columns; `text` holds the lines that stay, joined by a line feed, `n_lines`
    and `n_dropped` count lines before and those that went.

    A null or empty text is one empty line. Rows without doc_id keep all their lines and count as
    no document; rows that share a doc_id count as one document, each with its own lines. All
    lines of a document with the key go, also repeated ones. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = (
        docs.where(F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("row"),
                F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .select("doc", "row", "pos", F.btrim("line", F.lit(SPACES)).alias("bare"))
        .where(F.char_length("bare") >= min_chars)
        .select("doc", "row", "pos", fold_ascii(F.col("bare")).alias("key"))
        .select("doc", "row", "pos", F.xxhash64("key").alias("h1"),
                F.xxhash64(F.lit(1), "key").alias("h2")))
    lines = materialize(lines, "lines")
    # Written, so that the join below reads plain exchanges, which AQE splits at a hot key.
    common = materialize(
        lines.select("h1", "h2", "doc").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
        .where(F.col("n") >= min_docs).drop("n"), "common")
    gone = (
        lines.join(common, ["h1", "h2"]).where(F.col("doc") < F.col("last"))
        .groupBy("doc", "row").agg(F.collect_set("pos").alias("gone")))
    gone = materialize(gone, "gone")
    mine, names = sheltered(docs, MADE)
    whole = F.coalesce(F.col("text"), F.lit(""))
    joined = (
        mine.withColumn("row", F.xxhash64(whole)).join(gone, ["doc", "row"], "left")
        .withColumns({"lines": F.split(whole, "\n", -1),
                      "gone": F.coalesce("gone", F.array().cast("array<int>"))})
        .withColumn("left", F.array_except(
            F.sequence(F.lit(0), F.size("lines") - 1), "gone")))
    kept = F.when(F.size("gone") == 0, whole).otherwise(
        F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    return joined.select(
        *names, kept.alias("text"), F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, pos, line, coalesce(k.doc_id < c.last, false) AS gone
  FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''))
         AS kept_sha256
FROM m GROUP BY doc_id
"""
