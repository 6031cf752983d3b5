"""Quality rules: counts per document and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoline.llm.common import SPACES, others, plain_spaces, words_of
from thermoline.session import materialize

#: Buckets of words, and as many of pairs of neighbours (at most 32,768 each); weights are whole
#: thousandths, so that sums are exact in any order.
BUCKETS = 32768

#: Least sum of a word's and a pair's weight, in the mean, in thousandths: between the labelled
#: documents of high and of low quality, see README.
THRESHOLD = -300

MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "score", "kept"]


SYMBOLS = "#*$%&|<>"


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.crc32(w.cast("binary")))


def _pairs(hashes: Column, buckets: int) -> Column:
    """Buckets of the pairs of neighbours among hashed words."""
    return F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))),
                      _from(hashes, 2), lambda a, b: (a * 31 + b) % buckets)


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _from(items: Column, start: int) -> Column:
    return F.slice(items, start, F.greatest(F.size(items), F.lit(1)))


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row (kind, bucket, weight) per bucket in use, kind 0 for words and 1 for pairs of
    neighbours: thousandths of the logarithm of the share among the documents in `trusted` (a
    column doc_id) over the share among all. Both shares are smoothed by one; words and pairs are
    multinomials of their own; counts cover every document."""
    marks = trusted.select(F.col("doc_id").alias("good")).where("good is not null").distinct()
    # Codes of two bytes an n-gram, those of pairs below zero, go through the join in place of
    # texts. A merge join at any size: what is trusted grows with the corpus. An outer generator:
    # for a plain one Spark adds a filter on the list below the join, which makes it twice.
    hashed = docs.select("doc_id", _hashes(words_of(plain_spaces(F.col("text")))).alias("h"))
    coded = hashed.select("doc_id", F.concat(
        F.transform("h", lambda c: (c % buckets).cast("short")),
        F.transform(_pairs(F.col("h"), buckets), lambda c: (-1 - c).cast("short"))).alias("codes"))
    counted = materialize(
        coded.join(marks.hint("merge"), F.col("doc_id") == F.col("good"), "left")
        .select(F.col("good").isNotNull().cast("long").alias("good"),
                F.explode_outer("codes").alias("code"))
        .where("code is not null").groupBy("code").agg(F.sum("good").alias("target"), F.count("*").alias("raw"))
        .select(F.when(F.col("code") < 0, 1).otherwise(0).alias("kind"),
                F.when(F.col("code") < 0, -1 - F.col("code").cast("long")).otherwise(
                    F.col("code").cast("long")).alias("bucket"), "target", "raw"), "counts")
    totals = counted.groupBy("kind").agg(F.sum("target").alias("all_target"),
                                         F.sum("raw").alias("all_raw"))
    ratio = ((F.col("target") + 1) * (F.col("all_raw") + buckets)).cast("double") / (
        (F.col("raw") + 1) * (F.col("all_target") + buckets)).cast("double")
    return counted.join(F.broadcast(totals), "kind").select(
        "kind", "bucket", F.round(F.log(ratio) * 1000).cast("long").alias("weight"))


def _dense(weights: DataFrame, kind: int, buckets: int) -> Column:
    """All weights of a kind as one array, by bucket; 0 for a bucket that is not in use."""
    every = weights.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    joined = every.join(weights.where(F.col("kind") == kind), "bucket", "left").select(
        "bucket", F.coalesce("weight", F.lit(0).cast("long")).alias("weight"))
    return joined.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "weight"))),
                                  lambda x: x["weight"]).alias("w")).scalar()


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS,
                  threshold: int = THRESHOLD, min_words: int = 50) -> DataFrame:
    """Counts, the ratio and the verdict for every row of `docs`; other columns stay.

    Words are runs of other than the six white-space bytes. The n-grams are all words and all pairs
    of neighbours, hashed into `buckets` each; `score` is the sum of their weights, `kept` holds
    if the base rules hold and the score is at least `threshold` thousandths a word.
    `base_failed`: fewer than `min_words` words, or over half of them in three-word windows that
    come twice or more.

    A null or empty text has zero in all counts and fails. Rows without doc_id are counted as raw
    and never as trusted; each of several rows with one doc_id counts. With no trusted document
    all ratios are what smoothing leaves. An empty table gives an empty one. Texts of any length
    are taken whole, one row's words at a time. Texts are read twice; what is shuffled for the
    counts is two bytes an n-gram, and what all tasks get is the weights, one a bucket.
    """
    weights = materialize(bucket_weights(docs, trusted, buckets), "weights")
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(*[c.alias(f"_k{i}") for i, c in enumerate(others(docs, MADE))],
                        text.alias("_text"), plain_spaces(F.col("text")).alias("_spaced"))
    named = named.withColumns({
        "_words": words_of(F.col("_spaced")),
        "_lines": F.filter(F.split("_text", "\n", -1),
                           lambda x: F.btrim(x, F.lit(SPACES)) != "")})
    named = named.withColumn("_codes", F.transform("_words", lambda w: F.xxhash64(w)))
    named = named.withColumn("_windows", F.zip_with(
        F.zip_with("_codes", _from(F.col("_codes"), 2), lambda a, b: F.xxhash64(a, b)),
        _from(F.col("_codes"), 3), lambda ab, c: F.xxhash64(ab, c)))
    # The last two are no whole windows.
    named = named.withColumn("_windows", F.slice(
        "_windows", 1, F.greatest(F.size("_windows") - 2, F.lit(0))))
    ordered = F.sort_array(F.transform(
        "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    # Neighbours in the sorted list with one hash: both windows come twice or more.
    named = named.withColumn("_ordered", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"), ordered).otherwise(
            F.array().cast("array<struct<h:bigint,p:int>>")))
    pairs = F.flatten(F.filter(
        F.zip_with("_ordered", _from(F.col("_ordered"), 2),
                   lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"]))),
        lambda x: x.isNotNull()))
    covered = F.flatten(F.transform(pairs, lambda p: F.array(p, p + 1, p + 2)))
    counted = named.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": (F.char_length("_text") - F.octet_length("_spaced")
                       + F.octet_length(_without(F.col("_spaced"), " "))).cast("long"),
        "n_symbols": (F.octet_length("_text")
                      - F.octet_length(_without(F.col("_text"), SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.size(F.array_distinct(covered)).cast("long"),
        "_hashes": _hashes(F.col("_words")),
        "_of_word": _dense(weights, 0, buckets), "_of_pair": _dense(weights, 1, buckets)})
    counted = counted.withColumns({
        "base_failed": (F.col("n_words") < min_words)
        | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "score": F.aggregate(
            "_hashes", F.lit(0).cast("long"),
            lambda s, c: s + F.get("_of_word", (c % buckets).cast("int")))
        + F.aggregate(_pairs(F.col("_hashes"), buckets), F.lit(0).cast("long"),
                      lambda s, c: s + F.get("_of_pair", c.cast("int")))})
    kept = ~F.col("base_failed") & (F.col("score") >= threshold * F.col("n_words"))
    # A row generator between: a filter on a result is not moved down to the scan, where it would
    # evaluate the lists within their own loops, once for each word.
    return counted.select(
        *[F.col(f"_k{i}").alias(name) for i, name in enumerate(
            c for c in docs.columns if c.lower() not in MADE)],
        F.inline(F.array(F.struct(*MADE[:-1], kept.alias("kept")))))


def sql(buckets: int = BUCKETS, threshold: int = THRESHOLD) -> str:
    """The same in SQL, with CRC-32 spelled out over the bytes of a string."""
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH crc_table AS (
  SELECT list(list_reduce(
           list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
           lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
         ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'),
                     lambda w: w <> '') AS words
  FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
codes AS (
  SELECT word,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))),
             lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT DISTINCT word FROM w), crc_table),
n AS (
  SELECT doc_id, h, lead(h) OVER (PARTITION BY doc_id ORDER BY pos) AS next
  FROM w JOIN codes USING (word)),
f AS (
  SELECT doc_id, 0 AS kind, h % {buckets} AS bucket FROM n
  UNION ALL SELECT doc_id, 1, (h * 31 + next) % {buckets} FROM n WHERE next IS NOT NULL),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
c AS (
  SELECT kind, bucket, count(good.doc_id) AS target, count(*) AS raw
  FROM f LEFT JOIN good ON f.doc_id = good.doc_id GROUP BY kind, bucket),
totals AS (SELECT kind, sum(raw) AS all_raw, sum(target) AS all_target FROM c GROUP BY kind),
weights AS (
  SELECT kind, bucket, round(ln(
    ((target + 1) * (all_raw + {buckets}))::DOUBLE
    / ((raw + 1) * (all_target + {buckets}))::DOUBLE) * 1000)::BIGINT AS weight
  FROM c JOIN totals USING (kind)),
s AS (SELECT doc_id, sum(weight)::BIGINT AS score
      FROM f JOIN weights USING (kind, bucket) GROUP BY doc_id),
windows AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, pos, word AS a, lead(word) OVER x AS b, lead(word, 2) OVER x AS c
        FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY pos)) WHERE c IS NOT NULL),
again AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words
  FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '{space}+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(score, 0) AS score
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, score,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND score >= {threshold} * n_words AS kept
FROM m
"""
