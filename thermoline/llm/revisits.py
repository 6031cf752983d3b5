"""WARC revisits: a not-modified answer takes its body from the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoline.session import materialize

#: Header fields that a 304 answer may bring up to date (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified",
             "vary")


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, `www.` and default port; path without slashes at its
    end; parameters sorted, `utm_` ones and the fragment gone. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^(?i)https?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)),
                            "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(
        F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"),
        lambda p: (p != "") & ~p.startswith("utm_")))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(
        F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that become equal the last value stays."""
    pairs = F.transform(F.map_entries(F.coalesce(
        headers, F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    return F.map_from_entries(F.transform(
        F.array_distinct(F.transform(pairs, lambda e: e["k"])),
        lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda e: e["k"] == k), -1)["v"])))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per record of type `revisit`: what it stands for.

    `records`: record_id long, uri string, date timestamp or long, type string (`response`,
    `revisit`), headers map<string,string>, payload_digest string; other columns are left out.

    The response is the latest one of the same canonical URL before the revisit in the order
    (date, record_id). `verdict`: `match` or `mismatch` by the first validator that both have
    (entity tag, weakly compared; last-modified; payload digest), `unverified` if they share none,
    `orphan` without an earlier response. A match carries refers_to, refers_date, payload_digest
    and headers: those of the response, brought up to date by the permitted ones of the revisit.
    In any other case these are null; nothing is guessed from older responses.

    Null headers are no headers. Null uri, date or record_id: a revisit is an orphan, a response is
    never found. Repeated revisits each get a row; repeated responses count as one; of responses
    equal in date and record_id the one with the greatest digest counts. No rows, no result.

    Rows are dealt by ranges of (URL, date, record_id), so that captures of one URL, however many,
    spread over tasks; only the last response of each (range, URL) is carried on to later ranges.
    """
    headers = _lower_names(F.col("headers"))
    rows = records.select(
        canonical_url(F.col("uri")).alias("url"), F.col("date").alias("at"),
        F.col("record_id").alias("id"), F.col("type").alias("kind"), headers.alias("headers"),
        F.col("payload_digest").alias("digest")).where("kind in ('response', 'revisit')")
    rows = materialize(
        rows.repartitionByRange("url", "at", "id")
        .withColumn("part", F.spark_partition_id()), "captures")
    placed = F.col("url").isNotNull() & F.col("at").isNotNull() & F.col("id").isNotNull()
    found = F.when((F.col("kind") == "response") & placed,
                   F.struct("at", "id", "digest", "headers"))
    # Order within a range: a revisit comes before a response of the same date and id.
    here = (Window.partitionBy("part", "url")
            .orderBy("at", "id", F.col("kind").desc(), F.col("digest"))
            .rowsBetween(Window.unboundedPreceding, -1))
    local = rows.select("*", F.last(found, ignorenulls=True).over(here).alias("local"))
    order = F.struct("at", "id", "digest")
    heads = rows.where("url is not null").groupBy("part", "url").agg(
        F.max_by(found, F.when(found.isNotNull(), order)).alias("head"))
    before = (Window.partitionBy("url").orderBy("part")
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = heads.select("part", "url",
                           F.last("head", ignorenulls=True).over(before).alias("carried"))
    joined = local.where("kind = 'revisit'").join(carried, ["part", "url"], "left")
    best = F.when(placed, F.coalesce("local", "carried"))

    mine, theirs = F.col("headers"), F.col("found")["headers"]

    def tag(h: Column) -> Column:
        return F.regexp_replace(h["etag"], "^W/", "")

    checks = [(tag(mine), tag(theirs)), (mine["last-modified"], theirs["last-modified"]),
              (F.col("digest"), F.col("found")["digest"])]
    verdict = F.when(F.col("found").isNull(), "orphan")
    for a, b in checks:
        verdict = verdict.when((a == b).isNotNull(), F.when(a == b, "match").otherwise("mismatch"))
    merged = F.map_concat(
        F.map_filter(theirs, lambda k, _: ~(k.isin(*PERMITTED) & F.map_contains_key(mine, k))),
        F.map_filter(mine, lambda k, _: k.isin(*PERMITTED)))
    result = joined.withColumn("found", best).withColumn("verdict", verdict.otherwise("unverified"))
    match = F.col("verdict") == "match"
    return result.select(
        F.col("id").alias("record_id"), F.col("url").alias("canonical"), "verdict",
        F.when(match, F.col("found")["id"]).alias("refers_to"),
        F.when(match, F.col("found")["at"]).alias("refers_date"),
        F.when(match, F.col("found")["digest"]).alias("payload_digest"),
        F.when(match, merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Each page as two records: a full response, and a later or earlier not-modified answer."""
    n, html = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    tag = F.concat(F.lit('"'), F.substring(F.md5(html.cast("binary")), 1, 16), F.lit('"'))
    first = n * 7919 % 2592000
    shape = F.concat(F.lit("size "), F.octet_length(html) % 7)

    def headers(*pairs: tuple[str, Column]) -> Column:
        made = F.create_map(*[x for name, value in pairs for x in (F.lit(name), value)])
        return F.map_filter(made, lambda _, v: v.isNotNull())

    base = pages.where("page_id is not null")
    full = base.select(
        (2 * n).alias("record_id"), F.col("url").alias("uri"), first.alias("date"),
        F.lit("response").alias("type"),
        headers(("ETag", tag), ("Last-Modified", shape), ("Content-Type", F.lit("text/html")),
                ("Content-Length", F.octet_length(html).cast("string")),
                ("Cache-Control", F.lit("max-age=60"))).alias("headers"),
        F.sha1(html.cast("binary")).alias("payload_digest"))
    again = base.select(
        2 * n + 1, F.col("url"), first + n * 104729 % 1728000 - 432000, F.lit("revisit"),
        headers(("etag", F.when(n % 5 != 0, F.concat(F.when(n % 3 == 0, "W/").otherwise(""), tag))),
                ("last-modified", F.when(n % 7 != 0, shape)),
                ("cache-control", F.lit("max-age=600")), ("content-length", F.lit("0")),
                ("set-cookie", F.lit("a=b"))),
        F.lit(None).cast("string"))
    return full.unionAll(again)


def header_digest(headers: Column) -> Column:
    """One digest of a header map, whatever the order of its entries."""
    return F.md5(F.array_join(F.array_sort(F.transform(
        F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n"))


SQL = r"""
WITH b AS (
  SELECT page_id AS n, coalesce(html, '') AS html,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^(?i)https?://', '') AS bare
  FROM pages WHERE page_id IS NOT NULL),
u AS (
  SELECT n, html,
    regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^www\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
              lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS params,
    '"' || substr(md5(html), 1, 16) || '"' AS tag, n * 7919 % 2592000 AS first,
    'size ' || (octet_length(encode(html)) % 7) AS shape
  FROM b),
c AS (SELECT *, base || CASE WHEN len(params) > 0
                        THEN '?' || array_to_string(params, '&') ELSE '' END AS url FROM u),
r AS (
  SELECT 2 * n AS id, url, first AS moment, 'response' AS kind, tag, shape,
         octet_length(encode(html)) AS size, sha1(html) AS digest FROM c
  UNION ALL
  SELECT 2 * n + 1, url, first + n * 104729 % 1728000 - 432000, 'revisit',
         CASE WHEN n % 5 <> 0 THEN tag END, CASE WHEN n % 7 <> 0 THEN shape END, NULL, NULL
  FROM c),
w AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN
      {'id': id, 'moment': moment, 'tag': tag, 'shape': shape, 'size': size, 'digest': digest} END
      IGNORE NULLS) OVER (PARTITION BY url ORDER BY moment, id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f
  FROM r),
v AS (
  SELECT *, CASE WHEN f IS NULL THEN 'orphan'
                 WHEN tag IS NOT NULL THEN CASE WHEN tag = f.tag THEN 'match' ELSE 'mismatch' END
                 WHEN shape IS NOT NULL THEN
                   CASE WHEN shape = f.shape THEN 'match' ELSE 'mismatch' END
                 ELSE 'unverified' END AS verdict
  FROM w WHERE kind = 'revisit')
SELECT id AS record_id, url AS canonical, verdict,
       CASE WHEN verdict = 'match' THEN f.id END AS refers_to,
       CASE WHEN verdict = 'match' THEN f.moment END AS refers_date,
       CASE WHEN verdict = 'match' THEN f.digest END AS payload_digest,
       CASE WHEN verdict = 'match' THEN md5(
         'cache-control: max-age=600' || chr(10) || 'content-length: ' || f.size || chr(10)
         || 'content-type: text/html' || chr(10)
         || 'etag: ' || CASE WHEN tag IS NULL THEN f.tag
                             ELSE CASE WHEN ((id - 1) // 2) % 3 = 0 THEN 'W/' ELSE '' END || tag END
         || chr(10) || 'last-modified: ' || coalesce(shape, f.shape)) END AS headers_md5
FROM v
"""
