"""Line dedup, quality rules, licence scans and revisits on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from thermoline.llm import licences, lines, ngram_ratio, revisits

BOILER = "Subscribe to our weekly letter today."


def test_lines_stay_in_the_last_document(spark):
    df = spark.createDataFrame(
        [(1, f"a\n {BOILER.upper()}\nb"), (2, f"{BOILER}\n{BOILER}"), (3, f"c\n\t{BOILER}"),
         (4, "short\nshort"), (5, "short"), (6, "short"), (7, None)], "doc_id long, text string")
    rows = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"])
            for r in lines.drop_repeated_lines(df).collect()}
    assert rows == {1: ("a\nb", 3, 1), 2: ("", 2, 2), 3: (f"c\n\t{BOILER}", 2, 0),
                    4: ("short\nshort", 2, 0), 5: ("short", 1, 0), 6: ("short", 1, 0),
                    7: ("", 1, 0)}


def test_line_keys_fold_ascii_only(spark):
    a, b = "É" * 25, "é" * 25
    df = spark.createDataFrame([(1, a), (2, a), (3, b)], "doc_id long, text string")
    assert {r["n_dropped"] for r in lines.drop_repeated_lines(df).collect()} == {0}


def test_rows_of_one_document_count_once(spark):
    df = spark.createDataFrame([(1, BOILER), (1, BOILER), (1, f"x\n{BOILER}"), (2, BOILER)],
                               "doc_id long, text string")
    assert {r["n_dropped"] for r in lines.drop_repeated_lines(df).collect()} == {0}
    more = df.unionAll(spark.createDataFrame([(3, BOILER)], df.schema))
    rows = lines.drop_repeated_lines(more).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == [
        (1, ""), (1, ""), (1, "x"), (2, ""), (3, BOILER)]


def test_lines_of_odd_rows(odd, empty):
    rows = lines.drop_repeated_lines(odd)
    assert rows.count() == odd.count() and "N_Words" in rows.columns
    assert rows.filter("n_dropped > 0").count() == 0
    assert lines.drop_repeated_lines(empty).count() == 0


def test_quality_rules_of_odd_rows(odd, empty, spark):
    trusted = spark.createDataFrame([(6,), (6,), (None,)], "doc_id long")
    rows = ngram_ratio.quality_rules(odd, trusted).collect()
    assert len(rows) == odd.count()
    blank = [r for r in rows if not (r["text"] or "").strip()]
    assert all(r["n_words"] == r["word_chars"] == r["score"] == 0 and not r["kept"] for r in blank)
    long = next(r for r in rows if r["doc_id"] == 6)
    assert (long["n_words"], long["n_repeat_words"], long["base_failed"]) == (60_000, 60_000, True)
    assert next(r for r in rows if r["doc_id"] == 7)["word_chars"] == 4
    assert ngram_ratio.quality_rules(empty, trusted).count() == 0
    assert ngram_ratio.quality_rules(odd, trusted.limit(0)).count() == len(rows)


def test_repeated_windows(spark):
    def plain(text):
        words = text.split()
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        twice = [i for i, w in enumerate(windows) if windows.count(w) > 1]
        return len({i + k for i in twice for k in range(3)})

    texts = ["a b c d a b c", "a a a a", "a b", "", "x y z x y z x", "one two three four"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ngram_ratio.quality_rules(df, df.select("doc_id"))
    assert {r["text"]: r["n_repeat_words"] for r in rows.collect()} == {t: plain(t) for t in texts}


def test_junk_falls_below_the_threshold(spark):
    good = [(i, " ".join(f"w{(i + k) % 57}ing" for k in range(56))) for i in range(40)]
    junk = [(100 + i, " ".join(f"w{(i + k) % 57}$$$" for k in range(56))) for i in range(8)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string")
    trusted = df.filter("doc_id < 20")
    # So small a corpus takes few buckets: smoothing adds one to each.
    rows = ngram_ratio.quality_rules(df, trusted, buckets=512)
    assert {r["doc_id"] for r in rows.filter("kept").collect()} == {i for i, _ in good}


def test_garbled_and_shuffled_texts_lose_score(spark):
    """What comes before a word's end and the order of words count: copies of trusted texts with
    other word beginnings fall below the threshold, and shuffled ones lose."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1")
    some = [tuple(r) for r in docs.join(good, "doc_id", "left_semi").select(docs.columns).collect()]
    r = random.Random(3)
    garbled = [(1000 + i, " ".join("zqj#9" + w[-3:] for w in t.split())) for i, t in some]
    shuffled = [(2000 + i, " ".join(r.sample(t.split(), len(t.split())))) for i, t in some]
    more = spark.createDataFrame(garbled + shuffled, docs.schema)
    rows = {x["doc_id"]: x for x in ngram_ratio.quality_rules(docs.unionByName(more), good).collect()}
    assert sum(rows[1000 + i]["kept"] for i, _ in some) == 0
    assert sum(rows[i]["kept"] for i, _ in some) > 0
    long = [i for i, t in some if len(t.split()) > 20]
    assert all(rows[2000 + i]["score"] < rows[i]["score"] for i in long)


def test_low_quality_is_rejected_and_high_quality_stays(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = ngram_ratio.quality_rules(docs.select("doc_id", "text"), labels.where("quality = 1"))
    kept = rows.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {x["quality"]: x["share"] for x in kept}
    assert share[1] >= 0.99 and share[0] <= 0.02


@pytest.mark.parametrize("spdx, text", [
    ("MIT", licences.KNOWN[0][1]), ("BSD-2-Clause", licences.KNOWN[3][1])])
def test_whole_licences(spark, spdx, text):
    changed = "Copyright (c) 2020 Some One\n\n" + text.upper().replace(". ", ".\n\n  ").replace(
        "SUBLICENSE", "sub-licence")
    df = spark.createDataFrame([(1, changed), (2, text + " And more."), (3, None)],
                               "doc_id long, text string")
    rows = {r["doc_id"]: r["whole_licence"] for r in licences.scan_licences(df).collect()}
    assert rows == {1: spdx, 2: None, 3: None}


def test_notices(spark, odd, empty):
    text = "x\nReleased under the MIT licence!\nreleased under the MIT License.\nSPDX-License-Identifier: MIT"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "MIT")],
                               "doc_id long, text string")
    rows = licences.scan_licences(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_notices"], r["notices"]) for r in rows) == [
        (0, 3, "MIT"), (1, 3, "MIT"), (1, 3, "MIT"), (2, 0, "")]
    assert licences.scan_licences(odd).filter("n_notices = 0").count() == odd.count()
    assert licences.scan_licences(empty).count() == 0


RECORDS = ("record_id long, uri string, date long, type string, headers map<string,string>, "
           "payload_digest string, other int")


def resolve(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], RECORDS)
    return {r["record_id"]: r for r in revisits.resolve_revisits(df).collect()}


def test_revisits(spark):
    full = {"ETag": '"a"', "Content-Type": "text/html", "Expires": "1"}
    rows = resolve(spark, [
        (1, "http://www.Example.org:80/a/?b=2&a=1#x", 10, "response", full, "d1"),
        (2, "https://example.org/a?a=1&b=2&utm_x=1", 20, "revisit",
         {"etag": 'W/"a"', "Expires": "2", "Content-Type": "no", "EXPIRES": "3"}, None),
        (3, "https://example.org/a?a=1&b=2", 30, "revisit", {"etag": '"b"'}, None),
        (4, "https://example.org/a?a=1&b=2", 5, "revisit", {"etag": '"a"'}, None),
        (5, "https://example.org/a?a=1&b=2", 40, "revisit", None, "d1"),
        (6, "https://example.org/a?a=1&b=2", 41, "revisit", {}, None),
        (7, None, 50, "revisit", full, "d1"), (8, "x", None, "revisit", full, "d1"),
        (9, "https://example.org/A?a=1&b=2", 60, "revisit", {"etag": '"a"'}, None),
        (10, "x", 1, "other", None, None)])
    assert {k: r["verdict"] for k, r in rows.items()} == {
        2: "match", 3: "mismatch", 4: "orphan", 5: "match", 6: "unverified", 7: "orphan",
        8: "orphan", 9: "orphan"}
    assert rows[2]["headers"] == {"etag": 'W/"a"', "expires": "3", "content-type": "text/html"}
    assert (rows[2]["refers_to"], rows[2]["refers_date"], rows[2]["payload_digest"]) == (1, 10, "d1")
    assert rows[3]["refers_to"] is None and rows[3]["headers"] is None


def test_revisits_of_one_hot_url(spark):
    """All at one instant: record ids order them, wherever the ranges are cut."""
    rows = [(i, "http://x/", 7, "response" if i % 3 == 0 else "revisit",
             {"etag": str(i // 3)}, None) for i in range(600)]
    rows += [(5, "http://x/", 7, "revisit", {"etag": "1"}, None)]        # repeated
    found = revisits.resolve_revisits(spark.createDataFrame([(*r, 0) for r in rows], RECORDS))
    assert found.count() == 401
    assert found.filter((F.col("verdict") != "match")
                        | (F.col("refers_to") != F.col("record_id") - F.col("record_id") % 3)
                        ).count() == 0


def test_no_revisits(spark):
    assert resolve(spark, [(1, "http://x/", 7, "response", {}, None)]) == {}
    empty = spark.createDataFrame([], RECORDS)
    assert revisits.resolve_revisits(empty).count() == 0
