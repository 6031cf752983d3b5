"""Packed ids, whitening and lexical search against the tokenizer library, numpy and plain loops."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from thermoline.llm import lexical, packed, queries, whitening

FOLDER = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 4096, 4097, 10001])
def test_packed_ids_come_back_and_any_range_can_be_read(width, n):
    ids = np.random.default_rng(n).integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
    data = packed.pack(ids, width)
    assert packed.unpack(data).tolist() == ids.tolist()
    for a, b in ((0, 1), (5, 4099), (4095, 4097), (n - 1, n + 5), (n, n)):
        a = max(a, 0)
        assert packed.unpack(data, a, b).tolist() == ids[a:b].tolist()
    blocks = -(-n // packed.BLOCK)
    assert len(data) == 24 + 8 * (blocks + 1) + sum(
        -(-min(packed.BLOCK, n - b * packed.BLOCK) * width // 8) for b in range(blocks))


ODD = ["", None, "plain words", "It's WE'LL 12345 naïve Café É é", "<|endoftext|>A <|ENDOFTEXT|>",
       "x<|startoftext|>y", "tab\tvt\x0bff\x0cnbsp\xa0nel\x85fs\x1cgs\x1dsep end", "日本語 ไทย 한국어",
       "İstanbul ΣΑΣ ς", "́ combining first", "a" * 3000, "😀😀 ok\x00nul", "!!!??,,.. '' 's 't",
       "end. END!! (x) İx. ﬁn, straße; ªº. ǅ:", "".join(f"w{chr(97 + i % 26)}{i}. " for i in range(99)),
       " ".join(chr(97 + i % 26) * (1 + i // 26) + ".," [i % 2] for i in range(1200))]


def expected_ids(rows, end_id=2):
    library, at, out = Tokenizer.from_file(WORDS), 0, []
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_words_one_by_one_give_the_library_s_ids():
    own, library = packed.Encoder(WORDS), Tokenizer.from_file(WORDS)
    texts = [t or "" for t in ODD]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in own.ids([t.encode() for t in texts])] == want
    assert [own.long_ids(t.encode()).tolist() for t in texts] == want


def test_long_texts_are_encoded_in_portions(monkeypatch):
    monkeypatch.setattr(packed, "PORTION", 64)
    own, library = packed.Encoder(WORDS), Tokenizer.from_file(WORDS)
    text = "Some Words, and <|endoftext|> é more of them\n" * 40 + "z" * 300
    assert own.long_ids(text.encode()).tolist() == library.encode(
        text, add_special_tokens=False).ids


def test_files_hold_documents_in_order(spark, tmp_path):
    rows = [(i * 7 % 17, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr(
        "doc_id", "text", "1 as shard", "2 as `first`")
    packed.write_ids(docs, str(tmp_path / "ids"), WORDS, end_id=2, segment=50)
    done = packed.with_crc32(packed.read_documents(spark, str(tmp_path / "ids"))).collect()
    assert sorted(map(tuple, done)) == expected_ids(sorted(rows))
    library = Tokenizer.from_file(WORDS)
    stream = [i for _, t in sorted(rows) for i in [
        *library.encode(t or "", add_special_tokens=False).ids, 2]]
    for a, b in ((0, 1), (37, 203), (0, len(stream) + 9), (len(stream), len(stream) + 1)):
        parts = packed.read_range(spark, str(tmp_path / "ids"), a, b).orderBy("start").collect()
        assert np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist() == stream[a:b]
        assert not parts or parts[0]["start"] == a


def test_files_of_null_and_repeated_ids_and_of_nothing(spark, tmp_path):
    rows = [(None, "b"), (None, "a"), (3, "x y"), (3, "x y"), (3, "other"), (1, None)]
    packed.write_ids(spark.createDataFrame(rows, "doc_id long, text string"),
                     str(tmp_path / "a"), WORDS, end_id=2)
    done = packed.read_documents(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r["doc_id"] for r in done] == [None, None, 1, 3, 3, 3]
    assert [r["start"] for r in done] == np.cumsum([0, *(r["n_tokens"] for r in done[:-1])]).tolist()
    packed.write_ids(spark.createDataFrame([], "doc_id long, text string"),
                     str(tmp_path / "b"), WORDS, end_id=2)
    assert packed.read_documents(spark, str(tmp_path / "b")).count() == 0
    assert packed.read_range(spark, str(tmp_path / "b"), 0, 9).count() == 0


def test_registered_packed_ids(spark):
    docs = queries.table(spark, FOLDER, "documents").select("doc_id", "text").orderBy("doc_id")
    done = queries.QUERIES["op11_packed_ids"](spark, FOLDER).orderBy("doc_id").collect()
    assert [tuple(r) for r in done] == expected_ids([tuple(r) for r in docs.collect()])


def test_jacobi_on_the_cholesky_factor_gives_the_eigenpairs():
    r = np.random.default_rng(3)
    for size, rank in ((1, 1), (5, 5), (33, 33), (20, 7)):
        root = r.normal(size=(size, rank)) * 10.0 ** r.uniform(-3, 3, rank)
        matrix = root @ root.T
        factor = whitening.pivoted_cholesky(matrix)
        assert np.allclose(factor @ factor.T, matrix, rtol=1e-9, atol=1e-9 * matrix.max())
        values, axes = whitening.jacobi(factor)
        want = np.linalg.eigvalsh(matrix)[::-1][:len(values)]
        assert np.allclose(values, want, rtol=1e-8, atol=1e-12 * want[0])
        assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)
        assert np.allclose(matrix @ axes, axes * values, atol=1e-9 * want[0])
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def expected_whitening(rows):
    kept = [(v, np.floor(64 * np.array(e, np.float64)).astype(np.int64) + 1000000)
            for v, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in kept}), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    covariance = np.cov(fit.T.astype(np.float64), bias=True)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    return {v: (int(((n * x - sums) ** 2).sum()), (x - sums / n) @ axes / np.sqrt(values))
            for v, x in kept}, n, values / np.trace(covariance)


def check_whitening(done, rows):
    want, n, share = expected_whitening(rows)
    assert sorted((r["vec_id"], r["component"]) for r in done) == sorted(
        (v, k + 1) for v in want for k in range(len(share)))
    signs = {}
    for r in done:
        deviation, white = want[r["vec_id"]]
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation
        assert abs(r["explained"] / share[k] - 1) < 1e-9 and r["identity_error"] < 1e-9
        assert abs(abs(r["whitened"]) - abs(white[k])) < 1e-7
        if abs(white[k]) > 1e-3:
            signs.setdefault(k, set()).add(r["whitened"] * white[k] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_registered_whitening(spark):
    rows = queries.table(spark, FOLDER, "embeddings").select("vec_id", "embedding").collect()
    done = queries.QUERIES["op12_whitening"](spark, FOLDER).collect()
    check_whitening(done, [tuple(r) for r in rows])


def test_whitening_of_odd_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=3).tolist()) for i in range(40)] + [(100 + i, [1.0, 2.0, 3.0])
                                                                  for i in range(30)]
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 1.0, 1.0]),
             (203, [float("inf"), 1.0, 1.0]), (None, [0.5, 0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 as x", "'a' as Deviation", "'b' as other")
    whole, model, error = whitening.whiten(df)
    assert whole.columns == ["vec_id", "embedding", "x", "other", "deviation", "whitened"]
    done = whitening.by_component(whole, model, error).collect()
    assert len(done) == 71 * 3 and error < 1e-9 and model.n == 42
    short = df.unionByName(df.limit(1).selectExpr(
        "500L as vec_id", "array(1D, 2D) as embedding", "x", "Deviation", "other"))
    assert whitening.whiten(short)[0].where("vec_id = 500").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])],
                                  [(1, [])], [(1, None)]])
def test_whitening_needs_two_different_vectors(spark, rows):
    whole, model, error = whitening.whiten(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert model is None and whitening.by_component(whole, model, error).collect() == []


def test_deviation_is_exact_or_null():
    model = whitening.Whitening(3, [3 << 40, 6], np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[1 << 40, 2], [(1 << 40) + (1 << 29), 2], [(1 << 40) + (1 << 31), 2]])
    assert model.deviation(x) == [0, 9 << 58, None]


def expected_search(docs, items, top=20):
    def terms(text):
        lowered = (text or "").translate(str.maketrans(
            "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered))

    counts = [(doc, terms(t)) for doc, t in docs]
    counts = [(doc, c) for doc, c in counts if c]
    many, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked, scores = terms(text), []
        for doc, c in counts:
            m = 75 + 25 * c.total() * many // total
            score = sum(k * math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1)))
                        * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                        for t, k in asked.items() if c[t])
            if score > 0:
                scores.append((-score, -1 if doc is None else doc, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(sorted(scores)[:top])]
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_registered_search(spark):
    docs, items = (queries.table(spark, FOLDER, t).select(k, "text").collect()
                   for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    done = queries.QUERIES["op13_lexical_search"](spark, FOLDER).collect()
    assert sorted(map(tuple, done)) == sorted(expected_search(docs, items))


@pytest.mark.parametrize("per_slice,per_bundle", [(8192, 50000), (3, 2)])
def test_search_over_odd_rows(spark, per_slice, per_bundle):
    docs = [(i, t) for i, t in enumerate(
        ["red fox", "red RED dog", "", None, "...", "fox jumps over the red dog", "naïve 日本 fox",
         "same text", "same text", "x\x00y z_w"] + ["the red fox runs"] * 30)]
    docs += [(None, "red fox alone"), (7, "same text"), (7, "fox")]
    items = [(1, "Red fox, fox!"), (2, None), (3, ""), (4, "nothing here"), (5, "same"),
             (5, "text text"), (None, "日本 y w"), (6, "the")]
    done = lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "2 as n"),
        spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term"),
        per_slice=per_slice, per_bundle=per_bundle).collect()
    assert sorted(map(tuple, done), key=key) == sorted(expected_search(docs, items), key=key)


def test_search_over_nothing(spark):
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = some.limit(0)
    items = some.withColumnRenamed("doc_id", "item_id")
    assert lexical.search(none, items).count() == 0
    assert lexical.search(some, items.limit(0)).count() == 0
    assert lexical.search(none, items.limit(0)).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = ("Alpha beta, " * 50 + "y" * 200 + " gamma ").encode() * 3 + b"q" * 90
    whole = lexical.count_terms(text)
    monkeypatch.setattr(lexical, "_PIECE", 37)
    assert lexical.count_terms(text) == whole and whole[b"beta"] == 150 and whole[b"q" * 90] == 1
