"""Operators without SQL form: brute force, exact round trips, held-out accuracy, odd rows."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from thermoline.llm import bpe, byte_cnn, chosen_path, components, latent, ppm, suffix_merge
from thermoline.llm.common import bounded_sample
from thermoline.session import materialize

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# -- near duplicates ----------------------------------------------------------------------------

def linked(rows, size, percent):
    """doc_id -> (set size, component), by counting the common shingles of all pairs."""
    sets, holders, parent = {}, defaultdict(list), {}
    for i, text in rows:
        w = words_of(text)
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        parent[i] = i
        for s in sets[i]:
            holders[s].append(i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in sets.items():
        common = Counter(j for s in own for j in holders[s] if j != i)
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def near(df, size, percent):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"])
            for r in chosen_path.near_duplicates(df, size, percent).collect()}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_of_documents(documents, size, percent):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert near(documents, size, percent) == linked(rows, size, percent)


def edited(r, words, n):
    out = list(words)
    for k in r.sample(range(len(out)), n):
        out[k] = f"new{r.random()}"
    return " ".join(out)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Groups beyond what a node or a cell holds: parts, pivots and blocks find the same links."""
    monkeypatch.setattr(chosen_path, "NODE", 8)
    monkeypatch.setattr(chosen_path, "CELL_DOCS", 12)
    monkeypatch.setattr(chosen_path, "DEPTH", 2)
    r = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    # Copies of one text, up to four words apart, so that many pairs lie on either side of 0.85.
    rows = [(i, edited(r, base, i % 5)) for i in range(90)]
    rows += [(200 + i, " ".join(f"v{r.random()}" for _ in range(40))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert near(df, 3, 85) == linked(rows, 3, 85)


def test_known_groups_are_not_branched_on(spark, monkeypatch):
    """Once two trees have found a large group, the others compare what is outside it with it."""
    monkeypatch.setattr(chosen_path, "NODE", 8)
    made, children = Counter(), chosen_path._children

    def counted(rows, level, similarity):
        out = children(rows, level, similarity)
        made[bool(level), "label" in rows.columns] += out.count()
        return out

    monkeypatch.setattr(chosen_path, "_children", counted)
    r = random.Random(5)
    base, near_base = [f"w{k}" for k in range(120)], [f"w{k}" for k in range(60)]
    rows = [(i, edited(r, base, i % 4)) for i in range(80)]
    # Strays share half the text: they meet the group in its nodes and are not similar enough.
    rows += [(100 + i, " ".join(near_base + [f"v{r.random()}" for _ in range(60)]))
             for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert near(df, 3, 85) == linked(rows, 3, 85)
    assert made[True, False] > 80 and not made[True, True]
    assert made[True, False] < 3 * chosen_path.DEPTH * len(rows) * chosen_path.LEAD


def test_settled_links_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "materialize",
                        lambda df, name: written.append(name) or materialize(df, name))
    links = spark.createDataFrame([(k, k % 3) for k in range(3, 60)] * 2, "a long, b long")
    found = {r["id"]: r["component"] for r in components.connected_components(links).collect()}
    assert found == {k: k % 3 for k in range(60)}
    assert written == ["links"]


def test_chains_and_short_texts(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(k, k + 60))) for k in range(12)]
    rows += [(20, "a b"), (21, "A  B"), (22, "a"), (23, "b a"), (24, ""), (25, None), (26, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df, 3, 85) == linked(rows, 3, 85)


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = chosen_path.near_duplicates(odd, 3, 85)
    assert rows.columns == ["doc_id", "text", "lang", "_row", "N_Words", "n_shingles",
                            "component_id", "kept"]
    found = rows.collect()
    assert len(found) == odd.count()
    assert {(r["doc_id"], r["component_id"]) for r in found if r["text"] == "one"} == {
        (4, 4), (8, 4)}
    assert all(r["kept"] and r["component_id"] is None for r in found if r["doc_id"] is None)
    assert chosen_path.near_duplicates(empty, 3, 85).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (7, 7), (50, None)],
                                  "a long, b long")
    found = {r["id"]: r["component"] for r in components.connected_components(links).collect()}
    assert found == {**{k: 0 for k in range(41)}, 99: 99, 100: 99}


# -- repeated passages --------------------------------------------------------------------------

def without_repeats(rows):
    first = {}
    for i, text in rows:
        for p in range(len(text) - 49):
            s = text[p:p + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, text in rows:
        gone = bytearray(len(text))
        for p in range(len(text) - 49):
            if first[text[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(text), spans, kept))
    return out


def repeats(df, **more):
    return [(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"]))
            for r in suffix_merge.remove_repeats(df, **more).collect()]


@pytest.mark.parametrize("run_bytes", [4_000, 1 << 21])
def test_repeats_of_documents(documents, run_bytes):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in documents.collect()]
    assert sorted(repeats(documents, run_bytes=run_bytes)) == sorted(without_repeats(rows))


@pytest.mark.parametrize("common", [2, 64])
def test_repeats_that_overlap_and_periods(spark, monkeypatch, common):
    """Short periods, copies cut at any byte, anchors in many runs."""
    r, rows = random.Random(5), []
    base = "".join(r.choice("abcdefgh ") for _ in range(400))
    for i in range(60):
        a = r.randrange(300)
        text = {0: "ab" * r.randrange(60), 1: "z" * r.randrange(120)}.get(
            i % 6, base[a:a + r.randrange(100)] + r.choice("xyzé") * (i % 3) + base[:i])
        rows.append((r.randrange(40), text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffix_merge, "COMMON_RUNS", common)
    assert sorted(repeats(df, run_bytes=300)) == sorted(
        without_repeats([(i, t.encode()) for i, t in rows]))


def test_repeats_of_odd_rows(odd, empty, spark):
    rows = suffix_merge.remove_repeats(odd)
    assert rows.count() == odd.count()
    assert rows.filter("size(spans) > 0").count() == 0
    assert suffix_merge.remove_repeats(empty).count() == 0
    text = "".join(chr(97 + k % 23) for k in range(200))
    df = spark.createDataFrame([(None, text), (None, text), (3, text), (3, text)],
                               "doc_id long, text string")
    assert sorted((r[0] or 0, len(r[3])) for r in repeats(df)) == [(0, 0), (0, 0), (3, 200), (3, 200)]


def test_loser_tree_merges_in_order():
    r = random.Random(1)
    runs = []
    for _ in range(9):
        rows = sorted({bytes(r.choice(b"ab") for _ in range(12)) for _ in range(r.randrange(40))})
        shared, rest, body = [], [], b""
        for k, row in enumerate(rows):
            n = 0
            while k and n < 12 and row[n] == rows[k - 1][n]:
                n += 1
            shared.append(n)
            rest.append(12 - n)
            body += row[n:]
        runs.append((rows, suffix_merge.Stream(
            bytes(shared), bytes(rest), np.zeros(len(rows), np.int64).tobytes(),
            suffix_merge.zstandard.compress(body))))
    out = list(suffix_merge.merged([s for _, s in runs]))
    assert [t for *_, t in out] == sorted(t for rows, _ in runs for t in rows)
    for (_, _, _, a), (_, _, n, b) in zip(out, out[1:], strict=False):
        assert a[:n] == b[:n] and (n == len(b) or a[n] != b[n])


def run_of(texts, first=0):
    return suffix_merge.Run({
        "ids": [first + k for k in range(len(texts))], "sizes": [len(t) for t in texts],
        "body": suffix_merge.zstandard.compress(b"".join(texts))})


def test_ranges_of_anchors_are_alike_in_size():
    own = run_of([random.Random(3).randbytes(200_000)])
    own.anchors()
    n = np.bincount(suffix_merge.ranges(own.code, 4), minlength=16)
    assert n.min() > 0.9 * n.mean() and n.max() < 1.1 * n.mean()


def test_only_codes_of_several_strings_meet_in_a_tree(monkeypatch):
    """Two runs hold one passage, and a part of it that is cut short: the tree orders the strings
    round the cuts, not the whole passage."""
    r = random.Random(4)
    text = bytes(r.choice(b"abcdefgh ") for _ in range(20_000))
    pieces, seen = [], []
    for k, own in enumerate([run_of([text + r.randbytes(99)]),
                             run_of([r.randbytes(99) + text, text[5_000:5_100]], 7)]):
        own.anchors()
        n = len(own.known_codes()[0])
        own.records([True] * n, [False] * n, [])
        pieces += [(k, *p) for p in own.front_coded(2)]
    pieces.sort(key=lambda p: p[1])
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pieces, strict=True)],
                                       ["run", "range", "shared", "rest", "low", "body"])
    tree = suffix_merge.merged

    def counted(streams):
        for x in tree(streams):
            seen.append(x)
            yield x

    monkeypatch.setattr(suffix_merge, "merged", counted)
    rows = [x for out in suffix_merge._merge(iter([batch])) for x in out.to_pylist()]
    less = [np.concatenate([suffix_merge.unpacked(x["low"]) for x in rows if x["run"] == k])
            for k in (0, 1)]
    assert (less[0] == 0).all() and set(less[1].tolist()) == {0, -7} and len(rows) == 8
    assert (less[1] == -7).sum() > 1_500 and len(seen) < 20


def test_front_codes_and_back():
    r = random.Random(6)
    own = run_of([bytes(r.choice(b"a\0") for _ in range(90)) for _ in range(40)] + [r.randbytes(3_000)])
    own.anchors()
    n = len(own.known_codes()[0])
    own.records([True] * n, [False] * n, [])
    rows = np.concatenate([x for _, x, _ in own.strings(3)])
    shared, rest, _, body = ([p[k] for p in own.front_coded(3)] for k in (1, 2, 3, 4))
    back = suffix_merge.front_decoded(
        *(np.frombuffer(b"".join(x), np.uint8).astype(np.int64) for x in (shared, rest)),
        b"".join(map(suffix_merge.zstandard.decompress, body)))
    assert (rows == back).all() and len(rows) > 300
    texts = [x.tobytes() for x in rows]
    assert texts == sorted(set(texts))


def test_rows_with_one_code_are_told_apart():
    keys = np.array([[1, 2], [3, 4], [1, 2], [5, 6], [3, 4]], np.uint64)
    for codes in (None, np.zeros(5, np.uint64)):
        order, new = suffix_merge._grouped(keys, codes)
        groups = np.split(order, np.flatnonzero(new)[1:])
        assert sorted(sorted(g.tolist()) for g in groups) == [[0, 2], [1, 4], [3]]


def test_repeats_with_zero_bytes(spark):
    r = random.Random(8)
    rows = [(r.randrange(30), "".join(r.choice("ab\0") * r.randrange(1, 30) for _ in range(12)))
            for _ in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(repeats(df, run_bytes=900)) == sorted(
        without_repeats([(i, t.encode()) for i, t in rows]))


# -- language and quality -----------------------------------------------------------------------

def test_code_lengths_are_exact():
    """Against a plain recursion over dictionaries."""
    texts = {"x": [b"abracadabra", b"abab"], "y": [b"banana bandana"]}
    rows = []
    for lang, own in texts.items():
        for size, keys in enumerate(ppm.grams(own, ppm.ORDER + 1), 1):
            g, n = np.unique(keys, return_counts=True)
            rows += [(lang, size, int(a), int(b)) for a, b in zip(g, n, strict=True)]
    table = ppm.pa.Table.from_pylist([dict(zip(("lang", "size", "gram", "n"), r, strict=True))
                                      for r in rows])
    models = ppm.Models(table)

    def plain(lang, text):
        counts = Counter(t[i:i + s] for t in texts[lang] for s in range(1, ppm.ORDER + 2)
                         for i in range(len(t) - s + 1))
        total = 0.0
        for i in range(len(text)):
            for k in range(min(i, ppm.ORDER), -2, -1):
                if k < 0:
                    total += 8
                    break
                context = text[i - k:i]
                after = [n for g, n in counts.items() if len(g) == k + 1 and g[:k] == context]
                hit = counts.get(text[i - k:i + 1], 0)
                if hit:
                    total -= math.log2(hit / (sum(after) + len(after)))
                    break
                if after:
                    total -= math.log2(len(after) / (sum(after) + len(after)))
        return total

    tests = [b"abracab", b"", b"zzz", b"banana", b"a", b"bandabra!", b"nana nab"]
    want = [[plain(lang, t) for lang in ("x", "y")] for t in tests]
    assert np.allclose(models.bits(tests), want, rtol=1e-5)
    joint = b"".join(tests) * 3
    ppm_whole, ppm.WHOLE = ppm.WHOLE, 10
    try:
        assert ppm.long_text(models, joint)[0] == models.predict([joint])[0][0]
    finally:
        ppm.WHOLE = ppm_whole


def test_language_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = ppm.learn(docs.filter("doc_id % 4 != 0").select("lang", "text"), max_bytes=1 << 20)
    rows = ppm.identify(docs.filter("doc_id % 4 = 0"), models)
    held = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"),
                    F.max("score")).first()
    assert held[0] > 0.98 and 0 <= held[1] <= held[2] <= 1


def test_language_of_odd_rows(odd, empty):
    models = ppm.learn(odd)
    rows = ppm.identify(odd, models).collect()
    assert len(rows) == odd.count()
    assert {r["lang_pred"] for r in rows if not (r["text"] or "").strip()} == {"und"}
    assert {r["lang_pred"] for r in rows if r["text"] == "one"} == {"en"}
    nothing = ppm.learn(empty)
    assert {r["lang_pred"] for r in ppm.identify(odd, nothing).collect()} == {"und"}
    assert ppm.identify(empty, models).count() == 0


def test_gradients():
    network = byte_cnn.Network.fresh()
    texts = [bytes(np.random.default_rng(k).integers(32, 122, 90 + 150 * k, np.uint8))
             for k in range(4)]
    grid, firsts = byte_cnn.chunks(texts)
    labels, share = np.array([0, 1, 1, 0]), np.full(4, 0.25)

    def loss():
        network.tables = None
        p = network.probability(np.maximum.reduceat(network.hidden(grid), firsts, axis=0))
        return -(np.log(np.where(labels == 1, p, 1 - p)) * share).sum()

    for name, g in network.gradients(grid, firsts, labels, share).items():
        w, at = network.weights[name], np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = w[at], 1e-2
        w[at] = kept + step
        up = loss()
        w[at] = kept - step
        down = loss()
        w[at] = kept
        assert abs(g[at] - (up - down) / 2 / step) < 0.05 * abs(g[at]) + 1e-3, name


def test_chunks_cover_every_byte():
    for n in (0, 1, 127, 128, 129, 223, 224, 225, 1000):
        text = (np.arange(n) % 251 + 1).astype(np.uint8).tobytes()
        grid, firsts = byte_cnn.chunks([b"zz", text, b"q"])
        own = grid[firsts[1]:firsts[2]]
        assert set(own.reshape(-1)) - {0} == set(text)
        if n >= byte_cnn.CHUNK:
            assert (own > 0).all() and own[-1].tobytes() == text[-byte_cnn.CHUNK:]


def test_quality_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    network = byte_cnn.learn(docs.filter(~held_out), labels)
    rows = byte_cnn.classify(docs.filter(held_out), network).join(labels, "doc_id")
    right = rows.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast(
        "int"))).collect()
    assert all(r[1] > 0.8 for r in right) and len(right) == 2
    assert byte_cnn.learn(docs.filter(~held_out), labels).weights["out"].tolist() == \
        network.weights["out"].tolist()
    long = b"some text, " * 9000
    assert abs(network.score([long])[0] - network.score_long(long, 20_000)) < 1e-6


def test_quality_of_odd_rows(odd, empty):
    network = byte_cnn.learn(odd, odd.selectExpr("doc_id", "cast(doc_id % 2 as int) quality"))
    rows = byte_cnn.classify(odd, network).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert byte_cnn.classify(empty, byte_cnn.learn(empty, empty.selectExpr(
        "doc_id", "1 quality"))).count() == 0


def test_samples_with_long_texts(spark):
    """Long texts take no room from all others, and the bound holds with them."""
    rows = [("a", f"short text {i} " * 10) for i in range(400)]
    rows += [("a", f"{i} long " * 100_000) for i in range(8)] + [("b", "\u4e2d\u6587" * 300_000)]
    df = spark.createDataFrame(rows, "label string, text string")
    sample = bounded_sample(df, "label", 1000, 200_000).collect()
    short = [r for r in sample if r["text"].startswith("short")]
    assert len(short) >= 350 and {r["label"] for r in sample} == {"a", "b"}
    assert sum(len(r["text"].encode()) for r in sample) <= 200_000
    assert all(r["text"] in t for r in sample for label, t in rows[-9:]
               if label == r["label"] == "b")


def test_samples_with_rare_groups(spark):
    """Groups that hold little leave their share to others."""
    rows = [("a", f"{i} " * 250) for i in range(100, 400)]
    rows += [(f"rare{i}", f"text {i}") for i in range(300)]
    sample = bounded_sample(spark.createDataFrame(rows, "label string, text string"), "label",
                            1000, 150_000).collect()
    assert sum(r["label"] == "a" for r in sample) >= 50
    assert {r["label"] for r in sample} == {label for label, _ in rows}
    assert sum(len(r["text"]) for r in sample) <= 150_000


def plain_forward(network, text):
    """The network's probability by loops over bytes, filters and chunks."""
    w = {k: v.astype(np.float64) for k, v in network.weights.items()}
    last = max(0, len(text) - byte_cnn.CHUNK)
    best = [0.0] * byte_cnn.HIDDEN
    for start in [*range(0, last, byte_cnn.STEP), last]:
        chunk = text[start:start + byte_cnn.CHUNK].ljust(byte_cnn.CHUNK, b"\0")
        spots = []
        for s in range(byte_cnn.SPOTS):
            total = w["bias"].copy()
            for j in range(byte_cnn.TAPS):
                at = 2 * (s + j)
                total += np.concatenate([w["emb"][chunk[at]], w["emb"][chunk[at + 1]]]) @ w["conv"][j]
            spots.append([max(0.0, v) for v in total])
        pooled = [max(f) for f in zip(*spots)] + [sum(f) / len(spots) for f in zip(*spots)]
        for h in range(byte_cnn.HIDDEN):
            unit = w["hbias"][h] + sum(p * w["hid"][i, h] for i, p in enumerate(pooled))
            best[h] = max(best[h], unit)
    return 1 / (1 + math.exp(-(sum(b * o for b, o in zip(best, w["out"])) + w["obias"][0])))


def test_network_by_plain_loops(spark, documents):
    network = byte_cnn.learn(documents, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    texts = ["", "a", "b" * 127, "c" * 128, "d" * 129, "Ünï " * 80, None,
             *(r["text"] for r in documents.orderBy("doc_id").limit(4).collect())]
    rows = byte_cnn.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"),
                             network).collect()
    for r in rows:
        want = plain_forward(network, (texts[r["doc_id"]] or "").encode())
        assert abs(r["score"] - want) < 1e-4 and r["predicted"] == (r["score"] >= 0.5)


def test_no_text_is_shuffled_for_the_sample(spark, documents):
    """With broadcasts off but for counted tables, exchanges hold hashes or chosen texts only."""
    marks = documents.selectExpr("doc_id", "cast(doc_id % 2 as int) _label")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = bounded_sample(documents.select("doc_id", "text"), "_label", 50, 20_000, marks)
        plan = done._jdf.queryExecution().toString()
        rows = done.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert {r["_label"] for r in rows} == {0, 1}
    assert sum(len(r["text"].encode()) for r in rows) <= 20_000


def test_pipeline_stage_removes_rows_by_themselves(spark):
    """A row without doc_id goes if it holds an item; rows that share its doc_id stay."""
    import corpus_pipeline
    folder = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = "plain words about nothing in particular " * 3
    docs = spark.createDataFrame([(None, item), (None, clean), (5, item), (5, clean), (6, None)],
                                 "doc_id long, text string")
    kept = corpus_pipeline.decontamination(spark, docs, folder).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [
        (0, clean), (5, clean), (6, "")]


# -- decontamination ----------------------------------------------------------------------------

def test_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(
                    table[i][j + 1], table[i + 1][j])
        assert latent.common_subsequence(latent._masks(a), len(a), b) == table[-1][-1]


def test_decontamination_recall(spark):
    """Copies, changed copies and innocent texts, and all that a search of every window finds."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    r, planted = random.Random(4), []
    texts = [row["text"] for row in docs.orderBy("doc_id").limit(80).collect()]
    for k, item in enumerate(items.orderBy("item_id").collect()):
        words = item["text"].split()
        if k % 2:
            for at in r.sample(range(len(words) - 6), len(words) // 8):
                words[at] = "changed"
        own = texts[k].split()
        at = r.randrange(len(own) + 1)
        planted.append((10_000 + k, " ".join(own[:at] + words + own[at:]).upper() if k % 3 == 0
                        else " ".join(own[:at] + words + own[at:]), item["item_id"]))
    extra = spark.createDataFrame(planted, "doc_id long, text string, item long")
    found = {(x["doc_id"], x["item_id"]) for x in latent.contaminated(
        docs.unionAll(extra.select("doc_id", "text")), items).collect()}
    assert len({(i, item) for i, _, item in planted} - found) <= 0.1 * len(planted)
    want = set()
    known = latent.items_of([(x["item_id"], x["text"], None) for x in items.collect()])
    for row in docs.collect():
        hashes = latent.terms([(row["text"] or "").encode()])[0].tolist()
        present = set(hashes)
        for item in known:
            if sum(w in present for w in item.words) >= 0.6 * len(item.words) and any(
                    item.shared(hashes[a:a + 96]) >= latent.SHARE
                    for a in range(0, len(hashes), 16)):
                want.add((row["doc_id"], item.item_id))
    assert len(want - found) <= 0.1 * len(want)
    clean = {i for i, _ in found if i < 10_000} - {i for i, _ in want}
    assert len(clean) <= 2


def test_decontamination_recall_of_many_items(spark):
    """Copies are found however many items there are, also between words that weigh more."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(r.choices(words, k=r.randrange(16, 60)))) for k in range(1200)]
    docs = [(k, " ".join([*r.choices(words, k=r.randrange(90)), text,
                          *(f"rare{k}x{i}" for i in range(r.randrange(90)))]))
            for k, text in items]
    found = {(x["doc_id"], x["item_id"]) for x in latent.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(k, k) for k, _ in items}


def test_decontamination_of_odd_rows(odd, empty, spark):
    items = spark.createDataFrame(
        [(1, None, None), (2, "", None), (3, "too short", None), (3, "one", "x"),
         (4, "this is a question of seven words", "seven words"), (None, "nobody asked " * 4, None)],
        "item_id long, text string, answer string")
    assert latent.contaminated(odd, items).count() == 0
    assert latent.contaminated(empty, items).count() == 0
    assert latent.contaminated(odd, items.limit(0)).count() == 0
    held = odd.select("doc_id", F.lit("so This IS a question, of seven words?").alias("text"))
    rows = latent.contaminated(held, items).collect()
    assert len(rows) == odd.count() and {r["item_id"] for r in rows} == {4}
    assert {r["answered"] for r in rows} == {True}


def test_short_items_and_scripts_without_spaces(spark):
    """Items of two to four words are held where they come as they are; each wide character of an
    item without spaces is a word."""
    items = spark.createDataFrame(
        [(1, "two words"), (2, "one"), (3, "北京是中国的首都城市"), (4, "here are four words")],
        "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "Some two WORDS here."), (2, "two other words, one"), (3, "他说北京是中国的首都城市。对"),
         (4, "here are four, words"), (5, "two"), (6, "words two"), (7, "北京 city")],
        "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in latent.contaminated(docs, items).collect()}
    assert found == {(1, 1), (3, 3), (4, 4)}


def test_changed_copies_by_the_latent_space_alone(spark):
    """Without the look-up of runs, the space finds most copies in which words were changed; with
    it, all (`test_decontamination_recall`)."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(
        "/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(400).collect()]
    rows = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    items = latent.items_of([(r["item_id"], r["text"], None) for r in rows])
    r, texts = random.Random(8), [(t or "").encode() for _, t in docs]
    hosts = [t for t in texts if len(t.split()) > 30]
    planted = []
    for k, row in enumerate(rows):
        words = row["text"].encode().split()
        for at in r.sample(range(len(words)), len(words) // 7):
            words[at] = b"changed"
        own = hosts[k].split()
        at = r.randrange(len(own) + 1)
        planted.append(b" ".join(own[:at] + words + own[at:]))
    weight = latent.term_weights(spark.createDataFrame(docs, "doc_id long, text string"))
    space = latent.latent_space(spark.createDataFrame(docs, "doc_id long, text string"), weight)
    index = latent.Index(items, *latent.segments(items), weight, space)
    index.runs = []
    found = {(t, item) for t, item, *_ in index.search(planted)}
    assert sum((k, row["item_id"]) in found for k, row in enumerate(rows)) >= 0.7 * len(rows)
    index = latent.Index(items, *latent.segments(items), weight, space)
    found = {(t, item) for t, item, *_ in index.search(planted)}
    assert all((k, row["item_id"]) in found for k, row in enumerate(rows))


def test_latent_space_spans_the_passages(spark):
    """The products of passages in the space are those of an exact decomposition."""
    r = random.Random(2)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(4)]
    texts = [" ".join(r.choices(topics[k % 4], k=32)) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weight = latent.term_weights(docs)
    space = latent.latent_space(docs, weight, rank=8, more=16)
    term, starts, inverse = latent._passages([t.encode() for t in texts], weight ** 2)
    dense = np.zeros((len(starts), latent.TERMS))
    np.add.at(dense, (np.repeat(np.arange(len(starts)), 32), term), weight[term])
    dense *= inverse[:, None]
    exact = np.linalg.svd(dense, full_matrices=False)
    # The first four directions tell the topics apart; these the random range must have.
    angle = np.linalg.svd(np.linalg.qr(space.astype(float))[0].T @ exact[2][:4].T)[1]
    assert angle.min() > 0.99
    assert np.allclose(np.linalg.norm(dense @ space, axis=0)[:4], 1, atol=0.02)


def test_long_texts_are_searched_some_blocks_at_once(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = latent.items_of([(x["item_id"], x["text"], None) for x in rows])
    weight = latent.term_weights(docs)
    index = latent.Index(items, *latent.segments(items), weight, latent.latent_space(docs, weight))
    index.runs = []
    long = " ".join([x["text"] or "" for x in docs.orderBy("doc_id").collect()]
                    + [x["text"] for x in rows]).encode()
    whole = {(t, k) for t, k, *_ in index.search([long, b"", long[:3000]])}
    monkeypatch.setattr(latent, "AT_ONCE", 7)
    assert {(t, k) for t, k, *_ in index.search([long, b"", long[:3000]])} == whole
    assert len(whole) >= 0.7 * len(rows)


# -- tokens -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as file:
        return bpe.coder(file.read(), PATTERN)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_encoding_equals_the_library(documents, library, own):
    for row in documents.collect():
        assert ids(own.encode(row["text"])) == library.encode_ordinary(row["text"])


def test_encoding_of_random_text(library, own):
    r = random.Random(6)
    letters = "abcehlorst  '\n\t\r\x1c\x85\xa0 éüßñ中日🎉😀‍0123456789!!!...$$%%==aaaa AAAA'll\x00　"
    for _ in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(50)))
        text += r.choice(letters) * r.choice([0, 0, 0, 700])
        assert ids(own.encode(text)) == library.encode_ordinary(text), text
        assert own.decode(own.encode(text)) == text


def test_states_are_made_anew(library, own, monkeypatch, documents):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    for row in documents.limit(10).collect():
        assert ids(own.encode(row["text"])) == library.encode_ordinary(row["text"])


def test_utf8_in_pieces():
    r = random.Random(8)
    for _ in range(300):
        text = "".join(r.choice("aé中🎉\x00퟿") for _ in range(20))
        data, stream, out = text.encode(), bpe.Utf8Stream(), ""
        while data:
            n = r.randrange(1, 6)
            out, data = out + stream.feed(data[:n]), data[n:]
        assert out + stream.close() == text
    for broken in (b"\xff", b"a\xc3", b"\xe4\xb8", b"\xed\xa0\x80", b"\xf0\x9f\x8e", b"\x80\x80"):
        stream = bpe.Utf8Stream()
        out = "".join(stream.feed(broken[k:k + 1]) for k in range(len(broken))) + stream.close()
        assert out == broken.decode("utf-8", "replace")


def test_tokens_of_odd_rows(odd, empty):
    rows = bpe.decode(bpe.encode(odd, PATH, PATTERN), PATH).collect()
    assert len(rows) == odd.count()
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    assert bpe.decode(bpe.encode(empty, PATH, PATTERN), PATH).count() == 0
    unknown = odd.limit(1).select(F.lit(np.array([50_000_000], "<u4").tobytes()).alias("ids"))
    assert bpe.decode(unknown, PATH).first()["decoded"] == "�"


def test_digests(documents, library):
    from thermoline.llm.queries import QUERIES
    rows = {r["doc_id"]: r for r in QUERIES["op9_bpe"](
        documents.sparkSession, "/root/testdata/sf0.001").collect()}
    for row in documents.collect():
        want = library.encode_ordinary(row["text"] or "")
        assert rows[row["doc_id"]]["n_tokens"] == len(want)
        assert rows[row["doc_id"]]["ids_sha256"] == hashlib.sha256(
            np.array(want, "<u4").tobytes()).hexdigest()
        assert rows[row["doc_id"]]["decoded_sha256"] == hashlib.sha256(
            (row["text"] or "").encode()).hexdigest()


def test_packed_numbers_are_small_and_whole():
    numbers = np.array([0, -1, (1 << 63) - 1, -(1 << 63), 7] + [3] * 5000, np.int64)
    data = suffix_merge.packed(numbers)
    assert suffix_merge.unpacked(data).tolist() == numbers.tolist() and len(data) < 500
    assert suffix_merge.unpacked(suffix_merge.packed(numbers[:0])).tolist() == []


def test_sums_over_ranges_of_any_length():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 32, 33, 5000, 2, 1, 64, 1100])
    starts, table = np.cumsum(sizes) - sizes, rng.normal(size=(50, 7)).astype(np.float32)
    rows = rng.integers(0, 50, sizes.sum())
    own = latent._projected(rows, starts, table)
    want = [table[rows[a:a + n]].astype(float).sum(0) for a, n in zip(starts, sizes, strict=True)]
    assert own.dtype == np.float32 and np.abs(own - want).max() < 1e-3
    assert latent._projected(rows[:0], starts[:0], table).shape == (0, 7)
