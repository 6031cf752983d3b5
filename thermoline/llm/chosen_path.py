"""Near-duplicate documents by a chosen-path set similarity join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermoline.llm.common import (
    FOLD,
    arrow_groups,
    blocks,
    library_path,
    mix,
    sheltered,
    words_by_text,
)
from thermoline.llm.components import connected_components
from thermoline.session import materialize

#: Minwise tokens a document, independent trees, the deepest level of a tree, and the trees whose
#: large nodes are followed first.
COORDS, TREES, DEPTH, LEAD = 64, 10, 6, 2

#: Documents of a node that is compared exhaustively; times so many (and pairs so many times) once
#: groups are known and only pairs across them count; documents and shingles that are compared
#: exactly in one task.
NODE, KNOWN, CELL_DOCS, CELL_SHINGLES = 128, 64, 512, 4_000_000

#: Documents of a large group that are compared with all others of it first.
PIVOTS = 8

MADE = ["n_shingles", "component_id", "kept"]

_STEPS = mix(np.arange(1, COORDS + 1, dtype=np.uint64)) | np.uint64(1)
_MASKS = mix(np.arange(1001, COORDS + 1001, dtype=np.uint64))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's sorted set of hashed shingles of `size` words, A-Z in lower case. Fewer words
    are one shingle, no words none."""
    out = []
    for first, end in blocks([len(t) for t in texts], 1 << 20):
        hashes, begins = words_by_text([t.translate(FOLD) for t in texts[first:end]])
        code = np.full(max(0, len(hashes) - size + 1), 0, np.uint64)
        for k in range(size):
            code = mix(code + hashes[k:k + len(code)] + np.uint64(k + 1))
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            if b - a >= size:
                out.append(np.unique(code[a:b - size + 1]))
            elif b > a:
                own = np.zeros(1, np.uint64)
                for h in hashes[a:b]:
                    own = mix(own * np.uint64(3) + h)
                out.append(own ^ np.uint64(b - a))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, sig, mh): size of the shingle set, 128 bits that equal sets share, and the upper
    32 bits of the smallest value in the set under each of COORDS permutations, one after another."""
    library_path(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for first, end in blocks([len(t or b"") for t in texts], 2 << 20):
                sets = shingle_sets([t or b"" for t in texts[first:end]], shingle)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                sig, mh = [None] * len(sets), [None] * len(sets)
                if len(full):
                    joint = np.concatenate([sets[i] for i in full])
                    at = np.cumsum([0, *sizes[full][:-1]])
                    least = np.empty((len(full), COORDS), np.uint64)
                    for k in range(COORDS):
                        least[:, k] = np.minimum.reduceat((joint ^ _MASKS[k]) * _STEPS[k], at)
                    packed = (least >> np.uint64(32)).astype(">u4")
                    sums = np.stack([np.add.reduceat(mix(joint + np.uint64(c)), at)
                                     for c in (11, 29)], 1)
                    for row, i in enumerate(full):
                        sig[i], mh[i] = sums[row].tobytes(), packed[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first),
                     pa.array(sizes, pa.int64()), pa.array(sig, pa.binary()),
                     pa.array(mh, pa.binary())], ["doc_id", "n", "sig", "mh"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, sig binary, mh binary")


def _children(rows: DataFrame, level: int, similarity: float) -> DataFrame:
    """Each (node, id, mh) in the node's children: one for each coordinate that the node chose.
    A label is carried along.

    A node takes one or two of the coordinates, 1 / similarity on average, so that two documents
    of that similarity meet in one child on average, on every level.
    """
    node, mh = F.col("node"), F.col("mh")
    if level == 0:  # trees begin with coordinates of their own
        first = node * 6 % COORDS
    else:
        first = F.pmod(F.xxhash64(node, F.lit(level)), F.lit(COORDS))
    twice = F.pmod(F.xxhash64(node, F.lit(-level - 1)), F.lit(1000)) < int(1000 / similarity - 1000)
    step = 1 + F.pmod(F.xxhash64(node, F.lit("step")), F.lit(COORDS - 1))
    chosen = F.when(twice, F.array(first, (first + step) % COORDS)).otherwise(F.array(first))
    label = [F.col("label")] if "label" in rows.columns else []
    out = rows.select("node", "id", "mh", *label, F.explode(chosen).alias("coord"))
    token = F.substring(mh, (4 * F.col("coord") + 1).cast("int"), F.lit(4))
    tree = [node.alias("tree")] if level == 0 else []
    return out.select(F.xxhash64(node, "coord", token).alias("node"), "id", *label, *tree)


def _deeper(large: DataFrame, tokens: DataFrame,
            similarity: float) -> tuple[list[DataFrame], DataFrame | None]:
    """Small nodes below `large` ones (node, id, perhaps label), and what is still large at the last
    level."""
    small = []
    for level in range(1, DEPTH):
        if large.isEmpty():
            return small, None
        rows = materialize(_children(large.join(tokens, "id"), level, similarity),
                           f"children{level}")
        held = _sized(rows, f"level{level}")
        small.append(held.where("few"))
        large = held.where("not few").drop("few")
    return small, large


def _sized(rows: DataFrame, name: str) -> DataFrame:
    """The nodes that may link documents anew, with `few`: whether they are compared exhaustively.
    Documents of one label are linked already; only those outside a node's largest label are
    compared with all others."""
    if "label" in rows.columns:
        sizes = rows.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node").agg(
            F.sum("n").alias("size"), F.max("n").alias("most"))
        few = (F.col("size") <= KNOWN * NODE) & (
            F.col("size") * (F.col("size") - F.col("most")) <= KNOWN * NODE * NODE)
    else:
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).withColumn("most", F.lit(1))
        few = F.col("size") <= NODE
    sizes = sizes.where("size > most").select("node", few.alias("few"))
    return materialize(rows.join(sizes, "node"), name)


def _candidates(reps: DataFrame, similarity: float, agree: int) -> DataFrame:
    """(id, component): groups of documents that may be similar.

    All trees take their first step together. Where nodes stay large, as those of many edited
    copies of one text do in every tree, the first LEAD trees go on alone. What they connect is one
    label for the other trees, which go on with the nodes that hold several, and only until the
    documents outside a node's largest group are few enough to be compared with all of it.
    """
    tokens = reps.select("id", "mh")
    trees = F.sequence(F.lit(0).cast("long"), F.lit(TREES - 1).cast("long"))
    rows = _children(tokens.select(F.explode(trees).alias("node"), "id", "mh"), 0, similarity)
    held = _sized(rows, "level0")
    small, large = held.where("few"), held.where("not few")

    def edges(nodes: list[DataFrame], dense: DataFrame | None) -> DataFrame:
        parts = [rows.select("node", "id", _label(rows)) for rows in nodes]
        union = parts[0]
        for more in parts[1:]:
            union = union.unionAll(more)
        out = union.join(tokens, "id").select("node", "label", "mh").repartition(
            "node").sortWithinPartitions("node").mapInArrow(_agreeing(agree), "a long, b long")
        if dense is not None:
            dense = dense.select("node", _label(dense))
            centre = dense.groupBy("node").agg(F.min("label").alias("a"))
            out = out.unionAll(dense.join(centre, "node").where("a != label").select(
                "a", F.col("label").alias("b")))
        return out

    more, dense = _deeper(large.where(F.col("tree") < LEAD).select("node", "id"), tokens,
                          similarity)
    groups = materialize(connected_components(edges([small, *more], dense)), "groups")
    large = large.where(F.col("tree") >= LEAD).select("node", "id")
    if large.isEmpty():
        return groups
    held = _sized(large.join(groups, "id", "left").select(
        "node", "id", F.coalesce("component", "id").alias("label")), "labelled")
    more, dense = _deeper(held.where("not few").drop("few"), tokens, similarity)
    known = groups.select(F.col("id").alias("a"), F.col("component").alias("b"))
    return materialize(connected_components(known.unionAll(
        edges([held.where("few"), *more], dense))), "groups")


def _label(rows: DataFrame):
    return F.col("label" if "label" in rows.columns else "id").alias("label")


def _agreeing(limit: int):
    """For each small node a forest over its labels: those whose documents' tokens agree in `limit`
    coordinates. Documents outside the largest label are compared with all others."""

    def edges(label: np.ndarray, mh: np.ndarray) -> list[tuple[int, int]]:
        names, code, sizes = np.unique(label, return_inverse=True, return_counts=True)
        rest = np.flatnonzero(code != sizes.argmax())
        alike = np.zeros((len(names), len(names)), bool)
        for u in rest:
            alike[code[u], code[(mh == mh[u]).sum(1) >= limit]] = True
        return [(names[a], names[b]) for a, b in stars(alike | alike.T)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node in arrow_groups(batches, "node"):
            out = edges(np.array(node["label"]),
                        np.frombuffer(b"".join(node["mh"]), ">u4").reshape(-1, COORDS))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in out], pa.int64()),
                     pa.array([b for _, b in out], pa.int64())], ["a", "b"])
    return run


def stars(linked: np.ndarray) -> list[tuple[int, int]]:
    """(least, other) for each connected group of a symmetric table of links."""
    todo, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        queue = [start] if todo[start] else []
        todo[start] = False
        while queue:
            near = np.flatnonzero(linked[queue.pop()] & todo)
            todo[near] = False
            queue.extend(near.tolist())
            out.extend((start, int(v)) for v in near)
    return out


def _verify(shingle: int, percent: int):
    """Links (of labels) within each cell: forests of the pairs whose full sets are similar enough.
    Rows of one `side` of a cell (0 or 1) are compared with the other side only, those of side 2
    with all; documents that have one `label` already are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in arrow_groups(batches, "cell"):
            label = np.array(cell["label"])
            sets = shingle_sets(cell["text"], shingle)
            links = _forest(intersections(sets), np.array([len(s) for s in sets]),
                            label, np.array(cell["side"]), percent)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[list(a)]), pa.array(label[list(b)])], ["a", "b"])
    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections, exactly: products of blocks of the 0/1 table of shingles
    that two or more sets share."""
    joint = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(joint, kind="stable")
    joint, owner = joint[order], owner[order]
    new = np.r_[True, joint[1:] != joint[:-1]] if len(joint) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1 if len(column) else np.zeros(0, bool)
    take = shared[column] if len(column) else np.zeros(0, bool)
    column, owner = (np.cumsum(shared) - 1)[column[take]], owner[take]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        table = np.zeros((len(sets), 4096), np.float32)
        table[owner[a:b], column[a:b] - at] = 1
        out += table @ table.T
    return out


def _forest(common: np.ndarray, sizes: np.ndarray, label: np.ndarray, side: np.ndarray,
            percent: int) -> list[tuple[int, int]]:
    union = sizes[:, None] + sizes[None, :] - common
    linked = (100 * common >= percent * union) & (label[:, None] != label[None, :])
    linked &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    return stars(linked)


def _check(cells: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) of labels that full sets confirm in `cells` (cell, id, label, side)."""
    rows = cells.join(texts, "id").select("cell", "label", "side", "text")
    return rows.repartition("cell").sortWithinPartitions("cell", "label").mapInArrow(
        _verify(shingle, percent), "a long, b long")


def _pivots(members: DataFrame, tokens: DataFrame) -> DataFrame:
    """(comp, id): of each group the documents whose tokens agree most often with the most common
    token of the group in each coordinate. Of a text and its edited copies that is the text."""
    each = members.join(tokens, "id").select("comp", "id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(COORDS - 1)),
        lambda i: F.substring("mh", 4 * i + 1, F.lit(4)))).alias("coord", "token"))
    counts = each.groupBy("comp", "coord", "token").agg(F.count("*").alias("n"))
    best = counts.groupBy("comp", "coord").agg(
        F.max(F.struct("n", "token"))["token"].alias("token"))
    agree = each.join(best, ["comp", "coord", "token"]).groupBy("comp", "id").agg(
        F.count("*").alias("n"))
    order = Window.partitionBy("comp").orderBy(F.desc("n"), "id")
    return agree.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= PIVOTS).select("comp", "id")


def _links(reps: DataFrame, texts: DataFrame, candidates: DataFrame, shingle: int,
           percent: int) -> DataFrame:
    """Confirmed links within the groups of `candidates` (id, component): enough of them to hold
    together all documents that any pair of similar ones connects."""
    members = candidates.select("id", F.col("component").alias("comp")).join(
        reps.select("id", "n", "mh"), "id")
    members = materialize(members, "members")
    sizes = members.groupBy("comp").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    large = (F.col("docs") > CELL_DOCS) | (F.col("shingles") > CELL_SHINGLES)
    small = members.join(sizes.where(~large), "comp").select(
        F.xxhash64("comp").alias("cell"), "id", F.col("id").alias("label"), F.lit(2).alias("side"))
    big = materialize(members.join(sizes.where(large), "comp"), "large")
    if big.isEmpty():
        return _check(small, texts, shingle, percent)
    # A large group: parts of it, each with the pivots, give most links; what these leave apart is
    # compared block by block.
    parts = F.greatest(F.ceil(F.col("docs") / (CELL_DOCS // 2)),
                       F.ceil(F.col("shingles") / (CELL_SHINGLES // 2)))
    placed = big.select("comp", "id", "docs", "shingles", parts.alias("parts"))
    pivots = _pivots(big.select("comp", "id"), reps.select("id", "mh"))
    dealt = placed.select("comp", "id", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    spread = pivots.join(placed.select("comp", "parts").distinct(), "comp").select(
        "comp", "id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    first = dealt.unionAll(spread).distinct().select(
        F.xxhash64("comp", "part").alias("cell"), "id", F.col("id").alias("label"),
        F.lit(2).alias("side"))
    found = connected_components(_check(small.unionAll(first), texts, shingle, percent))
    return found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(
        _rest(placed, found, texts, shingle, percent))


def _rest(placed: DataFrame, labels: DataFrame, texts: DataFrame, shingle: int,
          percent: int) -> DataFrame:
    """Links between the components `labels` (id, component) of large groups: all documents outside
    a group's largest component are compared with all others, block against block."""
    marked = placed.join(labels, "id", "left").withColumn(
        "label", F.coalesce("component", "id"))
    marked = materialize(marked, "marked")
    counts = marked.groupBy("comp", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("comp").agg(F.max(F.struct("c", F.col("label").alias("main"))).alias(
        "m"), F.sum("c").alias("all")).select("comp", "m.*", "all").where("c < all")
    # The blocks of either side hold half a cell.
    per = F.least(F.lit(CELL_DOCS), F.greatest(F.lit(1), F.floor(
        CELL_SHINGLES / 2 / (F.col("shingles") / F.col("docs")))))
    sided = marked.join(main, "comp").withColumn("rest", F.col("label") != F.col("main"))
    sided = sided.withColumns({
        "na": F.ceil(F.col("c") / per), "nb": F.ceil((F.col("all") - F.col("c")) / per)})
    sided = sided.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.when(
        F.col("rest"), F.col("nb")).otherwise(F.col("na"))))
    # A block of the rest meets every block of the main part and each block of the rest; one of
    # the main part meets those of the rest.
    meets = F.when(F.col("rest"), F.concat(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("na") - 1), lambda i: F.struct(
            F.col("block").alias("x"), i.alias("y"), F.lit(True).alias("main"),
            F.lit(0).alias("side"))),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1), lambda i: F.struct(
            F.least("block", i).alias("x"), F.greatest("block", i).alias("y"),
            F.lit(False).alias("main"),
            F.when(i == F.col("block"), 2).when(i < F.col("block"), 1).otherwise(0).alias("side")))
    )).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1), lambda i: F.struct(
        i.alias("x"), F.col("block").alias("y"), F.lit(True).alias("main"),
        F.lit(1).alias("side"))))
    cells = sided.select("comp", "id", "label", F.explode(meets).alias("m")).select(
        F.xxhash64("comp", "m.x", "m.y", "m.main").alias("cell"), "id", "label", "m.side")
    return _check(cells, texts, shingle, percent)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """All columns with n_shingles, component_id and kept: documents are linked if their sets of
    hashed shingles share at least `percent` hundredths of their union; a component is what links
    connect, named by its smallest doc_id, whose row alone is kept.

    Equal sets are joined first, so that copies, however many, are one document from then on. The
    others are branched in TREES independent trees by chosen minwise tokens; nodes of up to NODE
    documents are compared by their tokens, larger ones branch on, and what is large at the last
    level counts as one candidate group. Groups of candidates are then compared on their full
    sets: all pairs of a group that fits a task; of a larger one first parts with pivots, and then
    every pair of blocks that is not connected yet. A pair of the least similarity is missed if no
    tree keeps it together: below 1 in 10,000 with ten trees and three levels; or if its tokens
    agree in fewer coordinates than 4.3 standard deviations below the mean.

    No words (null or empty text): nothing is linked and the row is kept. A null doc_id: component
    null, kept, linked with nothing. Rows with one doc_id are one document: its component is what
    either text is linked with, n_shingles that of the longer one, and all are kept or none. Ties and repeated
    rows make no difference. An empty table gives an empty one. Null, extra and clashing columns
    pass through, but for those that the result makes.
    """
    similarity = percent / 100
    agree = math.floor(COORDS * similarity
                       - 4.3 * math.sqrt(COORDS * similarity * (1 - similarity)))
    all_ = materialize(sketches(docs, shingle), "sketches")
    usable = all_.where("n > 0 and doc_id is not null")
    reps = materialize(
        usable.groupBy("sig", "n").agg(F.min(F.struct("doc_id", "mh")).alias("m"))
        .select("sig", "n", F.col("m.doc_id").alias("id"), "m.mh"), "reps")
    groups = _candidates(reps, similarity, agree)
    texts = docs.where("doc_id is not null").select(
        F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias(
            "text")).join(groups.select("id"), "id", "left_semi")
    texts = materialize(texts, "texts")
    found = connected_components(_links(reps, texts, groups, shingle, percent))
    by_set = reps.join(found, "id", "left").select(
        F.col("sig").alias("_sig"), F.col("n").alias("_n"),
        F.coalesce("component", "id").alias("component"))
    rows = all_.where("doc_id is not null").select("doc_id", "n", "sig").distinct().join(
        by_set, (F.col("sig") == F.col("_sig")) & (F.col("n") == F.col("_n")), "left").select(
            "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    return _result(docs, rows)


def _result(docs: DataFrame, rows: DataFrame) -> DataFrame:
    by_id = rows.groupBy(F.col("doc_id").alias("_id")).agg(
        F.max("n").alias("n"), F.min("component").alias("component"))
    mine, names = sheltered(docs, MADE)
    return mine.join(by_id, F.col("doc") == F.col("_id"), "left").select(
        *names, F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("doc").eqNullSafe(F.col("component")).alias("kept"))
