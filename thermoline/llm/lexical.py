"""Ranked lexical search by pipelined term partitioning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermoline.llm.common import FOLD, blocks, library_path
from thermoline.session import materialize

#: Documents of a result list.
TOP = 20

#: Documents of a slice, and (item, term) pairs of a bundle, on average.
SLICE, BUNDLE = 8192, 50_000

#: Owners of terms, in the order that bundles pass them: each has the terms that up to this share
#: of the documents hold, the last one all others. Rare terms come first: what bundles carry from
#: one owner to the next stays sparse.
OWNERS = (1 / 256, 1 / 16, 1 / 4, 1.0)

_SPACE = 32
_TERMS = bytes(b if b >= 128 or chr(b).isalnum() else _SPACE for b in FOLD)
_PIECE = 8 << 20


def count_terms(text: bytes) -> Counter:
    """How often each term comes in the text; long texts are counted in pieces."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        piece = text[at:at + _PIECE].translate(_TERMS)
        end = len(piece)
        if at + end < len(text):
            cut = piece.rfind(b" ")
            while cut < 0:  # one term as long as that
                end = min(len(text) - at, end + _PIECE)
                piece = text[at:at + end].translate(_TERMS)
                cut = end if at + end == len(text) else piece.rfind(b" ")
            piece, end = piece[:cut], cut
        counts.update(piece.split())
        at += max(end, 1)
    return counts


def term_counts(rows: DataFrame) -> DataFrame:
    """(row, id, n, term, tf) for each different term of each row of (row, id, text), and one with
    the empty term, whose tf is n, the number of all its terms."""
    library_path(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for a, b in blocks([len(t) for t in texts], 1 << 20):
                counts = [count_terms(t) for t in texts[a:b]]
                total = [c.total() for c in counts]
                sizes = [len(c) + 1 for c in counts]
                part = batch.slice(a, b - a)
                at = pa.array(np.repeat(np.arange(b - a), sizes))
                terms = [t for c in counts for t in (b"", *c)]
                tf = [v for c, n in zip(counts, total, strict=True) for v in (n, *c.values())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(at), part.column("id").take(at),
                     pa.array(total, pa.int64()).take(at),
                     pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())],
                    ["row", "id", "n", "term", "tf"])

    return rows.mapInArrow(run, "row long, id long, n long, term string, tf long")


def _rows(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("row"),
                     F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))


_BUNDLE = ("block int, slice int, q_item array<long>, q_term array<long>, q_times array<long>, "
           "q_owner array<int>, a_item array<long>, a_row array<long>, a_doc array<long>, "
           "a_score array<long>")
_FOUND = "item long, doc_id long, row long, score long"


def _list(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _docs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which of them are null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return (column.fill_null(0).to_numpy(zero_copy_only=False),
            column.is_null().to_numpy(zero_copy_only=False))


def _best(score: np.ndarray, doc: np.ndarray, none: np.ndarray, row: np.ndarray,
          top: int) -> np.ndarray:
    """Places of the `top` highest scores, equal ones by document (null first) and row."""
    some = np.arange(len(score))
    if len(some) > top:
        some = some[score >= np.partition(score, -top)[-top]]
    return some[np.lexsort((row[some], doc[some], ~none[some], -score[some]))][:top]


def serve(bundle: pa.Table, postings: pa.Table, owner: int, top: int | None) -> list:
    """One owner's work on one bundle: adds what its terms give each document of the slice to the
    bundle's accumulators. Returns the columns of the bundle for the next owner or, with `top`,
    those of each item's best documents of the slice."""
    item, term, times, owners = (_list(bundle, f"q_{x}") for x in ("item", "term", "times", "owner"))
    a_item, a_row, a_score = (_list(bundle, f"a_{x}") for x in ("item", "row", "score"))
    a_doc, a_none = _docs(bundle.column("a_doc").combine_chunks().flatten())
    order = np.argsort(postings.column("term").to_numpy(), kind="stable")
    p_term, p_row, p_gain = (postings.column(x).to_numpy()[order] for x in ("term", "row", "gain"))
    p_doc, p_none = (x[order] for x in _docs(postings.column("doc_id")))
    rows, first, place = np.unique(np.concatenate([a_row, p_row]), return_index=True,
                                   return_inverse=True)
    doc, none = np.concatenate([a_doc, p_doc])[first], np.concatenate([a_none, p_none])[first]
    held, came = place[:len(a_row)], place[len(a_row):]
    begins, ends = np.searchsorted(p_term, term), np.searchsorted(p_term, term, "right")
    mine = np.flatnonzero((owners == owner) & (ends > begins))
    by_item = np.argsort(a_item, kind="stable")
    sums = np.zeros(len(rows), np.int64)
    out = []
    for q in np.unique(np.concatenate([item, a_item])):  # an item may have no term left to serve
        sums[:] = 0
        a, b = np.searchsorted(a_item[by_item], [q, q + 1])
        sums[held[by_item[a:b]]] = a_score[by_item[a:b]]
        for k in mine[item[mine] == q]:
            # A row has a term once, so no place comes twice.
            sums[came[begins[k]:ends[k]]] += times[k] * p_gain[begins[k]:ends[k]]
        some = np.flatnonzero(sums > 0)
        if top is not None:
            some = some[_best(sums[some], doc[some], none[some], rows[some], top)]
        out.append((np.full(len(some), q, np.int64), rows[some], some, sums[some]))
    items, found, at, scores = (
        np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out, strict=True)
                                                                    if out else [()] * 4))
    docs = pa.array(doc[at], pa.int64(), mask=none[at])
    if top is not None:
        return [pa.array(items), docs, pa.array(found), pa.array(scores)]
    rest = owners != owner

    def whole(values) -> pa.Array:
        values = values if isinstance(values, pa.Array) else pa.array(values)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return [bundle.column("block").combine_chunks(), bundle.column("slice").combine_chunks(),
            whole(item[rest]), whole(term[rest]), whole(times[rest]), whole(owners[rest]),
            whole(items), whole(found), whole(docs), whole(scores)]


def _stage(owner: int, top: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = [f.split()[0] for f in (_BUNDLE if top is None else _FOUND).split(", ")]

    def stage(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        return pa.table(serve(bundle, postings, owner, top), names)

    return stage


def search(docs: DataFrame, items: DataFrame, top: int = TOP, per_slice: int = SLICE,
           per_bundle: int = BUNDLE) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents with a score above 0 of each row of
    `items` (item_id, text), among all rows of `docs` (doc_id, text).

    Terms are runs of letters, digits and bytes beyond ASCII, A-Z lowered. Postings of the items'
    terms are cut into slices of documents by a hash of the row and given to owners of terms by
    frequency. Items go in bundles, one for each slice: it carries the items' terms and sparse
    accumulators (item, document, score) from owner to owner, where a cogroup with the owner's
    postings of the slice adds whole numbers. The last owner keeps a slice's best `top` of an
    item, which are compared at the end. So a term that all documents hold is spread over all
    slices; a task holds one bundle and one slice of one owner's postings; every document that
    holds a term of the item is scored.

    Each row is a document or item of its own: repeated rows are listed as often, equal scores by
    doc_id (null first). Rows with null or empty text, or without a term, are in no list and not
    counted in N; items without text get no row. Other columns are not read. Empty tables give an
    empty result. Scores are exact in 64 bits.
    """
    spark = docs.sparkSession
    wanted = materialize(term_counts(_rows(items, "item_id")), "items")
    pairs = wanted.where("term <> ''").withColumn("item", F.col("row"))
    per_term = pairs.select("term").distinct().unionAll(
        spark.range(1).select(F.lit("").alias("term")))
    held = materialize(term_counts(_rows(docs, "doc_id")).join(per_term, "term", "left_semi"),
                       "postings")
    count, total = held.where("term = '' and tf > 0").agg(
        F.count("*"), F.coalesce(F.sum("tf"), F.lit(0))).first()
    slices = max(1, -(-count // per_slice))
    bundles = max(1, -(-pairs.count() // per_bundle))

    share = F.col("df") / F.lit(float(max(count, 1)))
    owner = F.lit(len(OWNERS) - 1)
    for k in reversed(range(len(OWNERS) - 1)):
        owner = F.when(share <= OWNERS[k], k).otherwise(owner)
    weight = F.floor(1000.0 * F.log(
        F.lit(float(2 * count + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    known = materialize(
        held.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
        .select("term", F.monotonically_increasing_id().alias("no"), weight.alias("weight"),
                owner.cast("int").alias("owner")), "terms")

    block = F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int")
    queries = materialize(pairs.join(known, "term").select(
        block.alias("block"), "item", "no", F.col("tf").alias("times"), "owner"), "queries")
    # A list a bundle: about `per_bundle` pairs, or one item's different terms.
    carried = queries.groupBy("block").agg(F.collect_list(
        F.struct("item", "no", "times", "owner")).alias("q"))
    empty = F.array().cast("array<long>")
    bundle = carried.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
        *[F.col(f"q.{c}").alias(f"q_{name}") for c, name in (
            ("item", "item"), ("no", "term"), ("times", "times"), ("owner", "owner"))],
        *[empty.alias(f"a_{c}") for c in ("item", "row", "doc", "score")])

    m = 75 + F.expr(f"(25 * n * {count}L) div {max(total, 1)}L")
    # The cogroup's key: which bundles ask for a term is known before postings are shuffled.
    asked = known.join(queries.select("block", "no").distinct(), "no")
    gains = held.where("term <> ''").join(asked, "term").withColumn("m", m).select(
        "owner", "block", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"),
        F.col("no").alias("term"), "row", F.col("id").alias("doc_id"),
        (F.col("weight") * F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)")).alias("gain"))
    gains = materialize(gains, "gains")

    for k in range(len(OWNERS)):
        best = top if k == len(OWNERS) - 1 else None
        owned = gains.where(F.col("owner") == k).drop("owner")
        bundle = bundle.groupBy("block", "slice").cogroup(
            owned.groupBy("block", "slice")).applyInArrow(
                _stage(k, best), _BUNDLE if best is None else _FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row")
    ranked = bundle.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = wanted.where("term = ''").select(F.col("row").alias("item"), F.col("id").alias("item_id"))
    return ranked.join(named, "item").select("item_id", "rank", "doc_id", "score")


def sql(top: int = TOP) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def terms(key: str, table: str) -> str:
        return (rf"SELECT {key}, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), "
                rf"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM {table}")

    return f"""
WITH d AS (SELECT doc_id, term, count(*) AS tf FROM ({terms('doc_id', 'documents')})
           GROUP BY doc_id, term),
i AS (SELECT item_id, term, count(*) AS times FROM ({terms('item_id', 'benchmark')})
      GROUP BY item_id, term),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM d GROUP BY doc_id),
t AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM len),
f AS (SELECT term, count(*) AS df FROM d GROUP BY term),
w AS (SELECT term, floor(1000.0::DOUBLE * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
             AS w FROM f, t),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf)
         // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN d USING (term) JOIN len USING (doc_id), t
  GROUP BY item_id, doc_id),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER
             AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {top}
"""
