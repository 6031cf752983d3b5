"""Benchmark decontamination: latent semantic search, then common subsequences and answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoline.llm.common import (
    FOLD,
    blocks,
    library_path,
    mix,
    words_by_text,
)

#: Hashed terms.
TERMS = 1 << 14

#: Words of a block; passages are windows of so many blocks, one from each block on.
BLOCK, WINDOWS = 16, (2, 4)

#: Dimensions of the latent space, and how many more the range finder draws.
RANK, MORE = 32, 8

#: Least cosine of a candidate in the latent space.
COSINE = 0.75

#: Marks of words by which candidates are counted before they are checked, of how many of an item's
#: rarest words first, and blocks to both sides of a chunk for which they are kept.
MARKS, RAREST, ASIDE = 1 << 10, 12, 6

#: So many words of an item in a row, found as they are, make a candidate at any cosine.
RUN = 5

#: Blocks whose cosines with all items are worked out at once.
AT_ONCE = 2048

#: Share of an item's words, in order, that marks a document; and that marks one with the answer.
SHARE, SHARE_WITH_ANSWER = 0.8, 0.6

#: Words of an item from which it is searched for word by word, and from which in one run only;
#: words of an answer if the benchmark names none.
LEAST_WORDS, LEAST_RUN, ANSWER_WORDS = 5, 2, 5

#: Items that one pass over the documents looks for.
ITEMS = 2000

_APART = np.ones(256, bool)
_APART[128:] = False
_APART[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False


# Characters of three bytes: scripts without spaces among them.
_WIDE = re.compile(rb"[\xe0-\xef][\x80-\xbf]{2}")


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where those of each text begin. Words are letters and digits, A-Z
    in lower case; characters of two or four bytes count as letters, and each of three (Chinese,
    Japanese, Thai) is a word."""
    folded = [t.translate(FOLD) for t in texts]
    return words_by_text([t if t.isascii() else _WIDE.sub(rb" \g<0> ", t) for t in folded], _APART)


def _term(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 14)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def term_weights(docs: DataFrame) -> np.ndarray:
    """Inverse frequency of each hashed term among blocks of words, counted over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TERMS, np.int64)
        for batch in batches:
            texts = _texts(batch)
            for a, b in blocks([len(t) for t in texts], 1 << 20):
                counts += np.bincount(_term(terms(texts[a:b])[0]), minlength=TERMS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros(TERMS)
    counts[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return np.log1p(counts.sum() / BLOCK / (1 + counts)).astype(np.float32)


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]

    def __post_init__(self) -> None:
        self.masks = _masks(self.words)
        self.answer_masks = _masks(self.answer)

    def shared(self, region: list[int]) -> float:
        return common_subsequence(self.masks, len(self.words), region) / len(self.words)

    def answered(self, region: list[int]) -> bool:
        return common_subsequence(self.answer_masks, len(self.answer), region) == len(self.answer)


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(masks: dict[int, int], n: int, region: list[int]) -> int:
    """Length of the longest common subsequence of n words, given by their places, and `region`:
    all of a column of the usual table is one number, updated bit-parallel."""
    full = (1 << n) - 1
    row = full
    for word in region:
        hit = row & masks.get(word, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def items_of(rows: list[tuple]) -> list[Item]:
    """Items of (item_id, text, answer); those with fewer than LEAST_RUN words are left out."""
    out = []
    hashes, begins = terms([(t or "").encode() for _, t, _ in rows])
    told, told_at = terms([(a or "").encode() for _, _, a in rows])
    for k, (item, _, _) in enumerate(rows):
        words = hashes[begins[k]:begins[k + 1]].tolist()
        answer = told[told_at[k]:told_at[k + 1]].tolist() or words[-ANSWER_WORDS:]
        if len(words) >= LEAST_RUN:
            out.append(Item(item, words, answer))
    return out


def segments(items: list[Item]) -> tuple[list[np.ndarray], np.ndarray]:
    """What is searched for: items, longer ones in parts of at most the widest window."""
    most, parts, owner = BLOCK * max(WINDOWS), [], []
    for k, item in enumerate(items):
        if len(item.words) < LEAST_WORDS:
            continue
        words = np.array(item.words, np.uint64)
        for part in np.array_split(words, -(-len(words) // most)):
            parts.append(_term(part))
            owner.append(k)
    return parts, np.array(owner, np.int64)


#: Rows that are added up before their sums are.
PIECE = 32


def _projected(rows: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of the `rows` of `table` over ranges, none of them empty, that begin at `starts`: the
    first rows of all ranges, then their second rows, and so on; long ranges in pieces."""
    sizes = np.diff(np.append(starts, len(rows)))
    per = -(-sizes // PIECE)
    ends = np.cumsum(per)
    within = np.arange(per.sum()) - np.repeat(ends - per, per)
    first = np.repeat(starts, per) + within * PIECE
    held = np.minimum(PIECE, np.repeat(sizes, per) - within * PIECE)
    order = np.argsort(-held, kind="stable")
    first, longer = first[order], np.cumsum(np.bincount(held, minlength=PIECE + 1)[::-1])[::-1]
    out = np.zeros((len(first), table.shape[1]), np.float32)
    for j in range(PIECE if len(first) else 0):
        n = longer[j + 1]
        if not n:
            break
        out[:n] += table.take(rows[first[:n] + j], axis=0)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return out[back] if len(back) == len(starts) else _projected(back, ends - per, out)


def _starts(begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of `width` words begin in each text, and the text of each."""
    per = -(-np.diff(begins) // width)
    text = np.repeat(np.arange(len(per)), per)
    within = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return begins[text] + within * width, text


def _passages(texts: list[bytes], square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, where passages of 2 * BLOCK words begin, and one over the length of each."""
    hashes, begins = terms(texts)
    term = _term(hashes)
    starts, _ = _starts(begins, 2 * BLOCK)
    if not len(starts):
        return term, starts, np.zeros(0, np.float32)
    return term, starts, 1 / np.sqrt(np.maximum(np.add.reduceat(square[term], starts), 1e-9))


#: Parts that a sum over all tasks is cut into.
SLICES = 64


def _summed(docs: DataFrame, shape: tuple[int, int],
            add: Callable[[np.ndarray, list[bytes]], None]) -> np.ndarray:
    """The sum of what `add` adds for the texts of all rows to an array of a fixed shape. Each
    task sends its own sum in slices, which are added up slice by slice."""
    rows = -(-shape[0] // SLICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows * SLICES, shape[1]))
        for batch in batches:
            texts = _texts(batch)
            for a, b in blocks([len(t) for t in texts], 1 << 20):
                add(total, texts[a:b])
        parts = [p.astype(np.float32).tobytes() for p in total.reshape(SLICES, -1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "part"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("slice").to_pylist(), batch.column("part"), strict=True):
                one = np.frombuffer(part.as_buffer(), np.float32)
                sums[k] = sums[k] + one if k in sums else one.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()),
             pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "part"])

    schema = "slice int, part binary"
    done = docs.select("text").mapInArrow(run, schema).repartition("slice").mapInArrow(
        join, schema).toArrow()
    out = np.zeros((SLICES, rows * shape[1]))
    for k, part in zip(done["slice"].to_pylist(), done["part"].to_pylist(), strict=True):
        out[k] = np.frombuffer(part)
    return out.reshape(-1, shape[1])[:shape[0]]


def latent_space(docs: DataFrame, weight: np.ndarray, rank: int = RANK,
                 more: int = MORE) -> np.ndarray:
    """(TERMS, rank): the first right singular vectors of the matrix of TF-IDF passages (of length
    one, a passage for each 2 * BLOCK words) of all documents, each over its singular value.

    Randomised: passages meet random directions, what comes back by their terms spans the range,
    and the passages' products in that range give the values. Tasks send sums whose size hangs on
    the number of terms and directions alone.
    """
    size, square = rank + more, weight ** 2
    drawn = np.random.default_rng(11).normal(size=(TERMS, size)).astype(np.float32)
    context = docs.sparkSession.sparkContext
    first = context.broadcast((drawn * weight[:, None], weight))

    def spread(total: np.ndarray, texts: list[bytes]) -> None:
        table, own = first.value
        term, starts, inverse = _passages(texts, own ** 2)
        if not len(starts):
            return
        met = _projected(term, starts, table) * inverse[:, None] ** 2
        sizes = np.diff(np.append(starts, len(term)))
        order = np.argsort(term.astype(np.int16), kind="stable")
        some, at = np.unique(term[order], return_index=True)
        rows = np.repeat(np.arange(len(starts)), sizes)[order]
        total[some] += _projected(rows, at, met)

    back = _summed(docs, (TERMS, size), spread) * weight[:, None]
    basis = np.linalg.qr(back)[0].astype(np.float32)
    second = context.broadcast((basis * weight[:, None], square))

    def products(total: np.ndarray, texts: list[bytes]) -> None:
        table, own = second.value
        term, starts, inverse = _passages(texts, own)
        if len(starts):
            met = (_projected(term, starts, table) * inverse[:, None]).astype(np.float64)
            total[:size] += met.T @ met

    values, turn = np.linalg.eigh(_summed(docs, (size, size), products))
    order = np.argsort(-values)[:rank]
    order = order[values[order] > 1e-6 * max(values.max(initial=0.0), 1e-9)]
    return basis @ (turn[:, order] / np.sqrt(values[order])).astype(np.float32)


_STEPS = np.array([pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64) for j in range(RUN)], np.uint64)


def run_codes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A code for each run of so many words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total += hashes[j:j + n] * _STEPS[j]
    return mix(total)


class Runs:
    """Runs of one length in all items: their codes in order, and the item and place of each."""

    def __init__(self, items: list[Item], length: int, whole: bool) -> None:
        codes, owner, place = [], [], []
        for k, item in enumerate(items):
            if len(item.words) == length if whole else len(item.words) >= length:
                some = run_codes(np.array(item.words, np.uint64), length)
                codes.append(some)
                owner.append(np.full(len(some), k))
                place.append(np.arange(len(some)))
        self.length = length
        joint = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(joint, kind="stable")
        self.codes = joint[order]
        self.owner, self.place = (np.concatenate(x)[order] if x else order for x in (owner, place))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(joint & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def found(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in the text, item, place in the item) of all runs of `hashes`."""
        codes = run_codes(hashes, self.length)
        at = np.flatnonzero(self.seen[(codes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        low, high = (np.searchsorted(self.codes, codes[at], side) for side in ("left", "right"))
        for i in np.flatnonzero(high > low):
            for j in range(low[i], high[i]):
                yield int(at[i]), int(self.owner[j]), int(self.place[j])


class Index:
    """The benchmark in the latent space, its runs of words, and the check of candidates."""

    def __init__(self, items: list[Item], parts: list[np.ndarray], owner: np.ndarray,
                 weight: np.ndarray, space: np.ndarray) -> None:
        self.items, self.owner = items, owner
        self.table = space * weight[:, None]
        lengths = np.array([len(p) for p in parts], np.int64)
        at = np.cumsum(lengths) - lengths
        query = _projected(np.concatenate(parts), at, self.table) if parts else np.zeros(
            (0, space.shape[1]), np.float32)
        self.query = query / np.maximum(np.linalg.norm(query, axis=1), 1e-9)[:, None]
        # Marks of each item's words, the rarest first; shorter items repeat their last one.
        self.words = np.array([len(i.words) for i in items], np.int64)
        self.marks = np.zeros((len(items), int(self.words.max(initial=1))), np.int64)
        for row, item in zip(self.marks, items, strict=True):
            own = np.array(item.words, np.uint64)
            own = own[np.argsort(-weight[_term(own)], kind="stable")]
            row[:len(own)] = own & np.uint64(MARKS - 1)
        self.runs = [r for r in (Runs(items, n, n < LEAST_WORDS)
                                 for n in range(LEAST_RUN, RUN + 1)) if len(r.codes)]

    def search(self, texts: list[bytes]) -> list[tuple[int, int, float, bool, int, int]]:
        """(text, item, share, answered, first word, last word) of what the check confirms."""
        hashes, begins = terms(texts)
        if not len(hashes):
            return []
        found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        whole: dict[tuple[int, int], int] = {}
        for runs in self.runs:
            for place, k, within in runs.found(hashes):
                text = int(np.searchsorted(begins, place, "right")) - 1
                if place + runs.length > begins[text + 1]:
                    continue
                if runs.length < LEAST_WORDS:
                    whole.setdefault((text, k), place)
                else:
                    width = -(-len(self.items[k].words) // BLOCK)
                    found.setdefault((text, k), []).append(
                        (-2.0, max(int(begins[text]), place - within), width))
        self._near(hashes, begins, found)
        out = []
        for (t, k), windows in sorted(found.items()):
            hit = self.check(self.items[k], hashes, begins[t], begins[t + 1], windows)
            if hit:
                out.append((t, self.items[k].item_id, *hit))
        for (t, k), place in sorted(whole.items()):
            end = place + len(self.items[k].words)
            out.append((t, self.items[k].item_id, 1.0,
                        self.items[k].answered(hashes[place:end].tolist()),
                        place - int(begins[t]), end - int(begins[t])))
        return out

    def _near(self, hashes: np.ndarray, begins: np.ndarray,
              found: dict[tuple[int, int], list[tuple[float, int, int]]]) -> None:
        """Adds the windows whose cosine with an item in the latent space is COSINE or more and
        near which enough of its words stand; some blocks at once, so that a long text takes no
        more memory than many short ones."""
        if not len(self.query) or not self.query.shape[1]:
            return
        starts, text = _starts(begins, BLOCK)
        term, most = _term(hashes), max(WINDOWS) - 1
        for low in range(0, len(starts), AT_ONCE):
            high = min(len(starts), low + AT_ONCE)
            end = min(len(starts), high + most)
            first, last = starts[low], starts[end] if end < len(starts) else len(term)
            own = _projected(term[first:last], starts[low:end] - first, self.table)
            owner = text[low:end]
            near = own @ self.query.T
            held = None
            for width in WINDOWS:
                total, sums = near[:high - low].copy(), own[:high - low].copy()
                for j in range(1, width):
                    n = max(0, min(high - low, len(near) - j))
                    same = (owner[j:j + n] == owner[:n])[:, None]
                    total[:n] += near[j:j + n] * same
                    sums[:n] += own[j:j + n] * same
                length = np.maximum(np.sqrt(np.einsum("ij,ij->i", sums, sums)), 1e-9)
                at, part = np.nonzero(total >= COSINE * length[:, None])
                if not len(at):
                    continue
                if held is None:
                    held = self._held(hashes, starts, low, end)
                score = total[at, part] / length[at]
                item = self.owner[part]
                enough = self._enough(held, at, width, item)
                for b, k, c in zip(at[enough].tolist(), item[enough].tolist(),
                                   score[enough].tolist(), strict=True):
                    found.setdefault((int(owner[b]), k), []).append(
                        (-c, int(starts[low + b]), width))

    @staticmethod
    def _held(hashes: np.ndarray, starts: np.ndarray, low: int, end: int) -> np.ndarray:
        """Bits of the marks that each block has, from ASIDE blocks before `low` on."""
        a, b = max(0, low - ASIDE), min(len(starts), end + ASIDE)
        stop = starts[b] if b < len(starts) else len(hashes)
        words = hashes[starts[a]:stop]
        block = np.repeat(np.arange(b - a), np.diff(np.append(starts[a:b], stop)))
        out = np.zeros((end - low + 2 * ASIDE, MARKS), bool)
        out[block + ASIDE - (low - a), (words & np.uint64(MARKS - 1)).astype(np.int64)] = True
        return np.packbits(out, axis=1, bitorder="little")

    def _enough(self, held: np.ndarray, at: np.ndarray, width: int,
                item: np.ndarray) -> np.ndarray:
        """Of which candidates the region may hold SHARE_WITH_ANSWER of the item's words: a count
        of their marks that is never too low. Longer items than ASIDE blocks reach all stay."""
        out = np.ones(len(at), bool)
        margin = -(-np.maximum(BLOCK, self.words[item] - 2 * BLOCK) // BLOCK)
        for m in np.unique(margin[margin <= ASIDE]).tolist():
            spread = np.zeros_like(held)
            for j in range(-m, width + m):  # what any block of the region has
                a, b = max(0, -j), min(len(held), len(held) - j)
                spread[a:b] |= held[a + j:b + j]
            some = np.flatnonzero(margin == m)
            for columns in (RAREST, self.marks.shape[1]):
                n = self.words[item[some]]
                marks = self.marks[item[some], :columns]
                has = spread[(at[some] + ASIDE)[:, None], marks >> 3] >> (marks & 7) & 1
                real = np.minimum(n, columns)
                has &= np.arange(marks.shape[1]) < real[:, None]
                good = has.sum(axis=1) + (n - real) >= SHARE_WITH_ANSWER * n
                out[some[~good]] = False
                some = some[good]
        return out

    @staticmethod
    def check(item: Item, hashes: np.ndarray, begin: int, end: int,
              windows: list[tuple[float, int, int]]) -> tuple | None:
        margin = max(BLOCK, len(item.words) - 2 * BLOCK)
        seen = set()
        for _, start, width in sorted(windows):
            a = max(int(begin), start - margin)
            b = min(int(end), start + width * BLOCK + margin)
            if (a, b) in seen:
                continue
            seen.add((a, b))
            region = hashes[a:b].tolist()
            share = item.shared(region)
            if share >= SHARE_WITH_ANSWER:
                answered = item.answered(region)
                if share >= SHARE or answered:
                    return share, answered, a - int(begin), b - int(begin)
        return None


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, answered, begin, end): which documents hold which items, and in
    which words (begin inclusive, end exclusive) the check looked.

    Passages of all documents span a latent space, by a randomised singular value decomposition
    of their TF-IDF vectors (`latent_space`). In it, windows of 32 and 64 words from every 16th on
    meet the items (longer ones in parts); pairs with a cosine of COSINE or more are candidates,
    and so are places where RUN words of an item stand in a row, whatever the cosine: what a few
    dimensions lose is not lost. Candidates are checked word by word: an item is held if SHARE of
    its words come in order near the passage, or SHARE_WITH_ANSWER of them and its whole answer:
    the benchmark's column `answer`, or the item's last ANSWER_WORDS words. The items go to the
    executors in blocks of ITEMS, one pass over the documents for each.

    Null and empty texts hold nothing; items that are null or of one word are in nothing,
    those of fewer than LEAST_WORDS words where they come as they are. Texts of any length are
    searched whole, some blocks at once. Rows are independent: a repeated row is reported as often, rows without doc_id with a
    null one. Of items with equal texts each is reported. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    library_path(spark)
    schema = "doc_id long, item_id long, share double, answered boolean, begin long, end long"
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text",
                            answer.cast("string").alias("answer"))
    count = rows.count()
    weight = term_weights(docs) if count else None
    space = latent_space(docs, weight) if count else None
    out = spark.createDataFrame([], schema)
    for at in range(0, count, ITEMS):
        some = rows.orderBy("item_id", "text", "answer").offset(at).limit(ITEMS).collect()
        items = items_of([tuple(r) for r in some])
        if items:
            out = out.unionAll(_search(docs, items, weight, space, schema))
    return out


def _search(docs: DataFrame, items: list[Item], weight: np.ndarray, space: np.ndarray,
            schema: str) -> DataFrame:
    parts, owner = segments(items)
    shared = docs.sparkSession.sparkContext.broadcast(Index(items, parts, owner, weight, space))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), _texts(batch)
            for a, b in blocks([len(t) for t in texts], 1 << 20):
                hits = shared.value.search(texts[a:b])
                if hits:
                    t, *rest = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[a + i] for i in t], pa.int64()),
                         *(pa.array(list(c), kind) for c, kind in zip(rest, (
                             pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()),
                             strict=True))],
                        ["doc_id", "item_id", "share", "answered", "begin", "end"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
