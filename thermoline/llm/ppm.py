"""Language ID: prediction by partial matching over bytes, one frozen model a language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoline.llm.common import arrow_map, bounded_sample, library_path, sheltered

#: Longest context in bytes, and bounds of the sample that the models are learnt from.
ORDER = 4
SAMPLE_BYTES = 8 << 20
SAMPLE_ROWS = 1000

MADE = ["lang_pred", "score"]


def context_counts(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """How often each byte string of 1 to order + 1 bytes occurs in each language: (lang, size,
    gram, n). Strings do not cross texts."""
    library_path(sample.sparkSession)

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for size, keys in enumerate(grams(own, order + 1), 1):
                    gram, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram), pa.string()),
                         pa.array(np.full(len(gram), size), pa.int32()),
                         pa.array(gram.astype(np.int64)), pa.array(n, pa.int64())],
                        ["lang", "size", "gram", "n"])

    rows = sample.mapInArrow(count, "lang string, size int, gram long, n long")
    return rows.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def grams(texts: list[bytes], most: int) -> list[np.ndarray]:
    """For sizes 1 to `most`, all byte strings of that size within the texts, as integers."""
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(raw))
    out, keys = [], raw
    for size in range(1, most + 1):
        if size > 1:
            keys = (keys[:-1] << 8) | raw[size - 1:]
        out.append(keys[left[:len(keys)] >= size])
    return out


@dataclass
class Table:
    """Costs in bits by byte string, in a hash table with open addressing."""

    slots: np.ndarray  # key of each slot, -1 if free
    rows: np.ndarray  # row of `cost` and `leave`
    cost: np.ndarray  # of the last byte after those before it, for each language
    leave: np.ndarray  # of an escape when the string is the context; 0 where it never was one

    @classmethod
    def build(cls, keys: np.ndarray, cost: np.ndarray, leave: np.ndarray) -> Table:
        bits = max(4, int(2 * len(keys)).bit_length())
        slots, rows = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        todo = np.arange(len(keys))
        at = cls.home(keys, bits)
        while len(todo):
            # Of the keys that want one free slot, the first takes it; the others move on.
            free = slots[at[todo]] == -1
            _, first = np.unique(at[todo[free]], return_index=True)
            taken = todo[free][first]
            slots[at[taken]], rows[at[taken]] = keys[taken], taken
            todo = np.setdiff1d(todo, taken, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
        return cls(slots, rows, cost.astype(np.float32), leave.astype(np.float32))

    @staticmethod
    def home(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        mask = len(self.slots) - 1
        at = self.home(keys, mask.bit_length())
        seen = self.slots[at]
        out = np.where(seen == keys, self.rows[at], -1)
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            seen = self.slots[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.rows[at[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out


class Models:
    """The context trees of all languages side by side.

    In a context seen n times with d different bytes after it, a byte seen c times costs
    -log2(c / (n + d)) bits; another one costs an escape, -log2(d / (n + d)), and then what it costs
    in the context without its first byte. Contexts never seen cost nothing; below the empty
    context all bytes cost 8. The costs are fixed once learnt: scoring changes no count.
    """

    def __init__(self, counts: pa.Table, order: int = ORDER) -> None:
        self.order = order
        langs = counts["lang"].to_pylist()
        self.langs = sorted(set(langs))
        code = np.searchsorted(np.array(self.langs, object), np.array(langs, object)) if langs \
            else np.zeros(0, int)
        size, gram, n = (counts[c].to_numpy() for c in ("size", "gram", "n"))
        k = len(self.langs)
        self.tables: list[Table] = []
        keys_by_size, cost_by_size, leaves = [], [], []
        below_keys, below_cost = np.zeros(1, np.int64), np.full((1, k), 8.0)
        for s in range(1, order + 2):
            own = size == s
            keys, row = np.unique(gram[own], return_inverse=True)
            seen = np.zeros((len(keys), k))
            np.add.at(seen, (row, code[own]), n[own])
            context, at = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(context), k)), np.zeros((len(context), k))
            np.add.at(total, at, seen)
            np.add.at(kinds, at, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                told = -np.log2(seen / (total + kinds)[at])
            shorter = below_cost[np.searchsorted(below_keys, keys & ((1 << 8 * (s - 1)) - 1))]
            cost = np.where(seen > 0, told, escape[at] + shorter)
            leave = np.zeros((len(below_keys), k))
            leave[np.searchsorted(below_keys, context)] = escape
            keys_by_size.append(keys)
            cost_by_size.append(cost)
            leaves.append(leave)
            below_keys, below_cost = keys, cost
        self.start = leaves[0][0] if len(leaves[0]) else np.zeros(k)
        for s in range(order + 1):
            leave = leaves[s + 1] if s < order else np.zeros_like(cost_by_size[s])
            self.tables.append(Table.build(keys_by_size[s], cost_by_size[s], leave))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length of each text in each language."""
        raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        out = np.zeros((len(texts), len(self.langs)))
        if not len(raw):
            return out
        behind = np.arange(len(raw)) - np.repeat(ends - lengths, lengths)
        owner = np.repeat(np.arange(len(texts)), lengths)
        keys = np.zeros(len(raw), np.int64)
        for back in range(self.order, -1, -1):
            keys[back:] |= raw[:max(0, len(raw) - back)] << (8 * back)
        # Most bytes are found in the longest context: one look-up, one sum for each text.
        full = np.flatnonzero(behind >= self.order)
        table = self.tables[self.order]
        row = table.find(keys[full])
        found = row >= 0
        self.add(out, owner[full[found]], table.cost[row[found]])
        rest = np.concatenate([np.flatnonzero(behind < self.order), full[~found]])
        rest.sort()
        missed = np.zeros(len(raw), bool)
        missed[full[~found]] = True
        for s in range(self.order, 0, -1):
            # `missed`: not found with s bytes before it, so the escape from those is due.
            due = rest[missed[rest]]
            context = (keys[due] >> 8) & ((1 << 8 * s) - 1)
            row = self.tables[s - 1].find(context)
            known = row >= 0
            self.add(out, owner[due[known]], self.tables[s - 1].leave[row[known]])
            ready = rest[behind[rest] >= s - 1]
            row = self.tables[s - 1].find(keys[ready] & ((1 << 8 * s) - 1))
            found = row >= 0
            self.add(out, owner[ready[found]], self.tables[s - 1].cost[row[found]])
            missed[:] = False
            missed[ready[~found]] = True
            keep = np.ones(len(raw), bool)
            keep[ready[found]] = False
            rest = rest[keep[rest]]
        if len(rest):
            self.add(out, owner[rest], np.broadcast_to(self.start + 8.0,
                                                       (len(rest), len(self.langs))))
        return out

    @staticmethod
    def add(out: np.ndarray, owner: np.ndarray, costs: np.ndarray) -> None:
        """Adds costs up by text; `owner` rises."""
        if len(owner):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[first]] += np.add.reduceat(costs, first, axis=0, dtype=np.float64)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language that codes each text in the fewest bits, and its share of probability if
        all were equally likely beforehand. Of equal ones the first by name."""
        bits = self.bits(texts)
        best = bits.argmin(1)
        over = np.minimum(bits - bits.min(1, keepdims=True), 1000)
        return [self.langs[i] for i in best], 1 / (2.0 ** -over).sum(1)


def learn(docs: DataFrame, order: int = ORDER, max_bytes: int = SAMPLE_BYTES,
          max_rows: int = SAMPLE_ROWS) -> Models:
    """Models of all languages in `docs` (columns lang, text). Counting runs on the executors; the
    driver gets at most (order + 1) x max_bytes counts, as the sample has no more byte strings."""
    sample = bounded_sample(docs, "lang", max_rows, max_bytes)
    return Models(context_counts(sample, order).toArrow(), order)


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """All columns with `lang_pred` and `score`, from `text` alone.

    Texts that are null or have no letter are `und` with score 0, and so is every text if the
    models were learnt from nothing. Rows are independent: repeated rows get equal results, an
    empty table gives an empty one. Texts are read whole, in portions of bounded size.
    """
    library_path(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(rows: pa.RecordBatch, texts: list) -> list[pa.Array]:
        own = shared.value
        some = [i for i, spoken in enumerate(rows.column("spoken").to_pylist())
                if spoken and own.langs]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        raw = [texts[i].encode() for i in some]
        for i, text in zip(some, raw, strict=True):
            if len(text) > WHOLE:  # in pieces that overlap by a context, added up
                langs[i], scores[i] = long_text(own, text)
        short = [i for i, text in zip(some, raw, strict=True) if len(text) <= WHOLE]
        if short:
            found, score = own.predict([texts[i].encode() for i in short])
            for i, lang, s in zip(short, found, score.tolist(), strict=True):
                langs[i], scores[i] = lang, s
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    mine, names = sheltered(docs, MADE)
    marked = mine.withColumn("spoken", F.col("text").rlike(r"\p{L}"))
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return arrow_map(marked, "text", made, run, portion=1 << 20).select(*names, *MADE)


#: Longer texts are coded in pieces, so that memory is bounded whatever the length.
WHOLE = 4 << 20


def long_text(models: Models, text: bytes) -> tuple[str, float]:
    """As `predict`, piece by piece: each piece is coded with the context before it, whose own
    cost is taken off again."""
    bits = np.zeros((1, len(models.langs)))
    for at in range(0, len(text), WHOLE):
        context = text[max(0, at - models.order):at]
        bits += models.bits([context + text[at:at + WHOLE]]) - models.bits([context])
    over = np.minimum(bits - bits.min(), 1000)
    return models.langs[int(bits.argmin())], float(1 / (2.0 ** -over).sum())

