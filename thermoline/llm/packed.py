"""Token ids in files of fixed-width bit-packed blocks, in order of document, and their readers."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoline.llm.common import PORTION, blocks, library_path, small

#: Ids of a block: a multiple of eight, so that blocks of any width begin at a byte.
BLOCK = 1 << 12

#: A segment (a row of the files) is closed by the document that brings it to so many ids.
SEGMENT = 1 << 19

#: Words of a generation whose ids a worker remembers (some 150 bytes a word).
REMEMBERED = 600_000

#: What ends the last token of a word in the vocabulary; marks at words' ends (no apostrophe, which
#: the pattern joins with letters); runs that go to the library as one text.
WORD_END, MARKS, JOINED = "</w>", ".,;:!?()\"", 500

SEGMENTS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("first", T.LongType()),
    T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("packed", T.BinaryType())])
SHARDS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType()),
    T.StructField("shard_ids", T.LongType()), T.StructField("shard_docs", T.LongType())])

_HEAD = np.dtype([("mark", "S4"), ("width", "<u4"), ("block", "<u4"), ("blocks", "<u4"),
                  ("ids", "<u8")])


def width_of(vocabulary: int) -> int:
    """The fewest bits that tell so many ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int, block: int = BLOCK) -> bytes:
    """Head, byte offset of each block (one more at the end), and the blocks: `width` bits an id,
    lowest bit first."""
    count = -(-len(ids) // block)
    parts, offsets = [], [0]
    for b in range(count):
        some = np.ascontiguousarray(ids[b * block:(b + 1) * block], "<u4")
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 4), axis=1, count=width,
                             bitorder="little")
        parts.append(np.packbits(bits, bitorder="little").tobytes())
        offsets.append(offsets[-1] + len(parts[-1]))
    head = np.array([(b"TLPK", width, block, count, len(ids))], _HEAD)
    return b"".join([head.tobytes(), np.array(offsets, "<u8").tobytes(), *parts])


def unpack(packed: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids `begin` to `end` (exclusive) of what `pack` returned; other blocks are not touched."""
    head = np.frombuffer(packed, _HEAD, 1)[0]
    if head["mark"] != b"TLPK":
        raise ValueError("not a packed segment")
    width, block, count, n = (int(head[k]) for k in ("width", "block", "blocks", "ids"))
    end = n if end is None else min(end, n)
    if begin >= end:
        return np.zeros(0, np.uint32)
    offsets = np.frombuffer(packed, "<u8", count + 1, _HEAD.itemsize).astype(np.int64)
    data = _HEAD.itemsize + 8 * (count + 1)
    out = []
    for b in range(begin // block, -(-end // block)):
        many = min(block, n - b * block)
        raw = np.frombuffer(packed, np.uint8, int(offsets[b + 1] - offsets[b]),
                            data + int(offsets[b]))
        bits = np.unpackbits(raw, count=many * width, bitorder="little").reshape(many, width)
        octets = np.zeros((many, 4), np.uint8)
        octets[:, :-(-width // 8)] = np.packbits(bits, axis=1, bitorder="little")
        out.append(octets.view("<u4")[:, 0])
    first = begin // block * block
    return np.concatenate(out)[begin - first:end - first].astype(np.uint32)


class _Numbers(dict):
    """Numbers of words in the order of their first use; `fresh` has the latest ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class _Known:
    """Words and their ids, one after the other."""

    def __init__(self) -> None:
        self.numbers, self.flat, self.bounds = _Numbers(), array("I"), array("q", [0])

    def add(self, ids) -> None:
        self.flat.extend(ids)
        self.bounds.append(len(self.flat))

    def of(self, word: bytes) -> array | None:
        number = self.numbers.get(word)
        return None if number is None else self.flat[self.bounds[number]:self.bounds[number + 1]]


class Encoder:
    """The ids of texts by the tokenizers library, which is asked once for each different word
    that is not remembered from this generation of words or the one before.

    The vocabulary's pattern never reaches over white space and drops it, so the ids of a text are
    those of its words. Its normal form lowers case: words of ASCII alone are looked up lowered,
    but for texts that may spell a special token. The pattern also parts letters from marks, so
    many words of letters, or their letters and their marks at the end, go to the library at once
    as one text; an id that ends a word ends each of them, and where the count of these differs
    each is asked for by itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.vocabulary, bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[number] = token.endswith(WORD_END)
        self.known, self.older = _Known(), _Known()

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> list[list[int]]:
        """Ids of runs of letters or of marks."""
        chunks = [runs[i:i + JOINED] for i in range(0, len(runs), JOINED)]
        out: list[list[int]] = []
        for chunk, ids in zip(chunks, self._each([" ".join(c) for c in chunks]), strict=True):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(chunk) and cuts[-1] == len(ids):
                cuts = cuts.tolist()
                out += [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
            else:
                out += self._each(chunk)
        return out

    def _new(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words that are not remembered."""
        runs: dict[str, int] = {}
        parts, others = [], []
        for word in words:
            text = word.decode()
            letters = text.rstrip(MARKS)
            if letters.isalpha():
                marks = text[len(letters):]
                parts.append((runs.setdefault(letters, len(runs)),
                              runs.setdefault(marks, len(runs)) if marks else None))
            else:
                parts.append(None)
                others.append(text)
        done, rest = self._runs(list(runs)), iter(self._each(others))
        return [next(rest) if p is None else done[p[0]] if p[1] is None
                else done[p[0]] + done[p[1]] for p in parts]

    def words(self, text: bytes) -> list[bytes]:
        return (text.lower() if text.isascii() and b"<|" not in text else text).split()

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; together the texts should be no longer than a few megabytes."""
        if len(self.known.numbers) > REMEMBERED:
            self.known, self.older = _Known(), self.known
        known, numbers = self.known, self.known.numbers
        places = []
        for text in texts:
            words = self.words(text)
            places.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        fresh, numbers.fresh = numbers.fresh, []
        found = [self.older.of(w) for w in fresh]
        asked = iter(self._new([w for w, ids in zip(fresh, found, strict=True) if ids is None]))
        for ids in found:
            known.add(next(asked) if ids is None else ids)
        flat, bounds = np.frombuffer(known.flat, np.uint32), np.frombuffer(known.bounds, np.int64)
        out = []
        for place in places:
            size = bounds[place + 1] - bounds[place]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            out.append(flat[np.repeat(bounds[place] - ends + size, size) + np.arange(total)])
        return out

    def long_ids(self, text: bytes) -> np.ndarray:
        """Ids of one long text, taken in portions that end at white space."""
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + PORTION)
            while end < len(text) and text[end:end + 1] not in b" \t\n\r\x0b\x0c":
                end += 1
            out.extend(self.ids([text[at:end]]))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _segments(rows: Iterator[pa.RecordBatch], path: str, end_id: int,
              segment: int) -> Iterator[pa.RecordBatch]:
    """Segments of one shard from its documents in order."""
    own = encoder(path)
    width = width_of(max(own.vocabulary, end_id + 1))
    first, total, held, doc_ids, lengths, shard = 0, 0, [], [], [], 0

    def close() -> pa.RecordBatch:
        ids = np.concatenate(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([first], pa.int64()),
             pa.array([len(ids)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
             pa.array([lengths], pa.list_(pa.int64())),
             pa.array([pack(ids, width)], pa.binary())], SEGMENTS.names)

    for batch in rows:
        if not batch.num_rows:
            continue
        shard = batch.column("shard")[0].as_py()
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        names = batch.column("doc_id").to_pylist()
        for a, b in blocks([len(t) for t in texts], PORTION):
            long = b - a == 1 and len(texts[a]) > PORTION
            done = [own.long_ids(texts[a])] if long else own.ids(texts[a:b])
            for name, ids in zip(names[a:b], done, strict=True):
                held.append(np.append(ids, np.uint32(end_id)))
                doc_ids.append(name)
                lengths.append(len(ids) + 1)
                total += len(ids) + 1
                if total >= segment:
                    yield close()
                    first += total
                    total, held, doc_ids, lengths = 0, [], [], []
    if doc_ids:
        yield close()


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int,
              segment: int = SEGMENT) -> None:
    """Writes the ids of every text of `docs` (doc_id, text), each followed by `end_id`, in
    ascending order of doc_id, below `path`:

    `segments`: a row of a Parquet file holds whole documents, about `segment` ids of them or a
    longer document alone: shard, place of its first id in the shard, doc_ids, lengths, and the
    packed ids (head, block offsets, blocks of BLOCK ids in the fewest bits that the vocabulary
    takes). `shards`: ids and documents of each shard and the place of its first id in all.

    Texts are dealt by ranges of (doc_id, hash of text, row), so that neither null nor repeated
    ids gather in one task, and encoded where they are then: no id is shuffled. Spark's own
    writers commit what tasks write, so that a repeated task leaves no trace; the driver gets
    nothing. Null and empty texts are the end id alone; null doc_ids come first; rows with one
    doc_id follow one another, ordered by a hash of the text. Other columns are not read. An
    empty table gives empty files.
    """
    spark = docs.sparkSession
    library_path(spark)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
                        F.xxhash64("text").alias("h"),
                        F.monotonically_increasing_id().alias("row"))
    dealt = dealt.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h")
    rows = dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    rows.mapInArrow(lambda x: _segments(x, tokenizer, end_id, segment), SEGMENTS).write.option(
        "compression", "zstd").parquet(f"{path}/segments")
    counted = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").groupBy("shard").agg(
        F.sum("n_ids").alias("shard_ids"), F.sum(F.size("lengths")).alias("shard_docs"))
    # One row a shard: the list of files, not of documents.
    counted.selectExpr("shard", "coalesce(sum(shard_ids) over (order by shard rows between "
                       "unbounded preceding and 1 preceding), 0) as base",
                       "shard_ids", "shard_docs").write.parquet(f"{path}/shards")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments").join(
        small(shards.select("shard", "base"), "shards"), "shard")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files; `start` counts the ids of all
    documents before it, `ids` are little-endian unsigned 32-bit integers with the end id."""
    library_path(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = unpack(row["packed"]).astype("<u4").tobytes()
                for a, b in blocks((4 * lengths).tolist(), PORTION):
                    at = ends[a:b] - lengths[a:b]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][a:b], pa.int64()),
                         pa.array(row["base"] + row["first"] + at), pa.array(lengths[a:b]),
                         pa.array([raw[4 * i:4 * j] for i, j in zip(at, ends[a:b], strict=True)],
                                  pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return _placed(spark, path).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def read_range(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """(start, ids): ids `begin` to `end` (exclusive) of the whole stream, in parts as the segments
    cut them. Of segments outside only their places are read, and of those inside only the blocks
    that hold wanted ids are unpacked."""
    library_path(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = row["base"] + row["first"]
                a, b = max(begin - at, 0), min(end - at, row["n_ids"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at + a]), pa.array(
                        [unpack(row["packed"], a, b).astype("<u4").tobytes()], pa.binary())],
                    ["start", "ids"])

    at = F.col("base") + F.col("first")
    some = _placed(spark, path).where((at < end) & (at + F.col("n_ids") > begin))
    return some.select("base", "first", "n_ids", "packed").mapInArrow(run, "start long, ids binary")


def with_crc32(documents: DataFrame) -> DataFrame:
    """`read_documents` with `ids_crc32` in place of the ids."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: list[int]) -> int:
    """The check sum of `with_crc32` for one list of ids."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
