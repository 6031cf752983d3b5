"""What the training-data operators share: columns, hashes of words, scratch tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoline.session import materialize

#: The six bytes that part words.
SPACES = " \t\n\x0b\x0c\r"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES.encode())] = True


def others(df: DataFrame, made: list[str]) -> list[Column]:
    """The columns of `df` that a result does not name itself: a result's column replaces one
    of the same name, upper and lower case alike, as Spark compares names."""
    taken = {name.lower() for name in made}
    return [df[f"`{name}`"] for name in df.columns if name.lower() not in taken]


def sheltered(docs: DataFrame, made: list[str]) -> tuple[DataFrame, list[Column]]:
    """`docs` under names that clash with nothing: doc, text, and _k0, _k1 ... for all columns
    that stay, with the expressions that give these their names back."""
    stay = [c for c in docs.columns if c.lower() not in {m.lower() for m in made}]
    return (docs.select(F.col("doc_id").alias("doc"), F.col("text"),
                        *[docs[f"`{c}`"].alias(f"_k{i}") for i, c in enumerate(stay)]),
            [F.col(f"_k{i}").alias(c) for i, c in enumerate(stay)])


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; `lower` suffices where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER))


def plain_spaces(text: Column) -> Column:
    """The text, null as empty, with a space for each other white-space byte."""
    text = F.coalesce(text, F.lit(""))
    for other in SPACES[1:]:
        text = F.replace(text, F.lit(other), F.lit(" "))
    return text


def words_of(spaced: Column) -> Column:
    """Words of what `plain_spaces` returns; parting at one character needs no pattern."""
    return F.array_remove(F.split(spaced, " "), "")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 17


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


POWERS = _Powers()


def prefix_codes(block: np.ndarray) -> np.ndarray:
    """Running sums from which `window_codes` and `word_hashes` take the code of any range."""
    up, _ = POWERS.to(len(block) + 1)
    sums = np.zeros(len(block) + 1, np.uint64)
    np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[:len(block)], out=sums[1:])
    return sums


def window_codes(block: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit code for each run of `width` bytes."""
    sums = prefix_codes(block)
    n = len(block) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[width:] - sums[:n]) * POWERS.to(n)[1][:n])


def word_hashes(data: bytes, space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of `data`; blocks end between words. `space` marks the
    bytes that part words."""
    raw = np.frombuffer(data, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + _BLOCK)
        while end < len(raw) and not space[raw[end]]:
            more = np.flatnonzero(space[raw[end:end + _BLOCK]])
            end = end + int(more[0]) if len(more) else min(len(raw), end + _BLOCK)
        block = raw[at:end]
        word = np.zeros(len(block) + 2, np.int8)
        word[1:-1] = ~space[block]
        edges = np.diff(word)
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = prefix_codes(block)
        code = (sums[last] - sums[first]) * POWERS.to(len(block) + 1)[1][first]
        starts.append(first + at)
        hashes.append(mix(code ^ (last - first).astype(np.uint64)))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def words_by_text(texts: list[bytes],
                  space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one more at the end)."""
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, hashes = word_hashes(b" ".join(texts), space)
    return hashes, np.searchsorted(starts, begins)


def blocks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring items whose sizes add up to `most` at most, or hold one item."""
    out, first, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            out.append((first, i))
            first, total = i, 0
        total += size
    return [*out, (first, len(sizes))] if len(sizes) > first else out


def library_path(spark: SparkSession) -> None:
    """Python workers find this library where the driver found it, also if the driver's own
    sys.path was set by hand. On a cluster the library is installed at one place on all nodes."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


#: Texts of so many bytes together are handed to Python code at once, or a single longer one.
PORTION = 4 << 20


def arrow_map(df: DataFrame, column: str, made: list[T.StructField],
              run: Callable[[pa.RecordBatch, list], list[pa.Array]],
              portion: int = PORTION) -> DataFrame:
    """`df` with the columns that `run` makes of each portion of rows: it gets the portion and the
    values of `column`. Portions are bounded by bytes, so that long texts don't add up."""
    schema = T.StructType([*df.schema.fields, *made])

    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
            for first, end in blocks(sizes, portion):
                part = batch.slice(first, end - first)
                new = run(part, part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [
                    *part.schema.names, *(f.name for f in made)])

    return df.mapInArrow(portions, schema)


#: A table of at most so many rows (of a few numbers each) may be sent to all executors.
SMALL_ROWS = 100_000


def small(df: DataFrame, name: str) -> DataFrame:
    """`df`, computed and written; marked for a broadcast join only if it was counted to be small."""
    written = materialize(df, name)
    return F.broadcast(written) if written.count() <= SMALL_ROWS else written


#: Of a text that holds more than one in so many parts of a group's bytes, a piece is learnt from.
PIECES = 20


def bounded_sample(rows: DataFrame, group: str, max_rows: int, max_bytes: int,
                   marks: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Rows (group, text) to learn from: of each group, in the order of a hash of the text, at most
    `max_rows` different texts, until they hold the group's share of `max_bytes` (one in any case).
    Rows without group or with a null or empty text are left out. With `marks` (key, group), the
    groups of rows are those of their key there.

    A share is an equal one or, where other groups hold less than theirs, up to as many times two
    of that as all groups together stay within `max_bytes`. Of a text of over a PIECES-th of the
    share a piece of that length at most stands for it, from a place that the hash chooses, so that
    one long text takes no room from all that follow.

    Only hashes and lengths are joined with `marks`, written and ranked; of a large group just
    those below a bound that some times `max_rows` of them meet, so that no task ranks a group.
    What is chosen (`max_rows` rows a group) meets the texts in a last pass over them.
    """
    hashed = rows.where(F.col("text") != "").withColumn("_h", F.xxhash64("text"))
    sized = hashed.select(*[F.col(c) for c in ([group] if marks is None else [key])], "_h",
                          F.octet_length("text").alias("size"))
    if marks is not None:
        sized = sized.join(marks.select(key, group), key)
    keys = materialize(sized.where(F.col(group).isNotNull()).select(
        F.col(group).alias("_group"), "_h", "size"), "hashes")
    bounds = small(keys.groupBy("_group").agg(F.approx_count_distinct("_h").alias("n")).select(
        "_group", (F.lit(-2.0 ** 63) + F.least(F.lit(1.0), 4.0 * max_rows / F.col("n"))
                   * F.lit(2.0 ** 64)).alias("most")), "bounds")
    low = keys.join(bounds, "_group").where(F.col("_h") <= F.col("most"))
    first = materialize(
        low.select("_group", "_h", "size").distinct().withColumn("rank", F.row_number().over(
            Window.partitionBy("_group").orderBy("_h", "size"))).where(F.col("rank") <= max_rows),
        "ranked")
    groups = max(1, first.select("_group").distinct().count())
    levels = [min(max_bytes, max_bytes * 2 ** j / groups) for j in range(groups.bit_length() + 1)]
    held = first.groupBy("_group").agg(*[
        F.least(F.sum(F.least("size", F.lit(x / PIECES))), F.lit(x)).alias(f"at{j}")
        for j, x in enumerate(levels)])
    sums = held.agg(*[F.coalesce(F.sum(f"at{j}"), F.lit(0.0)) for j in range(len(levels))]).first()
    share = max([x for x, total in zip(levels, sums, strict=True) if total <= max_bytes],
                default=levels[0])
    piece = max(4, int(share / PIECES))
    total = F.sum(F.least("size", F.lit(piece))).over(Window.partitionBy("_group").orderBy("rank"))
    chosen = small(first.withColumn("total", total).where(
        (F.col("total") <= share) | (F.col("rank") == 1)
    ).select("_group", "_h"), "sample")
    # No character has more than four bytes.
    ascii_only = F.octet_length("text") == F.char_length("text")
    length = F.when(ascii_only, piece).otherwise(piece // 4)
    places = F.greatest(F.char_length("text") - length, F.lit(0)) + 1
    part = F.substring("text", F.pmod("_h", places).cast("int") + 1, length)
    # A text stands for all its copies, also those in other groups.
    return hashed.select("text", "_h").join(chosen, "_h").select(
        F.col("_group").alias(group),
        F.when(F.octet_length("text") > piece, part).otherwise(F.col("text")).alias("text")
    ).distinct()


def arrow_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """Rows with one key, which must lie together, as lists by column; batches may cut groups."""
    held, last = None, None
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        keys = columns[key]
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = {name: values[a:b] for name, values in columns.items()}
            if held is not None and part[key][0] == last:
                for name, values in part.items():
                    held[name].extend(values)
            else:
                if held is not None:
                    yield held
                held, last = part, part[key][0]
    if held is not None:
        yield held
