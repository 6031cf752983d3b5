"""Per-key sequences and top-n: next reading, latest row, samples, newest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermoline import constants as C

# Slices of a sequence: steps that never go back, whatever the session's time zone.
GRAINS = ("day", "month", "year")
_SPREAD = 4096


def with_next(df: DataFrame, value: str = "cycle_temperature", key: str = "machine_id",
              time: str = "txn_timestamp", tie: str = "reading_id", out: str = "next_temp",
              grain: str = "day") -> DataFrame:
    """Adds the value of the key's next row by (time, tie); null on its last row. Rows without a
    key have no next row; rows without a time come first.

    One plan for any data: each key's sequence is cut at every `grain`, so a task holds one key
    and day at most, and only the first and the last row of a slice (two a key and day) are then
    put in order by key, which gives the last row its next value. Both read the same exchange, so
    the source is scanned and its rows shuffled once. Rows of one key and day that don't fit in
    memory are sorted on disk.
    """
    if grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain}")
    begin = F.coalesce(F.date_trunc(grain, F.col(time)), F.lit("0001-01-01").cast("timestamp"))
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(tie, time), F.lit(_SPREAD)))
    sliced = df.withColumns({"_slice": begin, "_spread": spread})
    inner = Window.partitionBy(key, "_slice", "_spread").orderBy(time, tie)
    # A struct tells a null value of the next row from no next row.
    held = F.struct(F.col(value).alias("v"))
    marked = sliced.withColumns({"_next": F.lead(held).over(inner),
                                 "_number": F.row_number().over(inner)})
    ends = marked.where(F.col("_next").isNull() | (F.col("_number") == 1))
    outer = Window.partitionBy(key, "_spread").orderBy("_slice", time, tie)
    closing = ends.withColumn("_after", F.lead(held).over(outer)).where(
        F.col("_next").isNull()).withColumn("_next", F.col("_after"))
    kept = [c for c in df.columns if c != out]
    following = F.when(F.col(key).isNotNull(), F.col("_next")["v"]).alias(out)
    return marked.where(F.col("_next").isNotNull()).select(*kept, following).unionAll(
        closing.select(*kept, following))


def _latest_first(order: Sequence[str]) -> list[Column]:
    return [F.desc(c) for c in order]


def latest_per_key(df: DataFrame, key: str = "machine_id",
                   order: Sequence[str] = ("txn_timestamp", "reading_id")) -> DataFrame:
    """The last row of each key by `order`. `row_number = 1` lets Spark keep one row per key
    and map task before the shuffle, so a hot key costs no more than any other."""
    window = Window.partitionBy(key).orderBy(*_latest_first(order))
    return (df.filter(F.col(key).isNotNull())
            .withColumn("_rank", F.row_number().over(window))
            .filter(F.col("_rank") == 1).drop("_rank"))


def dedupe(df: DataFrame, key: str = "reading_id",
           order: Sequence[str | Column] = ("txn_timestamp",),
           keep_keyless: bool = True) -> DataFrame:
    """One row per key, the first by `order`. Rows without a key are no copies of one another:
    all stay, unless `keep_keyless` is off."""
    window = Window.partitionBy(key).orderBy(*order)
    single = (df.filter(F.col(key).isNotNull())
              .withColumn("_rank", F.row_number().over(window))
              .filter(F.col("_rank") == 1).drop("_rank"))
    return single.unionByName(df.filter(F.col(key).isNull())) if keep_keyless else single


def _newest_parts(df: DataFrame, partition: str, enough: Column, each: str) -> Column:
    """True for the newest partitions, as many as `enough` (over the rows per partition, `n`, and
    those of newer ones, the sum of `each` as `newer`) asks for, and for rows without a partition."""
    counts = df.filter(F.col(partition).isNotNull()).groupBy(partition).agg(
        F.count(F.lit(1)).alias("n"))
    # One row per date, so this window stays small however long the history is.
    newer = Window.orderBy(F.desc(partition)).rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("newer", F.coalesce(F.sum(F.expr(each)).over(newer), F.lit(0)))
    return (F.col(partition) >= needed.filter(enough).agg(F.min(partition)).scalar()) | F.col(
        partition).isNull()


def partition_sample(df: DataFrame, per_partition: int = 3, total: int = 5,
                     partition: str = "dt",
                     order: Sequence[str] = ("txn_timestamp", "reading_id")) -> DataFrame:
    """A few landed rows: the first `per_partition` of each date, newest dates first, `total`
    in all. Only the newest dates that hold so many rows are read."""
    window = Window.partitionBy(partition).orderBy(*order)
    counted = F.col("newer") < total
    some = df.filter(_newest_parts(
        df, partition, counted, f"least(n, {int(per_partition)})"))
    return (some.withColumn("_rank", F.row_number().over(window))
            .filter(F.col("_rank") <= per_partition)
            .orderBy(F.desc(partition), "_rank").limit(total).drop("_rank"))


def newest(df: DataFrame, n: int | None = C.LOG_LIMIT[0], time: str = "txn_timestamp",
           tie: str = "reading_id") -> DataFrame:
    """Newest rows first; with `n`, a top-n kept per task and merged, without a full sort."""
    rows = df.orderBy(F.desc(time), F.desc(tie))
    return rows if n is None else rows.limit(n)


def newest_landed(df: DataFrame, n: int = C.LOG_LIMIT[0], partition: str = "dt",
                  time: str = "txn_timestamp", tie: str = "reading_id") -> DataFrame:
    """`newest` of a table partitioned by the day of `time`: only the newest dates that hold
    `n` rows between them are read, and the rows without a date, which have no time. How many
    dates that takes is a subquery over the rows per date, which needs file footers but no data."""
    return newest(df.filter(_newest_parts(df, partition, F.col("newer") < n, "n")), n, time, tie)


def newest_states(status: DataFrame, n: int | None = 100) -> DataFrame:
    """Machine states, last updated first."""
    return newest(status, n, "last_updated", "machine_id")


def recent_buffer(df: DataFrame, n: int = C.INGRESS_BUFFER, time: str = "txn_timestamp",
                  tie: str = "reading_id") -> DataFrame:
    """The rolling buffer: the `n` newest readings."""
    return newest(df, n, time, tie)


def recent_landed(df: DataFrame, dt: str, n: int = C.STREAM_TAIL) -> DataFrame:
    """Tail of one date's landed readings."""
    return newest(df.filter(F.col("dt") == F.lit(dt).cast("date")), n)
