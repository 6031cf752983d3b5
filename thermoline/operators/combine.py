"""Union, dedupe, merge and join of reading tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from thermoline import constants as C
from thermoline.operators import cleaning, filters, sequence
from thermoline.session import materialize

# What a repeated log insert overwrites.
LOG_UPDATES = ("cycle_temperature", "status")


def recent_telemetry(buffer: DataFrame, log: DataFrame, raw: DataFrame, limit: object = None,
                     machine_id: str | None = None, branch: str | None = None,
                     status: str | None = None, breakdown_soon: object = None,
                     since: str | None = None) -> DataFrame:
    """Newest readings over buffer, log and raw history. A reading found in several sources
    counts once, as the earliest source holds it; then filters, then the newest `limit`.

    No source is capped. The filter goes to all three scans first: only readings that match in
    some source can be listed, so only rows with their ids are ranked, and rows of other readings
    are not shuffled wide. Without any filter `newest_resolved` takes the newest of each source.
    `since` asks only for readings from that date on and prunes every source that is partitioned
    or sorted by time. Rows without id are left out.
    """
    if all(w is None for w in (machine_id, branch, status, breakdown_soon)) and since is None:
        return newest_resolved([("buffer", buffer), ("log", cleaning.backfill_sensors(log)),
                                ("raw", raw)], filters.clamp_limit(limit, *C.READINGS_LIMIT))

    def ready(df: DataFrame, rank: int, name: str) -> DataFrame:
        rows = cleaning.canonicalize(df)
        if since is not None:
            day = F.lit(since).cast("date")
            if "dt" in rows.columns:
                rows = rows.filter(F.col("dt") >= day)
            rows = rows.filter(F.col("txn_timestamp") >= day.cast("timestamp"))
        rows = rows.select(*cleaning.schemas.READING.names)
        return rows.select("*", F.lit(rank).alias("_source_rank"), F.lit(name).alias("source"))

    def matching(rows: DataFrame) -> DataFrame:
        return filters.filter_readings(rows, machine_id, branch, status, breakdown_soon)

    stacked = (ready(buffer, 0, "buffer")
               .unionByName(ready(cleaning.backfill_sensors(log), 1, "log"))
               .unionByName(ready(raw, 2, "raw")))
    if any(w is not None for w in (machine_id, branch, status, breakdown_soon)):
        wanted = matching(stacked).select("reading_id").distinct()
        stacked = stacked.join(wanted, "reading_id", "left_semi")
    single = sequence.dedupe(stacked, "reading_id",
                             ["_source_rank", F.desc("txn_timestamp"), "machine_id", "branch",
                              "cycle_temperature", "status", "breakdown_soon"],
                             keep_keyless=False)
    return sequence.newest(matching(single).drop("_source_rank"),
                           filters.clamp_limit(limit, *C.READINGS_LIMIT))


_SINGLE = ("_source_rank", "txn_timestamp", "machine_id", "branch", "cycle_temperature", "status",
           "breakdown_soon")


def newest_resolved(sources: Sequence[tuple[str, DataFrame]], n: int,
                    first: int | None = None) -> DataFrame:
    """The newest `n` readings over sources that overlap: a reading counts once, as the first of
    `sources` that holds it has it, with the name of that source. Rows without id are left out.

    A threshold algorithm: of each source the newest `first` (by default 2n) rows are candidates,
    and only for their ids is it looked up which source decides. An id that is no candidate has
    in each source at most the time of its last candidate, so once the nth reading found is not
    older than the newest of these bounds, nothing unseen can enter; otherwise four times as many
    candidates are taken. Of a source with `dt`, the day of its time, only the newest dates that
    hold as many rows are read for candidates. The look-up reads the last source from its oldest
    candidate on, the others whole, and shuffles none of them: it joins with the list of ids.
    """
    names = cleaning.schemas.READING.names

    def keyed(df: DataFrame) -> DataFrame:
        rows = cleaning.canonicalize(df).filter(F.col("reading_id").isNotNull())
        return rows.select(*names, *[c for c in ("dt",) if c in rows.columns])

    rows = [keyed(df) for _, df in sources]
    count = first or 2 * n
    while True:
        tops = [(sequence.newest_landed(r, count) if "dt" in r.columns
                 else sequence.newest(r, count)).select(*names, F.lit(k).alias("_source_rank"))
                for k, r in enumerate(rows)]
        stacked = tops[0]
        for top in tops[1:]:
            stacked = stacked.unionByName(top)
        seen = materialize(stacked, "newest")
        place = F.struct(F.col("txn_timestamp").isNotNull(), "txn_timestamp", "reading_id")
        bounds = {r["_source_rank"]: r for r in seen.groupBy("_source_rank").agg(
            F.count("*").alias("rows"), F.min(place).alias("last"),
            F.min("txn_timestamp").alias("oldest"), F.count("txn_timestamp").alias("timed")
        ).collect()}
        ids = seen.select("reading_id").distinct()
        parts = []
        for k, r in enumerate(rows):
            bound = bounds.get(k)
            if k == len(rows) - 1:  # no source after it: only newer copies of its own count
                if bound is None:
                    continue
                if bound["timed"] == bound["rows"]:
                    since = F.lit(bound["oldest"])
                    r = r.filter(F.col("txn_timestamp") >= since)
                    if "dt" in r.columns:
                        r = r.filter((F.col("dt") >= F.to_date(since)) | F.col("dt").isNull())
            parts.append(r.join(ids, "reading_id", "left_semi").select(
                *names, F.lit(k).alias("_source_rank"), F.lit(sources[k][0]).alias("source")))
        if not parts:
            return seen.select(*names, F.lit("").alias("source")).limit(0)
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part)
        order = [F.desc(c) if c == "txn_timestamp" else F.col(c) for c in _SINGLE]
        found = materialize(sequence.newest(
            sequence.dedupe(both, "reading_id", order, keep_keyless=False), n), "resolved")
        open_bounds = [b["last"] for b in bounds.values() if b["rows"] >= count]
        if not open_bounds:
            break
        end = found.agg(F.count("*").alias("rows"), F.min(place).alias("last")).first()
        if end["rows"] >= n and _key(end["last"]) >= max(_key(b) for b in open_bounds):
            break
        count *= 4
    return sequence.newest(found.drop("_source_rank"), n)


def _key(place: Row) -> tuple:
    """A place in order of time and id, as Python compares it; rows without time come last."""
    timed, time, reading = place
    return (timed, time, reading) if timed else (False, None, reading)


def fold_by_key(df: DataFrame, key: str = "reading_id",
                update_cols: Sequence[str] | str = LOG_UPDATES,
                order: Sequence[str] = ("txn_timestamp",)) -> DataFrame:
    """What inserting the rows one by one in `order` leaves: one row per key, with
    `update_cols` from its last row and every other column from its first.

    `"all"` takes the whole last row, `"none"` keeps the first. First and last are
    aggregates, so each map task ships at most one row per key.
    """
    keyed = df.filter(F.col(key).isNotNull())
    others = [c for c in df.columns if c != key]
    updates = others if update_cols == "all" else [] if update_cols == "none" else [
        c for c in others if c in update_cols]
    first = [c for c in others if c not in updates]
    # The remaining columns only settle ties, so that a replay gives the same row.
    position = F.struct(*order, *[c for c in others if c not in order])
    aggregates: list[Column] = []
    if first:
        aggregates.append(F.min_by(F.struct(*first), position).alias("_first"))
    if updates:
        aggregates.append(F.max_by(F.struct(*updates), position).alias("_last"))
    folded = keyed.groupBy(key).agg(*aggregates)
    return folded.select(*[
        F.col(c) if c == key else (F.col("_last") if c in updates else F.col("_first"))[c].alias(c)
        for c in df.columns])


def outer_merge(target: DataFrame, batch: DataFrame, key: str = "reading_id",
                update_cols: Sequence[str] | str = LOG_UPDATES) -> DataFrame:
    """Full outer merge of two tables that are unique by `key`: rows of either side stay; on
    a match `update_cols` come from the batch, also where it holds null."""
    others = [c for c in target.columns if c != key]
    updates = set(others if update_cols == "all" else () if update_cols == "none"
                  else update_cols)
    left = target.select(key, *others, F.lit(True).alias("_old")).alias("t")
    right = batch.select(key, *others, F.lit(True).alias("_new")).alias("b")
    joined = left.join(right, key, "full_outer")
    use_batch = {True: F.col("b._new").isNotNull(), False: F.col("t._old").isNull()}
    return joined.select(*[
        F.col(key) if c == key else
        F.when(use_batch[c in updates], F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
        for c in target.columns])


def merge_by_key(target: DataFrame, batch: DataFrame, key: str = "reading_id",
                 update_cols: Sequence[str] | str = LOG_UPDATES,
                 order: Sequence[str] = ("txn_timestamp",)) -> DataFrame:
    """Idempotent insert of `batch` into `target`, which is unique by `key`. The batch is
    folded first, so repeated deliveries meet the join as one row."""
    return outer_merge(target, fold_by_key(batch, key, update_cols, order), key, update_cols)


def status_rows(readings: DataFrame, updated: Column | None = None) -> DataFrame:
    """Readings as machine states; `last_updated` is the event time unless given. A message
    `offset` stays, to tell apart deliveries of one reading."""
    return readings.select("machine_id", "reading_id", "branch", "cycle_temperature", "status",
                           "breakdown_soon",
                           (F.col("txn_timestamp") if updated is None else updated)
                           .alias("last_updated"),
                           *[c for c in ("offset",) if c in readings.columns])


def upsert_status(target: DataFrame, batch: DataFrame, by: str = "event") -> DataFrame:
    """Latest state per machine of the table and a batch of states: the last event, or
    (`by="arrival"`) the last to arrive. Between deliveries of one reading the batch wins over
    the table, and in the batch the higher offset."""
    if by not in ("event", "arrival"):
        raise ValueError(f"unknown order: {by}")
    arrival = F.col("offset") if "offset" in batch.columns else F.lit(0).cast("bigint")
    fresh = batch.select(*target.columns, arrival.alias("_arrival"))
    known = target.withColumn("_arrival", F.lit(-1).cast("bigint"))
    order = ("last_updated", "reading_id", "_arrival") if by == "event" else (
        "last_updated", "_arrival", "reading_id")
    return sequence.latest_per_key(known.unionByName(fresh), "machine_id", order).drop("_arrival")


def log_rows(readings: DataFrame) -> DataFrame:
    """Readings without the columns the log does not keep."""
    return readings.select(*cleaning.schemas.LOG.names)


def status_with_predictions(status: DataFrame, predictions: DataFrame) -> DataFrame:
    """Machine states next to the latest prediction of each machine. Both sides have one row
    per machine; which side is broadcast, if any, is left to the sizes Spark sees."""
    latest = sequence.latest_per_key(predictions, "machine_id", ("scored_at", "prediction"))
    return status.join(latest.select("machine_id", "prediction", "scored_at"),
                       "machine_id", "left")
