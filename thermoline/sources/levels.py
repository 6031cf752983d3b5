"""Tables that take many small batches: one row per key, folded in levels.

Inserting rows one by one leaves of each key some columns of its first row and others of its last.
So a key's first and last row, by one total order, are all that has to be kept. They can be taken
in any grouping and any number of times: folding a batch twice changes nothing, and a reader that
sees a batch both by itself and folded reads the same.

    batch=…/            or dt=…/batch=…/: appended batches, as they came
    _levels/run=…/      first and last rows of the keys of many batches, bucketed by key
    _levels/manifest/   which runs count, which batches they hold, what may be deleted

Appending costs a batch its own size. `fanout` batches make a run of level 1, `fanout` runs of a
level make one of the next, so a row is written once a level, and there are as many levels as the
logarithm of the number of batches. Runs are bucketed tables: merging them needs no shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoline.sources import history
from thermoline.sources.versions import VersionedTable

# `retired` is the version of the manifest since which a folder no longer counts.
LEVELS = T.StructType([T.StructField("folder", T.StringType()),
                       T.StructField("level", T.IntegerType()),
                       T.StructField("buckets", T.IntegerType()),
                       T.StructField("retired", T.IntegerType())])


class LeveledTable:
    """Rows of `schema` by `key`; `order` tells which of a key's rows is first and which last, the
    other columns settle ties. Rows without key are left out, repeated rows count once. `folders`
    are the columns that name the folders of a batch, `batch` being the last of them; the table's
    rows have `batch`, which `order` may name."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str,
                 order: Sequence[str], updates: Sequence[str] | str = "all",
                 folders: Sequence[str] = ("batch",), buckets: int = 16, fanout: int = 8) -> None:
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.updates, self.folders = updates, tuple(folders)
        self.buckets, self.fanout = buckets, fanout
        self.fields = T.StructType([f for f in schema.fields if f.name not in self.folders])
        others = [*(f for f in self.fields.names if f != key), "batch"]
        self.position = [*order, *(c for c in others if c not in order)]
        self.manifest = VersionedTable(spark, f"{self.path}/_levels/manifest", LEVELS)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Adds one batch, for tables whose only folders are the batches. A batch that is repeated
        under its name replaces itself."""
        named = rows.select(*self.fields.names).withColumn("batch", F.lit(batch))
        history.write_history(named, self.path, ("batch",))

    def read(self, updates: Sequence[str] | str | None = None) -> DataFrame:
        """One row per key: `updates` (by default the table's own) from its last row, the other
        columns from its first. Only batches that are in no run are shuffled."""
        updates = self.updates if updates is None else updates
        entries = self._entries()
        rows = self._merged([r for r in entries if r["level"] and r["retired"] is None],
                            self._waiting_rows(entries))

        def side(name: str) -> str:
            last = updates == "all" or (updates != "none" and name in updates)
            return "_last" if last else "_first"

        return rows.select(*[F.col(c) if c == self.key else F.col(f"{side(c)}.{c}")
                             for c in self.fields.names])

    def waiting(self) -> list[str]:
        """Names of the batches that are in no run yet."""
        return self._waiting(self._entries())

    def runs(self) -> list[tuple[int, str]]:
        """(level, folder) of the runs that count."""
        return sorted((r["level"], r["folder"]) for r in self._entries()
                      if r["level"] and r["retired"] is None)

    def compact(self, least: int | None = None, keep: int = 3) -> bool:
        """Folds the waiting batches into a run if there are at least `least` (by default `fanout`)
        of them, together with the runs of each level that this fills up.

        The manifest is committed after the run is written, and refused if another job committed
        meanwhile; what is lost then is only the work. Folders that no longer count are deleted
        `keep` commits later, so that readers who have begun can finish.
        """
        entries, version = self._entries(), self.manifest.newest()
        batches = self._waiting(entries)
        if len(batches) < (self.fanout if least is None else max(1, least)):
            return False
        merged: list[Row] = []
        level = 1
        while True:
            full = [r for r in entries if r["level"] == level and r["retired"] is None]
            if len(full) + 1 < self.fanout:
                break
            merged, level = merged + full, level + 1
        run = f"run={uuid.uuid4().hex}"
        self._write_run(self._merged(merged, self._waiting_rows(entries, batches)), run)
        commit = (-1 if version is None else version) + 1
        gone = {r["folder"] for r in entries
                if r["retired"] is not None and r["retired"] <= commit - keep}
        for folder in gone:
            self._delete(folder)
        left = {r["folder"] for r in merged}
        kept = [(r["folder"], r["level"], r["buckets"],
                 commit if r["folder"] in left else r["retired"])
                for r in entries if r["folder"] not in gone]
        folded = [(f"batch={b}", 0, None, commit) for b in batches]
        self.manifest.replace(self.spark.createDataFrame(
            [*kept, *folded, (run, level, self.buckets, None)], LEVELS), after=version)
        self.manifest.prune()
        return True

    def _entries(self) -> list[Row]:
        # Runs, some for each level, and the batches and runs of the last few commits.
        return self.manifest.read().collect()

    def _waiting(self, entries: list[Row]) -> list[str]:
        folded = {r["folder"] for r in entries if r["level"] == 0}
        return sorted(name.split("=", 1)[1] for name in {
            place.getName() for place in self._batch_folders("batch=*")} - folded)

    def _waiting_rows(self, entries: list[Row], only: list[str] | None = None) -> DataFrame | None:
        batches = self._waiting(entries) if only is None else only
        if not batches:
            return None
        schema = T.StructType([*self.fields.fields,
                               *(T.StructField(f, T.StringType()) for f in self.folders)])
        rows = history.read_history(self.spark, self.path, schema)
        return rows.filter(F.col("batch").isin(batches) & F.col(self.key).isNotNull())

    def _merged(self, runs: list[Row], rows: DataFrame | None) -> DataFrame:
        parts = [self._run(r) for r in runs]
        if rows is not None:
            place = F.struct(*self.position)
            folded = rows.groupBy(self.key).agg(F.min(place).alias("_first"),
                                                F.max(place).alias("_last"))
            if not parts:
                return folded
            parts.append(folded.repartition(runs[0]["buckets"], self.key))
        if not parts:
            return self.spark.createDataFrame([], self._run_schema())
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part)
        return both if len(parts) == 1 else both.groupBy(self.key).agg(
            F.min("_first").alias("_first"), F.max("_last").alias("_last"))

    def _run_schema(self) -> T.StructType:
        types = {f.name: f.dataType for f in self.fields.fields} | {"batch": T.StringType()}
        place = T.StructType([T.StructField(c, types[c]) for c in self.position])
        return T.StructType([T.StructField(self.key, types[self.key]),
                             T.StructField("_first", place), T.StructField("_last", place)])

    def _write_run(self, rows: DataFrame, run: str) -> None:
        name = f"run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, self.key).write
         .bucketBy(self.buckets, self.key).sortBy(self.key)
         .option("path", f"{self.path}/_levels/{run}").saveAsTable(name))
        self.spark.sql(f"DROP TABLE {name}")

    def _run(self, run: Row) -> DataFrame:
        """The run as the bucketed table that it is. Only the catalog tells Spark about buckets, so
        it is named there while the plan is made; its files are not touched."""
        name = f"run_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                            for f in self._run_schema().fields)
        place = f"{self.path}/_levels/{run['folder']}".replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) "
            f"SORTED BY (`{self.key}`) INTO {run['buckets']} BUCKETS LOCATION '{place}'")
        try:
            # No last row is null. The filter makes rows of the scan's column batches: a union of
            # batches (Spark 4.1) promises the buckets of its children but doesn't line them up.
            # A filter of the key itself would hide from the union that the buckets are alike.
            return self.spark.table(name).filter(F.col("_last").isNotNull())
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def _hadoop(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _batch_folders(self, name: str) -> list:
        jvm, files = self._hadoop()
        above = "".join(f"/{c}=*" for c in self.folders[:-1])
        found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}{above}/{name}"))
        return [entry.getPath() for entry in found or []]

    def _delete(self, folder: str) -> None:
        jvm, files = self._hadoop()
        places = (self._batch_folders(folder) if folder.startswith("batch=") else
                  [jvm.org.apache.hadoop.fs.Path(f"{self.path}/_levels/{folder}")])
        for place in places:
            files.delete(place, True)
