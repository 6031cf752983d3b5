"""Date-partitioned raw history: read, land, publish."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoline import constants as C
from thermoline import schemas
from thermoline.operators import cleaning, sequence
from thermoline.session import materialize
from thermoline.sources.versions import VersionedTable

# Holds the text of a JSON line that could not be read.
BROKEN = "_broken_line"

# Names of files of JSON lines.
LINES = "*.json*"

# Without it, JSON output cuts times to milliseconds.
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

JSON_HISTORY = T.StructType([*schemas.MESSAGE.fields, T.StructField("dt", T.DateType())])


def read_history(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 merge_schema: bool = False) -> DataFrame:
    """Parquet files of the tree, whatever else lies in it; `dt` comes from the folders.

    Without `schema` the columns are those of one file; `merge_schema` collects them from all
    files, which takes a job over their footers.
    """
    reader = (spark.read.option("pathGlobFilter", "*.parquet")
              .option("mergeSchema", str(merge_schema).lower()))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def _lines(spark: SparkSession, path: str, schema: T.StructType, names: str) -> DataFrame:
    marked = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    return (spark.read.schema(marked).option("columnNameOfCorruptRecord", BROKEN)
            .option("pathGlobFilter", names).json(path))


def read_history_json(spark: SparkSession, path: str,
                      schema: T.StructType = JSON_HISTORY, names: str = LINES) -> DataFrame:
    """JSON-Lines files of the tree; `dt` comes from the folders. Lines that are no JSON object
    are no rows: `rejected_lines` has them."""
    # A broken line has no field at all; naming one keeps Spark from reading the mark alone.
    first = schema.fields[0].name
    return _lines(spark, path, schema, names).filter(
        F.col(BROKEN).isNull() | F.col(first).isNotNull()).drop(BROKEN)


def rejected_lines(spark: SparkSession, path: str,
                   schema: T.StructType = JSON_HISTORY, names: str = LINES) -> DataFrame:
    """(dt, line, reject_reason) of the JSON lines that are not read as readings."""
    first = schema.fields[0].name
    broken = _lines(spark, path, schema, names).filter(
        F.col(BROKEN).isNotNull() & F.col(first).isNull())
    return broken.select("dt", F.col(BROKEN).alias("line"),
                         F.lit(C.INVALID_JSON).alias("reject_reason"))


def _footer(uri: str) -> str:
    """Names and types of a Parquet file's columns, from its footer alone."""
    from pyarrow import fs, parquet

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        system, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:  # names may hold signs that a URI escapes: only the store is looked up by URI
        store, _, key = rest.lstrip("/").partition("/")
        scheme = "s3" if scheme in ("s3a", "s3n") else scheme
        system, base = fs.FileSystem.from_uri(f"{scheme}://{store}/")
        name = f"{base.rstrip('/')}/{key}"
    with system.open_input_file(name) as file:
        columns = parquet.read_metadata(file).schema
    return "; ".join(f"{c.path} {c.physical_type} {c.logical_type}" for c in columns)


def file_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(path, layout) of every Parquet file of the tree: the physical schema that its footer
    states. The footers are read in tasks; the data are not."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(layout=[_footer(uri) for uri in batch["path"]])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select("path").mapInPandas(read, "path string, layout string")


def _together(schemas_found: Sequence[T.StructType]) -> list[tuple[T.StructType, list[int]]]:
    """Schemas in as few groups as a first fit gives, so that in a group each column has one
    type; with the group's columns and the places of its schemas."""
    groups: list[tuple[dict[str, T.StructField], list[int]]] = []
    for place, schema in enumerate(schemas_found):
        have = {f.name.lower(): f for f in schema.fields}
        for columns, places in groups:
            if all(columns[n].dataType == f.dataType for n, f in have.items() if n in columns):
                columns.update({n: f for n, f in have.items() if n not in columns})
                places.append(place)
                break
        else:
            groups.append((have, [place]))
    return [(T.StructType(list(columns.values())), places) for columns, places in groups]


def read_drifted(spark: SparkSession, path: str) -> list[DataFrame]:
    """The Parquet files of the tree as few tables, each with all columns of its files.

    Columns that some files lack are no conflict: Spark collects them in one job over the footers,
    and there is one table. Where types differ, files are told apart by their footers' schemas;
    those that agree in the types of all shared columns are read together. The driver gets one
    example of each schema, and the paths of each group, as Spark's own file index does.
    """
    try:
        return [read_history(spark, path, merge_schema=True)]
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
    found = materialize(file_layouts(spark, path), "layouts")
    examples = found.groupBy("layout").agg(F.min("path").alias("path")).orderBy("layout").collect()
    # Folder columns keep the type that the whole tree gives them.
    folders = spark.read.format("binaryFile").load(path).schema.fields[4:]
    named = {f.name.lower() for f in folders}
    parts = []
    for schema, places in _together([spark.read.parquet(e["path"]).schema for e in examples]):
        rows = found.filter(F.col("layout").isin(*[examples[k]["layout"] for k in places]))
        files = [r["path"] for r in rows.select("path").collect()]
        full = [*[f for f in schema.fields if f.name.lower() not in named], *folders]
        parts.append(spark.read.schema(T.StructType(full)).option("basePath", path)
                     .parquet(*files))
    return parts


def load_history(spark: SparkSession, path: str, dedupe: bool = False,
                 layouts: Sequence[tuple[str, T.StructType | None]] | None = None,
                 merge_schema: bool = False) -> DataFrame:
    """Parquet and JSON-Lines files of the same date folders as one canonical table.

    Files may have been written by different writers: doubles, texts and longs may lie beside
    decimals, times and ints, and a column that some files lack is null for these alone
    (`read_drifted`). Where the writers are known, `layouts` saves the job over the footers: each
    is a pattern of file names, and their schema or None for that of one of them; `merge_schema`
    collects the columns of all files of a layout. With `dedupe` a reading delivered more than
    once counts once (its latest copy); readings without id all count.
    """
    def parquet(names: str, schema: T.StructType | None) -> list[DataFrame]:
        reader = (spark.read.option("pathGlobFilter", names)
                  .option("mergeSchema", str(merge_schema).lower()))
        return [(reader if schema is None else reader.schema(schema)).parquet(path)]

    reads = ([partial(read_drifted, spark, path)] if layouts is None
             else [partial(parquet, *layout) for layout in layouts])
    parts = []
    for read in [*reads, lambda: [read_history_json(spark, path)]]:
        try:
            parts += [cleaning.canonicalize(part) for part in read()]
        except AnalysisException as error:
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    if dedupe:
        rows = sequence.dedupe(rows, "reading_id",
                               [F.desc("txn_timestamp"), F.desc("dt"), "machine_id", "branch",
                                "cycle_temperature", "status", "breakdown_soon"])
    return rows


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """(dt, files, bytes, changed) per date folder, from the file listing alone: no file is
    opened."""
    listed = spark.read.format("binaryFile").load(path)
    return listed.groupBy("dt").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"),
                                    F.max("modificationTime").alias("changed"))


# What a target's manifest lists: the source's files that it was made of.
MANIFEST = T.StructType([T.StructField("path", T.StringType()),
                         T.StructField("length", T.LongType()),
                         T.StructField("modified", T.TimestampType()),
                         T.StructField("dt", T.DateType())])


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, dt) of every file, from the listing alone."""
    listed = spark.read.format("binaryFile").load(path)
    day = F.col("dt").cast("date") if "dt" in listed.columns else F.lit(None).cast("date")
    return listed.select("path", "length", F.col("modificationTime").alias("modified"),
                         day.alias("dt"))


def manifest(spark: SparkSession, target: str) -> VersionedTable:
    """The files of the source that `target` was last made of. Readers of the target pass over
    the folder, as over any whose name begins with an underscore."""
    return VersionedTable(spark, f"{target.rstrip('/')}/_published", MANIFEST)


def _lacking(files: DataFrame, others: DataFrame) -> DataFrame:
    """Files that `others` does not list, or lists with another length or time."""
    same = ["path", "length", "modified"]
    return files.join(others.select(*same), same, "left_anti")


def changed_dates(spark: SparkSession, source: str, target: str,
                  files: DataFrame | None = None) -> DataFrame:
    """The dates (dt) whose files in `source` are not those that `target` was made of: some came,
    whatever their time, some are gone, or some have another length or time. A target without
    manifest lacks all dates. `files` is a listing made before."""
    have = source_files(spark, source) if files is None else files
    known = manifest(spark, target).read()
    return _lacking(have, known).select("dt").unionAll(_lacking(known, have).select(
        "dt")).distinct()


def load_first(spark: SparkSession,
               sources: Sequence[Callable[[SparkSession], DataFrame]]) -> DataFrame:
    """The first source whose path exists. Only a missing or empty path moves on to the next;
    any other failure is raised."""
    missing: AnalysisException | None = None
    for source in sources:
        try:
            df = source(spark)
            df.schema  # resolves the path
            return df
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            missing = error
    raise missing if missing is not None else ValueError("no source given")


def write_result(df: DataFrame, path: str) -> None:
    """Replaces a result table."""
    df.write.mode("overwrite").parquet(path)


def write_result_json(df: DataFrame, path: str) -> None:
    """Replaces a result as JSON Lines, written by the tasks; nothing passes the driver."""
    df.write.mode("overwrite").option("timestampFormat", JSON_TIME).json(path)


def write_history(df: DataFrame, path: str, partitions: Sequence[str] = ("dt",),
                  file_format: str = "parquet") -> None:
    """Replaces exactly the partitions present in `df`.

    The rebalance gathers each date into few files, and splits a date that holds much of the
    data over several tasks, so no date is written by one task alone. The sort by date that the
    writer needs goes on by time, so that row groups can be skipped by it.
    """
    rows = df.hint("rebalance", *[F.col(p) for p in partitions])
    if "txn_timestamp" in df.columns:
        rows = rows.sortWithinPartitions(*partitions, "txn_timestamp")
    writer = (rows.write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy(*partitions))
    if file_format == "json":
        writer = writer.option("timestampFormat", JSON_TIME)
    writer.format(file_format).save(path)


def drop_dates(spark: SparkSession, target: str, dates: Sequence[str | None]) -> None:
    """Deletes the folders of dates; those that do not exist are passed over."""
    jvm = spark.sparkContext._jvm
    for day in dates:
        folder = jvm.org.apache.hadoop.fs.Path(
            f"{target}/dt={day or '__HIVE_DEFAULT_PARTITION__'}")
        files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if files.exists(folder):
            files.delete(folder, True)


def sync_partitions(spark: SparkSession, source: str, target: str,
                    dates: Sequence[str] | None = None, files: DataFrame | None = None,
                    derive: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Publishes raw history to another store: each date replaces that date there, in compacted
    files, with all its columns; a date that has no files or no rows any more goes. `dates` names
    the dates; by default those that changed since they were published, of which the driver gets
    the list (one entry per date). With `derive` the target holds what that makes of the rows; it
    must keep `dt`, and make the rows of a date from that date's rows alone.

    The source is listed first (or `files` is its listing, a written table), and the listing is
    committed as the target's manifest last. So a file that lands while the dates are written is
    not in the manifest and its date is published again next time, whether or not it was read
    now; a job that fails in between leaves the old manifest and is simply repeated.
    """
    listed = materialize(source_files(spark, source), "listing") if files is None else files
    known = manifest(spark, target)
    if dates is None:
        dates = [None if r["dt"] is None else str(r["dt"])
                 for r in changed_dates(spark, source, target, listed).collect()]
    if not dates:
        return
    # Null dates are compared as text, so that one list serves all.
    day = F.coalesce(F.col("dt").cast("string"), F.lit(""))
    wanted = day.isin(*[d or "" for d in dates])
    held = {r["d"] for r in listed.where(wanted).select(day.alias("d")).distinct().collect()}
    filled: set[str] = set()
    if held:
        rows = load_history(spark, source)
        named = [F.lit(d).cast("date") for d in dates if d is not None]
        chosen = F.col("dt").isin(*named) if named else F.lit(False)
        rows = rows.filter(chosen | F.col("dt").isNull() if None in dates else chosen)
        seen = Observation()
        write_history((rows if derive is None else derive(rows)).observe(
            seen, F.collect_set(day).alias("dates")), target)
        filled = set(seen.get["dates"])
    drop_dates(spark, target, [d for d in dates if (d or "") not in filled])
    known.replace(known.read().where(~wanted).unionByName(listed.where(wanted)))
    known.prune()


def sync_report(df: DataFrame) -> DataFrame:
    """What a store holds: rows and first and last reading per date, newest date first."""
    return (df.groupBy("dt").agg(F.count(F.lit(1)).alias("row_count"),
                                 F.min("txn_timestamp").alias("first_reading"),
                                 F.max("txn_timestamp").alias("last_reading"))
            .orderBy(F.desc("dt")))
