"""Small tables that are replaced as a whole, version by version.

Without a table format a path must not be overwritten while it is read. So each change is written
beside the versions and then renamed to a new `version=N` folder, which fails if another job has
done so first; readers take the newest one that carries the job's success mark.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version:012d}"

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark._jsparkSession.sessionState()
                                             .newHadoopConf())

    def versions(self) -> list[int]:
        """Finished versions, oldest first."""
        jvm, root, files = self._files()
        if not files.exists(root):
            return []
        done = []
        for entry in files.listStatus(root):
            name = entry.getPath().getName()
            mark = jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
            if name.startswith("version=") and files.exists(mark):
                done.append(int(name.split("=")[1]))
        return sorted(done)

    def read(self) -> DataFrame:
        """The newest version; empty if there is none."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(found[-1]))

    def newest(self) -> int | None:
        """Number of the newest version, None if there is none."""
        return max(self.versions(), default=None)

    def replace(self, df: DataFrame, after: int | None = -1) -> None:
        """Makes `df`, which may read the current version, the next version; or the one that
        follows version `after` (None: the first), if `df` was made from that. A failed write
        leaves the current version in place, and a version that exists is refused."""
        known = self.newest() if after == -1 else after
        folder = self._folder(0 if known is None else known + 1)
        waiting = f"{self.path}/_new-{uuid.uuid4().hex}"
        df.select(*self.schema.names).write.parquet(waiting)
        jvm, root, files = self._files()
        path = jvm.org.apache.hadoop.fs.Path
        if files.exists(path(folder)) and not files.exists(path(folder, "_SUCCESS")):
            files.delete(path(folder), True)  # left by a failed write
        options = self.spark.sparkContext._gateway.new_array(
            jvm.org.apache.hadoop.fs.Options.Rename, 0)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                files.makeQualified(root).toUri(), conf).rename(
                    path(waiting), path(folder), options)
        except Py4JJavaError as error:
            files.delete(path(waiting), True)
            if "FileAlreadyExists" in str(error.java_exception.toString()):
                raise RuntimeError(f"{folder} was committed by another job") from error
            raise

    def prune(self, keep: int = 3) -> None:
        """Deletes all but the newest `keep` versions."""
        jvm, _, files = self._files()
        for version in self.versions()[:-keep]:
            files.delete(jvm.org.apache.hadoop.fs.Path(self._folder(version)), True)
