"""Snapshots of tables under a folder, swapped by a compare-and-set pointer.

A version is a small file ``markers/v<n>`` that names, for each table, the folders of
rows that it consists of. A commit writes its rows to folders of their own and then
publishes the next version's file, whole or not at all and never over another: of two
writers that start from one version one gets a conflict, and a run that breaks off
leaves rows that no version names. A table is written anew or grows by the new rows
alone. Readers pin a version. Files are handled through Hadoop's file system, so the
folder may be in any store that Spark writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from recallframe.session import publish, published


class Conflict(RuntimeError):
    """Somebody else committed first."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version, 0 without any."""
        markers = self._path(f"{self.folder}/markers")
        if not self._fs.exists(markers):
            return 0
        return max((int(s.getPath().getName()[1:]) for s in self._fs.listStatus(markers)), default=0)

    def _folders(self, version: int) -> dict[str, list[str]]:
        return json.loads(published(self.spark, f"{self.folder}/markers/v{version}")) if version else {}

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self._folders(self.version() if version is None else version))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        return self.spark.read.parquet(*[f"{self.folder}/data/{f}" for f in self._folders(version)[table]])

    def commit(self, tables: dict[str, DataFrame], expected: int, added: dict[str, DataFrame] | None = None) -> int:
        """Version ``expected`` + 1: ``tables`` are written anew, tables of ``added`` get these rows behind their own, others stay. All of it or nothing."""
        if self.version() != expected:
            raise Conflict(f"version {self.version()}, not {expected}")
        folders, name = self._folders(expected), uuid.uuid4().hex
        for table, rows in {**tables, **(added or {})}.items():
            rows.write.parquet(f"{self.folder}/data/{name}/{table}")
            before = [] if table in tables else folders.get(table, [])
            folders[table] = [*before, f"{name}/{table}"]
        if not publish(self.spark, f"{self.folder}/markers/v{expected + 1}", json.dumps(folders)):
            raise Conflict(f"version {expected + 1} is taken")
        return expected + 1
