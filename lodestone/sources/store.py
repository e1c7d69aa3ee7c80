"""Versioned Parquet tables: readers see one snapshot of all tables, writers publish the next."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has published meanwhile."""


class Store:
    """Tables below a folder.

    Data is written to folders of its own first. A snapshot is a manifest, which names the folder of each
    table; manifests are numbered, and one is published by renaming a finished file to the next number,
    which fails if that is taken. So readers see the last finished snapshot at any time, several tables
    change at once or not at all, and of two writers the second starts anew from what the first published.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._never_overwrite = spark.sparkContext._gateway.new_array(options, 1)
        self._never_overwrite[0] = options.NONE
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)

    def _manifests(self) -> list[str]:
        """Names of the published manifests, oldest first."""
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(n for n in names if n.endswith(".json") and n[:-5].isdecimal())

    def snapshot(self) -> tuple[int, dict[str, str]]:
        """The number of the last manifest (0: none), and each table's folder."""
        names = self._manifests()
        if not names:
            return 0, {}
        text = self.spark.read.text(f"{self.root}/_manifests/{names[-1]}", wholetext=True).first()[0]
        return int(names[-1][:-5]), json.loads(text)

    def version(self, name: str) -> str | None:
        """A table's current folder."""
        return self.snapshot()[1].get(name)

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The current snapshot of a table; an empty one of the schema if there is none."""
        return self._read(name, self.version(name), schema)

    def _read(self, name: str, version: str | None, schema: str | None = None) -> DataFrame:
        if version is None:
            if schema is None:
                raise ValueError(f"there is no table {name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, df: DataFrame) -> str:
        """A new folder of a table, which no reader sees yet."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{version}")
        return version

    def commit(self, base: int, tables: dict[str, str]) -> None:
        """Publish a manifest as the one after `base`."""
        work = self._path(f"{self.root}/_manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(work, False)
        out.write(bytearray(json.dumps(tables, sort_keys=True), "utf-8"))
        out.close()
        try:
            self._context.rename(work, self._path(f"{self.root}/_manifests/{base + 1:012d}.json"), self._never_overwrite)
        except Exception as e:
            self._fs.delete(work, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"manifest {base + 1} is taken") from e
            raise

    def change(self, make, tries: int = 5) -> None:
        """Publish make(tables) -> {name: frame} on top of the current snapshot; if another writer comes first, again."""
        for k in range(tries):
            base, tables = self.snapshot()
            frames = make({n: self._read(n, v) for n, v in tables.items()})
            try:
                return self.commit(base, tables | {n: self.write(n, df) for n, df in frames.items()})
            except Conflict:
                if k + 1 == tries:
                    raise

    def publish(self, name: str, df: DataFrame) -> None:
        """Make df the current snapshot of a table. The old one stays until vacuum(), for those who still read it."""
        self.change(lambda tables: {name: df})

    def upsert(self, name: str, rows: DataFrame, key: str) -> None:
        """Replace all rows of the keys that rows has."""
        self.upsert_all({name: (rows, key)})

    def upsert_all(self, changes: dict[str, tuple[DataFrame, str]]) -> None:
        """Upserts of several tables in one snapshot: (rows, key) by name."""
        self.change(lambda tables: {n: without(tables[n], rows, key).unionByName(rows) if n in tables else rows for n, (rows, key) in changes.items()})

    def delete(self, name: str, column: str, value: str) -> None:
        """Drop the rows of a document or question; a blank value is an error."""
        self.delete_all([name], column, value)

    def delete_all(self, names: list[str], column: str, value: str) -> None:
        """Drop the rows of a document or question from several tables in one snapshot."""
        if not value or not value.strip():
            raise ValueError(f"{column} is blank")
        self.change(lambda tables: {n: tables[n].where(~F.col(column).eqNullSafe(F.lit(value))) for n in names if n in tables})

    def reset(self) -> None:
        """Drop all tables."""
        self._fs.delete(self._path(self.root), True)

    def vacuum(self, name: str) -> int:
        """Delete a table's folders that the current snapshot doesn't name, and manifests before it."""
        number, tables = self.snapshot()
        gone = 0
        folder = self._path(f"{self.root}/{name}")
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getPath().getName() != tables.get(name):
                self._fs.delete(s.getPath(), True)
                gone += 1
        for n in self._manifests():
            if int(n[:-5]) < number:
                self._fs.delete(self._path(f"{self.root}/_manifests/{n}"), False)
        return gone


def without(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Existing rows whose key isn't among rows."""
    return existing.join(rows.select(key).distinct(), key, "left_anti")


def new_only(rows: DataFrame, *indexed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is in none of the indexed tables."""
    for t in indexed:
        rows = without(rows, t, key)
    return rows
