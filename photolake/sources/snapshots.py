"""Tables in numbered versions: Parquet folders that manifests list. A manifest appears whole or not at all, so writers can't cross.

A writer reads a version, writes its changes beside the data, and puts the manifest of the next version in place. If another
writer was first, the version is taken: the changes are made anew from what that one left. A writer that dies leaves files
that no manifest lists.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from photolake.sources.scratch import small_tasks

#: Folders of changes that a table may have before the next commit writes it anew.
MOST_CHANGES = 16


class Conflict(RuntimeError):
    """The version that was to be written exists: another writer was first."""


def _put_once(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A file with the text under this name, whole or not at all; ``Conflict`` if the name is taken.

    On a local or mounted path by a hard link, elsewhere by a rename, which must not replace a file (as on HDFS).
    """
    draft = f".{name}-{uuid.uuid4().hex}"
    if urlparse(folder).scheme in ("", "file"):
        local = unquote(urlparse(folder).path)
        os.makedirs(local, exist_ok=True)
        with open(f"{local}/{draft}", "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(f"{local}/{draft}", f"{local}/{name}")
        except FileExistsError as e:
            raise Conflict(name) from e
        finally:
            os.unlink(f"{local}/{draft}")
        return
    jvm = spark._jvm
    source, goal = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}") for n in (draft, name))
    fs = goal.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(source, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(goal) or not fs.rename(source, goal):
        fs.delete(source, False)
        raise Conflict(name)


class Snapshot:
    """One version: ``read`` gives its tables, ``marks`` how far each stream has come."""

    def __init__(self, store: Snapshots, manifest: dict):
        self.store, self.manifest = store, manifest
        self.version, self.marks = manifest["version"], manifest["marks"]

    def read(self, name: str, only: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The table: of rows with one key those of the latest change. What changed is small beside the table and meets it by key.

        ``only`` keeps some rows by what they hold; it is asked before the table meets its changes, so that the rest moves nowhere.
        """
        about = self.manifest["tables"][name]
        spark, key = self.store.spark, about["key"]
        schema = StructType.fromJson(about["schema"])
        parts = [spark.read.schema(schema).parquet(f"{self.store.path}/{p}") for p in about["parts"]]
        if len(parts) == 1:
            return only(parts[0])
        changes = parts[1].withColumn("change_", F.lit(1))
        for k, part in enumerate(parts[2:], 2):
            changes = changes.unionByName(part.withColumn("change_", F.lit(k)))
        last = changes.groupBy(*key).agg(F.max_by(F.struct(*schema.names), "change_").alias("row_")).select("row_.*")
        return only(parts[0]).join(last.select(*key), key, "left_anti").select(*schema.names).unionByName(only(last).select(*schema.names))


class Snapshots:
    """The versions under ``path``, on storage that all writers share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """The latest version, 0 where there is none."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return max([int(n.split(".")[0]) for n in names if n[0] != "."], default=0)

    def at(self, version: int | None = None) -> Snapshot:
        version = self.version() if version is None else version
        if not version:
            return Snapshot(self, {"version": 0, "tables": {}, "marks": {}})
        text = self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).first()[0]
        return Snapshot(self, json.loads(text))

    def create(self, tables: dict[str, tuple[DataFrame, list[str]]]) -> Snapshot:
        """Version 1 from whole tables, each with its key; ``Conflict`` if there is one."""
        about = {name: {"key": key, "schema": df.schema.jsonValue(), "parts": [self._written(name, df)]} for name, (df, key) in tables.items()}
        return self._commit({"version": 1, "tables": about, "marks": {}})

    def update(self, change: Callable[[Snapshot], dict[str, DataFrame]], mark: tuple[str, int] | None = None, tries: int = 20) -> Snapshot:
        """The next version: ``change`` makes of a snapshot the new and changed rows of its tables, and is asked again after a conflict.

        ``mark`` names a stream and its batch: a batch that is not above the stream's mark was committed before and changes
        nothing. Mark and rows are committed together.
        """
        for _ in range(tries):
            now = self.at()
            if mark and now.marks.get(mark[0], -1) >= mark[1]:
                return now
            tables = {name: dict(about) for name, about in now.manifest["tables"].items()}
            for name, rows in change(now).items():
                about = tables[name]
                rows = rows.select(*[f["name"] for f in about["schema"]["fields"]])
                about["parts"] = [*about["parts"], self._written(name, rows)]
            marks = {**now.marks, **({mark[0]: mark[1]} if mark else {})}
            try:
                done = self._commit({"version": now.version + 1, "tables": tables, "marks": marks})
            except Conflict:
                continue
            return self._compacted(done)
        raise Conflict(f"{self.path}: {tries} tries")

    def _compacted(self, now: Snapshot) -> Snapshot:
        """Tables with many changes written anew, as a version of its own; left for the next commit if another writer comes between."""
        long = [name for name, about in now.manifest["tables"].items() if len(about["parts"]) > MOST_CHANGES]
        if not long:
            return now
        tables = {name: {**about, "parts": [self._written(name, now.read(name))]} if name in long else about for name, about in now.manifest["tables"].items()}
        try:
            return self._commit({"version": now.version + 1, "tables": tables, "marks": now.marks})
        except Conflict:
            return now

    def _written(self, name: str, df: DataFrame) -> str:
        part = f"{name}-{uuid.uuid4().hex}"
        with small_tasks(self.spark):
            df.write.parquet(f"{self.path}/{part}")
        return part

    def _commit(self, manifest: dict) -> Snapshot:
        if self.version() >= manifest["version"]:  # its manifest may be cleaned away
            raise Conflict(str(manifest["version"]))
        _put_once(self.spark, f"{self.path}/versions", f"{manifest['version']:012d}.json", json.dumps(manifest))
        return Snapshot(self, manifest)

    def clean(self, keep: int = 10) -> None:
        """Deletes manifests but the last ``keep``, and the folders that none of these lists.

        Not while a writer is at work: its folder is not listed yet.
        """
        last = self.version()
        kept = range(max(1, last - keep + 1), last + 1)
        used = {p for v in kept for about in self.at(v).manifest["tables"].values() for p in about["parts"]} | {"versions"}
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")):
            if not f.getPath().getName().startswith(".") and int(f.getPath().getName().split(".")[0]) < kept[0]:
                fs.delete(f.getPath(), False)
        for f in fs.listStatus(top):
            if f.getPath().getName() not in used:
                fs.delete(f.getPath(), True)
