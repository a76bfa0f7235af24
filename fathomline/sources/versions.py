"""A table by scope whose versions are swapped at once.

Rows lie in folders of the load that wrote them and of their scope. A version is a
small file in `_log` that names the folder of every scope; it is written under
another name and renamed when all data is there. Readers take the last version, so
they see a load whole or not at all, and a run that is stopped leaves what
was there before. A load replaces the scopes that it holds without reading or
copying others; to delete a scope is to leave it out. A writer's batches carry rising numbers, and one
that a version already holds changes nothing, so batches may be repeated. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScopedTable:
    """A table in `folder` with the columns of `schema`; `scope` are the columns that tell its scopes apart."""

    spark: SparkSession
    folder: str
    schema: str
    scope: tuple[str, ...]

    def _path(self, below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version; 0 before the first load."""
        files, log = self._files(), self._path("_log")
        names = [s.getPath().getName() for s in files.listStatus(log)] if files.exists(log) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def state(self, version: int | None = None) -> dict:
        """scopes: folder by scope; batches: the last batch by writer."""
        version = self.version() if version is None else version
        if not version:
            return {"scopes": {}, "batches": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/_log/{version}.json", wholetext=True).head()["value"])

    def _commit(self, state: dict) -> int:
        files, version = self._files(), self.version() + 1
        early, final = self._path(f"_log/.{version}-{uuid.uuid4().hex}"), self._path(f"_log/{version}.json")
        out = files.create(early)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if files.exists(final) or not files.rename(early, final):
            raise RuntimeError(f"version {version} was written by someone else")
        return version

    def read(self, version: int | None = None, scopes: list[str] | None = None) -> DataFrame:
        """The rows of a version, of all scopes or of some by their key; reads their folders only."""
        known = self.state(version)["scopes"]
        paths = [f"{self.folder}/data/{p}" for k, p in sorted(known.items()) if scopes is None or k in scopes]
        names = [f.split()[0] for f in self.schema.split(", ")]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(f"{self.schema}, load string").option("basePath", f"{self.folder}/data").parquet(*paths).select(*names)

    def key(self, row: dict) -> str:
        """A scope's key."""
        return json.dumps([None if row[c] is None else str(row[c]) for c in self.scope])

    def replace(self, rows: DataFrame, also: list[dict] = (), writer: str | None = None, batch: int = 0) -> int:
        """Exchanges the scopes that rows hold, and those of `also` that may be empty now; returns the version."""
        before = self.state()
        if writer is not None and batch <= before["batches"].get(writer, -1):
            return self.version()
        load = f"load={uuid.uuid4().hex}"
        names = [f.split()[0] for f in self.schema.split(", ")]
        salt = F.pmod(F.xxhash64(*(c for c in names if c not in self.scope)), F.lit(16))  # a crowded scope is written by many tasks
        rows.select(*names).repartition(*self.scope, salt).write.partitionBy(*self.scope).parquet(f"{self.folder}/data/{load}")
        scopes = dict(before["scopes"])
        for gone in also:
            scopes.pop(self.key(gone), None)
        files, level = self._files(), [("", [])]
        for _ in self.scope:  # the scopes' own folders, one level a column
            level = [
                (f"{at}/{s.getPath().getName()}", [*values, _value(s.getPath().getName())])
                for at, values in level for s in files.listStatus(self._path(f"data/{load}{at}")) if s.isDirectory() and "=" in s.getPath().getName()
            ]
        scopes |= {json.dumps(values): f"{load}{at}" for at, values in level}
        batches = before["batches"] | ({writer: batch} if writer is not None else {})
        return self._commit({"scopes": scopes, "batches": batches})

    def delete(self, where: Callable[[list], bool]) -> int:
        """Leaves out the scopes whose values `where` accepts; their data stays until `clean`."""
        before = self.state()
        return self._commit(before | {"scopes": {k: p for k, p in before["scopes"].items() if not where(json.loads(k))}})

    def clean(self) -> int:
        """Deletes loads that the last version doesn't name, what stopped runs left included; returns their number."""
        files, data = self._files(), self._path("data")
        used = {p.split("/")[0] for p in self.state()["scopes"].values()}
        stale = [s.getPath() for s in files.listStatus(data) if s.getPath().getName() not in used] if files.exists(data) else []
        for path in stale:
            files.delete(path, True)
        return len(stale)


def _value(name: str) -> str | None:
    from urllib.parse import unquote

    value = unquote(name.split("=", 1)[1])
    return None if value == "__HIVE_DEFAULT_PARTITION__" else value


def merged_by(table: ScopedTable, key: list[str], order: list[str], writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: rows of a batch replace the table's rows of the same key if they come later by `order`.

    The table's only scope is `bucket`, a hash of the key; a batch reads and rewrites the buckets it touches. A batch that
    is repeated after it was committed changes nothing; one that was stopped before starts anew.
    """
    (bucket,) = table.scope

    def merge(batch: DataFrame, number: int) -> None:
        if number <= table.state()["batches"].get(writer, -1):
            return
        new = batch.persist()
        touched = [r[0] for r in new.select(bucket).distinct().collect()]  # buckets, a fixed number
        old = table.read(scopes=[table.key({bucket: b}) for b in touched])
        newest = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
        both = old.unionByName(new.select(*old.columns)).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
        table.replace(both, writer=writer, batch=number)
        new.unpersist()

    return merge


def buckets(key: list[str], n: int = 16) -> Column:
    """The bucket of a row's key."""
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int").alias("bucket")
