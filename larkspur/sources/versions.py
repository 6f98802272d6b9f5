"""Tables that change as a whole: several tables as one version, and a sink that takes each key once.

Both write Parquet to folders that nothing reads yet, and then one small file that names them. That file appears by an
atomic rename, so a reader sees all of a change or none of it, and a run that dies leaves folders that no file names.
Paths are any that Spark's Hadoop file systems know; nothing is read or written outside them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.updates import refuse_maps


class Conflict(Exception):
    """Another writer was first."""


class _Log:
    """Numbered JSON files of a folder, each written once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(self.folder).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def numbers(self) -> list[int]:
        where = self.path(self.folder)
        if not self.fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self.fs.open(self.path(f"{self.folder}/{number:09}.json"))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def add(self, number: int, entry: dict) -> None:
        """Write file `number`; it is an error if it is there already."""
        final, draft = f"{self.folder}/{number:09}.json", f"{self.folder}/.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(draft), False)
        try:
            stream.write(json.dumps(entry).encode())
        finally:
            stream.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            # A rename that doesn't overwrite: of two writers of one number the second gets an error.
            files.rename(self.fs.makeQualified(self.path(draft)), self.fs.makeQualified(self.path(final)), none)
        except Exception as e:
            self.fs.delete(self.path(draft), False)
            if self.fs.exists(self.path(final)):
                raise Conflict(f"version {number} of {self.folder} is there already") from e
            raise

    def remove(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)

    def folders(self, parent: str) -> list[str]:
        where = self.path(parent)
        return [s.getPath().getName() for s in self.fs.listStatus(where) if s.isDirectory()] if self.fs.exists(where) else []


class VersionedTables:
    """Tables below `root` that change together.

    `_versions/<n>.json` names the folder of each table of version n. A writer gives the tables that it changes; the others
    are carried over by name. A version is read whole or not at all, and older versions stay readable until `vacuum`.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = _Log(spark, f"{self.root}/_versions")

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return max(self.log.numbers(), default=0)

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """Every table of a version, by default the newest. Schemas are part of the version, so that empty tables have theirs."""
        n = self.version() if version is None else version
        named = self.log.read(n)["tables"] if n else {}
        return {name: self.spark.read.schema(T.StructType.fromJson(t["schema"])).parquet(f"{self.root}/{t['folder']}") for name, t in named.items()}

    def commit(self, changed: Mapping[str, DataFrame], based_on: int | None = None) -> int:
        """Write the changed tables and make them the next version, whose number is returned.

        based_on: the version that the changes were made from, by default the newest; if there is a newer one when they
        are written, that is a `Conflict` and nothing changes.
        """
        base = self.version() if based_on is None else based_on
        named = dict(self.log.read(base)["tables"]) if base else {}
        attempt = uuid.uuid4().hex
        for name, rows in changed.items():
            folder = f"{name}/{attempt}"
            refuse_maps(rows).write.parquet(f"{self.root}/{folder}")
            named[name] = {"folder": folder, "schema": json.loads(rows.schema.json())}
        self.log.add(base + 1, {"tables": named})
        return base + 1

    def update(self, change: Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]], tries: int = 5) -> int:
        """Commit what `change` makes of the newest version's tables, again from the newest one after a conflict."""
        for k in range(tries):
            base = self.version()
            try:
                return self.commit(change(self.tables(base)), base)
            except Conflict:
                if k == tries - 1:
                    raise
        raise AssertionError

    def seed_if_empty(self, tables: Mapping[str, DataFrame]) -> bool:
        """Commit `tables` as the first version; whether there was none before."""
        if self.version():
            return False
        try:
            self.commit(tables, 0)
        except Conflict:
            return False
        return True

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the folders that none of the `keep` newest versions names, those of failed writers too; returns them.

        No writer may be at work meanwhile, as its folders have no name yet.
        """
        numbers = self.log.numbers()[-keep:]
        named = {t["folder"] for n in numbers for t in self.log.read(n)["tables"].values()}
        gone = [f"{name}/{f}" for name in self.log.folders(self.root) if not name.startswith("_") for f in self.log.folders(f"{self.root}/{name}") if f"{name}/{f}" not in named]
        for folder in gone:
            self.log.remove(f"{self.root}/{folder}")
        return gone


@dataclass(frozen=True)
class Kinds:
    """What an earlier result of a key means: codes of errors that are results, so their keys aren't tried again."""

    permanent: tuple[str, ...] = ()


class KeyedSink:
    """Results with their records, one for each key, committed in batches.

    A batch is written to a folder of its own; then a manifest that names it appears. Only batches with a manifest are
    read. A run that is repeated asks `pending` for the jobs that have no result yet. A result is a row without `error`,
    or with a permanent one; other errors are tried again, and the record of each attempt stays.
    """

    def __init__(self, spark: SparkSession, root: str, key: Sequence[str], kinds: Kinds = Kinds(), error: str = "error"):
        self.spark, self.root, self.key, self.kinds, self.error = spark, root.rstrip("/"), list(key), kinds, error
        self.log = _Log(spark, f"{self.root}/_commits")

    def attempts(self) -> DataFrame | None:
        """Every row of every committed batch, and `_batch`, its number; null before the first."""
        entries = [(n, self.log.read(n)) for n in self.log.numbers()]
        if not entries:
            return None
        schema = T.StructType.fromJson(entries[-1][1]["schema"])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/{e['folder']}" for _, e in entries])
        batch = F.element_at(F.create_map(*[x for n, e in entries for x in (F.lit(e["folder"]), F.lit(n))]), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        return rows.withColumn("_batch", batch)

    def _is_result(self) -> F.Column:
        error = F.col(self.error)
        code = error["code"] if isinstance(self._kind, T.StructType) else error
        return error.isNull() | (code.isin(*self.kinds.permanent) if self.kinds.permanent else F.lit(False))

    def results(self) -> DataFrame | None:
        """The first result of each key."""
        rows = self.attempts()
        if rows is None:
            return None
        self._kind = rows.schema[self.error].dataType
        own = [c for c in rows.columns if c not in (*self.key, "_batch")]
        first = rows.where(self._is_result()).groupBy(*self.key).agg(F.min_by(F.struct(*own), "_batch").alias("_r"))
        return first.select(*self.key, *[F.col(f"_r.{c}").alias(c) for c in own])

    def failures(self) -> DataFrame | None:
        """Keys that have attempts but no result: how many attempts, and the last error."""
        rows, done = self.attempts(), self.results()
        if rows is None:
            return None
        left = rows.join(done.select(*self.key), self.key, "left_anti")
        return left.groupBy(*self.key).agg(F.count("*").alias("attempts"), F.max_by(self.error, "_batch").alias("last_error"))

    def pending(self, jobs: DataFrame) -> DataFrame:
        """Jobs whose key has no result."""
        done = self.results()
        return jobs if done is None else jobs.join(done.select(*self.key), self.key, "left_anti")

    def commit(self, rows: DataFrame) -> int:
        """Write a batch (keys, results, error) and commit it; its number. Keys must be different within a batch."""
        folder = uuid.uuid4().hex
        refuse_maps(rows).write.parquet(f"{self.root}/data/{folder}")
        entry = {"folder": folder, "schema": json.loads(rows.schema.json())}
        while True:
            n = max(self.log.numbers(), default=0) + 1
            try:
                self.log.add(n, entry)
                return n
            except Conflict:
                continue

    def run(self, jobs: DataFrame, work: Callable[[DataFrame], DataFrame], batches: int = 1) -> int:
        """Take up the pending jobs in so many batches, by a hash of their keys, each committed when it is done; the number of batches with jobs.

        A run that dies loses the batch that it is at, and no other.
        """
        done = 0
        for k in range(batches):
            part = self.pending(jobs.where(F.pmod(F.xxhash64(*self.key), F.lit(batches)) == k))
            if not part.isEmpty():
                self.commit(work(part))
                done += 1
        return done

    def vacuum(self) -> list[str]:
        """Delete folders of batches that were never committed; no writer may be at work meanwhile."""
        named = {self.log.read(n)["folder"] for n in self.log.numbers()}
        gone = [f for f in self.log.folders(f"{self.root}/data") if f not in named]
        for f in gone:
            self.log.remove(f"{self.root}/data/{f}")
        return gone
