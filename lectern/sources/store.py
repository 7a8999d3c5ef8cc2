"""Versioned tables behind one pointer, for ingest runs that may die or be repeated.

A run writes its tables to folders of their own and then makes them visible at once
by creating one small file, the commit, under the next number; creating it fails if
another run took that number. What a run wrote before it died is named by no commit,
so it is never read, and nothing stays locked. A commit also names the batch it came
from: a batch that a commit names already changes nothing when it comes again.

Tables that a run does not write keep the folders of the commit before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lectern.plans.scratch import shuffles_go


class Conflict(RuntimeError):
    """Another run committed in the meantime; the run may be started again."""


@dataclass(frozen=True)
class Snapshot:
    """One commit: its number, its batch and the folder of each table."""

    number: int
    batch: int
    folders: dict[str, str]


EMPTY = Snapshot(0, -1, {})


class Store:
    """Tables under ``path`` in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, name: str) -> Snapshot | None:
        stream = self._fs.open(self._hadoop(f"{self.path}/commits/{name}"))
        try:
            told = json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:  # its writer died between creating and filling it
            return None
        finally:
            stream.close()
        return Snapshot(int(name.split(".")[0]), told["batch"], told["folders"])

    def current(self) -> Snapshot:
        """The newest commit; an empty snapshot where there is none."""
        for name in reversed(self._names("commits")):
            found = self._read(name)
            if found is not None:
                return found
        return EMPTY

    def table(self, name: str, at: Snapshot | None = None) -> DataFrame | None:
        """The table as of a commit, the newest by default; null where it was never written."""
        at = at or self.current()
        folder = at.folders.get(name)
        return None if folder is None else self.spark.read.parquet(f"{self.path}/tables/{folder}")

    def run(self, batch: int, work: Callable[[Snapshot], dict[str, DataFrame | Callable[[str], None]]]) -> bool:
        """Applies a batch unless it is in the store already; says whether it did.

        ``work`` makes tables from the current snapshot: DataFrames, or functions
        that write what they hold to a folder. Batches come in rising order.
        """
        before = self.current()
        if batch <= before.batch:
            return False
        folders = dict(before.folders)
        with shuffles_go(self.spark):
            for name, made in work(before).items():
                folders[name] = f"{name}-{batch}-{uuid.uuid4().hex}"
                target = f"{self.path}/tables/{folders[name]}"
                made.write.parquet(target) if isinstance(made, DataFrame) else made(target)
        self._commit(before.number, batch, folders)
        return True

    def _commit(self, before: int, batch: int, folders: dict[str, str]) -> None:
        names = self._names("commits")
        if names and self.current().number != before:
            raise Conflict(f"the store went on from commit {before}")
        number = 1 + max((int(n.split(".")[0]) for n in names), default=0)
        at = self._hadoop(f"{self.path}/commits/{number:012d}.json")
        try:
            stream = self._fs.create(at, False)
        except Exception as error:
            raise Conflict(f"commit {number} was taken by another run") from error
        try:
            stream.write(bytearray(json.dumps({"batch": batch, "folders": folders}).encode()))
        finally:
            stream.close()

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes tables that none of the newest ``keep`` commits names; not while a run is on."""
        kept: set[str] = set()
        for name in self._names("commits")[-keep:]:
            found = self._read(name)
            kept |= set(found.folders.values()) if found else set()
        gone = [n for n in self._names("tables") if n not in kept]
        for n in gone:
            self._fs.delete(self._hadoop(f"{self.path}/tables/{n}"), True)
        return gone
