"""Run-scoped tables in the folder that the driver and all executors share.

Lineage is cut by writing a table and reading it again, so a lost executor costs
at most the running stage. The folder is the session's ``spark.checkpoint.dir``;
only where that is unset (tests, local runs) a local default is used.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _settings(spark: SparkSession) -> tuple[str | None, str]:
    return spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master


def shared_dir(spark: SparkSession) -> str:
    """Folder named by the session; a local one only where the session names none and runs in one process."""
    named, master = _settings(spark)
    if not named and not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or "file://" + os.path.join(tempfile.gettempdir(), "lectern-checkpoints")


def workers_import_package(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed there."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_PACKAGE_ROOT, *filter(None, paths)])


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder is scratch
        pass


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it ends.

    Without it they stay until the driver collects its objects, so a job of many steps holds those of
    all. A frame made inside should be run once.
    """
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)


class Scratch:
    """Tables of one query call; the folder goes when the process ends."""

    def __init__(self, spark: SparkSession, name: str, within: str | None = None):
        self.spark = spark
        self.path = f"{(within or shared_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        workers_import_package(spark)
        atexit.register(_delete, spark, self.path)

    def part(self, label: str) -> Scratch:
        """Scratch of one step below this one, which may be dropped alone."""
        return Scratch(self.spark, label, self.path)

    def drop(self) -> None:
        """Deletes all tables; what was made of them must be written by now."""
        _delete(self.spark, self.path)

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and return a scan of what was written; its shuffle files go."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{label}"
        with shuffles_go(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
