"""Steps around ingestion: fetched files, caches, unions with what is stored, counters."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import lineage_state
from lectern.operators.tools import SCAN_SUFFIX
from lectern.plans.scratch import Scratch
from lectern.sources.files import is_pdf


def fetch_status(stored_size: Column, content: Column) -> Column:
    """What becomes of a download: a stored file stays, empty and foreign content is rejected."""
    return (
        F.when(F.coalesce(stored_size, F.lit(0)) > 0, "kept")
        .when(F.coalesce(F.length(content), F.lit(0)) == 0, "empty")
        .when(~is_pdf(content), "not a pdf")
        .otherwise("fetched")
    )


def cached_values(texts: DataFrame, cache: DataFrame, model: str | None = None) -> DataFrame:
    """``texts`` (id, text) with ``key``, ``value`` and whether it was ``cached``; misses have no value yet.

    The key is the sha256 of the text, behind the model's name and a newline where
    one is given. ``cache``: (key, value); of a key held twice the least value counts.
    """
    whole = F.col("text") if model is None else F.concat(F.lit(model + "\n"), F.col("text"))
    keyed = texts.where("text IS NOT NULL").select("id", F.sha2(whole, 256).alias("key"))
    held = cache.groupBy("key").agg(F.min("value").alias("value"), F.lit(True).alias("cached"))
    return keyed.join(held, "key", "left").select("id", "key", "value", F.coalesce("cached", F.lit(False)).alias("cached"))


def checked_values(misses: DataFrame, made: DataFrame) -> DataFrame:
    """``made`` (key, value), failing where it has not one value for each of ``misses`` (key)."""
    counted = misses.select("key").distinct().agg(F.count("*").alias("asked")).crossJoin(made.agg(F.count("*").alias("got")))  # one row each
    wrong = counted.where("asked <> got").first()
    if wrong:
        raise ValueError(f"{wrong.got} values for {wrong.asked} texts")
    return made


def union_with_stored(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The batch and the stored rows whose keys it has not."""
    return batch.unionByName(stored.join(batch.select(key).distinct(), key, "left_anti").select(*batch.columns))


def incremental_groups(batch: DataFrame, stored: dict[str, DataFrame], scratch: Scratch) -> dict[str, DataFrame]:
    """Lineage state after a batch (doc_id, title, cluster, published_on, embedding); see :mod:`lectern.operators.lineage_state`."""
    return stored | lineage_state.apply(stored, batch, batch.select("doc_id").distinct(), scratch)


def append_tables(prose: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """Chunks of a document in one sequence: prose (key, seq, page, end_page, kind, text), then tables (key, page, nth, text) by page."""
    counted = prose.groupBy(key).agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("page", "nth")) - 1
    placed = tables.withColumn("at", nth).join(counted, key, "left").withColumn("seq", (F.coalesce("n", F.lit(0)) + F.col("at")).cast("int"))
    own = placed.select(key, "seq", "page", F.col("page").alias("end_page"), F.lit("Table").alias("kind"), "text")
    every = prose.select(key, "seq", "page", "end_page", "kind", "text").unionByName(own)
    return every.withColumn("chunk_id", F.format_string("%s-%04d", F.col(key).cast("string"), "seq"))


def counters(pages: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, pages, ocr_pages, tables, chunks, skipped): ``pages`` (key, kind), ``chunks`` (key, kind).

    A document without chunks is skipped with a warning.
    """
    seen = pages.groupBy(key).agg(F.count("*").alias("pages"), F.count_if(F.col("kind") == "OcrProse").alias("ocr_pages"))
    made = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.count_if(F.col("kind") == "Table").alias("tables"))
    zero = F.lit(0)
    joined = seen.join(made, key, "left")
    return joined.select(key, "pages", "ocr_pages", F.coalesce("tables", zero).alias("tables"), F.coalesce("chunks", zero).alias("chunks"), F.col("chunks").isNull().alias("skipped"))


def native_scan_pairs(docs: DataFrame) -> DataFrame:
    """(native, scan): documents (doc_id) beside their scanned copies."""
    scans = docs.where(F.col("doc_id").endswith(SCAN_SUFFIX)).select(F.col("doc_id").alias("scan"))
    native = F.substring("scan", F.lit(1), F.length("scan") - len(SCAN_SUFFIX))
    return docs.select(F.col("doc_id").alias("native")).join(scans.withColumn("native", native), "native").select("native", "scan")


@contextlib.contextmanager
def exclusive_run(spark: SparkSession, folder: str, lease: float = 6 * 3_600) -> Iterator[None]:
    """One run at a time on a shared folder: a second one fails at once.

    A marker older than ``lease`` seconds is of a run that died and is taken over. Ingest
    runs need none of this, as commits of :mod:`lectern.sources.store` exclude each other.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_running")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.createNewFile(path):
        age = time.time() - fs.getFileStatus(path).getModificationTime() / 1000
        if age <= lease:
            raise RuntimeError(f"a run of {age:.0f} seconds holds {folder}")
        fs.delete(path, False)
        if not fs.createNewFile(path):
            raise RuntimeError(f"another run took {folder}")
    try:
        yield
    finally:
        fs.delete(path, False)
