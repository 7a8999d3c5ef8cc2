"""Reading of the driver's tables, and bounded samples to learn from."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lectern.plans.scratch import workers_import_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one table; ``sf_dir`` may be any path Spark can read."""
    workers_import_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Small pieces of Arrow batches, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def row_keys(rows: DataFrame) -> DataFrame:
    """(id, other columns, h, t, n) of ``rows`` (id, text, ...): hashes of id and text, and the text's length.

    One text for each id and other columns, the one whose hash is lowest, so an id
    that repeats counts once. Null and empty texts are left out. No text moves.
    """
    others = [c for c in rows.columns if c != "text"]
    hashed = rows.select(*others, F.xxhash64("id").alias("h"), F.xxhash64("text").alias("t"), F.length("text").alias("n")).where("n > 0")
    return hashed.groupBy(*others, "h").agg(F.min(F.struct("t", "n")).alias("first")).select(*others, "h", "first.*")


def fetch_rows(rows: DataFrame, keys: list[Row], chars: int) -> list[Row]:
    """The rows of ``keys`` (from :func:`row_keys`), in the order of their hashes.

    Keys are taken in their order while their texts
    have at most ``chars`` characters altogether; one that does not fit is passed
    over, so what reaches the driver is bounded whatever the rows hold.
    """
    chosen = []
    for k in keys:
        if k.n <= chars:
            chosen.append(k)
            chars -= k.n
    if not chosen:
        return []
    others = [c for c in rows.columns if c != "text"]
    names = [*others, "t"]
    schema = row_keys(rows).select(*names).schema
    wanted = rows.sparkSession.createDataFrame([tuple(k[c] for c in names) for k in chosen], schema)
    found = rows.withColumn("t", F.xxhash64("text")).join(F.broadcast(wanted), names).groupBy(*names).agg(F.first("text").alias("text"))
    by_key = {tuple(r[c] for c in names): r for r in found.collect()}
    return [by_key[k] for k in (tuple(k[c] for c in names) for k in chosen) if k in by_key]


def sample_rows(rows: DataFrame, most: int, chars: int) -> list[Row]:
    """At most ``most`` of ``rows`` (id, text, ...), those whose ids hash lowest; see :func:`row_keys` and :func:`fetch_rows`."""
    return fetch_rows(rows, row_keys(rows).orderBy("h", "id", "t").limit(most).collect(), chars)
