"""A stored lexical index: blocks of postings, and BM25 by their maxima.

Rows are dealt out to buckets of about ``BUCKET`` within their document (by a hash,
so no row needs a place of its own). A block holds what one term has in one bucket:
the ids, the term's occurrences and the lengths of the rows. A block of no term holds
all rows of its bucket. Blocks are made by groups of whole buckets from texts that are
read once, and stored sorted by term, statistics beside them.

A search reads the blocks of the terms asked for and deals buckets out in cells of
bounded size. A cell sums, for each query and bucket, weight times the largest part of
the query's terms: no row of the bucket can score more. The ``FIRST`` best buckets of
a query are scored first; of the others only those whose bound reaches the k-th best
score of the cell. A cell gives K rows a query. A query that is restricted to one
document meets that document's buckets only, while statistics stay those of the whole
store. A search reads the index and nothing else.

Equal scores (to six places) go to the smaller id. A row of no terms counts in the
statistics and is found by no query; a null text is one of no terms. Ids are unique.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import search_terms
from lectern.operators import lexical
from lectern.operators.lexical import ROW
from lectern.plans.scratch import Scratch, shuffles_go, workers_import_package

BUCKET = 16
FIRST = 24
#: Rows whose blocks are made together.
SHARD = 512
#: An index of many rows is written in parts of whole documents, each of which moves alone.
PARTS = 8
PART = 4_096


@dataclass(frozen=True)
class LexicalIndex:
    """Tables: blocks (term, doc, bucket, ids, tfs, dls), terms (term, df), stats (n, avgdl)."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str) -> LexicalIndex:
        return LexicalIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "terms", "stats")))

    def write(self, path: str) -> None:
        _write([self.blocks], path)


def _write(parts: Iterable[DataFrame], path: str) -> None:
    for blocks in parts:
        # a term's blocks go to several places, as some have nearly all rows
        with shuffles_go(blocks.sparkSession):
            blocks.repartition("term", F.pmod("bucket", F.lit(8))).sortWithinPartitions("term", "doc", "bucket").write.mode("append").parquet(f"{path}/blocks")
    stored = _of(blocks.sparkSession.read.parquet(f"{path}/blocks"))
    with shuffles_go(blocks.sparkSession):
        stored.terms.write.parquet(f"{path}/terms")
        stored.stats.write.parquet(f"{path}/stats")


def write(rows: DataFrame, path: str, bucket: int = BUCKET) -> None:
    """Writes the index of ``rows`` (id, doc, text); the shuffle files of one part at a time are on disk."""
    n = min(PARTS, -(-rows.count() // PART)) or 1
    part = F.pmod(F.xxhash64("doc", F.lit(n)), F.lit(n))
    _write((build(rows.where(part == i) if n > 1 else rows, bucket).blocks for i in range(n)), path)


def _of(blocks: DataFrame) -> LexicalIndex:
    terms = blocks.where(F.col("term") != ROW).groupBy("term").agg(F.sum(F.size("ids")).alias("df"))
    total = F.sum(F.aggregate("dls", F.lit(0).cast("bigint"), lambda s, x: s + x))
    n = F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")
    return LexicalIndex(blocks, terms, blocks.where(F.col("term") == ROW).agg(n, F.coalesce(total / F.sum(F.size("ids")), F.lit(0.0)).alias("avgdl")))


def build(rows: DataFrame, bucket: int = BUCKET) -> LexicalIndex:
    """Index of ``rows`` (id, doc, text)."""
    workers_import_package(rows.sparkSession)
    dealt = _buckets(rows, bucket)
    n_shards = -(-rows.count() // SHARD) or 1
    # texts are dealt out as they are and cut into terms afterwards
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc", "bucket"), F.lit(n_shards))).repartition("shard")
    dealt = dealt.select("shard", "id", "doc", "bucket", search_terms(F.col("text")).alias("terms"))
    kinds = dict(dealt.dtypes)
    schema = f"term string, doc {kinds['doc']}, bucket bigint, ids array<{kinds['id']}>, tfs array<int>, dls array<int>"
    return _of(dealt.groupBy("shard").applyInArrow(_blocks, schema))


def _blocks(table: pa.Table) -> pa.Table:
    """(term, doc, bucket, ids, tfs, dls) of rows (id, doc, bucket, terms) that hold whole buckets."""
    ids, doc, bucket, terms = (table.column(c).combine_chunks() for c in ("id", "doc", "bucket", "terms"))
    n, dls = len(ids), pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = terms.flatten().dictionary_encode()
    words = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([ROW], pa.string())])
    of = pd.DataFrame({"doc": doc.to_pandas(), "bucket": bucket.to_pandas()}).groupby(["doc", "bucket"], dropna=False).ngroup().to_numpy()
    row = np.concatenate([np.repeat(np.arange(n), dls), np.arange(n)])
    code = np.concatenate([coded.indices.to_numpy(), np.full(n, len(words) - 1)])
    # by term, bucket and row
    at, tf = np.unique((code * n + of[row]) * n + row, return_counts=True)
    row, block = at % n, at // n
    new = np.flatnonzero(np.diff(block, prepend=-1))
    first, offsets = pa.array(row[new]), pa.array(np.append(new, len(at)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (ids.take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(dls[row].astype(np.int32)))]
    return pa.table([words.take(pa.array(block[new] // n)), doc.take(first), bucket.take(first), *lists], names=["term", "doc", "bucket", "ids", "tfs", "dls"])


def _buckets(rows: DataFrame, bucket: int) -> DataFrame:
    """(id, doc, text, bucket): the rows of a document over as many buckets as they fill."""
    counted = rows.groupBy("doc").agg(F.ceil(F.count("*") / bucket).alias("n_buckets"))
    dealt = rows.select("id", "doc", "text").alias("r").join(counted.alias("c"), F.col("r.doc").eqNullSafe(F.col("c.doc")))
    return dealt.select("id", "r.doc", "text", F.pmod(F.xxhash64("id"), F.col("n_buckets")).alias("bucket"))


def search(index: LexicalIndex, queries: DataFrame, k: int, scratch: Scratch, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, id, score) of ``queries`` (query_id, text, perhaps scope), and (query_id, matched, opened): postings met and scored."""
    n, avgdl = index.stats.first()
    weight = F.col("qtf") * lexical.idf(F.lit(n), F.col("df"))
    asked = scratch.save(lexical.asked_terms(queries).join(index.terms, "term").select("query_id", "scope", "term", weight.alias("weight"), "df"), "asked")
    known = asked.select("term", "df").distinct()
    told = asked.count(), known.agg(F.sum("df")).first()[0] or 0
    n_cells = max(1, -(-told[1] // lexical.CELL))
    blocks = index.blocks.join(lexical.small(known.select("term"), told[0]), "term", "left_semi")
    posted = blocks.select("term", F.col("doc").cast("string").alias("doc"), "bucket", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("e"))
    part = lexical.part(F.col("e.tfs"), F.col("e.dls"), F.lit(avgdl))
    posted = posted.select(F.col("e.ids").alias("id"), "doc", "bucket", "term", part.alias("part"))
    cell = F.pmod(F.xxhash64("doc", "bucket"), F.lit(n_cells)).cast("int")
    found = scratch.save(lexical.in_cells(asked.drop("df"), posted, n_cells, cell, k, first), "found")
    work = found.where("matched IS NOT NULL").groupBy("query_id").agg(F.sum("matched").alias("matched"), F.sum("opened").alias("opened"))
    return lexical.top(found.where("score IS NOT NULL"), k), work
