"""Lexical retrieval: postings and BM25.

Corpus statistics cover the whole store whatever a query is restricted to. A term
that a query repeats counts once for each repeat; a query of no terms finds
nothing.

A search (:func:`ranked`) reads the texts once and keeps the postings of the terms
asked for. They are dealt out by row in cells of bounded size; a cell scores its rows
for a block of queries and gives K rows a query, so no pair of query and row is moved.
Ids of rows are unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lectern.functions.text import search_terms
from lectern.plans.scratch import Scratch, workers_import_package

K1 = 1.2
B = 0.75
#: Postings of a cell, and queries and their terms of a block.
CELL = 100_000
QUERIES = 256
TERMS = 1 << 15
#: Most (query, term) rows that are sent to every task.
BROADCAST_TERMS = 200_000
#: Terms of rows that are counted together.
COUNTED = 1 << 18
#: Stands for a row as such in :func:`counted`; no term is empty.
ROW = ""
SLACK = 1e-5


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def part(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """What a term gives to the score of a row, but for its weight."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): occurrences of each term and the length of the row."""
    terms = rows.select(key, search_terms(F.col(text)).alias("terms"))
    terms = terms.select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return terms.groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


def counted(rows: DataFrame, columns: list[str], text: str, only: list[str] | None = None) -> DataFrame:
    """(columns, dl, term, tf): as :func:`postings`, without a shuffle, and one row of the term ``ROW`` for each of ``rows``.

    ``only``: the terms that are wanted, where they are few.
    """
    workers_import_package(rows.sparkSession)
    added = [StructField("dl", LongType()), StructField("term", StringType()), StructField("tf", IntegerType())]
    schema = StructType([*rows.select(*columns).schema.fields, *added])
    wanted = None if only is None else pa.array(only, pa.string())

    def count(b: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
        coded = b.column(len(columns)).flatten().dictionary_encode()
        words, base = coded.dictionary.cast(pa.string()), len(coded.dictionary) + 1
        code, row = coded.indices.to_numpy(), np.repeat(np.arange(b.num_rows), sizes)
        if wanted is not None:
            met = pc.is_in(words, value_set=wanted).to_numpy(zero_copy_only=False)[code]
            code, row = code[met], row[met]
        at, tf = np.unique(row * base + code, return_counts=True)
        at, tf = np.concatenate([at, np.arange(b.num_rows) * base + base - 1]), np.concatenate([tf, np.ones(b.num_rows, dtype=np.int64)])
        row, words = at // base, pa.concat_arrays([words, pa.array([ROW], pa.string())])
        own = [b.column(i).take(pa.array(row)) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays([*own, pa.array(sizes[row]), words.take(pa.array(at % base)), pa.array(tf.astype(np.int32))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column(len(columns))).to_numpy().astype(np.int64)
            ends, start = np.cumsum(sizes), 0
            while start < b.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + COUNTED, side="right")))
                yield count(b.slice(start, stop - start), sizes[start:stop])
                start = stop

    return rows.select(*columns, search_terms(F.col(text)).alias("_terms")).mapInArrow(run, schema)


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, scope, term, qtf): the terms of ``queries`` (query_id, text, perhaps scope)."""
    scope = F.col("scope").cast("string") if "scope" in queries.columns else F.lit(None).cast("string")
    asked = queries.select("query_id", scope.alias("scope"), F.explode(search_terms(F.col("text"))).alias("term"))
    return asked.groupBy("query_id", "scope", "term").agg(F.count("*").alias("qtf"))


def small(asked: DataFrame, n: int) -> DataFrame:
    """``asked``, which has ``n`` rows at most, broadcast if those are few."""
    return F.broadcast(asked) if n <= BROADCAST_TERMS else asked


def cell_scores(asked: pd.DataFrame, posted: pd.DataFrame, k: int, first: int | None) -> pd.DataFrame:
    """(query_id, id, score, matched, opened): the best ``k`` rows of a cell for each query, and a row of no id with its work.

    ``asked``: (query_id, scope, term, weight); ``posted``: (id, doc, bucket, term, part).
    Where ``first`` is given, so many buckets of the highest bounds are scored first, then
    only those whose bound reaches the k-th score. Scores are rounded to six places, half
    up, and equal ones go to the smaller id.
    """
    out = {"query_id": [], "id": [], "score": [], "matched": [], "opened": []}
    if len(asked) and len(posted) and k > 0:
        words = pd.Index(asked["term"].unique())
        term = words.get_indexer(posted["term"])
        order = np.argsort(term, kind="stable")
        row, ids = pd.factorize(posted["id"].to_numpy()[order], sort=True)
        doc, part, term = posted["doc"].to_numpy()[order], posted["part"].to_numpy()[order], term[order]
        # a row's bucket, numbered within the cell
        bucket = posted.groupby(["doc", "bucket"], dropna=False, sort=True).ngroup().to_numpy()[order]
        n = int(bucket.max()) + 1
        bucket_doc = np.empty(n, dtype=object)
        bucket_doc[bucket] = doc
        bucket_of = np.empty(len(ids), dtype=np.int64)
        bucket_of[row] = bucket
        starts = np.searchsorted(term, np.arange(len(words) + 1))
        asked = asked.assign(code=words.get_indexer(asked["term"]))
        for query_id, own in asked.groupby("query_id"):
            spans = [(starts[c], starts[c + 1], w) for c, w in zip(own["code"], own["weight"], strict=True) if starts[c] < starts[c + 1]]
            if not spans:
                continue
            at = np.concatenate([np.arange(a, z) for a, z, _ in spans])
            value = np.concatenate([part[a:z] * w for a, z, w in spans])
            wanted = own["scope"].iloc[0]
            if wanted is not None:
                inside = bucket_doc[bucket[at]] == wanted
                at, value = at[inside], value[inside]
            if not len(at):
                continue
            score = lambda held: np.floor(np.bincount(row[at[held]], value[held], minlength=len(ids)) * 1e6 + 0.5) / 1e6
            if first is None:
                held, opened = np.ones(len(at), dtype=bool), len(at)
            else:
                # of one term, the largest part in each bucket
                high = np.zeros(n)
                for a, z, w in spans:
                    most = np.zeros(n)
                    np.maximum.at(most, bucket[a:z], part[a:z])
                    high += w * most
                if wanted is not None:
                    high[bucket_doc != wanted] = 0
                chosen = np.zeros(n, dtype=bool)
                chosen[np.argsort(-high, kind="stable")[:first]] = True
                begun = np.unique(row[at[chosen[bucket[at]]]])
                if len(begun) >= k:
                    least = np.partition(score(chosen[bucket[at]])[begun], len(begun) - k)[len(begun) - k]
                    chosen |= high + SLACK >= least
                else:
                    chosen[:] = True
                held = chosen[bucket[at]]
                opened = int(held.sum())
            scores, met = score(held), np.unique(row[at[held]])
            best = met[np.argsort(-scores[met], kind="stable")[:k]]
            out["query_id"] += [query_id] * (len(best) + 1)
            out["id"] += [*ids[best], None]
            out["score"] += [*scores[best], None]
            out["matched"] += [None] * len(best) + [len(at)]
            out["opened"] += [None] * len(best) + [opened]
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()})


def in_cells(asked: DataFrame, posted: DataFrame, n_cells: int, cell: Column, k: int, first: int | None) -> DataFrame:
    """:func:`cell_scores` of all cells: ``asked`` (query_id, scope, term, weight), a saved table, and ``posted`` (id, doc, bucket, term, part)."""
    told = asked.agg(F.count_distinct("query_id"), F.count("*")).first()
    n_q = max(-(-told[0] // QUERIES), -(-told[1] // TERMS), 1)
    asked = asked.withColumn("i", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int"))
    needed = asked.select(F.col("i").alias("block"), "term").distinct()
    asked = asked.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))))
    dealt = posted.withColumn("cell", cell).join(small(needed, told[1]), "term")
    kinds = dict(asked.dtypes)["query_id"], dict(posted.dtypes)["id"]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double, matched bigint, opened bigint"
    return asked.groupBy("i", "j").cogroup(dealt.groupBy("block", "cell")).applyInPandas(lambda a, b: cell_scores(a, b, k, first), schema)


def ranked(queries: DataFrame, rows: DataFrame, k: int, scratch: Scratch | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, rank, id, score): the best ``k`` of :func:`bm25`, whose arguments these are, for each query."""
    scratch = scratch or Scratch(rows.sparkSession, "words")
    scoped = "scope" in queries.columns
    asked = scratch.save(asked_terms(queries), "asked")
    known = asked.select("term").distinct()
    doc = F.col("doc").cast("string") if scoped else F.lit(None).cast("string")
    few = asked.count() <= BROADCAST_TERMS
    held = counted(rows.select("id", doc.alias("doc"), "text"), ["id", "doc"], "text", [r.term for r in known.collect()] if few else None)
    if not few:
        held = held.join(known.unionByName(rows.sparkSession.createDataFrame([(ROW,)], "term string")), "term", "left_semi")
    held = scratch.save(held, "held")
    told = held.where(F.col("term") == ROW).agg(F.count("*"), F.avg("dl")).first()
    posted = held.where(F.col("term") != ROW)
    df = scratch.save(posted.groupBy("term").agg(F.count("*").alias("df")), "df")
    n_cells = max(1, -(-(df.agg(F.sum("df")).first()[0] or 0) // CELL))
    weight = F.col("qtf") * idf(F.lit(told[0]), F.col("df"))
    weighted = scratch.save(asked.join(df, "term").select("query_id", "scope", "term", weight.alias("weight")), "weights")
    parts = posted.select("id", "doc", F.lit(0).alias("bucket"), "term", part(F.col("tf"), F.col("dl"), F.lit(told[1]), k1, b).alias("part"))
    found = in_cells(weighted, parts, n_cells, F.pmod(F.xxhash64("id"), F.lit(n_cells)).cast("int"), k, None)
    return top(found.where("score IS NOT NULL"), k)


def bm25(queries: DataFrame, rows: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) of ``queries`` (query_id, text) against ``rows`` (id, text).

    Where queries have a ``scope``, rows have a ``doc``: a scope that is not null
    meets the postings of that document only, before anything is scored.
    """
    scoped = "scope" in queries.columns
    own = ["scope"] if scoped else []
    asked = queries.select("query_id", *own, F.explode(search_terms(F.col("text"))).alias("term"))
    asked = asked.groupBy("query_id", *own, "term").agg(F.count("*").alias("qtf"))
    lengths = rows.select(F.size(search_terms(F.col("text"))).alias("dl"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    # only the terms asked for are grouped: their postings are all that scores need
    posted = postings(rows, "id", "text").join(asked.select("term").distinct(), "term", "left_semi")
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = (stats.select(c).scalar() for c in ("n", "avgdl"))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    weighted = asked.join(df, "term")
    if scoped:
        free = weighted.where("scope IS NULL").join(posted, "term")
        bound = weighted.where("scope IS NOT NULL").join(posted.join(rows.select("id", F.col("doc").alias("scope")), "id"), ["term", "scope"])
        columns = ["query_id", "id", "qtf", "df", "tf", "dl"]
        hits = free.select(columns).unionByName(bound.select(columns))
    else:
        hits = weighted.join(posted, "term")
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(F.col("qtf") * idf(n, F.col("df")) * tf), 6).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the best K, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
