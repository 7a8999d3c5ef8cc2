"""Rank fusion, reranking, per-document cap and the hybrid pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import search_terms
from lectern.interfaces import Grader


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, rank, id, score) from ``lists`` (query_id, list_no, rank, id): sums of 1 / (k + rank)."""
    if k < 0:
        raise ValueError("k must not be negative")
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "id", "score")


def diversity_cap(ranked: DataFrame, k: int = 6, per_doc: int = 4) -> DataFrame:
    """First ``per_doc`` of each document in rank order, then the passed-over ones, up to ``k``.

    ``ranked``: (query_id, rank, id, doc). Adds ``place``; fewer than ``k`` rows
    remain only where there are fewer. Where a column ``scope`` holds the one
    document a query is restricted to, the first ``k`` stay as they are.
    """
    if per_doc < 1:
        raise ValueError("at least one passage a document is needed")
    in_doc = Window.partitionBy("query_id", "doc").orderBy("rank")
    over = F.row_number().over(in_doc) > per_doc
    capped = ranked.withColumn("over_cap", (over & F.col("scope").isNull() if "scope" in ranked.columns else over).cast("int"))
    place = Window.partitionBy("query_id").orderBy("over_cap", "rank")
    return capped.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).drop("over_cap")


def term_coverage(query: str, text: str):
    """Deterministic grade from 0 to 10: the share of query terms that the whole passage holds."""
    asked = F.array_distinct(search_terms(F.col(query)))
    held = F.size(F.array_intersect(asked, search_terms(F.col(text))))
    return F.when(F.size(asked) > 0, F.round(10.0 * held / F.size(asked), 6)).otherwise(F.lit(0.0))


def rerank(ranked: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """Order by grade (0 to 10, missing 0), then by the rank before; the first ``k``."""
    graded = ranked.join(grades, ["query_id", "id"], "left")
    graded = graded.withColumn("grade", F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce("grade", F.lit(0.0)))))
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")
    return graded.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def passthrough(ranked: DataFrame, k: int) -> DataFrame:
    """The first ``k`` in their order, as a reranker that changes nothing."""
    return ranked.where(F.col("rank") <= k).withColumn("place", F.col("rank"))


def hybrid(
    dense: DataFrame, lexical: DataFrame, queries: DataFrame, rows: DataFrame, shortlist: int = 10, k: int = 6, per_doc: int = 4, grader: Grader = term_coverage
) -> DataFrame:
    """:func:`hybrid_of` of two ranked lists (query_id, rank, id)."""
    columns = ["query_id", "rank", "id"]
    lists = dense.select(*columns, F.lit(0).alias("list_no")).unionByName(lexical.select(*columns, F.lit(1).alias("list_no")))
    return hybrid_of(lists, queries, rows, shortlist, k, per_doc, grader)


def hybrid_of(lists: DataFrame, queries: DataFrame, rows: DataFrame, shortlist: int = 10, k: int = 6, per_doc: int = 4, grader: Grader = term_coverage) -> DataFrame:
    """Fuses ranked lists (query_id, list_no, rank, id), grades the shortlist and caps it by document.

    ``rows``: (id, doc, text); ``queries``: (query_id, text), with ``scope`` where
    some are restricted to one document, which the cap then leaves alone. The grader
    sees the shortlist only.
    """
    fused = rrf(lists).where(F.col("rank") <= shortlist)
    seen = fused.join(rows.withColumnRenamed("text", "passage"), "id").join(queries.withColumnRenamed("text", "question"), "query_id")
    about = ["doc", "scope"] if "scope" in queries.columns else ["doc"]
    grades = seen.select("query_id", "id", *about, grader("question", "passage").alias("grade"))
    ordered = rerank(fused, grades, shortlist).select("query_id", F.col("place").alias("rank"), "id", *about, "grade")
    return diversity_cap(ordered, k, per_doc)
