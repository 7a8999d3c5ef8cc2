"""Dense retrieval: exact cosine top-K of a query set, in blocks.

Queries and rows are dealt out in blocks of bounded size; one pair of blocks is
one matrix product, which keeps K rows a query. The merge ranks what the blocks
kept, so the rows moved are K a query and row block however large the store is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import cosines

BLOCK = 4_096
#: Queries of a block that are compared at once, and rows that a pair of blocks may give.
STRIP = 128
MOST_FOUND = 1 << 19


def _dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def _matrices(*sides: pd.Series) -> list[np.ndarray]:
    return [np.array(x.tolist(), dtype=np.float64).reshape(len(x), -1) for x in sides]


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Six places, half away from zero, as databases round."""
    return np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6, scores) + 0.0


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the K highest of each row, in order and equal ones by column; -inf is not counted."""
    found = scores > -np.inf
    if k < scores.shape[1]:
        found &= scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(found)
    order = np.lexsort((-scores[row, col], row))
    row, col = row[order], col[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first]


def _best_of_blocks(pdf: pd.DataFrame, k: int, weight: float, strip: int) -> pd.DataFrame:
    """The K best rows of each query of one pair of blocks.

    Beside the vectors and what is found only the products of one strip of queries are held.
    """
    scopes = pd.Series(pd.factorize(pdf["scope"])[0], pdf.index)
    a, b, x = pdf[pdf["kind"] == "query"], pdf[pdf["kind"] == "row"].sort_values("key"), pdf[pdf["kind"] == "barred"]
    taken = {int(of): held.to_numpy() for of, held in x.groupby("of")["key"]}
    keys, ids, bonus = a["key"].to_numpy(), b["key"].to_numpy(), b["bonus"].to_numpy()
    wanted, scope = scopes[a.index].to_numpy(), scopes[b.index].to_numpy()
    out = {"query_id": [keys[:0]], "id": [ids[:0]], "score": [bonus[:0]], "sim": [bonus[:0]]}
    asked, held = _matrices(a["vector"], b["vector"]) if len(a) and len(b) else (np.zeros((0, 1)), None)
    for start in range(0, len(asked), strip):
        part = slice(start, start + strip)
        sims = cosines(asked[part], held)
        s = _rounded(weight * sims + bonus)
        s[np.isnan(s)] = -np.inf
        if (wanted[part] >= 0).any():
            s[(wanted[part, None] >= 0) & (wanted[part, None] != scope)] = -np.inf
        for n, key in enumerate(keys[part]):
            if key in taken:
                s[n, np.isin(ids, taken[key])] = -np.inf
        row, col = _best(s, k)
        for name, values in (("query_id", keys[part][row]), ("id", ids[col]), ("score", s[row, col]), ("sim", sims[row, col])):
            out[name].append(values)
    return pd.DataFrame({name: np.concatenate(values) for name, values in out.items()})


def dense_topk(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK, barred: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score) for ``queries`` (query_id, vector, scope) and ``rows`` (id, vector, scope).

    A scope that is not null restricts a query to the rows of that scope, and
    ``barred`` (query_id, id) takes rows from single queries, both before the top K
    is taken. Scores are rounded to six places and ties go to the smaller id. Null
    vectors are left out on both sides.
    """
    if k < 1:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    return weighted_topk(queries, rows.withColumn("bonus", F.lit(0.0)), k, 1.0, block, barred).select("query_id", "rank", "id", "score")


def weighted_topk(queries: DataFrame, rows: DataFrame, k: int, weight: float, block: int = BLOCK, barred: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score, sim): the best K by ``weight`` times the cosine plus the row's ``bonus``.

    Arguments as in :func:`dense_topk`, rows with ``bonus`` (double). What is barred
    goes to the pairs of blocks that its query and row are in. A large K makes the
    blocks of queries smaller, and products are taken in strips, so that a pair of
    blocks takes no more memory for more queries, rows or a larger K.
    """
    queries, rows = queries.where("vector IS NOT NULL"), rows.where("vector IS NOT NULL")
    q_block = max(1, min(block, MOST_FOUND // min(k, block)))
    n_q, n_r = (-(-df.count() // size) or 1 for df, size in ((queries, q_block), (rows, block)))
    kind = "array<double>"
    vector, scope = F.col("vector").cast(kind).alias("vector"), F.col("scope").cast("string").alias("scope")
    q = _dealt(queries.select(F.col("query_id").cast("bigint").alias("key"), vector, scope), "key", n_q)
    r = _dealt(rows.select(F.col("id").cast("bigint").alias("key"), vector, scope, F.col("bonus").cast("double").alias("bonus")), "key", n_r)
    none = F.lit(None).cast("bigint").alias("of")
    q = q.select("key", "vector", "scope", F.lit(0.0).alias("bonus"), F.lit("query").alias("kind"), none, F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))).alias("j"))
    r = r.select("key", "vector", "scope", "bonus", F.lit("row").alias("kind"), none, F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("i"), F.col("block").alias("j"))
    every = q.unionByName(r)
    if barred is not None:
        ids = barred.select(F.col("id").cast("bigint").alias("key"), F.col("query_id").cast("bigint").alias("of"))
        x = _dealt(_dealt(ids, "of", n_q).withColumnRenamed("block", "i"), "key", n_r).withColumnRenamed("block", "j")
        x = x.select("key", F.lit(None).cast(kind).alias("vector"), F.lit(None).cast("string").alias("scope"), F.lit(0.0).alias("bonus"), F.lit("barred").alias("kind"), "of", "i", "j")
        every = every.unionByName(x)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        return _best_of_blocks(pdf, k, weight, STRIP)

    found = every.groupBy("i", "j").applyInPandas(product, "query_id bigint, id bigint, score double, sim double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score", "sim")


def all_similarities(queries: DataFrame, rows: DataFrame, block: int = 1_024) -> DataFrame:
    """(query_id, id, sim): the cosine of every one of ``queries`` (query_id, vector) with every one of ``rows`` (id, vector).

    For scorers that are to give every candidate of a stated query set. Both sides
    are dealt out in blocks of bounded size, and a pair of blocks is one matrix product.
    Null vectors are left out; a zero one has similarity 0.
    """
    n_q, n_r = (-(-df.count() // block) or 1 for df in (queries, rows))
    vector = F.col("vector").cast("array<double>").alias("vector")
    q = _dealt(queries.where("vector IS NOT NULL").select(F.col("query_id").cast("bigint").alias("key"), vector), "key", n_q)
    r = _dealt(rows.where("vector IS NOT NULL").select(F.col("id").cast("bigint").alias("key"), vector), "key", n_r)
    q = q.select("key", "vector", F.lit(True).alias("asks"), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))).alias("j"))
    r = r.select("key", "vector", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("i"), F.col("block").alias("j"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "sim": []})
        sims = cosines(*_matrices(a["vector"], b["vector"]))
        return pd.DataFrame({"query_id": np.repeat(a["key"].to_numpy(), len(b)), "id": np.tile(b["key"].to_numpy(), len(a)), "sim": sims.ravel()})

    return q.unionByName(r).groupBy("i", "j").applyInPandas(product, "query_id bigint, id bigint, sim double")
