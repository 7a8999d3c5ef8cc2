"""Exact top-k search by integer inner product (operator 13): columnar branch-and-bound.

Components become ``floor(scale * x)``. Candidates are dealt out in blocks of
bounded size and so are the queries; each pair of blocks is one group. Inside it
candidates lie in a vertical layout, one row for each dimension, and are taken
chunk by chunk:

* a query adds up ``dims`` dimensions at a time, those first in which it has most
  of its mass;
* what the dimensions left over can still add is at most the root of the query's
  remaining mass times the candidate's (Cauchy and Schwarz);
* candidates whose sum and bound stay below the query's k-th best score are left
  out, and the survivors are compacted, so later dimensions touch few.

Scores of survivors are whole, and a bound equal to the k-th best never leaves a
candidate out, so ties go to the smaller id as asked. Each group gives k rows a
query, of which a window keeps k.

Cases: vectors that are null or hold null or non-finite components and rows
without an id take no part; rows that share an id are one vector, the least in the
order of arrays, which is no candidate of its own id; vectors of different lengths
are not compared, and empty ones score 0 with each other; a query with fewer than
k candidates gets all of them; an empty table gives an empty result; other columns
are not read. Sums beyond 53 bits are made with whole numbers of any size, and a
score beyond 64 bits is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TopK:
    k: int = 5
    scale: int = 256
    #: Dimensions that are added up between two looks at the bounds.
    dims: int = 8
    rows_a_block: int = 16_384
    queries_a_block: int = 4_096
    #: Candidates of a block that are held against a query at once.
    chunk: int = 4_096


def integer_vectors(vectors: DataFrame, p: TopK) -> DataFrame:
    """(vec_id, v) of usable rows, one for each id."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * p.scale)).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


class Chunk:
    """Some candidates in vertical layout: dimensions by candidates."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, dims: int, whole: bool):
        self.ids = ids
        self.parts = [np.ascontiguousarray(rows[:, a : a + dims].T) for a in range(0, rows.shape[1], dims)]
        self.mass = [(x.astype(np.float64) ** 2).sum(axis=0) for x in self.parts]
        self.total = np.sum(self.mass, axis=0) if self.mass else np.zeros(len(ids))
        self.dtype = object if whole else np.float64

    def survivors(self, query: list[np.ndarray], mass: list[float], least: float | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(positions, scores, products made) of the candidates that may score ``least`` or more."""
        at, rest, own = None, self.total, float(sum(mass))
        score = np.zeros(len(self.ids), dtype=self.dtype)
        work = 0
        for b in sorted(range(len(mass)), key=lambda k: -mass[k]):
            part = self.parts[b] if at is None else self.parts[b][:, at]
            score = score + query[b] @ part
            work += part.size
            own -= mass[b]
            rest = rest - (self.mass[b] if at is None else self.mass[b][at])
            if least is None:
                continue
            reach = np.sqrt(np.maximum(rest, 0.0) * max(own, 0.0))
            keep = score.astype(np.float64) + reach * (1 + 1e-9) + 2 >= least  # rounding only ever keeps more
            if keep.sum() < 0.75 * keep.size:
                keep = np.flatnonzero(keep)
                at, score, rest = keep if at is None else at[keep], score[keep], rest[keep]
        return np.arange(len(self.ids)) if at is None else at, score, work


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, p: TopK) -> tuple[list[tuple[int, int, int]], int]:
    """((query_id, vec_id, score) of each query's best candidates, products made); integer matrices of equal width."""
    top = [int(np.abs(x).max(initial=0)) for x in (queries, rows)]
    whole = top[0] * top[1] * max(1, rows.shape[1]) >= 1 << 53 or max(top) >= 1 << 31
    kind = object if whole else np.float64
    starts = range(0, queries.shape[1], p.dims)
    split = [[np.ascontiguousarray(q[a : a + p.dims]).astype(kind) for a in starts] for q in queries]
    mass = [[float((x.astype(np.float64) ** 2).sum()) for x in q] for q in split]
    best: list[list[tuple[int, int]]] = [[] for _ in split]
    work = 0
    for a in range(0, len(ids), p.chunk):
        part = Chunk(ids[a : a + p.chunk], rows[a : a + p.chunk].astype(kind), p.dims, whole)
        for q, query_id in enumerate(query_ids.tolist()):
            held = best[q]
            at, score, made = part.survivors(split[q], mass[q], -held[-1][0] if len(held) == p.k else None)
            work += made
            own = part.ids[at] != query_id
            at, score = at[own], score[own]
            if len(score) > 4 * p.k:
                score_k = np.partition(score.astype(np.float64), -p.k)[-p.k]
                high = score.astype(np.float64) >= score_k
                at, score = at[high], score[high]
            found = [(-int(s), i) for s, i in zip(score.tolist(), part.ids[at].tolist(), strict=True)]
            best[q] = sorted(held + found)[: p.k]
    return [(query_id, i, -s) for query_id, held in zip(query_ids.tolist(), best, strict=True) for s, i in held], work


def exact_top_k(vectors: DataFrame, queries: DataFrame, p: TopK = TopK()) -> DataFrame:
    """(query_id, rank, vec_id, score): the best of ``vectors`` for each of ``queries``, both (vec_id, embedding)."""
    n_blocks, n_query_blocks = (-(-t.count() // most) or 1 for t, most in ((vectors, p.rows_a_block), (queries, p.queries_a_block)))
    block, query_block = (F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int") for n in (n_blocks, n_query_blocks))
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (n_blocks, n_query_blocks)]
    rows = integer_vectors(vectors, p).select(block.alias("i"), every[1].alias("j"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = integer_vectors(queries, p).select(every[0].alias("i"), query_block.alias("j"), F.lit(True).alias("asks"), "vec_id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks, ids = (group.column(c).to_numpy() for c in ("asks", "vec_id"))
        column = group.column("v").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
        found = []
        for size in np.unique(sizes[asks]).tolist():
            q, c = (np.flatnonzero((sizes == size) & side) for side in (asks, ~asks))
            matrix = [flat[starts[x][:, None] + np.arange(size)] for x in (q, c)]
            found += search_block(ids[q], matrix[0], ids[c], matrix[1], p)[0]
        return pa.table(list(zip(*found, strict=True)) if found else [[], [], []], schema=schema)

    hits = asked.unionByName(rows).groupBy("i", "j").applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
