"""Embedding near-duplicates by an exact metric range join (operator 7).

Cosine ``c`` of unit vectors is the angle ``r = arccos(c)``, a metric, so the join
is a range join with a fixed radius. Pivots divide the vectors into cells. Those
of the first kind are balls around dense places of a sample, of radius ``ball``;
what no ball holds goes to the nearest pivot of the second kind. A vector has to
be held against the vectors of another cell only where that cell can hold one
within ``r`` of it:

* a cell's own vectors lie between two angles of its pivot, so by the triangle
  inequality the vector's angle to the pivot is at most ``r`` outside of them;
* vectors of the cell of q are no nearer to the pivot p. On the sphere, a vector x
  with one of them within ``r`` has x (p - q) <= sin(r) |p - q|, as turning x by
  ``r`` must take it over the plane between p and q.

Each pair of cells meets once: a vector visits cells of a higher number than its
own only, and a link found there counts for both sides, so cells join
independently.

A cell's owners and visitors are dealt out in blocks of bounded size, and every
pair of blocks is one group, so no label, cell or cluster has to fit a task.
Equal vectors of a label form one class beforehand, which counts with its number
of copies. Pairs are never emitted: a group gives a count for each vector with
links and a star of its local components.

Cases: vectors that are null, empty or zero or hold null or non-finite components,
and rows without a label, link with nothing; vectors of different lengths never
link, and all lengths but the most common share one cell each; a cosine of just
the threshold links; a repeated row is a copy; vectors of any length are read
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.components import connected_components
from lectern.plans.scratch import Scratch


@dataclass(frozen=True)
class RangeJoin:
    cosine: float = 0.93
    #: Vectors that choose the pivots; any choice gives the same result.
    pivot_sample: int = 2_000
    #: Radius of the cells around dense places, and the vectors of the sample that make a place dense.
    ball: float = 0.6
    dense: int = 4
    max_pivots: int = 256
    #: Vectors of a cell of the second kind that are worth another one.
    cell_vectors: int = 16_384
    owners_a_block: int = 8_192
    visitors_a_block: int = 16_384


@dataclass(frozen=True)
class Cells:
    """``balls`` before ``pivots``; cell numbers follow that order."""

    balls: np.ndarray
    pivots: np.ndarray
    ball: float
    radius: float

    def homes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home cell, angle to its pivot) of each unit vector."""
        angle = angles(vectors, self.pivots)
        home = angle.argmin(axis=1)
        own = angle[np.arange(len(angle)), home]
        home = home + len(self.balls)
        if len(self.balls):
            near = angles(vectors, self.balls)
            closest = near.argmin(axis=1)
            least = near[np.arange(len(near)), closest]
            inside = least <= self.ball
            home, own = np.where(inside, closest, home), np.where(inside, least, own)
        return home, own

    def visits(self, vectors: np.ndarray, home: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Mask of the cells of higher numbers that may hold a vector within the radius.

        ``low`` and ``high``: least and largest angle of a cell's own vectors to its pivot.
        """
        slack = 1e-6  # rounding must only ever add a visit
        angle = angles(vectors, np.concatenate((self.balls, self.pivots)))
        out = (angle <= high + self.radius + slack) & (angle >= low - self.radius - slack)
        dots = vectors @ self.pivots.T
        nearest = dots.argmax(axis=1)
        apart = np.sqrt(np.maximum(((self.pivots[:, None] - self.pivots[None]) ** 2).sum(axis=2), 0))[nearest]
        over = dots.max(axis=1)[:, None] - dots <= math.sin(min(self.radius, math.pi / 2)) * apart + slack
        out[:, len(self.balls) :] &= over
        return out & (np.arange(out.shape[1]) > home[:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def choose_cells(sample: np.ndarray, n_pivots: int, p: RangeJoin) -> Cells:
    """Balls where the sample is densest, one after the other, and the sample's first other vectors as pivots."""
    near = angles(sample, sample) <= p.ball / 2 if len(sample) else np.zeros((0, 0), dtype=bool)
    left, balls = np.ones(len(sample), dtype=bool), []
    while len(balls) < p.max_pivots and left.any():
        held = (near & left).sum(axis=1) * left
        best = int(held.argmax())
        if held[best] < p.dense:
            break
        balls.append(best)
        left &= angles(sample, sample[best : best + 1])[:, 0] > p.ball
    rest = np.flatnonzero(left) if left.any() else np.arange(len(sample))
    radius = math.acos(max(-1.0, min(1.0, p.cosine)))
    return Cells(sample[balls], sample[rest[: max(1, n_pivots)]], p.ball, radius)


def join_blocks(owners: pd.DataFrame, visitors: pd.DataFrame | None, cosine: float) -> pd.DataFrame:
    """Rows (id, n, root): links between the two blocks, or within one, and local components."""
    inner = visitors is None
    visitors = owners if inner else visitors
    ids = np.unique(np.concatenate((owners["rep"], visitors["rep"])))
    label = np.arange(ids.size)
    at_o, at_v = np.searchsorted(ids, owners["rep"]), np.searchsorted(ids, visitors["rep"])
    a, b = (unit(np.array(x["embedding"].tolist(), dtype=np.float64)) for x in (owners, visitors))
    n = np.zeros(ids.size, dtype=np.int64)
    copies_o, copies_v = owners["copies"].to_numpy(), visitors["copies"].to_numpy()
    for i in range(0, len(a), 256):
        near = a[i : i + 256] @ b.T >= cosine
        if inner:
            near[np.arange(len(near)), np.arange(i, i + len(near))] = False
        some = np.flatnonzero(near.any(axis=1))
        if not some.size:
            continue
        n[at_o[i + some]] += near[some] @ copies_v
        if not inner:
            n[at_v] += copies_o[i + some] @ near[some]
        for k in some:
            met = np.unique(label[np.append(at_v[near[k]], at_o[i + k])])
            if met.size > 1:
                label[np.isin(label, met)] = met[0]
    linked = np.flatnonzero(n)
    return pd.DataFrame({"id": ids[linked], "n": n[linked], "root": ids[label[linked]]})


def near_duplicates(vectors: DataFrame, scratch: Scratch, p: RangeJoin = RangeJoin()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), "label")
    usable = F.expr(
        "vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 "
        "AND forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity')) "
        "AND exists(embedding, e -> e <> 0)"
    )
    vectors = vectors.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = vectors.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.save(classes.withColumn("dim", F.size("embedding")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.max_by("dim", "n").alias("dim")).first()
    n_pivots = min(p.max_pivots, max(1, (sizes.n or 0) // p.cell_vectors))
    dim = sizes.dim or 0
    taken = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep").limit(p.pivot_sample).select("embedding").collect()
    sample = unit(np.array([r.embedding for r in taken], dtype=np.float64)) if taken else np.zeros((0, dim))
    cells = choose_cells(sample, n_pivots, p)
    n_cells = len(cells.balls) + len(cells.pivots)

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            home, angle = np.full(len(b), n_cells), np.zeros(len(b))  # vectors of another length share one cell of their own
            same = (b["dim"] == dim).to_numpy()
            if same.any():
                home[same], angle[same] = cells.homes(unit(np.array(b["embedding"][same].tolist(), dtype=np.float64)))
            yield b.assign(home=home, angle=angle)

    label_type = dict(classes.dtypes)["label"]
    schema = f"label {label_type}, embedding {kind}, rep bigint, copies bigint, dim int, home int"
    located = scratch.save(classes.mapInPandas(locate, schema + ", angle double"), "homes")
    low, high = np.full(n_cells, np.inf), np.full(n_cells, -np.inf)  # an empty cell is visited by nobody
    for r in located.where(F.col("home") < n_cells).groupBy("home").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect():
        low[r.home], high[r.home] = r.low, r.high

    def visit_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            visits: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(b)
            same = np.flatnonzero(b["dim"] == dim)
            if same.size:
                mask = cells.visits(unit(np.array(b["embedding"].iloc[same].tolist(), dtype=np.float64)), b["home"].to_numpy()[same], low, high)
                for i, row in zip(same, mask, strict=True):
                    visits[i] = np.flatnonzero(row).astype(np.int32)
            yield b.drop(columns="angle").assign(visits=visits)

    dealt = scratch.save(located.mapInPandas(visit_cells, schema + ", visits array<int>"), "cells")

    # Blocks of a cell: its owners o, its visitors v. Owner block i meets the owner blocks from i on and every
    # visitor block; visitor blocks are numbered behind the owners'.
    key = ["label", "dim", "cell"]
    owners = dealt.withColumn("cell", F.col("home")).drop("visits")
    visitors = dealt.withColumn("cell", F.explode("visits")).drop("visits")
    n_owners = owners.groupBy(*key).agg(F.ceil(F.count("*") / p.owners_a_block).cast("int").alias("o"))
    n_visitors = visitors.groupBy(*key).agg(F.ceil(F.count("*") / p.visitors_a_block).cast("int").alias("v"))
    blocks = n_owners.join(n_visitors, key, "left").select(*key, "o", F.coalesce("v", F.lit(0)).alias("v"))
    group, values = [*key, "i", "j"], ["rep", "copies", "embedding", "owner"]
    own = owners.join(blocks, key).withColumn("at", F.pmod(F.xxhash64("rep"), "o").cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("o") + F.col("v") - 1)))
    own = own.withColumns({"i": F.least("at", "other"), "j": F.greatest("at", "other"), "owner": F.col("at") <= F.col("other")})
    visit = visitors.join(blocks, key).withColumn("j", F.col("o") + F.pmod(F.xxhash64("rep"), "v").cast("int"))
    visit = visit.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("o") - 1))).withColumn("owner", F.lit(False))
    cosine = p.cosine

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        inner = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        sides = [pdf[m].reset_index(drop=True) for m in (pdf["owner"], ~pdf["owner"])]
        if not inner and not (len(sides[0]) and len(sides[1])):
            return pd.DataFrame({"id": [], "n": [], "root": []}, dtype="int64")
        return join_blocks(sides[0], None if inner else sides[1], cosine)

    rows = own.select(*group, *values).unionByName(visit.select(*group, *values))
    found = scratch.save(rows.groupBy(*group).applyInPandas(block, "id bigint, n bigint, root bigint"), "found")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    placed = (
        classes.join(counts.withColumnRenamed("id", "rep"), "rep", "left")
        .join(components.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = vectors.where("usable").join(placed, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = vectors.where("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
