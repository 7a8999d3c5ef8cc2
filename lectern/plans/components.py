"""Connected components of an edge table by alternating star contraction.

Each round rewires every edge towards the smallest vertex seen, first over the
larger neighbours and then over the smaller ones; the vertex minimum is a
partially aggregated ``min`` and the rewiring an equi-join that adaptive
execution can split, so a vertex holding a third of all edges needs no task of
its own size. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.plans.scratch import Scratch


def _rewire(directed: DataFrame, keep: Column) -> DataFrame:
    """(u, v) -> (v, m) for the edges chosen by ``keep``; m = min of u and its v."""
    low = directed.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    joined = directed.join(low, "u")
    return joined.where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges``: two id columns ``a``, ``b``. Returns (id, component) for every id met.

    ``component`` is the smallest id reachable. Null ends and self loops are
    ignored; an empty edge table gives an empty result; repeated edges and either
    orientation give the same result.
    """
    state = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    state = scratch.save(state.distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            state.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _rewire(both, F.col("v") > F.col("u")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        state = scratch.save(small, "round")
        got = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == seen:
            break
        seen = tuple(got)
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = state.select(F.col("b").alias("id")).distinct()
    return state.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
