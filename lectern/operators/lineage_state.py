"""Lineage kept up batch by batch: new rows meet stored prefix tokens and join stored groups.

State: ``titles`` (doc_id, cluster, at, tokens, embedding), ``prefixes`` (doc_id,
cluster, token), ``order`` (cluster, token, df) and ``groups`` (doc_id,
lineage_group). A title's prefix is taken in one fixed order of tokens, rarest first
as of the first batch and unseen ones before all; any fixed order finds every link,
so the order is not made anew.

Links are not kept, as a work of n editions has up to n * n / 2. A batch costs what
it touches: its rows, and those left of groups that lose a document, meet the stored
prefixes of their own tokens; other groups join by their own number. The result
equals grouping all documents at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.lineage import joined, prefixes, titles, token_order
from lectern.plans.components import connected_components
from lectern.plans.scratch import Scratch

TABLES = ("titles", "prefixes", "order", "groups")


def _grouped(edges: DataFrame, scratch: Scratch) -> DataFrame:
    return connected_components(edges, scratch).select(F.col("id").alias("doc_id"), F.col("component").alias("lineage_group"))


def apply(old: dict[str, DataFrame | None], batch: DataFrame, touched: DataFrame, scratch: Scratch) -> dict[str, DataFrame]:
    """State after ``batch`` (doc_id, title, cluster, published_on, embedding) replaces the documents ``touched`` (doc_id)."""
    fresh = scratch.save(titles(batch), "fresh")
    if old["titles"] is None:
        order = scratch.save(token_order(fresh), "order")
        prefix = scratch.save(prefixes(fresh, order), "prefixes")
        found = _grouped(joined(prefix.withColumn("fresh", F.lit(True)), fresh, scratch), scratch)
        return {"titles": fresh, "prefixes": prefix, "order": order, "groups": found}
    every = scratch.save(old["titles"].join(touched, "doc_id", "left_anti").unionByName(fresh), "titles")
    mine = prefixes(fresh, old["order"])
    prefix = scratch.save(old["prefixes"].join(touched, "doc_id", "left_anti").unionByName(mine), "prefixes")
    # what is left of a group that loses a document is joined anew from its titles
    broken = old["groups"].join(touched, "doc_id", "left_semi").select("lineage_group").distinct()
    whole = scratch.save(old["groups"].join(broken, "lineage_group", "left_anti").select("doc_id", "lineage_group"), "whole")
    parted = old["groups"].join(broken, "lineage_group", "left_semi").select("doc_id").join(touched, "doc_id", "left_anti")
    asking = scratch.save(fresh.select("doc_id").unionByName(parted).distinct(), "asking").withColumn("fresh", F.lit(True))
    told = prefix.join(asking, "doc_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    added = scratch.save(joined(told, every, scratch), "added")
    ends = added.select(F.col("a").alias("doc_id")).unionByName(added.select(F.col("b").alias("doc_id"))).distinct()
    moved = scratch.save(whole.join(ends, "doc_id", "left_semi").select("lineage_group").distinct(), "moved")
    own = whole.join(moved, "lineage_group", "left_semi").select(F.col("doc_id").alias("a"), F.col("lineage_group").alias("b"))
    still = whole.join(moved, "lineage_group", "left_anti").select("doc_id", "lineage_group")
    return {"titles": every, "prefixes": prefix, "groups": still.unionByName(_grouped(own.unionByName(added), scratch))}
