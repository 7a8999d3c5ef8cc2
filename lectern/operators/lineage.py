"""Editions of one work: similarity links, components and survivors.

Two documents are linked when they share a cluster, their dates lie within the
gap, their titles are alike and their vectors are close. Candidates come from
cluster and title tokens: titles with a Jaccard of at least t share one of the first
n - ceil(t * n) + 1 tokens, the rarest first, so common words never make pairs.

A work of very many editions has links between nearly all of them. Documents of a
token are dealt out in blocks, a pair of blocks is compared by matrix products, and
leaves one edge for each document that a link joins to those before, so rows stay as
many as documents although every pair is compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import title_tokens
from lectern.functions.vectors import cosines
from lectern.plans.components import connected_components
from lectern.plans.scratch import Scratch

GAP_DAYS = 730
MIN_JACCARD = 0.55
MIN_COSINE = 0.95
MICROS_A_DAY = 86_400_000_000
BLOCK = 4_096
#: Rows of a matrix product.
STRIP = 256


def titles(docs: DataFrame) -> DataFrame:
    """(doc_id, cluster, at, tokens, embedding) of ``docs`` (doc_id, title, cluster, published_on, embedding)."""
    at = F.unix_micros(F.col("published_on").cast("timestamp")).alias("at")
    return docs.select("doc_id", "cluster", at, title_tokens(F.col("title")).alias("tokens"), F.col("embedding").cast("array<double>").alias("embedding"))


def token_order(titled: DataFrame) -> DataFrame:
    """(cluster, token, df)."""
    return titled.select("cluster", F.explode("tokens").alias("token")).groupBy("cluster", "token").agg(F.count("*").alias("df"))


def prefixes(titled: DataFrame, order: DataFrame, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """(doc_id, cluster, token): the tokens of each title that a like title shares one of, by ``order`` and unseen ones before all."""
    tokens = titled.select("doc_id", "cluster", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    placed = tokens.join(order, ["cluster", "token"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "token"))
    kept = placed.withColumn("nth", nth).where(F.col("nth") <= F.col("n") - F.ceil(min_jaccard * F.col("n") - 1e-9) + 1)
    return kept.select("doc_id", "cluster", "token")


class _Alike:
    """Which rows have a title like that of a given one; rows with one set of tokens are told together."""

    def __init__(self, tokens: list, min_jaccard: float):
        number: dict[frozenset, int] = {}
        self.of = np.array([number.setdefault(frozenset(t), len(number)) for t in tokens])
        self.sets, self.min_jaccard, self.known = list(number), min_jaccard, (-1, None)
        self.sizes, holders = np.array([len(x) for x in self.sets]), {}
        for n, words in enumerate(self.sets):
            for w in words:
                holders.setdefault(w, []).append(n)
        self.holders = {w: np.array(x) for w, x in holders.items()}

    def __call__(self, row: int) -> np.ndarray:
        n = self.of[row]
        if self.known[0] != n:
            common = np.zeros(len(self.sets))
            for w in self.sets[n]:
                common[self.holders[w]] += 1
            either = self.sizes + len(self.sets[n]) - common
            self.known = (n, (common / np.maximum(either, 1) >= self.min_jaccard)[self.of])
        return self.known[1]


def spanning_edges(block: pd.DataFrame, unlike: tuple[int, int] | None, gap: int, min_jaccard: float, min_cosine: float) -> list[tuple]:
    """Edges that join what links join, of the rows (doc_id, chunk, fresh, at, tokens, embedding) of one token.

    Links have an end that is ``fresh``. With ``unlike`` (two chunks) links within one
    chunk are found elsewhere.
    """
    ids, at, chunk, fresh = (block[c].to_numpy() for c in ("doc_id", "at", "chunk", "fresh"))
    vectors, alike = np.array(block["embedding"].tolist(), dtype=np.float64), _Alike(block["tokens"].tolist(), min_jaccard)
    label, out = np.arange(len(ids)), []
    for one, other in [(None, None)] if unlike is None else [unlike, unlike[::-1]]:
        rows = np.flatnonzero(fresh if one is None else fresh & (chunk == one))
        rows = rows[np.argsort(alike.of[rows], kind="stable")]
        # two fresh ends were met the other way round
        against = np.arange(len(ids)) if one is None else np.flatnonzero((chunk == other) & ((one < other) | ~fresh))
        for start in range(0, len(rows) if len(against) else 0, STRIP):
            strip = rows[start : start + STRIP]
            close = cosines(vectors[strip], vectors[against]) > min_cosine
            for n, i in enumerate(strip):
                met = label[against[close[n] & alike(i)[against] & (np.abs(at[against] - at[i]) <= gap)]]
                for other_label in np.unique(met[met != label[i]]):
                    out.append((ids[i], ids[other_label]))
                    label[label == other_label] = label[i]
    return out


def joined(prefix: DataFrame, titled: DataFrame, scratch: Scratch, gap_days: int = GAP_DAYS, min_jaccard: float = MIN_JACCARD, min_cosine: float = MIN_COSINE, block: int = BLOCK) -> DataFrame:
    """(a, b): edges between ``titled`` (see :func:`titles`) with the same components as all links with a fresh end.

    ``prefix``: (doc_id, cluster, token, fresh). Documents without a date or a vector have no link.
    """
    usable = titled.where("at IS NOT NULL AND size(embedding) > 0").withColumn("dim", F.size("embedding"))
    asked = prefix.where("cluster IS NOT NULL").join(usable.select("doc_id", "dim"), "doc_id")
    sized = asked.groupBy("cluster", "token", "dim").agg(F.count("*").alias("n"), F.max("fresh").alias("any"))
    sized = scratch.save(sized.where("n > 1 AND any").drop("any"), "tokens")
    # tokens of few documents share cells
    cells = (sized.agg(F.sum("n")).first()[0] or 0) // block + 1
    spot, k = F.xxhash64("cluster", "token", "dim"), F.ceil(F.col("n") / block).cast("int")
    members = asked.join(sized.select("cluster", "token", "dim", k.alias("k")), ["cluster", "token", "dim"])
    members = members.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = members.select(
        "doc_id", "fresh", "cluster", "token", "dim", "chunk", F.when(F.col("k") > 1, spot).otherwise(F.pmod(spot, F.lit(cells))).alias("cell"),
        F.least("chunk", "x").alias("i"), F.greatest("chunk", "x").alias("j"),
    ).join(usable.select("doc_id", "at", "tokens", "embedding"), "doc_id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for (_, _, _, i, j), own in pdf.groupby(["cluster", "token", "dim", "i", "j"]):
            out += spanning_edges(own, None if i == j else (i, j), gap_days * MICROS_A_DAY, min_jaccard, min_cosine)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("cell", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, lineage_group): smallest id of the component; documents alone are absent."""
    titled = scratch.save(titles(docs).where("at IS NOT NULL AND cluster IS NOT NULL"), "titles")
    prefix = prefixes(titled, token_order(titled)).withColumn("fresh", F.lit(True))
    found = connected_components(joined(scratch.save(prefix, "prefixes"), titled, scratch), scratch)
    return found.select(F.col("id").alias("doc_id"), F.col("component").alias("lineage_group"))


def survivors(ranked: DataFrame) -> DataFrame:
    """Ranked (query_id, rank, doc_id, lineage_group, published_on) with one row a group.

    A group appears at the rank of its best member and shows its newest one (ties:
    smaller id), with the ids it stands for, and those as structs (doc_id,
    published_on) in rank order. Without a group a row stays as it is.
    """
    alone = F.col("lineage_group").isNull()
    group = F.when(alone, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("g"), F.col("lineage_group").cast("string")))
    newest = F.struct(F.unix_micros(F.col("published_on").cast("timestamp")).alias("at"), (-F.col("doc_id")).alias("neg"))
    out = ranked.withColumn("key", group).groupBy("query_id", "key").agg(
        F.min("rank").alias("best_rank"), F.max(newest).alias("top"), F.sort_array(F.collect_list("doc_id")).alias("members"),
        F.sort_array(F.collect_list(F.struct("rank", "doc_id", "published_on"))).alias("listed"),
    )
    doc = (-F.col("top.neg")).alias("doc_id")
    out = out.select("query_id", "best_rank", doc, "members", "listed").withColumn("suppressed", F.array_join(F.array_remove("members", F.col("doc_id")), ","))
    older = F.filter("listed", lambda x: x["doc_id"] != F.col("doc_id"))
    out = out.withColumn("superseded", F.transform(older, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["published_on"].alias("published_on"))))
    order = Window.partitionBy("query_id").orderBy("best_rank")
    return out.select("query_id", F.row_number().over(order).alias("rank"), "best_rank", "doc_id", "suppressed", "superseded")


def listing(groups: DataFrame) -> DataFrame:
    """(lineage_group, members): the ids of each group in order, as one line."""
    members = F.transform(F.sort_array(F.collect_list("doc_id")), lambda i: i.cast("string"))
    return groups.groupBy("lineage_group").agg(F.array_join(members, ", ").alias("members"))
