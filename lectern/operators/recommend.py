"""Recommendation: three-signal score, greedy ceiling, MMR, affinity and reasons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import COUNT_WORDS
from lectern.operators.lineage import survivors

WEIGHTS = (0.5, 0.3, 0.2)
HIT_CAP = 5
RRF_K = 60
TAU_DAYS = 1_000.0
RECENCY_FLOOR = 0.3
CEILING = 0.95


def recency(published_on: Column, as_of: Column) -> Column:
    """From 1 for new down to the floor, by the age in days at ``as_of``."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(published_on.cast("timestamp"))
    age = F.greatest(F.lit(0.0), micros / 86_400e6)
    return RECENCY_FLOOR + (1 - RECENCY_FLOOR) * F.exp(-age / TAU_DAYS)


def rounded(value: Column, places: int = 6) -> Column:
    """Half away from zero on the scaled double, as databases round; ``round`` goes by the shortest decimal."""
    scale = 10.0**places
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale + 0.0


def chunk_evidence(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, evidence, chunk_hits, best_rank) of ``hits`` (query_id, rank, doc_id).

    The first five hits of a document count; the others still take up ranks.
    """
    nth = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))
    counted = hits.withColumn("nth", nth).where(F.col("nth") <= HIT_CAP)
    return counted.groupBy("query_id", "doc_id").agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("evidence"), F.count("*").alias("chunk_hits"), F.min("rank").alias("best_rank")
    )


def listed_documents(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """``ranked`` (query_id, rank, doc_id) beside its ``docs`` (doc_id, ...); ids that are no document go."""
    return ranked.join(docs, "doc_id")


def hits_by_document(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, hits) of ``docs`` (query_id, doc_id): its hits (rank, page) by rank, perhaps none.

    ``hits`` come from a retriever of bounded depth.
    """
    listed = hits.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "page"))).alias("hits"))
    none = F.array().cast("array<struct<rank:int,page:int>>")
    return docs.select("query_id", "doc_id").join(listed, ["query_id", "doc_id"], "left").withColumn("hits", F.coalesce(F.col("hits").cast("array<struct<rank:int,page:int>>"), none))


def score(candidates: DataFrame, hits: DataFrame, as_of: Column) -> DataFrame:
    """Ranks ``candidates`` (query_id, doc_id, doc_sim, published_on, chunk_count).

    score = weights over similarity, chunk evidence scaled to the best candidate,
    and recency; ties go to the smaller id; every candidate is returned.
    """
    joined = candidates.join(chunk_evidence(hits), ["query_id", "doc_id"], "left")
    raw = F.coalesce("evidence", F.lit(0.0)) / F.sqrt(F.greatest(F.lit(1), "chunk_count"))
    most = F.max("raw").over(Window.partitionBy("query_id"))
    scaled = F.when(most > 0, F.col("raw") / most).otherwise(F.lit(0.0))
    out = joined.withColumn("raw", raw).withColumn("chunk_aggregate", scaled).withColumn("recency", recency(F.col("published_on"), as_of))
    a, b, c = WEIGHTS
    total = rounded(a * F.col("doc_sim") + b * F.col("chunk_aggregate") + c * F.col("recency"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    out = out.withColumn("score", total).withColumn("rank", F.row_number().over(order))
    return out.select(
        "query_id", "rank", "doc_id", "score", *[rounded(F.col(c)).alias(c) for c in ("doc_sim", "chunk_aggregate", "recency")],
        F.coalesce("chunk_hits", F.lit(0)).alias("chunk_hits"), F.coalesce("best_rank", F.lit(0)).alias("best_rank"),
    )


def _unit(vectors: list) -> np.ndarray:
    rows = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def mmr_order(seed_sim: np.ndarray, sims: np.ndarray, ids: list, k: int, lam: float) -> list[int]:
    """Indices in the order picked: lam * similarity to the seed less the rest times that to the closest pick, or 0 if all are opposed."""
    if not 0 <= lam <= 1:
        raise ValueError("lambda must be from 0 to 1")
    left, closest, picked = list(range(len(ids))), np.zeros(len(ids)), []
    while left and len(picked) < k:
        value = {i: round(lam * seed_sim[i] - (1 - lam) * closest[i], 9) for i in left}
        best = min(left, key=lambda i: (-value[i], -seed_sim[i], ids[i]))
        left.remove(best)
        closest = np.maximum(closest, sims[:, best])
        picked.append(best)
    return picked


def mmr(shortlist: DataFrame, k: int = 5, lam: float = 0.7) -> DataFrame:
    """(query_id, pick, doc_id, seed_sim) of ``shortlist`` (query_id, doc_id, seed_sim, embedding).

    The pick order is the list order. A query's shortlist is of bounded length, so
    each is one small group; similarities are rounded to nine places for ties.
    """
    if not 0 <= lam <= 1:
        raise ValueError("lambda must be from 0 to 1")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        unit = _unit(pdf["embedding"].tolist())
        chosen = mmr_order(pdf["seed_sim"].to_numpy(), np.round(unit @ unit.T, 6), pdf["doc_id"].tolist(), k, lam)
        out = pdf.loc[chosen, ["query_id", "doc_id", "seed_sim"]]
        return out.assign(pick=np.arange(1, len(out) + 1, dtype=np.int32))

    return shortlist.groupBy("query_id").applyInPandas(pick, "query_id bigint, doc_id bigint, seed_sim double, pick int")


def greedy_ceiling(ranked: DataFrame, ceiling: float = CEILING) -> DataFrame:
    """``ranked`` (query_id, rank, doc_id, embedding) without rows too close to one kept before.

    Greedy in rank order against what is kept only; a query's list is of bounded length.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        unit = _unit(pdf["embedding"].tolist())
        kept: list[int] = []
        for i in range(len(pdf)):
            if not kept or (unit[kept] @ unit[i]).max() <= ceiling:
                kept.append(i)
        return pdf.loc[kept, ["query_id", "rank", "doc_id"]]

    return ranked.groupBy("query_id").applyInPandas(keep, "query_id bigint, rank int, doc_id bigint")


def resolve(ranked: DataFrame, seeds: DataFrame, ceiling: float = CEILING) -> DataFrame:
    """(query_id, rank, doc_id, suppressed, superseded): one row a lineage group, and ungrouped rows under the ceiling.

    ``ranked``: (query_id, rank, doc_id, lineage_group, published_on, embedding);
    ``seeds``: (query_id, doc_id, lineage_group, embedding), at most one row a query.
    The seed and its whole group go. The ceiling holds for ungrouped rows only,
    against what is kept before them and the seed; a query's list is of bounded length.
    """
    seed = seeds.select("query_id", F.col("doc_id").alias("seed_id"), F.col("lineage_group").alias("seed_group"), F.col("embedding").alias("seed"))
    own = F.coalesce(F.col("doc_id") == F.col("seed_id"), F.lit(False)) | F.coalesce(F.col("lineage_group") == F.col("seed_group"), F.lit(False))
    left = ranked.join(seed, "query_id", "left").where(~own)
    vectors = left.select("query_id", "doc_id", F.col("lineage_group").isNotNull().alias("grouped"), "embedding", "seed")
    shown = survivors(left.select("query_id", "rank", "doc_id", "lineage_group", "published_on")).drop("rank").join(vectors, ["query_id", "doc_id"])

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("best_rank").reset_index(drop=True)
        first = pdf["seed"].iloc[0]
        unit = _unit(pdf["embedding"].tolist() + ([] if first is None else [first]))
        against = [] if first is None else [len(pdf)]
        kept: list[int] = []
        for i in range(len(pdf)):
            if pdf["grouped"].iloc[i] or not against or (unit[against] @ unit[i]).max() <= ceiling:
                kept.append(i)
                against.append(i)
        out = pdf.loc[kept, ["query_id", "doc_id"]]
        return out.assign(rank=np.arange(1, len(out) + 1, dtype=np.int32))

    kept = shown.groupBy("query_id").applyInPandas(keep, "query_id bigint, rank int, doc_id bigint")
    return kept.join(shown.select("query_id", "doc_id", "suppressed", "superseded"), ["query_id", "doc_id"])


def affinity(pairs: DataFrame) -> DataFrame:
    """(session_id, doc_id, affinity): the largest ``sim`` of the session's recent queries, else to its profile, else 0.

    ``pairs``: (session_id, doc_id, kind, sim), kind 'query' or 'profile'.
    """
    best = pairs.groupBy("session_id", "doc_id").agg(
        F.max(F.when(F.col("kind") == "query", F.col("sim"))).alias("q"), F.max(F.when(F.col("kind") == "profile", F.col("sim"))).alias("p")
    )
    return best.select("session_id", "doc_id", F.round(F.coalesce("q", "p", F.lit(0.0)), 6).alias("affinity"))


def affinity_ranking(affinities: DataFrame) -> DataFrame:
    """Adds ``rank``: documents of a session by affinity, ties to the smaller id."""
    order = Window.partitionBy("session_id").orderBy(F.desc("affinity"), "doc_id")
    return affinities.withColumn("rank", F.row_number().over(order))


def breakdown() -> Column:
    """The numbers behind a reason in one line."""
    a, b, c = (f"{w:.2f}".rstrip("0").rstrip(".") for w in WEIGHTS)
    return F.format_string(
        f"docSim=%.3f*{a} chunkAgg=%.3f*{b} recency=%.3f*{c} hits=%d bestRank=%d", "doc_sim", "chunk_aggregate", "recency", F.col("chunk_hits").cast("int"), F.col("best_rank").cast("int")
    )


def topic_overlap(topics: Column, context: Column) -> Column:
    """The document's topics, in its order, that the context has too, ignoring case."""
    lowered = F.transform(context, F.lower)
    return F.filter(topics, lambda t: F.array_contains(lowered, F.lower(t)))


def count_word(n: Column) -> Column:
    words = F.array(*[F.lit(w) for w in COUNT_WORDS])
    return F.when(n.between(1, 10), F.get(words, n.cast("int") - 1)).otherwise(n.cast("string"))


def reason(c: dict[str, Column]) -> Column:
    """One sentence on what made a recommendation.

    Columns: doc_sim, chunk_aggregate, recency, chunk_hits, first_page, last_page,
    topics, context_topics, published_on, recent_queries, superseded (array of
    structs doc_id, published_on). The sentences are fixed values.
    """
    a, b, r = (w * c[k] for w, k in zip(WEIGHTS, ("doc_sim", "chunk_aggregate", "recency"), strict=True))
    overlap = topic_overlap(c["topics"], c["context_topics"])
    topic = F.coalesce(F.get(overlap, F.lit(0)), F.get(c["topics"], F.lit(0)), F.lit("this area"))
    first, last = c["first_page"].cast("string"), c["last_page"].cast("string")
    pages = F.when(first.isNull(), F.lit("no pages")).when(first == last, F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("pp. "), first, F.lit("-"), last))
    hits = c["chunk_hits"].cast("string")
    matches = F.when(c["chunk_hits"] == 1, F.lit(" strong match, ")).otherwise(F.lit(" strong matches, "))
    depth = F.concat(F.lit("Covers "), topic, F.lit(" in depth ("), hits, matches, pages, F.lit(")"))
    related = F.when(F.size(overlap) > 0, F.concat(F.lit("Strong topical overlap on "), F.array_join(overlap, ", "))).otherwise(F.concat(F.lit("Closely related to "), topic))
    month = F.date_format(c["published_on"].cast("timestamp"), "MMM yyyy")
    recent = F.concat(F.lit("A recent take on "), topic, F.lit(" (published "), month, F.lit(")"))
    lead = F.when((c["chunk_hits"] > 0) & (b >= a) & (b >= r), depth).when(a >= r, related).otherwise(recent)
    n = c["recent_queries"]
    noun = F.when(n == 1, F.lit(" question")).otherwise(F.lit(" questions"))
    asked = F.when(n > 0, F.concat(F.lit(", which your last "), count_word(n), noun, F.lit(" circled around"))).otherwise(F.lit(""))
    older = F.transform(c["superseded"], lambda s: F.concat(F.lit(" Supersedes "), s["doc_id"].cast("string"), F.lit(", "), F.date_format(s["published_on"].cast("timestamp"), "MMM yyyy"), F.lit(".")))
    return F.concat(lead, asked, F.lit("."), F.array_join(older, ""))
