"""Registered queries of the public functions: search, answers, recommendations.

Benchmark items are the questions, conversations the sessions, documents or
embeddings the catalogue; every tenth pair of ids is one lineage group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators import chunking, dense, fusion, lexical, lexical_index, lists, recommend, services, sessions, tools
from lectern.plans import queries as base
from lectern.plans.scratch import Scratch
from lectern.sources import prompts
from lectern.sources.store import Store


def _group(key: str) -> Column:
    return F.when(F.col(key) % 10 < 2, F.col(key) - F.col(key) % 10).alias("lineage_group")


def _dates(spark: SparkSession, d: str) -> DataFrame:
    return base._t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("timestamp").alias("published_on"))


def _dated(docs: DataFrame, dates: DataFrame) -> DataFrame:
    return docs.join(dates, "doc_id", "left").withColumn("published_on", F.coalesce("published_on", F.lit("1990-01-01").cast("timestamp")))


def _vector_store(spark: SparkSession, d: str) -> DataFrame:
    e = base._t(spark, d, "embeddings").where("embedding IS NOT NULL")
    docs = e.select(
        F.col("vec_id").alias("doc_id"), F.concat(F.lit("Vector "), F.col("vec_id").cast("string")).alias("title"),
        F.array(F.concat(F.lit("label "), F.coalesce("label", F.lit(-1)).cast("string"))).alias("topics"),
        (F.col("vec_id") % 3 + 1).cast("int").alias("chunk_count"), _group("vec_id"), "embedding",
    )
    return _dated(docs, _dates(spark, d))


def _document_store(spark: SparkSession, d: str) -> DataFrame:
    docs = base._t(spark, d, "documents")
    vectors = base._embedded(docs.withColumnRenamed("doc_id", "id").select("id", "text"), "id").withColumnRenamed("id", "doc_id")
    chunks = F.size(chunking.window_starts(F.size(tx.split_words(F.col("text"))), 800, 120))
    about = docs.select(
        "doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.array(F.coalesce("lang", F.lit("-")), F.coalesce("source", F.lit("-"))).alias("topics"),
        chunks.alias("chunk_count"), _group("doc_id"),
    )
    return Scratch(spark, "store").save(_dated(about.join(vectors, "doc_id"), _dates(spark, d)), "documents")


def _as_queries(df: DataFrame, seeded: bool = False) -> DataFrame:
    """Fills the columns of a query that has no seed, no topics or no history."""
    wanted = {
        "seed_id": F.lit(None).cast("bigint"), "seed_group": F.lit(None).cast("bigint"), "seed_vector": F.lit(None).cast("array<double>"),
        "context_topics": F.array().cast("array<string>"), "recent_queries": F.lit(0),
    }
    return df.withColumns({c: v for c, v in wanted.items() if c not in df.columns})


def _listed(asked: DataFrame, picks: DataFrame) -> DataFrame:
    return tools.format_recommendations(asked, picks)


def more_like_this(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id ends in 00 or 55: its list as text."""
    store = _vector_store(spark, d)
    seeds = store.where("doc_id % 100 IN (0, 55)")
    asked = _as_queries(
        seeds.select(
            F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("doc_id").alias("seed_id"), F.col("lineage_group").alias("seed_group"),
            F.col("embedding").cast("array<double>").alias("seed_vector"), F.col("topics").alias("context_topics"),
        )
    )
    ranker = lists.ScoredCatalogue(asked, store, F.lit(base.AS_OF).cast("timestamp"))
    return _listed(asked, tools.select_and_explain(ranker, asked, store))


def _search(spark: SparkSession, d: str, scoped: bool, k: int, shortlist: int = 10) -> DataFrame:
    """(query_id, rank, id, doc, grade) of benchmark items; scoped ones ask one source, each tenth one that is not there."""
    items, docs = base._items(spark, d), base._docs(spark, d)
    scope = F.when(F.col("query_id") % 10 == 0, F.lit("nowhere")).otherwise(F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    items = items.withColumn("scope", scope if scoped else F.lit(None).cast("string"))
    q = base._embedded(items, "query_id").withColumnRenamed("embedding", "vector").join(items.select("query_id", "scope"), "query_id")
    r = base._embedded(docs, "id").withColumnRenamed("embedding", "vector").join(docs.select("id", F.col("doc").alias("scope")), "id")
    near = dense.dense_topk(q, r, 20)
    words = lexical.ranked(items if scoped else items.select("query_id", "text"), docs, 20)
    found = fusion.hybrid(near, words, items, docs, shortlist, k)
    return found.select("query_id", "place", "id", "doc", "grade")


def bm25_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    items, docs = base._items(spark, d), base._docs(spark, d)
    scoped = items.withColumn("scope", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return lexical.ranked(scoped, docs, 20)


def _indexed(spark: SparkSession, d: str, name: str, scope: Column | None) -> tuple[DataFrame, DataFrame]:
    """Results and work of a search that reads a stored index of all documents."""
    scratch = Scratch(spark, name)
    lexical_index.build(base._docs(spark, d)).write(f"{scratch.path}/index")
    items = base._items(spark, d)
    items = items if scope is None else items.withColumn("scope", scope)
    return lexical_index.search(lexical_index.LexicalIndex.read(spark, f"{scratch.path}/index"), items, 20, scratch)


def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d, "index", None)[0]


def bm25_indexed_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d, "index", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))[0]


def bm25_index_work(spark: SparkSession, d: str) -> DataFrame:
    """Postings of each item's terms, and whether bounds kept some of them closed or all were needed."""
    work = _indexed(spark, d, "index", None)[1]
    return work.select("query_id", "matched", (F.col("opened") <= F.col("matched")).alias("bounded"))


def hybrid_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, True, 6).select("query_id", F.col("place").cast("bigint").alias("place"), "id", F.round("grade", 4).alias("grade"))


def _passages(spark: SparkSession, d: str, scoped: bool) -> DataFrame:
    found = Scratch(spark, "search").save(_search(spark, d, scoped, 6), "found")
    texts = base._t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    title = F.concat(F.lit("Document "), F.col("id").cast("string"))
    return found.join(texts, "id").select("query_id", "place", title.alias("title"), (F.col("id") % 7 + 1).alias("page"), "doc", "text")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The passages of a filtered search as text, or the sentence for none."""
    told = tools.format_passages(base._items(spark, d), _passages(spark, d, True))
    return told.select("query_id", F.md5("answer").alias("answer_md5"), F.when(F.col("answer") == tools.NO_PASSAGES, F.col("answer")).alias("none"))


def answer_question(spark: SparkSession, d: str) -> DataFrame:
    asked = base._items(spark, d).withColumnRenamed("text", "question")
    told = tools.answer_prompts(asked, _passages(spark, d, True), prompts.shipped("answer").template)
    return told.select("query_id", F.md5("prompt").alias("prompt_md5"), "answer")


def recommend_for_query(spark: SparkSession, d: str) -> DataFrame:
    store = _document_store(spark, d)
    asked = base._embedded(base._items(spark, d), "query_id").withColumnRenamed("embedding", "vector")
    found = Scratch(spark, "hits").save(_search(spark, d, False, 10), "hits")
    hits = found.select("query_id", F.col("place").alias("rank"), F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("page"))
    ranker = lists.ScoredCatalogue(asked, store, F.lit(base.AS_OF).cast("timestamp"), hits)
    return _listed(asked, tools.select_and_explain(ranker, _as_queries(asked), store, hits=hits))


def _session_queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(recent queries, profiles) of all sessions, with their vectors."""
    turns = Scratch(spark, "turns").save(base._turns(spark, d), "turns")
    recent = sessions.recent_queries(turns).select(F.col("session_id").alias("query_id"), "recency", F.col("embedding").alias("vector"))
    spread = sessions.profile(turns).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("p"))
    return recent, spread.select(F.col("session_id").alias("query_id"), F.transform("p", lambda x: x["value"]).alias("vector"))


def _for_sessions(spark: SparkSession, d: str, store: DataFrame, shown: DataFrame | None) -> DataFrame:
    scratch = Scratch(spark, "sessions")
    recent, profiles = (scratch.save(x, "asked") for x in _session_queries(spark, d))
    counted = recent.groupBy("query_id").agg(F.count("*").cast("int").alias("recent_queries"))
    asked = _as_queries(profiles.join(counted, "query_id", "left").fillna(0, ["recent_queries"]))
    return tools.select_and_explain(lists.SessionAffinity(recent, profiles, store, shown), asked, store)


def recommend_for_user(spark: SparkSession, d: str) -> DataFrame:
    """Every session's list, without what it was shown: documents of its own last two digits."""
    store = _document_store(spark, d)
    talks = base._t(spark, d, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    shown = talks.withColumn("m", F.col("query_id") % 50).join(store.select("doc_id", (F.col("doc_id") % 50).alias("m")), "m").select("query_id", "doc_id")
    told = tools.format_recommendations(talks, _for_sessions(spark, d, store, shown), tools.NO_HISTORY)
    return told.select("query_id", "answer")


def sidebar_recommend(spark: SparkSession, d: str) -> DataFrame:
    """As rows, without scanned copies (each ninth document), whatever was shown before."""
    store = _document_store(spark, d)
    named = store.withColumn("key", F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, F.lit("-SCAN")).otherwise(F.lit(""))))
    return _for_sessions(spark, d, tools.exclude_scans(named, "key"), None).select("query_id", F.col("pick").cast("bigint").alias("pick"), "doc_id", "reason")


def duplicate_resolver(spark: SparkSession, d: str) -> DataFrame:
    """Shortlists of vectors through the whole resolver, at a ceiling of 0.3, which these vectors reach."""
    short = base._shortlist(spark, d).withColumn("lineage_group", F.when(F.col("doc_id") % 10 < 4, F.col("doc_id") % 100 - F.col("doc_id") % 10))
    ranked = Scratch(spark, "resolver").save(_dated(short, _dates(spark, d)), "ranked")
    e = base._t(spark, d, "embeddings").where("vec_id % 20 = 0")
    group = F.when(F.col("vec_id") % 10 < 4, F.col("vec_id") % 100 - F.col("vec_id") % 10)
    seeds = e.select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("doc_id"), group.alias("lineage_group"), "embedding")
    out = recommend.resolve(ranked, seeds, 0.3)
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "suppressed")


def _token_counts(texts: list[str]) -> list[list[float]]:
    """Stands for an embedding service: counts of the hashed tokens."""
    out = []
    for t in texts:
        row = [0.0] * 64
        for token in t.split(" ") if t else ():
            row[vx.bucket_of(token, 64)] += 1
        out.append(row)
    return out


def service_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all items and user turns from a service, whose answers to the items were stored before."""
    store = Store(spark, f"{Scratch(spark, 'service').path}/store")
    embed = services.ServiceEmbedder(services.Service("counts", _token_counts, "array<double>"), store)
    terms = tx.search_terms(F.col("text")).alias("terms")
    items = base._t(spark, d, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), terms)
    asked = base._t(spark, d, "conversations").where("role = 'user'").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("bigint").alias("turn"), terms)
    embed(items, ["kind", "id", "turn"], "terms")
    made = embed(items.unionByName(asked), ["kind", "id", "turn"], "terms")
    return made.select("kind", "id", "turn", F.posexplode("embedding").alias("pos", "value")).where("value > 0").withColumn("pos", F.col("pos").cast("bigint"))


def _by_vectors(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    q, r = (base._embedded(x, c).select(c, F.col("embedding").alias("vector"), F.lit(None).alias("scope")) for x, c in ((queries, "query_id"), (rows, "id")))
    return dense.dense_topk(q, r, k)


def _by_words(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    return lexical.ranked(queries, rows, k)


def plugged_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid retrieval of all items by retrievers that are passed in."""
    found = services.retrieve(base._items(spark, d), base._docs(spark, d), [_by_vectors, _by_words])
    return found.select("query_id", F.col("place").cast("bigint").alias("place"), "id", "doc", F.round("grade", 4).alias("grade"))


def _lenient(texts: list[str]) -> list[str]:
    """Stands for a judge: supports as many of two claims as the prompt's length modulo three."""
    return [f'```json\n{{"supported": {len(t) % 3}, "total": 2}}\n```' for t in texts]


def service_judge(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as an answer, each fifth one unanswerable and each seventh one declined, judged by a service."""
    c = base._t(spark, d, "conversations")
    answer = F.when(F.col("turn") % 7 == 6, F.lit(tools.NO_CONTEXT)).otherwise(F.col("text"))
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), (F.col("turn") % 5 != 4).alias("is_answerable"), answer.alias("answer"), F.col("role").alias("passages"))
    return services.judged_faithfulness(rows, services.Service("judge", _lenient, batch=100))


def queries() -> dict[str, base.Query]:
    found = (
        more_like_this, recommend_for_query, recommend_for_user, sidebar_recommend, duplicate_resolver,
        bm25_topk_filtered, bm25_indexed, bm25_indexed_filtered, bm25_index_work, hybrid_topk_filtered, hybrid_search, answer_question,
        service_embeddings, plugged_hybrid, service_judge,
    )
    return {q.__name__: q for q in found}
