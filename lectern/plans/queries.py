"""Registered queries of the retrieval and recommendation operators, over whole tables.

Query sets are stated: every embedding whose id is divisible by 20, all benchmark
items, all sessions. Limits are the operators' own top K.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators import chunking, dense, fusion, guards, lexical, lineage, lookup, metrics, recommend, sessions, tables
from lectern.plans.scratch import Scratch, workers_import_package
from lectern.sources import extraction

AS_OF = "2000-01-01"
Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Scan of a table. Texts that lie in fewer splits than there are cores are dealt out, as one task would do all the work on them."""
    workers_import_package(spark)
    found, cores = spark.read.parquet(f"{d}/{name}.parquet"), spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and found._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return found.repartition(cores)
    return found


# -- dense and lexical retrieval ---------------------------------------------------------------
def _dense(spark: SparkSession, d: str, k: int, filtered: bool) -> DataFrame:
    e = _t(spark, d, "embeddings")
    scope = F.col("label") if filtered else F.lit(None)
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), scope.alias("scope"))
    return dense.dense_topk(rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), rows, k)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, 20, False)


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, 20, True)


def _items(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("doc"))


def _bm25(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return lexical.ranked(_items(spark, d), _docs(spark, d).select("id", "text"), k)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d)


def _embedded(df: DataFrame, key: str) -> DataFrame:
    return vx.hash_embedding(df.select(key, tx.search_terms(F.col("text")).alias("terms")), [key], "terms")


def _dense_docs(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    q = _embedded(_items(spark, d), "query_id").select("query_id", F.col("embedding").alias("vector"), F.lit(None).alias("scope"))
    r = _embedded(_docs(spark, d), "id").select("id", F.col("embedding").alias("vector"), F.lit(None).alias("scope"))
    return dense.dense_topk(q, r, k)


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), "p_retailprice", "p_size")
    lists = [
        part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "id"))).select("query_id", "rank", "id", F.lit(i).alias("list_no"))
        for i, c in enumerate(("p_retailprice", "p_size"))
    ]
    return fusion.rrf(lists[0].unionByName(lists[1])).withColumn("rank", F.col("rank").cast("bigint"))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    found = fusion.hybrid(_dense_docs(spark, d), _bm25(spark, d), _items(spark, d), _docs(spark, d))
    return found.select("query_id", F.col("place").cast("bigint").alias("place"), "id", "doc", F.round("grade", 4).alias("grade"))


def diversity_cap(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.col("source").alias("doc"), "n_chars")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "id")))
    return fusion.diversity_cap(ranked).select("query_id", F.col("place").cast("bigint").alias("place"), F.col("rank").cast("bigint").alias("rank"), "id", "doc")


# -- lookups -------------------------------------------------------------------------------------
def read_pages(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), (F.col("turn") + 1).alias("end_page"), F.length("text").alias("n_chars"))
    return lookup.read_pages(c, 2, 9).select("doc", "page", F.col("n_chars").cast("bigint").alias("n_chars"))


REQUESTS = ["Supplier#000000003", " supplier#000000007 ", "000000009", "Supplier#00000000", "no such supplier", "", "5"]


def resolve_id(spark: SparkSession, d: str) -> DataFrame:
    catalogue = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("title"))
    asked = spark.createDataFrame([(r,) for r in REQUESTS], "request string")
    return lookup.resolve(asked, catalogue)


def embedding_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return lookup.cache_misses(_t(spark, d, "documents"), _t(spark, d, "conversations").where("text IS NOT NULL"), "hash-64").select("key")


def newest_upsert(spark: SparkSession, d: str) -> DataFrame:
    stored = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    batch = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return lookup.newest_upsert(stored, batch, "key")


def catalogue_status(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as manifest, shipped lines as files, parts shipped as ingested chunks."""
    manifest = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("title"))
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.count("*").alias("chunk_count"))
    told = lookup.catalogue_status(manifest, manifest.select("doc_id"), lines)
    return told.select("doc_id", "title", (F.col("state") == "ingested").alias("ingested"), "chunk_count")


# -- chunking and extraction -----------------------------------------------------------------------
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    cut = chunking.fixed_windows(_t(spark, d, "documents"), "doc_id", "text")
    return cut.select("doc_id", "chunk_id", F.col("start").cast("bigint").alias("start"), F.col("n_tokens").cast("bigint").alias("n_tokens"), F.md5("text").alias("text_md5"))


def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    cut = chunking.section_chunks(extraction.html_paragraphs(_t(spark, d, "pages")), "page_id", 100, 60, 10)
    return cut.select("page_id", F.col("seq").cast("bigint").alias("seq"), "heading", F.md5("text").alias("text_md5"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), F.col("turn").alias("seq"), "text", "role")
    words = c.where("role = 'assistant'").select("doc_id", "page", (F.length("text") / 1000.0).alias("confidence"))
    out = extraction.page_text(c, words)
    return out.select("doc_id", F.md5("text").alias("text_md5"), F.round("mean_confidence", 6).alias("mean_confidence"))


def ocr_classify(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations")
    kind = chunking.ocr_kind(chunking.has_text_layer(F.col("text")), F.lit(0.95))
    return c.select("conv_id", "turn", kind.alias("kind"))


def summary_trim(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    text = F.array_join(tx.token_budget(tx.split_words(F.col("text")), 6000), " ")
    return docs.select("doc_id", F.md5(tx.trim_words(text, 150)).alias("summary_md5"))


def composite_text(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    made = chunking.composite_text(F.col("p_name"), F.array("p_brand", "p_type"), F.concat(F.lit("size "), F.col("p_size").cast("string")))
    return part.select("p_partkey", made.alias("text"))


def formula_restore(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation")
    content = F.concat("n_name", F.lit(" :formula: and :formula:, then :formula:"))
    slots = F.array(
        F.struct((F.col("n_regionkey") % 2 == 0).alias("display"), F.col("n_name").alias("value")),
        F.struct(F.lit(False).alias("display"), F.lit(" ").alias("value")),
    )
    return n.select("n_nationkey", tx.restore_formulas(content, slots).alias("text"))


def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    """A table a region: its name over two columns, then its nations."""
    n = _t(spark, d, "nation")
    nth = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    body = n.select(F.col("n_regionkey").alias("table_id"), nth.alias("row"), F.col("n_nationkey").cast("string").alias("a"), F.concat("n_name", F.lit("|x")).alias("b"))
    columns = ["table_id", "seq", "row", "col", "row_span", "col_span", "content"]
    one = F.lit(1)
    cells = [
        body.select("table_id", (F.col("row") * 2 + i).alias("seq"), "row", F.lit(i).alias("col"), one.alias("row_span"), one.alias("col_span"), F.col(c).alias("content"))
        for i, c in enumerate("ab")
    ]
    head = _t(spark, d, "region").select(F.col("r_regionkey").alias("table_id"), F.lit(0).alias("seq"), F.lit(0).alias("row"), F.lit(0).alias("col"), one.alias("row_span"), F.lit(5).alias("col_span"), F.col("r_name").alias("content"))
    every = head.unionByName(cells[0]).unionByName(cells[1]).select(columns)
    shape = body.groupBy("table_id").agg((F.max("row") + 1).alias("n_rows")).withColumn("n_cols", F.lit(2))
    return tables.markdown(shape, every)


# -- text guards --------------------------------------------------------------------------------------
def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(tx.redact(F.col("text"))).alias("redacted_md5"))


def pii_redact_base(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(tx.redact(F.col("text"), phone=False)).alias("redacted_md5"))


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, d, "conversations")
    title = F.concat(F.lit("Conversation number "), F.col("conv_id").cast("string"))
    passages = c.select(F.col("conv_id").alias("answer_id"), F.col("conv_id").alias("doc_id"), title.alias("title"), (F.col("turn") + 1).cast("int").alias("page"), (F.col("turn") + 1).cast("int").alias("end_page"))
    told = F.concat(F.lit("One [Conversation num, p.1] two [CONVERSATION NUMBER "), F.col("conv_id").cast("string"), F.lit(", p.3] three [Convers, p.1] four [Elsewhere entirely, p.2] five [Convers, p.1].  "))
    return c.select(F.col("conv_id").alias("answer_id"), told.alias("answer")).distinct(), passages


def citation_guard(spark: SparkSession, d: str) -> DataFrame:
    return guards.guard(*_answers(spark, d))


# -- vectors, lineage, recommendation ------------------------------------------------------------------
def centroid(spark: SparkSession, d: str) -> DataFrame:
    out = vx.centroid(_t(spark, d, "embeddings").where("label IS NOT NULL"), "label", "embedding")
    return out.select("label", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    title = F.array_join(F.slice(tx.split_words(F.col("text")), 1, 8), " ")
    dates = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("timestamp").alias("published_on"))
    base = docs.select("doc_id", title.alias("title"), F.col("lang").alias("cluster"), "n_chars").join(dates, "doc_id", "left")
    vectors = vx.hash_embedding(docs.select("doc_id", tx.split_words(F.lower("text")).alias("terms")), ["doc_id"], "terms")
    return base.join(vectors, "doc_id")


def lineage_groups(spark: SparkSession, d: str) -> DataFrame:
    return lineage.groups(_catalogue(spark, d), Scratch(spark, "lineage"))


def near_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "survivors")
    docs = scratch.save(_catalogue(spark, d), "catalogue")
    found = lineage.groups(docs, scratch)
    ranked = docs.join(found, "doc_id", "left").withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n_chars"), "doc_id")))
    out = lineage.survivors(ranked.withColumnRenamed("cluster", "query_id").select("query_id", "rank", "doc_id", "lineage_group", "published_on"))
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.col("best_rank").cast("bigint").alias("best_rank"), "doc_id", "suppressed")


def rec_score(spark: SparkSession, d: str) -> DataFrame:
    """Every document for every benchmark item: similarity, BM25 evidence and recency."""
    q = _embedded(_items(spark, d), "query_id").withColumnRenamed("embedding", "vector")
    dates = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("timestamp").alias("published_on"))
    r = _embedded(_docs(spark, d), "id").withColumnRenamed("embedding", "vector")
    chunks = F.size(chunking.window_starts(F.size(tx.split_words(F.col("text"))), 800, 120)).alias("chunk_count")
    about = _docs(spark, d).select(F.col("id").alias("doc_id"), chunks).join(dates, "doc_id", "left").withColumn("published_on", F.coalesce("published_on", F.lit("1990-01-01").cast("timestamp")))
    sims = dense.all_similarities(q, r).select("query_id", F.col("id").alias("doc_id"), F.col("sim").alias("doc_sim"))
    candidates = sims.join(Scratch(spark, "about").save(about, "about"), "doc_id")
    scored = recommend.score(candidates, _bm25(spark, d, 10).withColumnRenamed("id", "doc_id"), F.lit(AS_OF).cast("timestamp"))
    return scored.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score", "doc_sim", "chunk_aggregate", "recency", F.col("chunk_hits").cast("bigint").alias("chunk_hits"))


def rec_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Reasons over nations as documents and regions as context."""
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    columns = {
        "doc_sim": (key % 5) / 4.0, "chunk_aggregate": (key % 3) / 2.0, "recency": (key % 7) / 6.0, "chunk_hits": key % 4,
        "first_page": F.when(key % 4 > 0, key + 1), "last_page": F.when(key % 4 > 0, key + key % 2 + 1),
        "topics": F.array("n_name", F.upper("r_name")), "context_topics": F.when(key % 2 == 0, F.array(F.lower("r_name"))).otherwise(F.array(F.lit("none"))),
        "published_on": F.lit("1998-03-05"), "recent_queries": key % 3,
        "superseded": F.when(key % 6 == 0, F.array(F.struct(key.alias("doc_id"), F.lit("1997-11-02").alias("published_on")))).otherwise(F.array().cast("array<struct<doc_id:int,published_on:string>>")),
    }
    return n.select("n_nationkey", recommend.reason(columns).alias("reason"))


def _shortlist(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    found = _dense(spark, d, k + 1, False).where("id <> query_id").withColumnRenamed("id", "doc_id")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    kept = found.withColumn("nth", nth).where(F.col("nth") <= k).select("query_id", "doc_id", F.col("score").alias("seed_sim"), F.col("nth").alias("rank"))
    return kept.join(e, "doc_id")


def mmr_topk(spark: SparkSession, d: str) -> DataFrame:
    return recommend.mmr(_shortlist(spark, d)).withColumn("pick", F.col("pick").cast("bigint"))


def lambda_sweep(spark: SparkSession, d: str) -> DataFrame:
    short = Scratch(spark, "sweep").save(_shortlist(spark, d), "shortlist")
    arms = [recommend.mmr(short, lam=lam).withColumn("lam", F.lit(lam)) for lam in (1.0, 0.7, 0.3)]
    return arms[0].unionByName(arms[1]).unionByName(arms[2]).select("lam", "query_id", F.col("pick").cast("bigint").alias("pick"), "doc_id")


def dedup_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """Greedy ceiling at 0.3, which these vectors reach."""
    return recommend.greedy_ceiling(_shortlist(spark, d), 0.3).select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id")


# -- sessions ---------------------------------------------------------------------------------------------
def _turns(spark: SparkSession, d: str) -> DataFrame:
    asked = _t(spark, d, "conversations").where("role = 'user'")
    terms = asked.select(F.col("conv_id").alias("session_id"), "turn", tx.search_terms(F.col("text")).alias("terms"))
    return vx.hash_embedding(terms, ["session_id", "turn"], "terms")


def recent_queries(spark: SparkSession, d: str) -> DataFrame:
    asked = _t(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn")
    return sessions.recent_queries(asked).withColumn("recency", F.col("recency").cast("bigint"))


def session_profile(spark: SparkSession, d: str) -> DataFrame:
    return sessions.profile(_turns(spark, d)).select("session_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


def affinity(spark: SparkSession, d: str) -> DataFrame:
    """Every session's recent queries against every benchmark item."""
    # a recent query's number names its session again
    recent = sessions.recent_queries(_turns(spark, d)).select((F.col("session_id") * 64 + F.col("recency")).alias("id"), F.col("embedding").alias("vector"))
    items = _embedded(_items(spark, d), "query_id").withColumnRenamed("embedding", "vector")
    sims = dense.all_similarities(items, recent).select(F.floor(F.col("id") / 64).alias("session_id"), F.col("query_id").alias("doc_id"), F.lit("query").alias("kind"), "sim")
    return recommend.affinity(sims)


def turn_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    calls = e.select(F.col("user_id").alias("turn_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("function"), F.round(F.col("value") * 1000).cast("bigint").alias("duration_ms"), tokens.alias("tokens_in"), (tokens * 2).alias("tokens_out"))
    out = sessions.turn_metrics(calls, 0.15, 0.60)
    return out.select("turn_id", F.md5("functions").alias("functions_md5"), "duration_ms", "tokens_in", "tokens_out", (F.col("cost") * 100_000_000).cast("bigint").alias("cost_e8"))


# -- metrics ------------------------------------------------------------------------------------------------
def _lists(spark: SparkSession, d: str, filtered: bool = False) -> DataFrame:
    """(case_id, rank, doc): the first six other vectors for each seed."""
    found = _dense(spark, d, 7, filtered).where("id <> query_id")
    lists = found.select(F.col("query_id").alias("case_id"), F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank"), F.col("id").alias("doc"))
    return lists.where("rank <= 6")


def _list_metrics(spark: SparkSession, d: str, filtered: bool = False) -> DataFrame:
    """Metrics of the lists; the gold of a seed is the others of its label."""
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "label")
    cases = labels.where("doc % 20 = 0").withColumnRenamed("doc", "case_id")
    return metrics.metrics_of_judged(metrics.judged_by_label(_lists(spark, d, filtered), labels, cases), 5)


def rec_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _list_metrics(spark, d)


def catalogue_coverage(spark: SparkSession, d: str) -> DataFrame:
    size = _t(spark, d, "embeddings").count()
    return metrics.coverage(_lists(spark, d), size)


def intra_list_diversity(spark: SparkSession, d: str) -> DataFrame:
    lists = _lists(spark, d).join(_t(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "embedding"), "doc")
    a = lists.select("case_id", F.col("rank").alias("i"), F.col("embedding").alias("x"))
    b = lists.select("case_id", F.col("rank").alias("j"), F.col("embedding").alias("y"))
    pairs = a.join(b, "case_id").where("i < j").select("case_id", vx.cosine(F.col("x"), F.col("y")).alias("sim"))
    return metrics.intra_list_diversity(pairs)


def duplicate_leakage(spark: SparkSession, d: str) -> DataFrame:
    grp = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.when(F.col("label") < 5, F.col("label")).alias("grp"))
    return metrics.duplicate_leakage(_lists(spark, d).join(grp, "doc"))


def ablation_pivot(spark: SparkSession, d: str) -> DataFrame:
    runs = [_list_metrics(spark, d, f).withColumn("config", F.lit(c)) for f, c in ((False, "dense"), (True, "filtered"))]
    return metrics.ablation_table(metrics.aggregate_runs(runs[0].unionByName(runs[1])), ["dense", "filtered"])


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from lectern.streaming.sessions import event_counts

    out = event_counts(_t(spark, d, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def queries() -> dict[str, Query]:
    names = (
        "dense_topk dense_topk_filtered bm25_topk rrf_fuse hybrid_topk diversity_cap read_pages resolve_id embedding_cache_misses newest_upsert "
        "catalogue_status chunk_fixed chunk_sections page_text ocr_classify summary_trim composite_text formula_restore table_markdown pii_redact "
        "pii_redact_base citation_guard centroid lineage_groups near_dup_groups rec_score rec_reasons mmr_topk lambda_sweep dedup_ceiling "
        "recent_queries session_profile affinity turn_metrics rec_metrics catalogue_coverage intra_list_diversity duplicate_leakage ablation_pivot event_windows"
    )
    from lectern.plans import eval_queries, ingest_queries, tool_queries

    return {n: globals()[n] for n in names.split()} | tool_queries.queries() | ingest_queries.queries() | eval_queries.queries()
