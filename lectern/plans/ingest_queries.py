"""Registered queries of sources, ingestion steps and lookups around them.

Conversations stand for documents whose turns are pages, lines or calls; nations
and suppliers for a manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import replies
from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators import chunking, fusion, guards, ingestion, lineage, lineage_state, lookup, recommend, sessions, tools
from lectern.operators import ingest_run as ingest_run_steps
from lectern.plans import queries as base
from lectern.plans.scratch import Scratch
from lectern.sources import extraction, files, layout
from lectern.sources.store import Store
from lectern.streaming import sessions as streams


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _json_file(scratch: Scratch, rows: DataFrame, name: str, field: str) -> str:
    """Path of one JSON object that lists ``rows``, a handful, under ``field``."""
    path = f"{scratch.path}/{name}.json"
    rows.groupBy().agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(field)).select(F.to_json(F.struct(field)).alias("value")).write.text(path)
    return path


# -- sources and sinks -------------------------------------------------------------------------
def _manifest(spark: SparkSession, d: str) -> DataFrame:
    n = base._t(spark, d, "nation").join(base._t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(
        _text("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.concat(F.lit("https://files.example/"), _text("n_nationkey")).alias("url"), F.col("r_name").alias("cluster"),
        (F.col("n_nationkey") + 1).cast("int").alias("expectedPages"), F.lit("1998-03-05T00:00:00Z").alias("publishedOn"),
    )
    return files.read_manifest(spark, _json_file(Scratch(spark, "manifest"), rows, "manifest", "documents"))


def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).withColumn("published_on", F.date_format("published_on", "yyyy-MM-dd"))


def document_enumeration(spark: SparkSession, d: str) -> DataFrame:
    """Every third document has no file, every fourth a scanned copy beside it."""
    n = base._t(spark, d, "nation")
    own = n.where("n_nationkey % 3 <> 0").select(F.concat(_text("n_nationkey"), F.lit(".pdf")).alias("name"))
    scans = n.where("n_nationkey % 4 = 0").select(F.concat(_text("n_nationkey"), F.lit("-Scanned.pdf")).alias("name"))
    return files.enumerate_documents(_manifest(spark, d), own.unionByName(scans)).select("doc_id", "title", "name", "missing")


def fetch_status(spark: SparkSession, d: str) -> DataFrame:
    c = base._t(spark, d, "conversations")
    content = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("%PDF-1.7 "), F.col("text"))).when(F.col("turn") % 3 == 1, F.lit("")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", ingestion.fetch_status(F.when(F.col("turn") % 5 == 0, F.lit(10)), content.cast("binary")).alias("status"))


def layout_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    roles = F.array(*[F.lit(r) for r in ("title", "sectionHeading", "footnote", "pageHeader", "pageFooter", "pageNumber")])
    c = base._t(spark, d, "conversations")
    pages = F.when(F.col("turn") % 4 < 3, F.array((F.col("turn") + 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.get(roles, (F.col("turn") % 8).cast("int")).alias("role"), pages.alias("pages"), F.when(F.col("turn") % 9 == 6, " ").otherwise(F.col("text")).alias("text"))
    return extraction.paragraphs(rows).select("doc_id", "seq", F.col("page").cast("bigint").alias("page"), "kind", F.md5("text").alias("text_md5"))


def layout_tables(spark: SparkSession, d: str) -> DataFrame:
    c = base._t(spark, d, "conversations")
    page = F.array((F.col("turn") + 1).cast("int"))
    none = F.array().cast("array<int>")
    rows = c.select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 0, page).otherwise(none).alias("pages"), F.when(F.col("turn") % 3 == 1, page).otherwise(none).alias("cell_pages"),
        F.when(F.col("turn") % 4 != 1, F.lit("| a |")).alias("markdown"),
    )
    return extraction.table_pages(rows).select("conv_id", "turn", F.col("page").cast("bigint").alias("page"), "skipped")


def gold_questions(spark: SparkSession, d: str) -> DataFrame:
    n = base._t(spark, d, "nation")
    rows = n.select(
        F.concat(F.lit("q"), F.lpad(_text("n_nationkey"), 2, "0")).alias("question"), F.col("n_name").alias("expectedAnswer"), F.when(F.col("n_nationkey") % 5 != 0, _text("n_regionkey")).alias("goldDocId"),
        F.when(F.col("n_nationkey") % 5 != 0, F.array((F.col("n_nationkey") + 1).cast("int"))).otherwise(F.array().cast("array<int>")).alias("goldPages"), (F.col("n_nationkey") % 5 != 0).alias("isAnswerable"),
    )
    read = files.read_qa_cases(spark, _json_file(Scratch(spark, "gold"), rows, "questions", "cases"))
    return read.select("case_id", "question", "goldDocId", F.array_join(F.col("goldPages").cast("array<string>"), ",").alias("pages"), "isAnswerable")


def gold_recommendations(spark: SparkSession, d: str) -> DataFrame:
    n = base._t(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(_text("n_nationkey"))).alias("relevantDocIds"))
    rows = n.select(_text("n_regionkey").alias("seedDocId"), "relevantDocIds")
    read = files.read_rec_cases(spark, _json_file(Scratch(spark, "gold"), rows, "recommendations", "cases"))
    return read.select("case_id", "seedDocId", F.array_join("relevantDocIds", ",").alias("relevant"))


def telemetry_since(spark: SparkSession, d: str) -> DataFrame:
    """Turn metrics of a log, written in two batches, of what came after a mark."""
    e = base._t(spark, d, "events")
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    calls = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("turn_id"), F.col("event_type").alias("function"), F.round(F.col("value") * 1000).cast("bigint").alias("duration_ms"), tokens.alias("tokens_in"), tokens.alias("tokens_out"))
    path = f"{Scratch(spark, 'telemetry').path}/log"
    for part in (0, 1):
        files.append_log(calls.where(F.col("seq") % 2 == part), path)
    schema = "seq bigint, turn_id bigint, function string, duration_ms bigint, tokens_in bigint, tokens_out bigint"
    out = sessions.turn_metrics(files.read_log(spark, path, schema, after=100), 0.0, 0.0)
    return out.select("turn_id", F.md5("functions").alias("functions_md5"), "duration_ms", "tokens_in", "tokens_out", F.col("cost").cast("double").alias("cost"))


def result_file(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a written result file: cases, then means."""
    from lectern.operators import metrics

    s = base._t(spark, d, "supplier").select(F.lit("dense").alias("config"), F.col("s_suppkey").alias("case_id"), F.lit("share").alias("metric"), F.when(F.col("s_suppkey") % 4 != 0, (F.col("s_suppkey") % 8) / 8.0).alias("value"))
    path = f"{Scratch(spark, 'results').path}/results"
    files.write_results(files.result_rows(s, metrics.aggregate_runs(s), "qa", "2024-01-01T00:00:00Z"), path)
    return spark.read.text(path).where(~F.col("value").startswith("timestamp_utc")).withColumnRenamed("value", "line")


def session_state(spark: SparkSession, d: str) -> DataFrame:
    """The last snapshot of every session after streaming all user turns."""
    scratch = Scratch(spark, "sessions")
    turns = base._turns(spark, d).withColumn("shown", F.array(F.col("turn") % 3, F.col("turn") % 5).cast("array<bigint>"))
    turns = scratch.save(turns, "turns")
    stream = spark.readStream.schema(turns.schema).parquet(turns.inputFiles()[0].rsplit("/", 1)[0])
    out = f"{scratch.path}/snapshots"
    numbered = lambda batch, number: batch.withColumn("batch_no", F.lit(number)).write.mode("append").parquet(out)
    query = streams.session_state(stream).writeStream.foreachBatch(numbered).outputMode("update").option("checkpointLocation", f"{scratch.path}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.groupBy("session_id").agg(F.max_by(F.struct("turns", "n_recent", "n_surfaced", "profile"), "batch_no").alias("s"))
    total = F.aggregate("s.profile", F.lit(0.0), lambda a, x: a + x)
    return last.select("session_id", "s.turns", F.col("s.n_recent").cast("bigint").alias("n_recent"), F.col("s.n_surfaced").cast("bigint").alias("n_surfaced"), F.round(total, 6).alias("profile_sum"))


# -- caches, unions, counters ---------------------------------------------------------------------
def summary_cache(spark: SparkSession, d: str) -> DataFrame:
    docs = base._t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    cache = base._t(spark, d, "documents").where("doc_id % 3 = 0 AND text IS NOT NULL").select(F.sha2("text", 256).alias("key"), F.length("text").alias("value"))
    return ingestion.cached_values(docs, cache).withColumn("value", F.col("value").cast("bigint"))


def lineage_union(spark: SparkSession, d: str) -> DataFrame:
    batch = base._t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("title"))
    stored = base._t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"))
    return ingestion.union_with_stored(batch, stored, "doc_id")


def incremental_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Groups after three batches in a store: a third of the documents under the title of another, two thirds as they are, and the rest."""
    scratch = Scratch(spark, "incremental")
    docs = scratch.save(base._catalogue(spark, d).select("doc_id", "title", "cluster", "published_on", "embedding"), "catalogue")
    store = Store(spark, f"{scratch.path}/store")
    other = docs.where("doc_id % 3 = 1").join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("title").alias("next")), "doc_id", "left")
    batches = [other.withColumn("title", F.coalesce("next", "title")).drop("next"), docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")]
    for number, batch in enumerate(batches):
        store.run(number, lambda at, batch=batch: lineage_state.apply({n: store.table(n, at) for n in lineage_state.TABLES}, batch, batch.select("doc_id"), scratch))
    return store.table("groups")


def ingest_run(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in the store after four runs: some documents at twice their length, all of them, the same batch again, and removals."""
    scratch = Scratch(spark, "ingest")
    store = Store(spark, f"{scratch.path}/store")
    docs = base._t(spark, d, "documents").select(
        "doc_id", F.array_join(F.slice(tx.split_words(F.col("text")), 1, 8), " ").alias("title"), F.col("lang").alias("cluster"), F.lit("1998-03-05").cast("timestamp").alias("published_on"), "text"
    )
    twice = docs.where("doc_id % 4 = 0").withColumn("text", F.concat("text", F.lit(" "), "text"))
    gone = docs.where("doc_id % 10 = 7").withColumn("removed", F.lit(True))
    for number, batch, indexed in ((1, twice, False), (2, docs, False), (2, docs, False), (3, gone, True)):
        ingest_run_steps.ingest(store, batch, number, scratch, ingest_run_steps.Steps(index=indexed))
        store.vacuum(keep=1)
    return store.table("chunks").select("chunk_id", "doc_id", F.md5("text").alias("text_md5"))


def lineage_listing(spark: SparkSession, d: str) -> DataFrame:
    found = lineage.groups(base._catalogue(spark, d), Scratch(spark, "listing"))
    return lineage.listing(found)


def sanity_cosines(spark: SparkSession, d: str) -> DataFrame:
    e = base._t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    named = spark.createDataFrame([(a, a + 7 * a % 40 + 1) for a in range(9)] + [(0, 10**9)], "a bigint, b bigint")
    return vx.named_cosines(named, e)


def chunks_with_tables(spark: SparkSession, d: str) -> DataFrame:
    """Windows over the turns of a conversation as pages, then two tables for every third."""
    c = base._t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")
    kinds = c.where("page % 2 = 0").select("doc_id", "page", F.lit("OcrProse").alias("kind"))
    prose = chunking.paged_windows(c, "doc_id", kinds, 80, 12)
    own = c.where("doc_id % 3 = 0 AND page <= 2").select("doc_id", (3 - F.col("page")).alias("page"), F.lit(0).alias("nth"), F.concat(F.lit("| table on "), (3 - F.col("page")).cast("string"), F.lit(" |")).alias("text"))
    made = ingestion.append_tables(prose, own, "doc_id")
    return made.select("chunk_id", F.col("page").cast("bigint").alias("page"), F.col("end_page").cast("bigint").alias("end_page"), "kind", F.md5("text").alias("text_md5"))


def chunk_variable(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 400 characters, a word costing its length."""
    words = tx.split_words(F.col("text"))
    docs = base._t(spark, d, "documents").select("doc_id", words.alias("words"), F.transform(words, lambda w: F.length(w)).alias("costs"))
    return chunking.variable_windows(docs, "doc_id", "words", "costs", 400, 60)


def ingestion_counters(spark: SparkSession, d: str) -> DataFrame:
    c = base._t(spark, d, "conversations")
    pages = c.select(F.col("conv_id").alias("doc_id"), F.when(F.col("turn") % 3 == 0, "OcrProse").otherwise("Prose").alias("kind"))
    chunks = c.where("conv_id % 5 <> 0").select(F.col("conv_id").alias("doc_id"), F.when(F.col("turn") % 4 == 0, "Table").otherwise("Prose").alias("kind"))
    return ingestion.counters(pages, chunks, "doc_id")


def section_spans(spark: SparkSession, d: str) -> DataFrame:
    c = base._t(spark, d, "conversations")
    kind = F.when(F.col("turn") % 4 == 1, "SectionHeading").otherwise("Body")
    parts = chunking.sections(c.select("conv_id", F.col("turn").alias("seq"), F.floor(F.col("turn") / 2).alias("page"), kind.alias("kind"), "text"), "conv_id")
    return parts.select("conv_id", F.col("section").cast("bigint").alias("section"), "page", "end_page", F.size(tx.split_words(F.col("text"))).cast("bigint").alias("n_tokens"))


def section_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a conversation, a word costing its length, with two tables for every third."""
    c = base._t(spark, d, "conversations")
    kind = F.when(F.col("turn") % 4 == 1, "SectionHeading").otherwise("Body")
    rows = c.select("conv_id", F.col("turn").alias("seq"), F.floor(F.col("turn") / 2).alias("page"), kind.alias("kind"), "text")
    own = c.where("conv_id % 3 = 0 AND turn <= 1").select("conv_id", (3 - F.col("turn")).alias("page"), F.lit(0).alias("nth"), F.concat(F.lit("| table on "), (3 - F.col("turn")).cast("string"), F.lit(" |")).alias("text"))
    made = chunking.section_chunks(rows, "conv_id", 300, 200, 40, own, lambda w: F.length(w))
    return made.select("conv_id", F.col("seq").cast("bigint").alias("seq"), F.col("page").cast("bigint").alias("page"), F.col("end_page").cast("bigint").alias("end_page"), "kind", F.md5("text").alias("text_md5"))


def layout_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of all pages, of which the store held every second one before."""
    store = Store(spark, f"{Scratch(spark, 'layout').path}/store")
    pages = base._t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").cast("binary").alias("content"))
    layout.analyse(pages.where("doc_id % 2 = 0"), store, 1)
    found = layout.analyse(pages, store, 2)
    return found.select(F.col("doc_id").alias("page_id"), F.col("seq").cast("bigint").alias("seq"), "kind", F.md5("text").alias("text_md5"))


def token_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Words of a text while their lengths add up to at most 2,000."""
    docs = base._t(spark, d, "documents").select("doc_id", tx.split_words(F.col("text")).alias("words"))
    n = tx.budget_words(F.col("words"), 2_000, lambda w: F.length(w))
    kept = docs.select("doc_id", "words", n.alias("n"))
    return kept.select("doc_id", F.col("n").cast("bigint").alias("n"), F.md5(F.array_join(F.slice("words", F.lit(1), F.col("n")), " ")).alias("prefix_md5"))


def ocr_pages(spark: SparkSession, d: str) -> DataFrame:
    c = base._t(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    pages = c.select("doc", "page", ((F.length("text") % 100) / 100.0).alias("confidence"))
    probes = c.where("page % 2 = 0").select("doc", "page", chunking.has_text_layer(F.col("text"), 120).alias("has_layer"))
    return chunking.classified_pages(pages, probes).select("doc", "page", "kind")


def scan_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = base._t(spark, d, "supplier").select(F.concat(F.lit("S"), _text("s_suppkey")).alias("doc_id"), "s_suppkey")
    docs = s.select("doc_id").unionByName(s.where("s_suppkey % 5 = 0").select(F.concat("doc_id", F.lit("-SCAN")).alias("doc_id")))
    return ingestion.native_scan_pairs(docs)


def recommendable(spark: SparkSession, d: str) -> DataFrame:
    s = base._t(spark, d, "supplier")
    docs = s.select(F.concat(F.lit("S"), _text("s_suppkey"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("-SCAN")).otherwise(F.lit(""))).alias("doc_id"))
    return tools.exclude_scans(docs, "doc_id")


def document_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages 2 to 5 of one document, in reading order."""
    c = base._t(spark, d, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), (F.col("turn") + 1).alias("end_page"), F.col("turn").alias("chunk_id"))
    return lookup.in_page_order(lookup.read_pages(c, 2, 5, doc=3)).select("doc", "page", F.col("place").cast("bigint").alias("place"))


def catalogue_files(spark: SparkSession, d: str) -> DataFrame:
    """The manifest beside files and ingested documents."""
    manifest = base._t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("title"))
    there = base._t(spark, d, "part").select(F.col("p_partkey").alias("doc_id")).where("doc_id % 2 = 0")
    done = base._t(spark, d, "lineitem").where("l_suppkey % 3 = 0").groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.count("*").alias("chunk_count"))
    return lookup.catalogue_status(manifest, there, done)


def corpus_status(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as manifest, even parts as files by their size, each seventh one as a scanned copy too."""
    key = F.concat(F.lit("S"), _text("s_suppkey"))
    manifest = base._t(spark, d, "supplier").select(key.alias("doc_id"), F.col("s_name").alias("title"), _text("s_nationkey").alias("cluster"))
    part = base._t(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"))
    own = part.where("p_partkey % 2 = 0").select(F.concat(F.lit("s"), _text("p_partkey"), F.lit(".PDF")).alias("name"), "size")
    scans = part.where("p_partkey % 7 = 0").select(F.concat(F.lit("s"), _text("p_partkey"), F.lit("-scanned.pdf")).alias("name"), "size")
    done = base._t(spark, d, "lineitem").where("l_suppkey % 3 = 0").groupBy(F.concat(F.lit("S"), _text("l_suppkey")).alias("doc_id")).agg(F.count("*").alias("chunk_count"))
    return lookup.corpus_status(manifest, own.unionByName(scans), done)


# -- sessions, hits, citations -----------------------------------------------------------------------
def _shown(spark: SparkSession, d: str) -> DataFrame:
    return base._t(spark, d, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 10).alias("doc_id"))


def unseen(spark: SparkSession, d: str) -> DataFrame:
    e = base._t(spark, d, "events").select(F.col("user_id").alias("session_id")).distinct()
    candidates = e.withColumn("doc_id", F.explode(F.sequence(F.lit(0), F.lit(19)).cast("array<bigint>")))
    return sessions.exclude_surfaced(candidates, _shown(spark, d))


def surfaced_sets(spark: SparkSession, d: str) -> DataFrame:
    return sessions.surfaced_sets(_shown(spark, d)).select("session_id", "n", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"))


def turn_context(spark: SparkSession, d: str) -> DataFrame:
    """Of each user and day, the calls of the last quarter of a day with any."""
    e = base._t(spark, d, "events")
    got = e.select(F.col("user_id").alias("session_id"), F.date_format("ts", "yyyy-MM-dd").alias("turn"), F.floor(F.hour("ts") / 6).alias("call"), F.col("event_id").alias("passage"))
    return sessions.turn_context(got)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    li = base._t(spark, d, "lineitem").select(F.col("l_linenumber").alias("query_id"), F.col("l_suppkey").alias("doc_id"), "l_orderkey")
    first = li.groupBy("query_id", "doc_id").agg(F.min("l_orderkey").alias("o"), F.count("*").alias("n"))
    order = Window.partitionBy("query_id").orderBy("o", "doc_id", "k")
    spread = first.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(7)).cast("int"))))
    return spread.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "doc_id", (F.col("k") % 3).cast("int").alias("page"))


def chunk_hits(spark: SparkSession, d: str) -> DataFrame:
    out = recommend.chunk_evidence(_hits(spark, d))
    return out.select("query_id", "doc_id", F.round("evidence", 9).alias("evidence"), "chunk_hits", F.col("best_rank").cast("bigint").alias("best_rank"))


def hits_by_document(spark: SparkSession, d: str) -> DataFrame:
    docs = base._t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id")).withColumn("query_id", F.explode(F.array(F.lit(1), F.lit(2))))
    out = recommend.hits_by_document(docs, _hits(spark, d))
    line = F.transform("hits", lambda h: F.concat(h["rank"].cast("string"), F.lit(":"), h["page"].cast("string")))
    return out.select("query_id", "doc_id", F.array_join(line, ",").alias("hits"))


def ranked_documents(spark: SparkSession, d: str) -> DataFrame:
    """A ranked list beside what is known of its documents; ids without a document go."""
    ranked = base.rrf_fuse(spark, d).withColumnRenamed("id", "doc_id")
    docs = base._t(spark, d, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"))
    return recommend.listed_documents(ranked, docs).select("query_id", "rank", "doc_id", "title")


def passthrough_topk(spark: SparkSession, d: str) -> DataFrame:
    return fusion.passthrough(base.rrf_fuse(spark, d), 5).select("query_id", "place", "id")


def affinity_rank(spark: SparkSession, d: str) -> DataFrame:
    ranked = recommend.affinity_ranking(base.affinity(spark, d)).where("rank <= 10")
    return ranked.select("session_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "affinity")


def profile_affinity(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a session whose kinds are queries, profiles or neither."""
    li = base._t(spark, d, "lineitem")
    kind = F.when(F.col("l_suppkey") % 3 == 0, "query").when(F.col("l_suppkey") % 3 == 1, "profile").otherwise("none")
    rows = li.select(F.col("l_suppkey").alias("session_id"), F.col("l_linenumber").alias("doc_id"), kind.alias("kind"), (F.col("l_quantity") / 100.0 - 0.2).cast("double").alias("sim"))
    return recommend.affinity(rows)


def citation_violations(spark: SparkSession, d: str) -> DataFrame:
    answers, passages = base._answers(spark, d)
    log = guards.violation_log(answers.withColumn("question", F.concat(F.lit("q"), _text("answer_id"))), passages)
    return log.select("answer_id", F.col("nth").cast("bigint").alias("nth"), "cited_title", F.col("cited_page").cast("bigint").alias("cited_page"), "question")


def citation_panel(spark: SparkSession, d: str) -> DataFrame:
    answers, passages = base._answers(spark, d)
    found = guards.panel_matches(guards.citations(answers), passages)
    return found.select("answer_id", F.col("nth").cast("bigint").alias("nth"), F.col("p_page").cast("bigint").alias("p_page"), "on_page")


# -- replies -------------------------------------------------------------------------------------------
def _reply(body: Column) -> Column:
    """Every second reply stands in a code fence."""
    return F.when(F.col("turn") % 2 == 0, body).otherwise(F.concat(F.lit(" ```json\n"), body, F.lit("\n```\n")))


def summary_replies(spark: SparkSession, d: str) -> DataFrame:
    c = base._t(spark, d, "conversations")
    topics = F.transform(F.sequence(F.lit(1), (F.col("turn") % 9 + 1).cast("int")), lambda i: F.concat(F.lit("t"), i.cast("string")))
    body = F.when(F.col("turn") % 5 == 4, F.lit('{"summary": " ", "topics": ["x"]}')).when(F.col("turn") % 7 == 6, F.lit("no json")).otherwise(F.to_json(F.struct(F.repeat(F.concat("text", F.lit(" ")), F.lit(4)).alias("summary"), topics.alias("topics"))))
    got = c.select("conv_id", "turn", replies.summary(_reply(body)).alias("s"))
    return got.select("conv_id", "turn", F.md5("s.summary").alias("summary_md5"), F.array_join("s.topics", ",").alias("topics"))


def grade_replies(spark: SparkSession, d: str) -> DataFrame:
    c = base._t(spark, d, "conversations")
    score = ((F.col("conv_id") * 7 + F.col("turn") * 5) % 16 - 2).cast("string")
    body = F.concat(F.lit('{"scores": [{"index": 1, "score": '), score, F.lit('}, {"index": 2, "score": 4.5}]}'))
    body = F.when(F.col("turn") % 6 == 5, F.lit('{"scores": []}')).otherwise(body)
    got = c.select("conv_id", "turn", F.explode(replies.grades(_reply(body))).alias("g"))
    return got.select("conv_id", "turn", F.col("g.index").cast("bigint").alias("index"), "g.score")


def queries() -> dict[str, base.Query]:
    found = (
        manifest_scan, document_enumeration, fetch_status, layout_paragraphs, layout_tables, gold_questions, gold_recommendations, telemetry_since, result_file, session_state,
        summary_cache, lineage_union, incremental_lineage, ingest_run, lineage_listing, sanity_cosines, chunks_with_tables, chunk_variable, ingestion_counters, section_spans, section_windows, layout_blocks, token_prefix, ocr_pages,
        scan_pairs, recommendable, document_pages, catalogue_files, corpus_status, unseen, surfaced_sets, turn_context, chunk_hits, hits_by_document, ranked_documents, passthrough_topk, affinity_rank,
        profile_affinity, citation_violations, citation_panel, summary_replies, grade_replies,
    )
    return {q.__name__: q for q in found}
