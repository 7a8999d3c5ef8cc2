"""An ingest run: a batch of documents becomes chunks, vectors, groups and an index, all at once.

A batch holds whole documents (doc_id, title, cluster, published_on, text) and
perhaps ``removed``: documents that go. What the store has of a document is replaced
as a whole, so a text that gives fewer chunks than before leaves none behind.
Everything a run makes becomes visible with one commit (:mod:`lectern.sources.store`).

Tables: documents, chunks (chunk_id, doc_id, seq, text), vectors (doc_id, embedding,
chunk_count), lineage state, groups (doc_id, lineage_group) and the lexical index.
Chunks, vectors and lineage follow the batch; the index is made anew over all chunks,
as its statistics are those of the whole store. What a run wrote on its way goes when
it ends; tables that newer commits replaced go with ``Store.vacuum``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.operators import chunking, lexical_index, lineage_state
from lectern.plans.scratch import Scratch
from lectern.sources.store import Snapshot, Store

#: Chunker of (documents, key, text) -> (key, seq, text, ...), embedder of (rows, key columns, terms).
Chunker = Callable[[DataFrame, str, str], DataFrame]
Embedder = Callable[[DataFrame, list[str], str], DataFrame]


@dataclass(frozen=True)
class Steps:
    chunker: Chunker = chunking.fixed_windows
    embedder: Embedder = vx.hash_embedding
    #: Whether the lexical index is made anew with each batch.
    index: bool = True


def chunks_of(docs: DataFrame, steps: Steps) -> DataFrame:
    cut = steps.chunker(docs.select("doc_id", "text"), "doc_id", "text")
    return cut.select(F.format_string("%s-%04d", F.col("doc_id").cast("string"), "seq").alias("chunk_id"), "doc_id", F.col("seq").cast("int").alias("seq"), "text")


def vectors_of(chunks: DataFrame, steps: Steps) -> DataFrame:
    """(doc_id, embedding, chunk_count): mean of a document's chunk vectors, scaled to length one."""
    terms = chunks.select("doc_id", "chunk_id", tx.search_terms(F.col("text")).alias("terms"))
    made = steps.embedder(terms, ["doc_id", "chunk_id"], "terms")
    value = vx.centroid(made, "doc_id", "embedding").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v"))
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    return value.select("doc_id", F.transform("v", lambda x: x["value"]).alias("embedding")).join(counted, "doc_id")


def replaced(stored: DataFrame | None, made: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored rows of documents that are not in ``gone`` (doc_id), and the new ones."""
    return made if stored is None else stored.join(gone, "doc_id", "left_anti").select(*made.columns).unionByName(made)


def ingest(store: Store, batch: DataFrame, number: int, scratch: Scratch, steps: Steps = Steps()) -> bool:
    """Applies one batch; says whether it was new. A batch that repeats or died half-way may simply be run again.

    Of several rows of one document in a batch the least text counts; a null id is left
    out. A document whose text gives no chunk is kept without chunks, vector or group.
    """
    has_removed, scratch = "removed" in batch.columns, scratch.part("run")

    def work(before: Snapshot) -> dict[str, DataFrame | Callable[[str], None]]:
        columns = ["title", "cluster", "published_on", "text"]
        removed = F.coalesce(F.col("removed"), F.lit(False)) if has_removed else F.lit(False)
        one = F.min(F.struct(removed.alias("removed"), "text", "title", "cluster", "published_on")).alias("d")
        rows = scratch.save(batch.where("doc_id IS NOT NULL").groupBy("doc_id").agg(one).select("doc_id", "d.removed", *[f"d.{c}" for c in columns]), "batch")
        touched, live = rows.select("doc_id"), rows.where("NOT removed").drop("removed")
        chunks = scratch.save(chunks_of(live, steps), "chunks")
        vectors = scratch.save(vectors_of(chunks, steps), "vectors")
        described = live.drop("text").join(vectors.select("doc_id", "embedding"), "doc_id")
        old = {name: store.table(name, before) for name in (*lineage_state.TABLES, "documents", "chunks", "vectors")}
        state = lineage_state.apply(old, described, touched, scratch)
        every, written = replaced(old["chunks"], chunks, touched), []

        def write_chunks(target: str) -> None:
            every.write.parquet(target)
            written.append(target)

        def write_index(target: str) -> None:
            """Of the chunks as they were just written, so that they need no copy."""
            held = store.spark.read.schema(every.schema).parquet(written[-1])
            lexical_index.write(held.select(F.col("chunk_id").alias("id"), F.col("doc_id").cast("string").alias("doc"), "text"), target)

        out = {
            "documents": replaced(old["documents"], live, touched),
            "chunks": write_chunks,
            "vectors": replaced(old["vectors"], vectors, touched),
            **state,
        }
        if steps.index:
            out["index"] = write_index
        return out

    try:
        return store.run(number, work)
    finally:
        scratch.drop()


def ingest_stream(store: Store, stream: DataFrame, scratch: Scratch, steps: Steps = Steps()):
    """A writer that applies each micro-batch of documents once, whatever is run again after a failure."""
    return stream.writeStream.foreachBatch(lambda rows, number: ingest(store, rows, number, scratch, steps) and None)


def index_of(store: Store) -> lexical_index.LexicalIndex:
    at = store.current()
    return lexical_index.LexicalIndex.read(store.spark, f"{store.path}/tables/{at.folders['index']}")
