"""Page reads and identifier resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SPAN = 5


def read_pages(chunks: DataFrame, first: int, last: int = 0, doc: object = None) -> DataFrame:
    """Chunks (doc, chunk_id, page, end_page) that overlap the pages asked for, at most five of them.

    ``doc`` restricts them to one document, by a predicate that reaches the scan.
    """
    first = max(1, first)
    last = first if last < first else min(last, first + MAX_SPAN - 1)
    overlap = (F.col("page") <= last) & (F.greatest("page", F.coalesce("end_page", F.lit(0))) >= first)
    return (chunks if doc is None else chunks.where(F.col("doc") == doc)).where(overlap)


def in_page_order(pages: DataFrame) -> DataFrame:
    """Adds ``place``: the order in which a document's chunks are read."""
    return pages.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("page", "chunk_id")))


def _runs(text: Column, size: Column) -> Column:
    """Runs of ``size`` characters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.transform(starts, lambda i: F.substring(text, i, size))).otherwise(F.array().cast("array<string>"))


def _grams(text: Column) -> Column:
    """Distinct runs of one, two and three characters."""
    return F.array_distinct(F.concat(*[_runs(text, F.lit(k)) for k in (1, 2, 3)]))


def _containing(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """(request, doc_id) where a title (doc_id, t) contains the request (request, r).

    Such a title has all runs of three characters of the request (all of it if it is
    shorter), so the two meet on the one that the fewest titles have.
    """
    grams = titles.select("doc_id", "t", F.explode(_grams(F.col("t"))).alias("gram"))
    own = F.array_distinct(_runs(F.col("r"), F.least(F.lit(3), F.length("r"))))
    wanted = asked.select("request", "r", F.explode(own).alias("gram"))
    df = grams.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    rarest = wanted.join(df, "gram", "left").groupBy("request", "r").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("least"))
    chosen = rarest.where("least.df > 0").select("request", "r", F.col("least.gram").alias("gram"))
    return chosen.join(grams, "gram").where(F.contains("t", F.col("r"))).select("request", "doc_id").distinct()


def resolve(requests: DataFrame, catalogue: DataFrame, listed: int | None = None) -> DataFrame:
    """(request, status, doc_id, ambiguous) for ``requests`` (request) against ``catalogue`` (doc_id, title).

    An id or title that equals the request (ignoring case) comes first, else the
    one title that contains it; several are ambiguous. Blank requests match nothing.
    Equality is an equi-join, and so is containing, on runs of three characters. All
    matches of an ambiguous request are named, or the ``listed`` smallest.
    """
    asked = requests.select("request", F.lower(F.trim("request")).alias("r")).where("r <> ''").distinct()
    title, key = F.lower("title"), F.lower(F.col("doc_id").cast("string"))
    named = catalogue.select("doc_id", key.alias("r")).unionByName(catalogue.select("doc_id", title.alias("r")))
    exact = asked.join(named, "r").groupBy("request").agg(F.min("doc_id").alias("exact_id"))
    rest = asked.join(exact, "request", "left_anti")
    met = _containing(rest, catalogue.select("doc_id", title.alias("t")))
    few = met
    if listed is not None:
        few = met.withColumn("nth", F.row_number().over(Window.partitionBy("request").orderBy("doc_id"))).where(F.col("nth") <= listed)
    found = met.groupBy("request").agg(F.count("*").alias("n"), F.min("doc_id").alias("one"))
    found = found.join(few.groupBy("request").agg(F.sort_array(F.collect_list("doc_id")).alias("all")), "request")
    out = requests.join(exact, "request", "left").join(found, "request", "left")
    one = F.coalesce("exact_id", F.when(F.col("n") == 1, F.col("one")))
    status = F.when(one.isNotNull(), "match").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return out.select("request", status.alias("status"), one.alias("doc_id"), F.when(status == "ambiguous", F.array_join("all", ",")).alias("ambiguous"))


def newest_upsert(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of both with the batch's row where a key is in both.

    Of several rows of one key on the same side the one whose columns sort last stays.
    """
    columns = stored.columns
    last = F.max(F.struct(F.col("batch_no"), *[F.col(f"`{c}`") for c in columns])).alias("last")
    every = stored.withColumn("batch_no", F.lit(0)).unionByName(batch.withColumn("batch_no", F.lit(1)))
    return every.groupBy(key).agg(last).select(*[F.col(f"last.`{c}`") for c in columns])


def catalogue_status(manifest: DataFrame, files: DataFrame, ingested: DataFrame) -> DataFrame:
    """``manifest`` (doc_id, title) with ``state`` and ``chunk_count``.

    ``files``: (doc_id) of those downloaded; ``ingested``: (doc_id, chunk_count).
    """
    joined = manifest.join(files.select("doc_id", F.lit(True).alias("there")).distinct(), "doc_id", "left").join(ingested, "doc_id", "left")
    state = F.when(F.col("chunk_count").isNotNull(), "ingested").when(F.col("there"), "downloaded").otherwise("missing")
    return joined.select("doc_id", "title", state.alias("state"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def corpus_status(manifest: DataFrame, files: DataFrame, ingested: DataFrame) -> DataFrame:
    """(doc_id, title, cluster, present, n_bytes, has_scan, ingested, chunk_count): one row a manifest entry.

    ``files``: (name, size); a document's own file is ``{id}.pdf``, its scanned copy
    ``{id}-scanned.pdf``, ignoring case. ``ingested``: (doc_id, chunk_count).
    """
    sized = files.groupBy(F.lower("name").alias("name")).agg(F.max("size").alias("size"))
    own = manifest.withColumn("name", F.lower(F.concat("doc_id", F.lit(".pdf")))).withColumn("scan", F.lower(F.concat("doc_id", F.lit("-scanned.pdf"))))
    joined = own.join(sized, "name", "left").join(sized.select(F.col("name").alias("scan"), F.lit(True).alias("scanned")), "scan", "left").join(ingested, "doc_id", "left")
    zero = F.lit(0)
    return joined.select(
        "doc_id", "title", "cluster", F.col("size").isNotNull().alias("present"), F.coalesce("size", zero).cast("bigint").alias("n_bytes"), F.coalesce("scanned", F.lit(False)).alias("has_scan"),
        F.col("chunk_count").isNotNull().alias("ingested"), F.coalesce("chunk_count", zero).cast("bigint").alias("chunk_count"),
    )


def cache_misses(texts: DataFrame, cached: DataFrame, model: str) -> DataFrame:
    """Distinct (key, text) whose key is not cached: sha256 of the model, a newline and the text."""
    key = F.sha2(F.concat(F.lit(model + "\n"), F.col("text")), 256)
    asked = texts.where("text IS NOT NULL").select(key.alias("key"), "text").dropDuplicates(["key"])
    return asked.join(cached.select(key.alias("key")).distinct(), "key", "left_anti")
