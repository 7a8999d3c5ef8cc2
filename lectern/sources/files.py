"""JSON manifests and gold sets, JSON line logs, result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "documents array<struct<id: string, title: string, url: string, cluster: string, expectedPages: int, publishedOn: string>>"
QA_CASES = "cases array<struct<question: string, expectedAnswer: string, goldDocId: string, goldPages: array<int>, isAnswerable: boolean>>"
REC_CASES = "cases array<struct<seedDocId: string, relevantDocIds: array<string>>>"
RESULT_COLUMNS = ["timestamp_utc", "kind", "config", "case_id", "metric", "value"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a manifest entry; a manifest without documents is an error."""
    raw = spark.read.schema(MANIFEST).json(path, multiLine=True)
    listed = raw.select(F.explode(F.when(F.size("documents") > 0, F.col("documents")).otherwise(F.raise_error(F.lit("the manifest lists no documents")))).alias("d"))
    return listed.select(
        F.col("d.id").alias("doc_id"), F.col("d.title").alias("title"), F.col("d.url").alias("url"), F.col("d.cluster").alias("cluster"),
        F.col("d.expectedPages").alias("expected_pages"), F.to_timestamp("d.publishedOn").alias("published_on"),
    )


def enumerate_documents(manifest: DataFrame, files: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Manifest rows beside their files, and a row for each scanned copy.

    ``files``: (name). A document without a file has ``missing`` set, so that
    callers may warn and skip; ``{id}-scanned.pdf`` adds the document ``{ID}-SCAN``.
    """
    if wanted is not None:
        manifest = manifest.where(F.upper("doc_id").isin([w.upper() for w in wanted]))
    names = files.select(F.lower("name").alias("name")).distinct()
    own = manifest.withColumn("name", F.lower(F.concat("doc_id", F.lit(".pdf")))).join(names.withColumn("there", F.lit(True)), "name", "left")
    scans = manifest.withColumn("name", F.lower(F.concat("doc_id", F.lit("-scanned.pdf")))).join(names, "name")
    scans = scans.withColumn("doc_id", F.concat(F.upper("doc_id"), F.lit("-SCAN"))).withColumn("title", F.concat("title", F.lit(" (scanned copy)")))
    return own.withColumn("missing", F.col("there").isNull()).drop("there").unionByName(scans.withColumn("missing", F.lit(False)))


def is_pdf(content: Column) -> Column:
    return (F.length(content) > 0) & (F.substring(content, 1, 4) == F.lit("%PDF").cast("binary"))


def _cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = spark.read.schema(schema).json(path, multiLine=True)
    full = F.when(F.size("cases") > 0, F.col("cases")).otherwise(F.raise_error(F.lit("the gold set has no cases")))
    return raw.select(F.posexplode(full).alias("case_id", "c"))


def read_qa_cases(spark: SparkSession, path: str) -> DataFrame:
    """Question cases; an answerable one without gold document or pages is an error."""
    rows = _cases(spark, path, QA_CASES).select("case_id", "c.*")
    bad = F.col("isAnswerable") & (F.col("goldDocId").isNull() | (F.coalesce(F.size("goldPages"), F.lit(0)) < 1))
    checked = F.when(bad, F.raise_error(F.lit("an answerable case needs a gold document and pages"))).otherwise(F.col("isAnswerable"))
    return rows.withColumn("isAnswerable", checked)


def read_rec_cases(spark: SparkSession, path: str) -> DataFrame:
    return _cases(spark, path, REC_CASES).select("case_id", "c.*")


def result_rows(rows: DataFrame, means: DataFrame, kind: str, timestamp: str) -> DataFrame:
    """Case rows and MEAN rows in the columns of a result file; values to six places."""
    every = rows.select("config", F.col("case_id").cast("string").alias("case_id"), "metric", "value").unionByName(
        means.select("config", F.lit("MEAN").alias("case_id"), "metric", "value")
    )
    trimmed = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", "value"), "0+$", ""), "\\.$", "")
    return every.where("value IS NOT NULL").select(F.lit(timestamp).alias("timestamp_utc"), F.lit(kind).alias("kind"), "config", "case_id", "metric", trimmed.alias("value"))


def write_results(rows: DataFrame, path: str) -> None:
    rows.select(*RESULT_COLUMNS).write.mode("overwrite").csv(path, header=True, quote="")


def append_log(rows: DataFrame, path: str) -> None:
    """JSON lines; each writer makes files of its own, so writers never mix lines."""
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str, after: int | None = None, sequence: str = "seq") -> DataFrame:
    """Rows of a JSON line log, those with a sequence number above ``after``."""
    rows = spark.read.schema(schema).json(path)
    return rows if after is None else rows.where(F.col(sequence) > after)
