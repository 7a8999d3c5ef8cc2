"""Page text, paragraphs and tables from layout rows, and from HTML as local default."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DROPPED_ROLES = ("pageHeader", "pageFooter", "pageNumber")


def page_text(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page, text, mean_confidence) of ``lines`` (doc_id, page, seq, text) and ``words`` (doc_id, page, confidence).

    A page without words has confidence one.
    """
    text = lines.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("lines"))
    text = text.select("doc_id", "page", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))
    mean = words.groupBy("doc_id", "page").agg(F.avg("confidence").alias("mean"))
    return text.join(mean, ["doc_id", "page"], "left").select("doc_id", "page", "text", F.coalesce("mean", F.lit(1.0)).alias("mean_confidence"))


def paragraphs(rows: DataFrame) -> DataFrame:
    """(doc_id, seq, page, kind, text) of ``rows`` (doc_id, seq, role, pages, text), furniture and blanks left out."""
    kept = rows.where(~F.coalesce(F.col("role"), F.lit("")).isin(*DROPPED_ROLES) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    kind = F.when(F.col("role") == "title", "Title").when(F.col("role") == "sectionHeading", "SectionHeading").when(F.col("role") == "footnote", "Footnote").otherwise("Body")
    return kept.select("doc_id", "seq", F.coalesce(F.get("pages", F.lit(0)), F.lit(1)).alias("page"), kind.alias("kind"), "text")


def table_pages(rows: DataFrame) -> DataFrame:
    """Tables with ``page`` (that of the table, else of its first cell) and ``skipped``: why one is left out, or null.

    ``rows``: (pages, cell_pages, ...), with ``markdown`` where it is made already,
    which is null for a degenerate table.
    """
    page = F.coalesce(F.get("pages", F.lit(0)), F.get("cell_pages", F.lit(0)))
    degenerate = F.col("markdown").isNull() if "markdown" in rows.columns else F.lit(False)
    return rows.withColumn("page", page).withColumn("skipped", F.when(page.isNull(), "no page").when(degenerate, "degenerate"))


def html_paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, seq, page, kind, text): headings and paragraphs of pages, furniture left out.

    Scripts, styles, comments, menus and footers go first; a paragraph runs to the
    next heading, paragraph or the end, and what stands before the first is one too.
    """
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|footer|head)\b.*?</\1>|<div class=.ad.>.*?</div>", "")
    cut = pages.select(key, F.posexplode(F.split(bare, r"(?i)(?=<h1>|<p>)")).alias("seq", "piece"))
    text = F.trim(F.regexp_replace(F.regexp_replace("piece", r"<[^>]*>", " "), r"\s+", " "))
    kind = F.when(F.lower("piece").startswith("<h1>"), "SectionHeading").otherwise("Body")
    return cut.select(key, "seq", F.lit(1).alias("page"), kind.alias("kind"), text.alias("text")).where("text <> ''")
