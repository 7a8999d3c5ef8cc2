"""Citation guard: parse, test against the retrieved passages, strip and warn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a citation tag, the title lazily up to the page.
CITATION = r"\[([^\[\]\n]+?),\s*p\.(\d+)\]"
MIN_PREFIX = 10


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, nth, tag, title, page) of every citation in ``answers`` (answer_id, answer)."""
    groups = [F.regexp_extract_all("answer", F.lit(CITATION), F.lit(i)) for i in range(3)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("tag", "title", "page"), strict=True)])
    found = answers.select("answer_id", F.posexplode(zipped).alias("nth", "c"))
    return found.select("answer_id", "nth", F.col("c.tag").alias("tag"), F.trim("c.title").alias("title"), F.col("c.page").cast("int").alias("page"))


def unsupported(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """Citations without support in ``passages`` (answer_id, doc_id, title, page, end_page).

    Supported: the page lies in a passage's span and its title is equal (ignoring
    case), or the cited title has ten characters and begins the titles of exactly
    one document among those passages.
    """
    cited = citations(answers)
    met = cited.join(passages.withColumnsRenamed({"title": "p_title", "page": "p_page"}), "answer_id", "left")
    on_page = F.col("page").between(F.col("p_page"), F.greatest("p_page", "end_page"))
    same = F.lower("p_title") == F.lower("title")
    begins = (F.length("title") >= MIN_PREFIX) & F.startswith(F.lower("p_title"), F.lower("title"))
    flags = met.groupBy("answer_id", "nth", "tag", "title", "page").agg(
        F.coalesce(F.max((on_page & same).cast("int")), F.lit(0)).alias("equal"),
        F.count_distinct(F.when(on_page & begins, F.col("doc_id"))).alias("begun"),
    )
    return flags.where("equal = 0 AND begun <> 1").select("answer_id", "nth", "tag", "title", "page")


def violation_log(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """One record for each unsupported occurrence: (answer_id, nth, cited_title, cited_page, question)."""
    bad = unsupported(answers, passages).select("answer_id", "nth", F.col("title").alias("cited_title"), F.col("page").alias("cited_page"))
    asked = answers.select("answer_id", F.col("question") if "question" in answers.columns else F.lit(None).cast("string").alias("question"))
    return bad.join(asked, "answer_id")


def panel_matches(cited: DataFrame, passages: DataFrame) -> DataFrame:
    """The passages behind each of ``cited`` (answer_id, nth, title, page) for a reader.

    Titles match where either holds the other, ignoring case. Passages whose span has
    the page come alone; without any, all of the title are shown.
    """
    met = cited.join(passages.withColumnsRenamed({"title": "p_title", "page": "p_page"}), "answer_id")
    a, b = F.lower("p_title"), F.lower("title")
    met = met.where(F.contains(a, b) | F.contains(b, a))
    met = met.withColumn("on_page", F.col("page").between(F.col("p_page"), F.greatest("p_page", "end_page")))
    some = F.max("on_page").over(Window.partitionBy("answer_id", "nth"))
    return met.withColumn("some", some).where(F.col("on_page") | ~F.col("some")).select("answer_id", "nth", "doc_id", "p_page", "on_page")


def guard(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(answer_id, guarded, removed): answers without unsupported tags and with a warning, whose sentence is a fixed value."""
    bad = unsupported(answers, passages).groupBy("answer_id").agg(
        F.count("*").alias("removed"), F.sort_array(F.collect_list(F.struct("nth", "tag"))).alias("found")
    )
    tags = F.array_distinct(F.transform("found", lambda t: t["tag"]))
    joined = answers.join(bad.select("answer_id", "removed", tags.alias("tags")), "answer_id", "left")
    stripped = F.rtrim(F.aggregate("tags", F.col("answer"), lambda text, tag: F.replace(text, tag, F.lit(""))))
    warned = F.concat(
        stripped, F.lit("\n\n[warning: removed "), F.col("removed").cast("string"),
        F.lit(" citation(s) not supported by the retrieved passages: "), F.array_join("tags", ", "), F.lit("]"),
    )
    return joined.select("answer_id", F.when(F.col("removed") > 0, warned).otherwise(F.col("answer")).alias("guarded"), F.coalesce("removed", F.lit(0)).alias("removed"))
