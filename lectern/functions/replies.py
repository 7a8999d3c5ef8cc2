"""Replies of models as columns: JSON, perhaps in a code fence.

A reply that is no JSON of the expected shape gives NULL and never fails the job;
callers see which rows those are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import trim_words

SUMMARY_WORDS = 150
MAX_TOPICS = 6


def strip_fences(reply: Column) -> Column:
    """The reply without the code fence around it: from behind its first line up to the last fence."""
    text = F.btrim(reply, F.lit(" \t\r\n"))
    inner = F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*)```", 1)
    return F.when(text.startswith("```"), F.btrim(inner, F.lit(" \t\r\n"))).otherwise(text)


def claim_share(reply: Column) -> Column:
    """Supported claims over all claims of ``{"supported": n, "total": n}``, from 0 to 1; NULL without claims."""
    got = F.from_json(strip_fences(reply), "supported double, total double")
    share = got["supported"] / F.when(got["total"] > 0, got["total"])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) + F.when(share.isNotNull(), F.lit(0.0))


def judged_score(reply: Column) -> Column:
    """The score of ``{"score": x}``, held to 0 to 1."""
    score = F.from_json(strip_fences(reply), "score double")["score"]
    return F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def grades(reply: Column) -> Column:
    """Array of (index, score) of ``{"scores": [{"index": n, "score": x}]}``, scores held to 0 to 10; NULL without any."""
    got = F.from_json(strip_fences(reply), "scores array<struct<index: int, score: double>>")["scores"]
    held = F.transform(got, lambda g: F.struct(g["index"].alias("index"), F.least(F.lit(10.0), F.greatest(F.lit(0.0), g["score"])).alias("score")))
    return F.when(F.size(got) > 0, held)


def summary(reply: Column) -> Column:
    """Struct (summary, topics) of ``{"summary": text, "topics": [...]}``; NULL where either is missing.

    At most 150 words and six topics are kept.
    """
    got = F.from_json(strip_fences(reply), "summary string, topics array<string>")
    text = F.btrim(got["summary"], F.lit(" \t\r\n"))
    whole = (F.coalesce(text, F.lit("")) != "") & (F.coalesce(F.size(got["topics"]), F.lit(0)) > 0)
    return F.when(whole, F.struct(trim_words(text, SUMMARY_WORDS).alias("summary"), F.slice(got["topics"], 1, MAX_TOPICS).alias("topics")))
