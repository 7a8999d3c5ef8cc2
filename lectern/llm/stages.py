"""Pipeline stages: (spark, docs, sf_dir) -> DataFrame, each one operator.

All but the last return the columns of ``docs`` as they are, whatever their names;
only personal data changes values (``text``, and ``n_chars`` where there is one).

Cases: a null, empty or white-space text fails the quality rules, so it leaves at
the first stage; by themselves the later stages keep it (it is scored as an empty
text, links with nothing, has no personal data and packs to one closing id); a null
id is trained on by no stage and stays; rows that repeat stay together: they get
one verdict, share one id and are all kept or all left out, but rows of different
ids and one text leave one id; ties go as the operators state; texts are read whole;
an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import jaccard, packing, pii, quality, toxicity
from lectern.llm.queries import tokenizer_path
from lectern.llm.tables import table
from lectern.plans.scratch import Scratch, workers_import_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learned from the labels of the documents given."""
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return jaccard.keep_one(docs, Scratch(spark, "near-duplicates"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kind; ``n_chars`` follows the text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers_import_package(spark)
    return packing.pack_documents(docs, tokenizer_path(), Scratch(spark, "packing"))
