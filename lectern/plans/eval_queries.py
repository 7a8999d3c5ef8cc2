"""Registered queries of the answer metrics and the ablation report.

Benchmark items are the cases; judges' replies and retrieved pages follow from
their numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import metrics
from lectern.plans import queries as base


def _cases(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    return base._t(spark, d, "benchmark").select(
        i.alias("case_id"), (i % 5 != 0).alias("is_answerable"), (i % 10).cast("string").alias("gold_doc"), F.array((i % 4).cast("int"), (i % 4 + 1).cast("int")).alias("gold_pages"),
        F.when(i % 7 == 0, F.lit(" INSUFFICIENT_CONTEXT\n")).otherwise(F.lit("An answer.")).alias("answer"),
    )


def _retrieved(cases: DataFrame) -> DataFrame:
    """Six passages a case, none for each eleventh."""
    ranks = cases.where("case_id % 11 <> 0").select("case_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rank"))
    return ranks.select("case_id", ((F.col("case_id") + F.floor(F.col("rank") / 3)) % 10).cast("string").alias("doc"), (F.col("rank") % 5).cast("int").alias("page"))


def context_metrics(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d)
    got = metrics.context_metrics(cases, _retrieved(cases))
    return got.select("case_id", "recall", F.round("precision", 6).alias("precision"))


def judge_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Faithfulness, correctness, abstention and violations of every case."""
    cases = _cases(spark, d)
    i = F.col("case_id")
    claims = F.concat(F.lit('```json\n{"supported": '), (i % 4).cast("string"), F.lit(', "total": '), (i % 3).cast("string"), F.lit("}\n```"))
    score = F.concat(F.lit('{"score": '), (i % 9 / 6.0 - 0.2).cast("string"), F.lit("}"))
    violations = cases.where("case_id % 3 = 0").select("case_id")
    parts = {
        "faithfulness": metrics.faithfulness(cases.withColumn("reply", claims)),
        "correctness": metrics.answer_correctness(cases.withColumn("reply", score)),
        "abstention": metrics.abstention(cases),
        "violations": metrics.citation_violation_rate(cases, violations),
    }
    rows = [p.select(F.lit(n).alias("metric"), "case_id", F.round("value", 6).alias("value")) for n, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def ocr_delta(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d)
    got = _retrieved(cases)
    return metrics.ocr_delta(cases, got.where("page < 3"), got.where("page > 1"), "3", 4)


def answer_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of the judged metrics, each over the cases it applies to."""
    rows = judge_metrics(spark, d).withColumn("config", F.lit("judge"))
    return metrics.aggregate_runs(rows)


def ablation_axes(spark: SparkSession, d: str) -> DataFrame:
    """Labels of three runs: one axis varies, one is constant, one is missing from a run."""
    r = base._t(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("run_id"))
    axes = r.withColumn("axis", F.explode(F.array(F.lit("chunker"), F.lit("lambda"), F.lit("retriever"))))
    value = F.when(F.col("axis") == "chunker", F.lit("section")).when(F.col("axis") == "lambda", F.lit("0.7")).otherwise(F.concat(F.lit("r"), F.col("run_id").cast("string")))
    return metrics.axis_labels(axes.where("NOT (axis = 'lambda' AND run_id = 2)").withColumn("value", value))


def queries() -> dict[str, base.Query]:
    return {q.__name__: q for q in (context_metrics, judge_metrics, ocr_delta, answer_means, ablation_axes)}


_CASES = """
WITH c AS (
  SELECT item_id AS case_id, item_id % 5 <> 0 AS ok, (item_id % 10)::VARCHAR AS gold, [item_id % 4, item_id % 4 + 1] AS pages, item_id % 7 = 0 AS declined FROM benchmark),
r AS (SELECT case_id, ((case_id + rank // 3) % 10)::VARCHAR AS doc, rank % 5 AS page FROM c, (SELECT unnest(range(1, 7)) AS rank) WHERE case_id % 11 <> 0)"""

_JUDGED = _CASES + """,
v AS (
  SELECT 'faithfulness' AS metric, case_id, CASE WHEN ok AND NOT declined AND case_id % 3 > 0 THEN least(1, (case_id % 4)::DOUBLE / (case_id % 3)) END AS value FROM c
  UNION ALL SELECT 'correctness', case_id, CASE WHEN ok THEN CASE WHEN declined THEN 0 ELSE greatest(0, least(1, (case_id % 9)::DOUBLE / 6 - 0.2::DOUBLE)) END END FROM c
  UNION ALL SELECT 'abstention', case_id, CASE WHEN NOT ok THEN declined::INT END FROM c
  UNION ALL SELECT 'violations', case_id, CASE WHEN ok THEN (case_id % 3 = 0)::INT END FROM c)"""


def oracle_sql() -> dict[str, str]:
    return {
        "context_metrics": _CASES + """,
h AS (SELECT r.case_id, max((doc = gold AND list_contains(pages, page))::INT) AS found, avg((doc = gold AND list_contains(pages, page))::INT) AS prec FROM r JOIN c USING (case_id) WHERE ok GROUP BY 1)
SELECT case_id, CASE WHEN ok THEN coalesce(found, 0)::DOUBLE END AS recall, round(prec, 6) AS precision FROM c LEFT JOIN h USING (case_id)""",
        "judge_metrics": _JUDGED + " SELECT metric, case_id, round(value, 6) AS value FROM v",
        "ocr_delta": _CASES + """
SELECT case_id, CASE WHEN ok AND gold = '3' AND list_max(pages) <= 4 THEN
  (SELECT count(*) > 0 FROM r WHERE r.case_id = c.case_id AND page > 1 AND list_contains(pages, page))::INT::DOUBLE -
  (SELECT count(*) > 0 FROM r WHERE r.case_id = c.case_id AND page < 3 AND list_contains(pages, page))::INT::DOUBLE END AS value FROM c""",
        "answer_means": _JUDGED + " SELECT 'judge' AS config, metric, round(avg(round(value, 6)), 6) AS value FROM v WHERE value IS NOT NULL GROUP BY metric",
        "ablation_axes": """
SELECT r_regionkey AS run_id, CASE WHEN r_regionkey = 2 THEN '?' ELSE '0.7' END || ';r' || r_regionkey AS label, 'Held constant: chunker=section.' AS constants FROM region WHERE r_regionkey < 3""",
    }
