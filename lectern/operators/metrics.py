"""Ranking and answer metrics as aggregates; NULL means not applicable.

Lists are (case_id, rank, doc); gold is (case_id, doc). Means skip NULL, so each
metric has its own number of cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.replies import claim_share, judged_score


def judged(lists: DataFrame, gold: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows of the lists with ``hit``, beside every case's number of gold documents."""
    size = gold.groupBy("case_id").agg(F.count("*").alias("n_gold"))
    marked = lists.join(gold.select("case_id", "doc", F.lit(1).alias("hit")), ["case_id", "doc"], "left")
    return cases.select("case_id").join(size, "case_id", "left").join(marked, "case_id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def judged_by_label(lists: DataFrame, labels: DataFrame, cases: DataFrame) -> DataFrame:
    """The same where the gold of a case is all other documents of its label.

    ``labels``: (doc, label); ``cases``: (case_id, label), the case being a document
    itself. A label's documents are counted, not paired.
    """
    size = labels.where("label IS NOT NULL").groupBy("label").agg((F.count("*") - 1).alias("n_gold"))
    listed = lists.join(labels, "doc", "left").select("case_id", "rank", "doc", F.col("label").alias("doc_label"))
    rows = cases.join(size, "label", "left").join(listed, "case_id", "left")
    hit = F.coalesce((F.col("doc_label") == F.col("label")) & (F.col("doc") != F.col("case_id")), F.lit(False)).cast("int")
    return rows.select("case_id", "n_gold", "doc", "rank", hit.alias("hit"))


def ranking_metrics(lists: DataFrame, gold: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """Long (metric, case_id, value): recall, precision, nDCG at ``k`` and MRR."""
    return metrics_of_judged(judged(lists, gold, cases), k)


def metrics_of_judged(rows: DataFrame, k: int) -> DataFrame:
    """The metrics of ``rows`` (case_id, n_gold, doc, rank, hit)."""
    within = F.col("rank") <= k
    gain = F.when(within, F.col("hit") / F.log2(F.col("rank") + 1.0))
    # the best list has its gold documents first
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_gold")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    per_case = rows.groupBy("case_id", "n_gold").agg(
        F.max(F.when(within, F.col("hit"))).alias("recall"),
        F.avg(F.when(within, F.col("hit"))).alias("precision"),
        F.sum(gain).alias("dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    has = F.col("n_gold") > 0
    values = {
        f"recall@{k}": F.when(has, F.coalesce(F.col("recall"), F.lit(0)).cast("double")),
        f"precision@{k}": F.when(has, F.col("precision")),
        f"ndcg@{k}": F.when(has, F.coalesce("dcg", F.lit(0.0)) / best),
        "mrr": F.when(has, F.coalesce(1.0 / F.col("first"), F.lit(0.0))),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(v, 6).alias("value")) for n, v in values.items()])
    return per_case.select("case_id", F.explode(pairs).alias("m")).select("m.metric", "case_id", "m.value")


def coverage(lists: DataFrame, corpus_size: int, block: int = 10_000) -> DataFrame:
    """(case_id, value): distinct documents over the cases so far, over the corpus.

    The running sum goes over blocks of case numbers first, then inside each block,
    so only one row a block meets in one task.
    """
    first = lists.groupBy("doc").agg(F.min("case_id").alias("case_id")).groupBy("case_id").agg(F.count("*").alias("fresh"))
    seen = lists.select("case_id").distinct().join(first, "case_id", "left")
    seen = seen.select("case_id", F.floor(F.col("case_id") / block).alias("block"), F.coalesce("fresh", F.lit(0)).alias("fresh"))
    so_far = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    before = seen.groupBy("block").agg(F.sum("fresh").alias("n")).select("block", so_far.alias("before"))
    running = F.sum("fresh").over(Window.partitionBy("block").orderBy("case_id").rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn("inside", running).join(before, "block").select("case_id", F.round((F.col("before") + F.col("inside")) / corpus_size, 6).alias("value"))


def intra_list_diversity(pairs: DataFrame) -> DataFrame:
    """(case_id, value): one less the mean similarity of ``pairs`` (case_id, sim) of one list."""
    return pairs.groupBy("case_id").agg(F.round(1 - F.avg("sim"), 6).alias("value"))


def duplicate_leakage(lists: DataFrame) -> DataFrame:
    """(case_id, value): 1 where a lineage group (column ``grp``, null for none) is listed twice."""
    most = lists.groupBy("case_id", "grp").agg(F.count("grp").alias("n"))
    return most.groupBy("case_id").agg((F.max("n") >= 2).cast("double").alias("value"))


def abstention(answers: DataFrame, token: str = "INSUFFICIENT_CONTEXT") -> DataFrame:
    """(case_id, value): whether an unanswerable case is declined; NULL for answerable ones."""
    said = abstained(F.col("answer"), token).cast("double")
    return answers.select("case_id", F.when(~F.col("is_answerable"), said).alias("value"))


def citation_violation_rate(answers: DataFrame, violations: DataFrame) -> DataFrame:
    """(case_id, value): 1 where an answerable case has any violation."""
    n = violations.groupBy("case_id").agg(F.count("*").alias("n"))
    joined = answers.join(n, "case_id", "left")
    return joined.select("case_id", F.when(F.col("is_answerable"), (F.coalesce("n", F.lit(0)) > 0).cast("double")).alias("value"))


def is_gold(doc: Column, page: Column, gold_doc: Column, gold_pages: Column) -> Column:
    """Whether a passage is gold: its document and the page it starts on."""
    return F.coalesce((doc == gold_doc) & F.array_contains(gold_pages, page), F.lit(False))


def context_metrics(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(case_id, recall, precision) by pages of ``retrieved`` (case_id, doc, page).

    ``cases``: (case_id, is_answerable, gold_doc, gold_pages). Unanswerable cases have
    neither; without passages there is no precision.
    """
    asked = cases.where("is_answerable").select("case_id", "gold_doc", "gold_pages")
    marked = retrieved.join(asked, "case_id").withColumn("hit", is_gold(F.col("doc"), F.col("page"), F.col("gold_doc"), F.col("gold_pages")).cast("int"))
    found = marked.groupBy("case_id").agg(F.max("hit").cast("double").alias("found"), F.avg("hit").alias("precision"))
    joined = cases.select("case_id", "is_answerable").join(found, "case_id", "left")
    return joined.select("case_id", F.when(F.col("is_answerable"), F.coalesce("found", F.lit(0.0))).alias("recall"), "precision")


def abstained(answer: Column, token: str = "INSUFFICIENT_CONTEXT") -> Column:
    return F.coalesce(F.btrim(answer, F.lit(" \t\r\n")) == token, F.lit(False))


def faithfulness(answers: DataFrame) -> DataFrame:
    """(case_id, value) of ``answers`` (case_id, is_answerable, answer, reply): the judge's share of supported claims.

    NULL for unanswerable cases, declined answers and replies without claims.
    """
    value = F.when(F.col("is_answerable") & ~abstained(F.col("answer")), claim_share(F.col("reply")))
    return answers.select("case_id", value.alias("value"))


def answer_correctness(answers: DataFrame) -> DataFrame:
    """(case_id, value) of the same with the judge's score as ``reply``: declining an answerable case scores 0."""
    value = F.when(F.col("is_answerable"), F.when(abstained(F.col("answer")), F.lit(0.0)).otherwise(judged_score(F.col("reply"))))
    return answers.select("case_id", value.alias("value"))


def ocr_delta(cases: DataFrame, native: DataFrame, scanned: DataFrame, native_doc: str, scanned_pages: int) -> DataFrame:
    """(case_id, value): whether the scanned copy gives a gold page, less whether the native document does.

    ``native`` and ``scanned``: (case_id, page) retrieved within either. Only for
    answerable cases of that document whose gold pages are all scanned.
    """
    def found(rows: DataFrame, name: str) -> DataFrame:
        hit = rows.join(cases.select("case_id", "gold_pages"), "case_id").where(F.array_contains("gold_pages", F.col("page")))
        return hit.select("case_id", F.lit(1.0).alias(name)).distinct()

    joined = cases.join(found(native, "n"), "case_id", "left").join(found(scanned, "s"), "case_id", "left")
    applies = F.col("is_answerable") & (F.col("gold_doc") == native_doc) & F.forall("gold_pages", lambda p: p <= scanned_pages)
    return joined.select("case_id", F.when(applies, F.coalesce("s", F.lit(0.0)) - F.coalesce("n", F.lit(0.0))).alias("value"))


def axis_labels(runs: DataFrame) -> DataFrame:
    """(run_id, label, constants) of ``runs`` (run_id, axis, value).

    The label joins the values of the axes that vary; what all runs share is stated
    once. Without a varying axis the label names every axis.
    """
    n_runs = runs.agg(F.count_distinct("run_id")).first()[0]
    kinds = runs.groupBy("axis").agg(F.count_distinct("value").alias("n"), F.count_distinct("run_id").alias("held"))
    varies = F.col("n") + F.when(F.col("held") < n_runs, 1).otherwise(0) > 1  # an axis some run lacks varies too
    marked = kinds.select("axis", varies.alias("varies"))
    ids, axes = runs.select("run_id").distinct(), marked
    grid = ids.join(F.broadcast(axes)).join(runs, ["run_id", "axis"], "left").withColumn("value", F.coalesce("value", F.lit("?")))  # runs by axes, a report's size
    pair = F.struct("axis", "value")
    grouped = grid.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("varies"), pair))).alias("varying"), F.sort_array(F.collect_list(F.when(~F.col("varies"), pair))).alias("constant"), F.sort_array(F.collect_list(pair)).alias("every")
    )
    stated = F.transform("constant", lambda x: F.concat(x["axis"], F.lit("="), x["value"]))
    label = F.when(F.size("varying") > 0, F.array_join(F.transform("varying", lambda x: x["value"]), ";")).otherwise(
        F.array_join(F.transform("every", lambda x: F.concat(x["axis"], F.lit("="), x["value"])), ";")
    )
    return grouped.select("run_id", label.alias("label"), F.when(F.size("constant") > 0, F.concat(F.lit("Held constant: "), F.array_join(stated, "; "), F.lit("."))).alias("constants"))


def aggregate_runs(rows: DataFrame, last: tuple[str, ...] = ("coverage",)) -> DataFrame:
    """(config, metric, value): means of (config, metric, case_id, value); the last value for cumulative metrics."""
    kept = rows.where("value IS NOT NULL")
    value = F.when(F.col("metric").isin(*last), F.max_by("value", "case_id")).otherwise(F.avg("value"))
    return kept.groupBy("config", "metric").agg(F.round(value, 6).alias("value"))


def ablation_table(means: DataFrame, configs: list[str]) -> DataFrame:
    """One row a metric, one column a configuration; a dash where it is missing."""
    text = means.withColumn("value", F.format_string("%.3f", "value"))
    return text.groupBy("metric").pivot("config", configs).agg(F.first("value")).na.fill("—")
