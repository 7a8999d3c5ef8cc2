"""Quality rules: hashed n-gram log-likelihood ratio (operator 1, native).

Two multinomials over hashed word unigrams and bigrams are compared: one counted
over trusted documents, one over every document. A document's ratio is the sum
of its n-grams' weights over the number of its n-grams, and every document is
held to one fixed threshold. Weights are whole thousandths of a nat, so sums are
exact in any order and the verdict is deterministic.

Trusted documents are all of those labelled as good. Their ids are counted first:
up to ``broadcast_ids`` of them are broadcast, more are joined by a shuffle, with
the same result. Everything counted covers all rows. The weight table has
``buckets`` entries.

Everything is DataFrame functions: the work on one text stays inside its row, so
scoring needs no shuffle. Counting shuffles one row a bucket and task, and the
texts once where the trusted ids are too many to broadcast.

Cases: a null text, an empty one and one of white space have no words and fail
the base rules; a text is read whole, whatever its length; equal rows and ties
get equal verdicts, and a document at the threshold is kept; rows that share an
id are judged each by its own text; with no trusted document the target is
uniform; an empty table gives an empty result; other columns are ignored by
:func:`assess` and kept by :func:`keep_good`, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\\x20\\x09-\\x0D]"  # as a SQL string literal
TRIM = r"' \t\n\u000b\f\r'"


@dataclass(frozen=True)
class QualityRules:
    buckets: int = 10_000
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Thousandths of a nat an n-gram that a kept document has at least.
    threshold: int = -60
    #: Most trusted ids that are broadcast, about 60 bytes each; beyond it they are shuffled.
    broadcast_ids: int = 1_000_000


def words(text: str) -> Column:
    """Words of a text column: runs without ASCII white space; null gives none."""
    return F.expr(f"CASE WHEN btrim({text}, {TRIM}) <> '' THEN split(btrim({text}, {TRIM}), '{SPACE}+') ELSE array() END")


def _grams(n: int) -> str:
    """Buckets of the unigrams and bigrams of the array ``w``."""
    one = f"transform(w, x -> crc32(CAST(x AS BINARY)) % {n})"
    two = f"transform(sequence(1, size(w) - 1), i -> crc32(CAST(concat_ws(' ', w[i - 1], w[i]) AS BINARY)) % {n})"
    return f"CASE WHEN size(w) > 1 THEN concat({one}, {two}) ELSE {one} END"


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def gram_weights(docs: DataFrame, labels: DataFrame, rules: QualityRules) -> list[int]:
    """Weight of each bucket from one pass over all documents."""
    ids = trusted_ids(labels)
    few = ids.count() <= rules.broadcast_ids
    target = (F.broadcast(ids) if few else ids.hint("merge")).withColumn("trusted", F.lit(1))
    counted = (
        docs.select("doc_id", "text")
        .join(target, "doc_id", "left")
        .select(F.coalesce("trusted", F.lit(0)).alias("trusted"), words("text").alias("w"))
        .select("trusted", F.explode(F.expr(_grams(rules.buckets))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    )
    size = rules.buckets
    totals = F.expr("struct(sum(raw) OVER () AS raw, sum(target) OVER () AS target)")
    ratio = F.expr(
        f"ln((target + 1.0D) / (coalesce(t.target, 0) + {size})) - ln((raw + 1.0D) / (coalesce(t.raw, 0) + {size}))"
    )
    rows = counted.withColumn("t", totals).select("bucket", F.round(ratio * 1000).cast("bigint").alias("weight"), "t")
    got = rows.collect()  # one row a bucket
    t_raw, t_target = (got[0].t.raw, got[0].t.target) if got else (0, 0)
    unseen = math.log(1 / (t_target + size)) - math.log(1 / (t_raw + size))
    weights = [int(math.floor(abs(unseen) * 1000 + 0.5)) * (1 if unseen > 0 else -1)] * size
    for r in got:
        weights[r.bucket] = r.weight
    return weights


def base_rules(df: DataFrame, rules: QualityRules) -> DataFrame:
    """Adds the base columns to ``df`` (doc_id, text, w and any others)."""
    windows = "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
    # words hold no space, so joined windows are equal only where their words are
    placed = "transform(c, e -> struct(concat_ws(' ', w[e.i], w[e.i + 1], w[e.i + 2]) AS x, e.i AS i))"
    lines = f"filter(split(coalesce(text, ''), '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    df = df.select(
        *df.columns,
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.expr("CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '')) AS BIGINT)").alias("n_symbols"),
        F.expr(lines).alias("lines"),
        F.expr(f"CASE WHEN size(w) > 2 THEN {windows} ELSE array() END").alias("h"),
    )
    df = df.select(
        *[c for c in df.columns if c != "lines"],
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(x AS x, i AS i))) ELSE array() END").alias("c"),
    )
    # only windows whose hash repeats are looked at further, by their words
    again = "filter({0}, (e, j) -> (j > 0 AND {0}[j - 1].x = e.x) OR (j < size({0}) - 1 AND {0}[j + 1].x = e.x))".format
    df = df.withColumn("c", F.expr(again("c"))).withColumn("s", F.expr(f"sort_array({placed})"))
    df = df.withColumn("r", F.expr(f"sort_array(transform({again('s')}, e -> e.i))"))
    # words in a sorted run of windows: each window adds what the one before left uncovered
    covered = (
        "aggregate(r, named_struct('n', 0L, 'p', -3), (a, i) -> named_struct('n', a.n + least(3, i - a.p), 'p', i), a -> a.n)"
    )
    df = df.withColumn("n_repeat_words", F.expr(covered)).drop("s", "r", "h", "c")
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    return df.withColumn("base_failed", failed)


def _judge(df: DataFrame, weights: list[int], rules: QualityRules) -> DataFrame:
    """Adds all counts and the verdict to ``df`` (doc_id, text and any others)."""
    table = F.expr("split('" + ",".join(map(str, weights)) + "', ',')").cast("array<bigint>")
    n, given = rules.buckets, df.columns
    df = base_rules(df.withColumn("w", words("text")), rules)
    total = (
        f"aggregate(w, 0L, (a, x) -> a + weights[crc32(CAST(x AS BINARY)) % {n}]) + CASE WHEN size(w) > 1 THEN "
        f"aggregate(sequence(1, size(w) - 1), 0L, (a, i) -> "
        f"a + weights[crc32(CAST(concat_ws(' ', w[i - 1], w[i]) AS BINARY)) % {n}]) ELSE 0L END"
    )
    df = df.withColumn("weights", table).withColumn("llr_sum", F.expr(total)).drop("weights", "w")
    df = df.withColumn("n_grams", F.greatest(2 * F.col("n_words") - 1, F.lit(0)))
    kept = ~F.col("base_failed") & (F.col("llr_sum") >= rules.threshold * F.col("n_grams"))
    df = df.withColumn("kept", kept)
    # The counts leave through a generator: a filter on them stays above it. Pushed below,
    # each use of a count in it would become a copy of all that made it.
    made = [c for c in df.columns if c not in given]
    return df.select(*given, F.explode(F.array(F.struct(*made))).alias("judged")).select(*given, "judged.*")


def assess(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row a document: counts, base verdict, ratio in thousandths of a nat, verdict."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return _judge(docs, gram_weights(docs, labels, rules), rules).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever those are called."""
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, key = (F.col(f"c{names.index(c)}") for c in ("text", "doc_id"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("doc_id"), text.cast("string").alias("text"))
    judged = _judge(packed, gram_weights(packed.select("doc_id", "text"), labels, rules), rules)
    return judged.where("kept").select("row.*").toDF(*names)
