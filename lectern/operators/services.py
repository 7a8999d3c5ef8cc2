"""Model services as arguments of operators: batches, bounded retries, answers kept by content.

A service maps a list of texts to as many answers. Each different text is asked once,
in batches from the executors; a batch that fails, or gives another number of
answers, is asked again up to ``attempts`` times, with growing waits, before the job
fails. With a store, answers are kept under the sha256 of the service's name and the
text, and only texts without one are asked in later runs.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.interfaces import Retriever
from lectern.operators import fusion, metrics
from lectern.plans.scratch import workers_import_package
from lectern.sources.store import Snapshot, Store


@dataclass(frozen=True)
class Service:
    name: str
    call: Callable[[list[str]], list[Any]]
    #: Spark type of an answer.
    kind: str = "string"
    batch: int = 64
    attempts: int = 3
    #: Seconds before the second attempt; doubled each time.
    wait: float = 0.5


def ask(service: Service, texts: list[str]) -> list[Any]:
    """Answers to one batch, tried as often as the service allows."""
    for attempt in range(1, service.attempts + 1):
        try:
            got = list(service.call(texts))
            if len(got) != len(texts):
                raise ValueError(f"{service.name}: {len(got)} answers to {len(texts)} texts")
            return got
        except Exception:
            if attempt == service.attempts:
                raise
            time.sleep(service.wait * 2 ** (attempt - 1))
    raise ValueError("a service needs one attempt at least")


def _asked(texts: DataFrame, service: Service) -> DataFrame:
    """(key, answer) of ``texts`` (key, text)."""
    workers_import_package(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), service.batch):
                part = b.iloc[at : at + service.batch]
                yield pd.DataFrame({"key": part["key"].to_numpy(), "answer": pd.Series(ask(service, part["text"].tolist()), dtype=object)})

    return texts.mapInPandas(run, f"key string, answer {service.kind}")


def answers(texts: DataFrame, service: Service, store: Store | None = None, number: int | None = None) -> DataFrame:
    """``texts`` (id columns, text) with ``answer``; null texts have none.

    ``number``: of the run in the store, the next one where it is not given.
    """
    key = F.sha2(F.concat(F.lit(service.name + "\n"), F.col("text")), 256)
    keyed = texts.withColumn("_key", key)
    asked = keyed.where("text IS NOT NULL").groupBy(F.col("_key").alias("key")).agg(F.first("text").alias("text"))
    if store is None:
        made = _asked(asked, service)
    else:
        name = f"answers-{service.name}"

        def work(before: Snapshot) -> dict[str, DataFrame]:
            held = store.table(name, before)
            misses = asked if held is None else asked.join(held.select("key"), "key", "left_anti")
            fresh = _asked(misses, service)
            return {name: fresh if held is None else held.unionByName(fresh)}

        store.run(store.current().batch + 1 if number is None else number, work)
        made = store.table(name)
    return keyed.join(made.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


@dataclass(frozen=True)
class ServiceEmbedder:
    """An embedder, as operators take one, whose vectors come from a service of kind array<double>."""

    service: Service
    store: Store | None = None

    def __call__(self, df: DataFrame, key: list[str], tokens: str, dim: int = 64) -> DataFrame:
        texts = df.select(*key, F.array_join(F.coalesce(F.col(tokens), F.array().cast("array<string>")), " ").alias("text"))
        return answers(texts, self.service, self.store).select(*key, F.col("answer").alias("embedding"))


def retrieve(queries: DataFrame, rows: DataFrame, retrievers: list[Retriever], depth: int = 20, shortlist: int = 10, k: int = 6, per_doc: int = 4) -> DataFrame:
    """Hybrid retrieval with any retrievers: (queries, rows, k) -> (query_id, rank, id, score) each.

    ``queries``: (query_id, text); ``rows``: (id, doc, text).
    """
    ranked = [r(queries, rows, depth).select("query_id", "rank", "id", F.lit(n).alias("list_no")) for n, r in enumerate(retrievers)]
    lists = ranked[0]
    for one in ranked[1:]:
        lists = lists.unionByName(one)
    return fusion.hybrid_of(lists, queries, rows, shortlist, k, per_doc)


def judged_faithfulness(answered: DataFrame, judge: Service, store: Store | None = None) -> DataFrame:
    """(case_id, value) of ``answered`` (case_id, is_answerable, answer, passages), by a judge's replies.

    Only answers that are judged are sent: those of answerable cases that are not declined.
    """
    sent = F.col("is_answerable") & ~metrics.abstained(F.col("answer"))
    prompt = F.concat(F.lit("Passages:\n"), F.coalesce("passages", F.lit("")), F.lit("\n\nAnswer:\n"), F.col("answer"))
    told = answers(answered.select("case_id", F.when(sent, prompt).alias("text")), judge, store)
    return metrics.faithfulness(answered.join(told.select("case_id", F.col("answer").alias("reply")), "case_id"))
