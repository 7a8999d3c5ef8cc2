"""What steps leave on disk."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from lectern.llm import jaccard
from lectern.plans.scratch import Scratch, shuffles_go
from lectern.sources.store import Store


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def left(spark, before: set[str]) -> set[str]:
    """Files go a moment after the query's end."""
    for _ in range(50):
        found = shuffle_files(spark) - before
        if not found:
            break
        time.sleep(0.1)
    return found


def test_a_saved_step_leaves_no_shuffle_files(spark):
    scratch, before = Scratch(spark, "t"), shuffle_files(spark)
    counted = spark.range(5_000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n"))
    held = scratch.save(counted.join(counted.withColumnRenamed("n", "m"), "k"), "counted")
    assert left(spark, before) == set()
    again = scratch.save(counted, "again")  # a frame may still be saved twice
    assert held.count() == again.count() == 700
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_setting_of_the_session_stays(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(name, "false")
    with shuffles_go(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == "false"
    spark.conf.unset(name)


def test_a_batch_leaves_no_shuffle_files(spark):
    store, before = Store(spark, f"{Scratch(spark, 't').path}/store"), shuffle_files(spark)
    rows = spark.range(3_000)
    made = {"counted": rows.groupBy((F.col("id") % 9).alias("k")).count(), "held": lambda target: rows.distinct().write.parquet(target)}
    assert store.run(0, lambda at: made)
    assert left(spark, before) == set() and store.table("counted").count() == 9 and store.table("held").count() == 3_000


def test_compared_sets_go(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i % 7 * 40 : i % 7 * 40 + 100] + [f"x{i}"])) for i in range(90)]
    scratch, before = Scratch(spark, "t"), shuffle_files(spark)
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), scratch)
    kept = [os.path.basename(f) for f, _, _ in os.walk(scratch.path.removeprefix("file://"))]
    assert not [f for f in kept if f.endswith(("-sets", "-pairs", "-cells", "-asks", "-ids"))]
    assert len(left(spark, before)) == 0
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i % 7 for i in range(90)}
