"""The store, ingest runs that die or repeat, and lineage kept up batch by batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import vectors as vx
from lectern.operators import ingest_run, lexical_index, lineage, lineage_state
from lectern.plans.scratch import Scratch
from lectern.sources.store import Conflict, Store

DOCS = "doc_id long, title string, cluster string, published_on string, text string"


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("published_on", F.col("published_on").cast("timestamp"))


def test_commits_show_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = lambda x: spark.createDataFrame([(x,)], "x long")
    assert store.table("t") is None and store.current().number == 0
    assert store.run(5, lambda at: {"t": one(1), "u": one(10)})

    def dies(at):
        return {"t": one(2), "u": lambda folder: (_ for _ in ()).throw(OSError("lost"))}

    with pytest.raises(OSError):
        store.run(6, dies)
    assert [store.table(n).first().x for n in "tu"] == [1, 10]  # half-written tables are named by no commit
    assert store.run(6, lambda at: {"t": one(2)}) and not store.run(6, lambda at: {"t": one(3)}) and not store.run(2, lambda at: {"t": one(3)})
    assert [store.table(n).first().x for n in "tu"] == [2, 10]
    (tmp_path / "commits" / "000000000003.json").write_text("")  # its writer died
    assert store.current().number == 2 and store.run(7, lambda at: {"u": one(11)}) and store.current().number == 4
    assert [store.table(n).first().x for n in "tu"] == [2, 11]
    assert len(store.vacuum(1)) == 3 and [store.table(n).first().x for n in "tu"] == [2, 11]


def test_runs_at_the_same_time_conflict(spark, tmp_path):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one = spark.createDataFrame([(1,)], "x long")

    def slow(at):
        other.run(1, lambda at: {"t": one})
        return {"t": one}

    with pytest.raises(Conflict):
        store.run(2, slow)
    assert store.current().batch == 1 and store.run(2, lambda at: {"t": one})


def editions(rng, n):
    """Works in several editions, their titles and vectors close."""
    words = [f"term{i}" for i in range(40)]
    rows = []
    for i in range(n):
        work = rng.randrange(n // 3)
        own = random.Random(work)
        title = [*own.choices(words, k=5), rng.choice(["draft", "final", "2nd"]), *rng.choices(words, k=rng.randint(0, 1))]
        text = own.choices(words, k=60) + rng.choices(words, k=rng.randint(0, 2))
        rows.append((i, " ".join(title), f"c{work % 2}", f"199{rng.randint(0, 4)}-0{1 + i % 9}-01", " ".join(text)))
    return rows


def groups_of(df):
    return {r.doc_id: r.lineage_group for r in df.collect()}


def catalogue(spark, rows):
    docs = documents(spark, rows)
    vectors = vx.hash_embedding(docs.select("doc_id", F.split("text", " ").alias("t")), ["doc_id"], "t")
    return docs.drop("text").join(vectors, "doc_id")


@pytest.mark.parametrize("seed", [1])
def test_batches_equal_grouping_all_at_once(spark, seed):
    rng, scratch = random.Random(seed), Scratch(spark, "t")
    rows = {r[0]: r for r in editions(rng, 60)}
    state, held = dict.fromkeys(lineage_state.TABLES), {}
    for step in range(3):
        batch = {i: rows[i] for i in rng.sample(sorted(rows), 25)}
        if step:  # some come under another document's title and text, some go
            batch |= {i: (i, *rows[(i + 1) % 60][1:]) for i in rng.sample(sorted(held), 4)}
        gone = set(rng.sample(sorted(held), 3)) if step == 2 else set()
        batch = {i: r for i, r in batch.items() if i not in gone}
        touched = spark.createDataFrame([(i,) for i in {*batch, *gone}], "doc_id long")
        new = lineage_state.apply(state, catalogue(spark, list(batch.values())), touched, scratch)
        state |= {name: scratch.save(df, name) for name, df in new.items()}
        held = {i: r for i, r in (held | batch).items() if i not in gone}
        whole = lineage.groups(catalogue(spark, list(held.values())), scratch)
        assert groups_of(state["groups"]) == groups_of(whole)
    assert state["groups"].count() > 10


def test_untouched_clusters_are_left_alone(spark):
    scratch = Scratch(spark, "t")
    rows = editions(random.Random(4), 40)
    state = dict.fromkeys(lineage_state.TABLES) | lineage_state.apply(dict.fromkeys(lineage_state.TABLES), catalogue(spark, rows), spark.createDataFrame([(r[0],) for r in rows], "doc_id long"), scratch)
    new = [(100, "wholly other words here", "c9", "1995-01-01", "nothing alike")]
    after = lineage_state.apply(state, catalogue(spark, new), spark.createDataFrame([(100,)], "doc_id long"), scratch)
    assert groups_of(after["groups"]) == groups_of(state["groups"]) and "order" not in after


def test_ingest_replaces_documents_and_survives_a_crash(spark, tmp_path):
    store, scratch = Store(spark, str(tmp_path)), Scratch(spark, "t")
    long = " ".join(f"w{i}" for i in range(1_700))
    first = documents(spark, [(1, "A", "c", "1990-01-01", long), (2, "B", "c", "1990-01-01", "few words"), (3, "C", "c", "1990-01-01", None)])
    assert ingest_run.ingest(store, first, 0, scratch)
    ids = lambda: sorted(r.chunk_id for r in store.table("chunks").collect())
    assert ids() == ["1-0000", "1-0001", "1-0002", "2-0000"]
    second = documents(spark, [(1, "A", "c", "1990-01-01", "short now"), (2, None, None, None, None), (4, "D", "c", "1991-01-01", "zebra words")])
    second = second.withColumn("removed", F.col("doc_id") == 2)

    class Dies(Exception):
        pass

    def broken(df, key, terms):
        raise Dies

    with pytest.raises(Dies):
        ingest_run.ingest(store, second, 1, scratch, ingest_run.Steps(embedder=broken))
    assert ids() == ["1-0000", "1-0001", "1-0002", "2-0000"]
    assert ingest_run.ingest(store, second, 1, scratch) and not ingest_run.ingest(store, second, 1, scratch)
    assert ids() == ["1-0000", "4-0000"]
    assert sorted(r.doc_id for r in store.table("documents").collect()) == [1, 3, 4]
    assert {r.doc_id: r.chunk_count for r in store.table("vectors").collect()} == {1: 1, 4: 1}
    found, _ = lexical_index.search(ingest_run.index_of(store), spark.createDataFrame([(1, "zebra")], "query_id long, text string"), 3, scratch)
    assert [r.id for r in found.collect()] == ["4-0000"]


def test_streams_apply_each_batch_once(spark, tmp_path):
    store, scratch = Store(spark, str(tmp_path / "store")), Scratch(spark, "t")
    source = str(tmp_path / "in")
    for start in (0, 5):
        documents(spark, [(i, f"T{i}", "c", "1990-01-01", f"text of {i}") for i in range(start, start + 5)]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(documents(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second run has lost its checkpoint and sends the same batches again
        writer = ingest_run.ingest_stream(store, stream, scratch, ingest_run.Steps(index=False)).trigger(availableNow=True)
        writer.option("checkpointLocation", Scratch(spark, "c").path).start().awaitTermination()
        assert store.table("chunks").count() == 10 and store.current().number == 2


def test_a_run_leaves_nothing_in_its_scratch(spark, tmp_path):
    store, scratch = Store(spark, str(tmp_path)), Scratch(spark, "t")
    scratch.save(spark.range(1), "own")
    assert ingest_run.ingest(store, documents(spark, [(1, "A", "c", "1990-01-01", "few words")]), 0, scratch)
    at = spark._jvm.org.apache.hadoop.fs.Path(scratch.path)
    assert [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)] == ["001-own"]
    assert [r.chunk_id for r in store.table("chunks").collect()] == ["1-0000"]
