"""The stored lexical index against BM25 over all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import lexical, lexical_index
from lectern.plans.scratch import Scratch


def corpus(spark, n=400):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, f"d{i % 5}" if i % 11 else None, " ".join(rng.choices(words, [1 / (k + 1) ** 1.3 for k in range(60)], k=rng.randint(1, 30)))) for i in range(n)]
    rows += [(n, "d1", None), (n + 1, "d1", "the of"), (n + 2, "d2", rows[7][2])]
    return Scratch(spark, "t").save(spark.createDataFrame(rows, "id long, doc string, text string"), "rows")


def asked(spark, scoped):
    rng = random.Random(5)
    rows = [(q, " ".join(rng.choices([f"w{i}" for i in range(60)], k=rng.randint(1, 8))), f"d{q % 6}" if q % 3 else None) for q in range(30)]
    rows += [(90, "the", None), (91, None, None), (92, "unknownword", "d1"), (93, 'w1 AND "w59" -w3 (w58', None)]
    df = spark.createDataFrame(rows, "query_id long, text string, scope string")
    return df if scoped else df.drop("scope")


@pytest.mark.parametrize("scoped,bucket,first", [(False, 16, 24), (True, 4, 1), (False, 2, 3)])
def test_search_equals_scoring_all_rows(spark, scoped, bucket, first):
    rows, queries = corpus(spark), asked(spark, scoped)
    scratch = Scratch(spark, "t")
    lexical_index.build(rows, bucket).write(f"{scratch.path}/index")
    got, _ = lexical_index.search(lexical_index.LexicalIndex.read(spark, f"{scratch.path}/index"), queries, 7, scratch, first)
    want = lexical.top(lexical.bm25(queries, rows), 7)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 100


def test_bounds_keep_postings_closed(spark):
    scratch = Scratch(spark, "t")
    common = [(i, "d", "aa bb cc " + ("rare " * 9 if i % 100 == 0 else "") + f"x{i}") for i in range(2_000)]
    lexical_index.build(spark.createDataFrame(common, "id long, doc string, text string"), 4).write(f"{scratch.path}/index")
    index = lexical_index.LexicalIndex.read(spark, f"{scratch.path}/index")
    found, work = lexical_index.search(index, spark.createDataFrame([(1, "rare aa bb")], "query_id long, text string"), 10, scratch)
    assert [r.id for r in found.orderBy("rank").collect()] == [i * 100 for i in range(10)]
    work = work.first()
    assert work.matched == 4_020 and work.opened < 0.1 * work.matched


def test_scopes_are_met_below_the_scores(spark):
    rows, queries = corpus(spark), asked(spark, True)
    kept = {(r.query_id, r.id): r.score for r in lexical.bm25(queries.drop("scope"), rows).collect()}
    scopes, docs = {r.query_id: r.scope for r in queries.collect()}, {r.id: r.doc for r in rows.collect()}
    want = {k: s for k, s in kept.items() if scopes[k[0]] is None or scopes[k[0]] == docs[k[1]]}
    assert {(r.query_id, r.id): r.score for r in lexical.bm25(queries, rows).collect()} == want
    plan = lexical.bm25(queries.where(F.col("scope").isNotNull()), rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [query_id") < plan.index("scope")


def test_search_moves_k_rows_a_query_and_cell(spark):
    """Every query meets every row, yet what is written on the way stays below one row a pair of query and row."""
    scratch = Scratch(spark, "t")
    rows = spark.createDataFrame([(i, f"d{i % 3}", f"aa bb cc x{i}") for i in range(1_500)], "id long, doc string, text string")
    queries = spark.createDataFrame([(q, "aa bb cc") for q in range(20)], "query_id long, text string")
    lexical_index.build(rows, 4).write(f"{scratch.path}/index")
    search = Scratch(spark, "t")
    found, work = lexical_index.search(lexical_index.LexicalIndex.read(spark, f"{scratch.path}/index"), queries, 5, search, 2)
    assert found.count() == 100 and {r.matched for r in work.collect()} == {4_500}
    written = sum(spark.read.parquet(f.getPath().toString()).count() for f in _tables(spark, search.path))
    assert written < 500


def _tables(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)


def test_ranked_is_the_top_of_bm25_in_any_cells(spark, monkeypatch):
    rows = corpus(spark)
    for scoped, cell, queries, sent in ((False, 50, 7, 200_000), (True, 100_000, 256, 0), (True, 300, 3, 200_000)):
        for name, value in (("CELL", cell), ("QUERIES", queries), ("BROADCAST_TERMS", sent)):
            monkeypatch.setattr(lexical, name, value)
        want = lexical.top(lexical.bm25(asked(spark, scoped), rows), 7).collect()
        assert sorted(lexical.ranked(asked(spark, scoped), rows, 7).collect()) == sorted(want) and len(want) > 100


def test_counted_is_postings_and_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "COUNTED", 40)
    rows = corpus(spark)
    got = sorted((r.id, r.term, r.dl, r.tf) for r in lexical.counted(rows, ["id"], "text").collect())
    want = [(r.id, r.term, r.dl, r.tf) for r in lexical.postings(rows, "id", "text").collect()]
    sizes = [(r.id, "", len(r.terms), 1) for r in rows.select("id", lexical.search_terms(F.col("text")).alias("terms")).collect()]
    assert got == sorted(want + sizes)
    some = lexical.counted(rows, ["id"], "text", ["w1", "w7"]).where("term <> ''").collect()
    assert sorted((r.id, r.term, r.dl, r.tf) for r in some) == sorted(x for x in want if x[1] in ("w1", "w7"))


def test_an_index_written_in_parts_is_that_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical_index, "PART", 20)
    rows = spark.createDataFrame([(i, f"d{i % 11}" if i % 9 else None, None if i == 3 else f"w{i % 5} w{i % 7} x{i}") for i in range(110)], "id long, doc string, text string")
    whole, parts = (f"{Scratch(spark, 't').path}/index" for _ in range(2))
    lexical_index.build(rows).write(whole)
    lexical_index.write(rows, parts)
    a, b = (lexical_index.LexicalIndex.read(spark, p) for p in (whole, parts))
    for x, y in ((a.blocks, b.blocks), (a.terms, b.terms), (a.stats, b.stats)):
        assert sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
