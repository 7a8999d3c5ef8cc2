"""Hand-computed cases of the retrieval and recommendation operators."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import vectors as vx
from lectern.interfaces import choose
from lectern.operators import chunking, dense, fusion, guards, lexical, lineage, lookup, metrics, recommend, sessions, tables
from lectern.plans.scratch import Scratch
from lectern.sources import extraction, files
from lectern.streaming import sessions as streams


def angle(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_vectors(spark):
    arr = lambda v: F.lit(v) if v is None else F.array(*[F.lit(x) for x in v]).cast("array<double>")
    cos = lambda a, b: one(spark, vx.cosine(arr(a), arr(b)))
    assert cos(angle(0), angle(60)) == pytest.approx(0.5)
    assert cos([0.0, 0.0], [1.0, 0.0]) == cos([1.0], [1.0, 0.0]) == cos([], []) == 0.0
    df = spark.createDataFrame([("a", [3.0, 0.0]), ("a", [0.0, 3.0])], "k string, v array<double>")
    got = [r.value for r in vx.centroid(df, "k", "v").orderBy("pos").collect()]
    assert got == pytest.approx([math.sqrt(0.5)] * 2)


def test_rrf(spark):
    rows = [(1, 0, 1, "A"), (1, 0, 2, "B"), (1, 0, 3, "C"), (1, 1, 1, "A"), (1, 1, 2, "C"), (1, 1, 3, "D")]
    df = spark.createDataFrame(rows, "query_id int, list_no int, rank int, id string")
    got = [(r.id, r.score) for r in fusion.rrf(df).orderBy("rank").collect()]
    assert [i for i, _ in got] == ["A", "C", "B", "D"]
    assert [s for _, s in got] == pytest.approx([2 / 61, 1 / 63 + 1 / 62, 1 / 62, 1 / 63], abs=1e-9)
    with pytest.raises(ValueError):
        fusion.rrf(df, -1)


def test_cap_backfills(spark):
    ranked = spark.createDataFrame([(1, i + 1, i, d) for i, d in enumerate("XXXXXY")], "query_id int, rank int, id int, doc string")
    got = [r.doc for r in fusion.diversity_cap(ranked, 6, 4).orderBy("place").collect()]
    assert got == list("XXXXYX")
    with pytest.raises(ValueError):
        fusion.diversity_cap(ranked, 6, 0)


def test_rerank_missing_grades_are_zero(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12)], "query_id int, rank int, id int")
    grades = spark.createDataFrame([(1, 12, 99.0), (1, 11, 3.0)], "query_id int, id int, grade double")
    assert [(r.id, r.grade) for r in fusion.rerank(ranked, grades, 3).orderBy("place").collect()] == [(12, 10.0), (11, 3.0), (10, 0.0)]


def test_grade_reads_the_whole_text(spark):
    text = "filler " * 2_000 + "needle haystack"
    df = spark.createDataFrame([("needle haystack", text)], "question string, passage string")
    assert df.select(fusion.term_coverage("question", "passage").alias("grade")).first().grade == 10.0


def test_dense_blocks_and_scope(spark):
    rows = spark.createDataFrame([(i, angle(7 * i), str(i % 2)) for i in range(30)] + [(99, None, "0")], "id long, vector array<double>, scope string")
    asked = spark.createDataFrame([(1, angle(0), None), (2, angle(0), "1")], "query_id long, vector array<double>, scope string")
    for block in (4096, 4):
        got = dense.dense_topk(asked, rows, 3, block).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.id) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 1), (2, 3), (2, 5)]
    assert dense.dense_topk(asked, rows, 0).count() == 0


def cell(asked, held, scopes=None):
    """A pair of blocks as the product gets it."""
    q = pd.DataFrame({"key": range(len(asked)), "vector": list(asked), "kind": "query"})
    r = pd.DataFrame({"key": range(len(held)), "vector": list(held), "kind": "row"})[::-1]
    return pd.concat([q.assign(scope=None), r.assign(scope=scopes)], ignore_index=True).assign(bonus=0.0, of=np.nan)


def test_dense_pair_of_blocks_takes_its_vectors_and_one_strip():
    rng = np.random.default_rng(1)
    few, many = rng.normal(size=(64, 4)), rng.normal(size=(8_192, 4))
    pdf = cell(many, few)
    tracemalloc.start()
    got = dense._best_of_blocks(pdf, 1, 1.0, 128)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 8_192 and peak < 8e6


def test_dense_strip_breaks_ties_by_id_and_skips_undefined_scores():
    held = np.array([angle(a) for a in (40, 10, 10, 10, 0, 10)])
    held[4] = np.nan
    for strip in (1, 2, 5):
        got = dense._best_of_blocks(cell(np.array([angle(10)] * 3 + [[0.0, 0.0], [np.nan, 0.0]]), held), 3, 1.0, strip)
        assert got.groupby("query_id")["id"].agg(list).to_dict() == {0: [1, 2, 3], 1: [1, 2, 3], 2: [1, 2, 3], 3: [0, 1, 2]}


def test_bm25(spark):
    rows = spark.createDataFrame([(1, "red fish"), (2, "Blue fish, blue sky"), (3, "the of")], "id int, text string")
    asked = spark.createDataFrame([(1, "blue (fish) +NOT"), (2, "the")], "query_id int, text string")
    got = lexical.top(lexical.bm25(asked, rows), 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 2), (1, 1)]
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    tf = lambda n, dl: n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl / 2))
    assert got[0].score == pytest.approx(idf(1) * tf(2, 4) + idf(2) * tf(1, 4), abs=1e-6)


def test_lookup(spark):
    pages = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 3, 3), (1, "c", 9, 9)], "doc int, chunk_id string, page int, end_page int")
    ids = lambda *a: [r.chunk_id for r in lookup.read_pages(pages, *a).orderBy("chunk_id").collect()]
    assert ids(2) == ["a"] and ids(-3, 99) == ["a", "b"] and ids(2, 3) == ["a", "b"]
    docs = spark.createDataFrame([("A1", "Principles draft"), ("A2", "Principles final"), ("B", "Other")], "doc_id string, title string")
    asked = spark.createDataFrame([(" a1 ",), ("other",), ("principles",), ("fin",), ("zzz",), ("",)], "request string")
    got = {r.request: (r.status, r.doc_id) for r in lookup.resolve(asked, docs).collect()}
    assert got == {" a1 ": ("match", "A1"), "other": ("match", "B"), "principles": ("ambiguous", None), "fin": ("match", "A2"), "zzz": ("none", None), "": ("none", None)}


def test_windows(spark):
    docs = spark.createDataFrame([("D", " ".join(f"w{i}" for i in range(1, 27))), ("E", ""), ("N", None)], "id string, text string")
    got = chunking.fixed_windows(docs, "id", "text", 10, 2).orderBy("seq").collect()
    assert [(r.chunk_id, r.start, r.n_tokens) for r in got] == [("D-0000", 0, 10), ("D-0001", 8, 10), ("D-0002", 16, 10)]
    costs = spark.createDataFrame([("D", [3, 3, 9, 1, 1, 1])], "id string, c array<int>")
    got = chunking.variable_windows(costs, "id", "c", "c", 5, 2).orderBy("seq").collect()
    assert [(r.start, r.stop) for r in got] == [(0, 1), (1, 2), (2, 3), (3, 6)]


def test_sections(spark):
    rows = [(1, 0, 1, "Body", "pre"), (1, 1, 1, "SectionHeading", "gone"), (1, 2, 2, "Title", "H"), (1, 3, 3, "Body", "a b c"), (1, 4, 4, "Footnote", "d")]
    df = spark.createDataFrame(rows, "doc int, seq int, page int, kind string, text string")
    got = chunking.section_chunks(df, "doc", 10, 4, 0).orderBy("seq").collect()
    assert [(r.text, r.page, r.end_page) for r in got] == [("pre", 1, 1), ("H\na b c\nd", 2, 4)]
    got = chunking.section_chunks(df, "doc", 3, 2, 0).orderBy("seq").collect()
    assert [r.text for r in got] == ["pre", "H\na b", "H\nc d"]


def lineage_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, cluster string, published_on string, embedding array<double>")


def test_lineage(spark):
    rows = [
        (1, "Principles for resilience (draft) v1", "c", "2020-01-01", angle(0)), (2, "Principles for resilience, final 2021", "c", "2021-03-01", angle(5)),
        (3, "Principles for resilience", "c", "2021-03-01", angle(40)), (4, "Quite other title", "c", "2021-03-01", angle(2)),
        (5, "Principles for resilience", "d", "2021-03-01", angle(1)), (6, "Principles for resilience", "c", "2010-01-01", angle(1)),
    ]
    got = {r.doc_id: r.lineage_group for r in lineage.groups(lineage_docs(spark, rows), Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1}
    ranked = spark.createDataFrame([(1, 1, 1, 1, "2020-01-01"), (1, 2, 9, None, "2019-01-01"), (1, 3, 2, 1, "2021-01-01")], "query_id int, rank int, doc_id long, lineage_group long, published_on string")
    assert [(r.doc_id, r.suppressed) for r in lineage.survivors(ranked).orderBy("rank").collect()] == [(2, "1"), (9, "")]


def test_title_tokens(spark):
    title = F.lit("Final Report, 2021 — v1 (d516) Café May rev3x")
    assert one(spark, tx.title_tokens(title)) == ["report", "café", "rev3x"]


def test_scores(spark):
    assert one(spark, recommend.recency(F.lit("2000-01-01"), F.lit("2000-01-01"))) == 1.0
    old = one(spark, recommend.recency(F.lit("1997-04-06"), F.lit("2000-01-01")))
    assert old == pytest.approx(0.3 + 0.7 * math.exp(-1))
    cand = spark.createDataFrame([(1, d, s, "2000-01-01", 4) for d, s in ((1, 0.5), (2, 0.5), (3, 0.1))], "query_id long, doc_id long, doc_sim double, published_on string, chunk_count int")
    hits = spark.createDataFrame([(1, r, 3) for r in range(1, 8)], "query_id long, rank int, doc_id long")
    got = recommend.score(cand, hits, F.lit("2000-01-01")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [3, 1, 2] and got[0].chunk_hits == 5 and got[0].best_rank == 1


def test_mmr_and_ceiling(spark):
    rows = [(1, d, math.cos(math.radians(a)), angle(a)) for d, a in ((1, 10), (2, 11), (3, 60))]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, seed_sim double, embedding array<double>")
    order = lambda lam, k=5: [r.doc_id for r in recommend.mmr(df, k, lam).orderBy("pick").collect()]
    assert order(1.0) == [1, 2, 3] and order(0.3) == [1, 3, 2] and order(0.7, 1) == [1]
    with pytest.raises(ValueError):
        recommend.mmr(df, 5, 1.1)
    ranked = df.withColumn("rank", F.col("doc_id").cast("int"))
    assert [r.doc_id for r in recommend.greedy_ceiling(ranked).orderBy("rank").collect()] == [1, 3]


def test_resolver_drops_seed_group_and_near_ungrouped(spark):
    # 1: seed; 2: its edition; 3, 4: editions near each other; 5: near the seed; 6: near 4; 7: apart
    rows = [(d, d, g, f"1998-0{d}-01", angle(a)) for d, g, a in ((1, 1, 0), (2, 1, 40), (3, 3, 90), (4, 3, 91), (5, None, 1), (6, None, 92), (7, None, 150))]
    rows = [(q, *r) for q in (1, 2) for r in rows]
    ranked = spark.createDataFrame(rows, "query_id long, rank int, doc_id long, lineage_group long, published_on string, embedding array<double>")
    seeds = ranked.where("doc_id = 1 AND query_id = 1").select("query_id", "doc_id", "lineage_group", "embedding")
    got = recommend.resolve(ranked.withColumn("published_on", F.col("published_on").cast("timestamp")), seeds).orderBy("query_id", "rank").collect()
    assert [(r.rank, r.doc_id, r.suppressed) for r in got if r.query_id == 1] == [(1, 4, "3"), (2, 7, "")]
    assert [(r.doc_id, r.suppressed) for r in got if r.query_id == 2] == [(2, "1"), (4, "3"), (5, ""), (7, "")]


def test_profile_and_recent(spark):
    turns = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 2, [0.0, 1.0]), ("t", 1, [1.0, 1.0])], "session_id string, turn int, embedding array<double>")
    got = {(r.session_id, r.pos): r.value for r in sessions.profile(turns).collect()}
    assert got[("s", 0)] == pytest.approx(0.8) and got[("s", 1)] == pytest.approx(0.2) and got[("t", 1)] == pytest.approx(1.0)
    many = spark.createDataFrame([("s", i) for i in range(8)], "session_id string, turn int")
    assert [r.turn for r in sessions.recent_queries(many).orderBy("recency").collect()] == [7, 6, 5, 4, 3]
    with pytest.raises(ValueError):
        sessions.profile(turns, 1.5)


def test_cost(spark):
    calls = spark.createDataFrame([(1, 1, "f", 10, 1000, 500), (2, 1, "g", 5, None, None)], "turn_id int, seq int, function string, duration_ms long, tokens_in long, tokens_out long")
    got = {r.turn_id: (r.cost, r.tokens_in) for r in sessions.turn_metrics(calls, 0.15, 0.60).collect()}
    assert float(got[1][0]) == pytest.approx(0.00045) and got[2] == (None, 0)
    assert sessions.turn_metrics(calls, 0, 0).where("cost IS NOT NULL").count() == 0


def test_redaction(spark):
    cases = {"a@b.co and 4111 1111 1111 1111": "[email redacted] and [number redacted]", "123-45-6789": "[id redacted]", "+44 20 7946 0958 x": "[number redacted] x", "SP 800-207 d516": "SP 800-207 d516"}
    for text, want in cases.items():
        assert one(spark, tx.redact(F.lit(text))) == want


def test_citation_guard(spark):
    passages = spark.createDataFrame([(1, "A", "Principles for Things (draft)", 2, 3), (1, "B", "Principles for Things (final)", 5, 0)], "answer_id int, doc_id string, title string, page int, end_page int")
    text = "x [PRINCIPLES for things (draft), p.3] [Principles for Things, p.5] [Principles for Things (draft), p.4] [Short, p.2] [note] "
    out = guards.guard(spark.createDataFrame([(1, text), (2, "plain")], "answer_id int, answer string"), passages).orderBy("answer_id").collect()
    assert out[0].removed == 2 and "[Short, p.2]]" in out[0].guarded and "(draft), p.3]" in out[0].guarded
    assert out[1].guarded == "plain"


def test_markdown_and_formulas(spark):
    shape = spark.createDataFrame([(1, 2, 2), (2, 1, 1), (3, 0, 2)], "table_id int, n_rows int, n_cols int")
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, 9, "h|x"), (1, 1, 1, 0, 1, 1, "a\r\nb"), (1, 2, 1, 0, 1, 1, "last"), (2, 0, 0, 0, 1, 1, " ")], "table_id int, seq int, row int, col int, row_span int, col_span int, content string")
    got = {r.table_id: r.markdown for r in tables.markdown(shape, cells).collect()}
    assert got == {1: "| h\\|x | h\\|x |\n| --- | --- |\n| last |  |", 2: None, 3: None}
    slots = F.array(F.struct(F.lit(False).alias("display"), F.lit(" ").alias("value")), F.struct(F.lit(True).alias("display"), F.lit("y").alias("value")))
    assert one(spark, tx.restore_formulas(F.lit("a :formula: b :formula: c :formula:"), slots)) == "a :formula: b \\[ y \\] c :formula:"


def test_metrics(spark):
    lists = spark.createDataFrame([(1, r, d) for r, d in enumerate("abcd", 1)], "case_id int, rank int, doc string")
    gold = spark.createDataFrame([(1, "a"), (1, "c")], "case_id int, doc string")
    cases = spark.createDataFrame([(1,), (2,)], "case_id int")
    got = {(r.metric, r.case_id): r.value for r in metrics.ranking_metrics(lists, gold, cases, 5).collect()}
    assert got[("ndcg@5", 1)] == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3)), abs=1e-6)
    assert got[("mrr", 1)] == 1.0 and got[("precision@5", 1)] == 0.5 and got[("recall@5", 2)] is None
    runs = spark.createDataFrame([("x", "coverage", 1, 0.1), ("x", "coverage", 2, 0.3), ("x", "mrr", 1, None), ("x", "mrr", 2, 0.5)], "config string, metric string, case_id int, value double")
    means = metrics.aggregate_runs(runs)
    assert {r.metric: r.value for r in means.collect()} == {"coverage": 0.3, "mrr": 0.5}
    table = {r.metric: (r.x, r.y) for r in metrics.ablation_table(means, ["x", "y"]).collect()}
    assert table == {"coverage": ("0.300", "—"), "mrr": ("0.500", "—")}
    rows = files.result_rows(runs, means, "qa", "t").collect()
    assert {(r.case_id, r.value) for r in rows} == {("1", "0.1"), ("2", "0.3"), ("2", "0.5"), ("MEAN", "0.3"), ("MEAN", "0.5")}
    answers = spark.createDataFrame([(1, " INSUFFICIENT_CONTEXT ", False), (2, "no", False), (3, "x", True)], "case_id int, answer string, is_answerable boolean")
    assert [r.value for r in metrics.abstention(answers).orderBy("case_id").collect()] == [1.0, 0.0, None]


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"documents": [{"id": "A1", "title": "T", "url": "u", "cluster": "c", "expectedPages": 3, "publishedOn": "2020-01-02"}]}')
    manifest = files.read_manifest(spark, str(tmp_path / "m.json"))
    names = spark.createDataFrame([("A1-scanned.pdf",)], "name string")
    got = {(r.doc_id, r.missing) for r in files.enumerate_documents(manifest, names).collect()}
    assert got == {("A1", True), ("A1-SCAN", False)}
    (tmp_path / "bad.json").write_text('{"cases": [{"question": "q", "isAnswerable": true}]}')
    with pytest.raises(Exception, match="gold document"):
        files.read_qa_cases(spark, str(tmp_path / "bad.json")).collect()
    log = spark.createDataFrame([(1, "a"), (2, "b")], "seq int, function string")
    files.append_log(log, str(tmp_path / "log"))
    assert [r.function for r in files.read_log(spark, str(tmp_path / "log"), "seq int, function string", after=1).collect()] == ["b"]
    rows = spark.createDataFrame([(1, 0, "pageHeader", [1], "x"), (1, 1, "title", [2], "T"), (1, 2, None, None, "b"), (1, 3, None, [3], " ")], "doc_id int, seq int, role string, pages array<int>, text string")
    assert [(r.kind, r.page) for r in extraction.paragraphs(rows).orderBy("seq").collect()] == [("Title", 2), ("Body", 1)]
    with pytest.raises(ValueError, match="unknown"):
        choose("chunker", "x", {"fixed": 1})


def test_streaming_sessions(spark, tmp_path):
    state = None
    for turn, v in ((1, [1.0, 0.0]), (2, [0.0, 1.0])):
        state = streams.update(state, [(turn, v, [turn, 7])])
    assert state[0] == pytest.approx([0.8, 0.2]) and state[2] == [1, 7, 2] and state[3] == 2
    with pytest.raises(ValueError):
        streams.update(state, [(3, [1.0], [])])
    schema = "session_id bigint, turn int, embedding array<double>, shown array<bigint>"
    spark.createDataFrame([(1, 2, [0.0, 1.0], [5]), (1, 1, [1.0, 0.0], None), (2, 1, [1.0, 1.0], [])], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    streams.run_to_end(streams.session_state(stream), "snapshots", "update", str(tmp_path / "ck"))
    got = {r.session_id: r for r in spark.table("snapshots").collect()}
    assert list(got[1].profile) == pytest.approx([0.8, 0.2]) and got[1].n_recent == 2 and got[1].n_surfaced == 1 and got[2].turns == 1


def test_streaming_windows_equal_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    streams.run_to_end(streams.event_counts(stream), "counts", "complete", str(tmp_path / "ck2"))
    want = {(r.start, r.event_type): r.n for r in streams.event_counts(events).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("counts").collect()} == want
    assert streams.event_sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_cosines_of_counts_are_exact_and_round_as_databases_do(spark):
    """A product over the product of lengths; unit vectors give some of these a last bit less or more."""
    counts = np.random.default_rng(3).integers(0, 9, (200, 64)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(counts)], "id long, vector array<double>")
    length = np.sqrt((counts * counts).sum(axis=1))
    want = {(a, b): (counts[a] @ counts[b]) / (length[a] * length[b]) for a in range(20) for b in range(200)}
    found = dense.all_similarities(rows.where("id < 20").withColumnRenamed("id", "query_id"), rows)
    assert {(r.query_id, r.id): r.sim for r in found.collect()} == want
    halves = spark.createDataFrame([(0.0078125,), (-0.0078125,), (0.53906249999999994,), (0.0,)], "x double").select(recommend.rounded(F.col("x")))
    assert [r[0] for r in halves.collect()] == [0.007813, -0.007813, 0.539062, 0.0]


def test_editions_of_large_works_are_joined_in_blocks(spark):
    """Two works of 60 editions and lone ones, dates spread, against all pairs; as many edges as documents at most a token."""
    rng, rows = np.random.default_rng(5), []
    for i in range(160):
        work = i % 2 if i < 120 else i
        words = [f"w{work}n{n}" for n in range(6)] + ([f"x{i}"] if i % 3 == 0 else [])
        vector = [float(work), 3.0, 1.0 + 2 * (i % 5 == 0), float(rng.integers(0, 2))] if i % 17 else [1.0, 0.0]
        rows.append((i, " ".join(words), None if i % 29 == 7 else "c", None if i % 31 == 3 else f"19{rng.integers(80, 99)}-0{1 + i % 9}-01", vector))
    docs = spark.createDataFrame(rows, "doc_id long, title string, cluster string, published_on string, embedding array<double>")
    scratch = Scratch(spark, "t")
    titled = scratch.save(lineage.titles(docs), "titles")
    held = {r.doc_id: r for r in titled.collect()}

    def linked(x, y):
        if x.cluster is None or x.cluster != y.cluster or x.at is None or y.at is None or abs(x.at - y.at) > lineage.GAP_DAYS * lineage.MICROS_A_DAY or len(x.embedding) != len(y.embedding):
            return False
        common, (v, w) = len({*x.tokens} & {*y.tokens}), (np.array(x.embedding), np.array(y.embedding))
        return common / len({*x.tokens, *y.tokens}) >= lineage.MIN_JACCARD and (v @ w) / math.sqrt(v @ v) / math.sqrt(w @ w) > lineage.MIN_COSINE

    root = {i: i for i in held}
    for a in held:
        for b in held:
            if a < b and linked(held[a], held[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    alone = {r for r in root.values() if sum(x == r for x in root.values()) == 1}
    want = {i: r for i, r in root.items() if r not in alone}
    prefix = lineage.prefixes(titled, lineage.token_order(titled)).withColumn("fresh", F.lit(True))
    for block in (7, 4_096):
        edges = scratch.save(lineage.joined(prefix, titled, scratch, block=block), "edges")
        found = lineage.connected_components(edges, scratch)
        assert {r.id: r.component for r in found.collect()} == want and len(want) > 60
    assert edges.count() <= prefix.count()
    # with one fresh half, the links of that half only
    half = scratch.save(lineage.joined(prefix.withColumn("fresh", F.col("doc_id") < 60), titled, scratch, block=7), "half")
    root = {i: i for i in held}
    for a in range(60):
        for b in held:
            if a != b and linked(held[a], held[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    assert {r.id: r.component for r in lineage.connected_components(half, scratch).collect()} == {i: r for i, r in root.items() if sum(x == r for x in root.values()) > 1}
