"""Tool functions, ingestion steps, replies and answer metrics on small cases."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import replies
from lectern.functions import text as tx
from lectern.operators import guards, ingestion, lookup, metrics, tools
from lectern.plans.scratch import Scratch
from lectern.sources import prompts
from lectern.streaming import sessions as streams


def angle(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def catalogue(spark, rows):
    """Rows (doc_id, degrees, lineage_group, published)."""
    full = [(d, f"T{d}", ["x"], p, 1, g, angle(a)) for d, a, g, p in rows]
    schema = "doc_id long, title string, topics array<string>, published_on string, chunk_count int, lineage_group long, embedding array<double>"
    return spark.createDataFrame(full, schema).withColumn("published_on", F.col("published_on").cast("timestamp"))


def as_of():
    return F.lit("2000-01-01").cast("timestamp")


QUERY = "query_id long, vector array<double>, seed_id long, seed_group long, seed_vector array<double>, context_topics array<string>, recent_queries int"


def test_more_like_this_leaves_out_the_seed_and_its_editions(spark):
    docs = catalogue(spark, [(1, 0, 1, "1990-01-01"), (2, 2, 1, "1999-01-01"), (3, 20, None, "1995-01-01"), (4, 60, 4, "1994-05-01"), (5, 62, 4, "1996-05-01")])
    asked = spark.createDataFrame([(1, angle(0), 1, 1, angle(0), ["X"], 0)], QUERY)
    ranked = tools.ranked_catalogue(asked, docs, as_of())
    picks = {r.pick: r for r in tools.select_and_explain(ranked, asked, docs).collect()}
    assert [picks[i].doc_id for i in sorted(picks)] == [3, 5]
    assert picks[2].reason == "Strong topical overlap on x. Supersedes 4, May 1994."
    text = tools.format_recommendations(asked, tools.select_and_explain(ranked, asked, docs)).first().answer
    assert text.startswith("1. T3 [3] — score ") and "\n   topics: x\n   signals: docSim=0.940*0.5 chunkAgg=0.000*0.3 " in text
    assert tools.format_recommendations(asked, tools.select_and_explain(ranked.limit(0), asked, docs)).first().answer == tools.NO_RECOMMENDATIONS


def test_small_pool_gives_the_same_ranks(spark):
    docs = catalogue(spark, [(i, 7 * i % 90, None, f"19{70 + i % 29}-01-01") for i in range(40)])
    asked = spark.createDataFrame([(1, angle(30)), (2, angle(80))], "query_id long, vector array<double>")
    hits = spark.createDataFrame([(1, 1, 39), (1, 2, 5), (2, 1, 39)], "query_id long, rank int, doc_id long")
    whole = tools.ranked_catalogue(asked, docs, as_of(), hits, 100).where("rank <= 6").collect()
    assert sorted(whole) == sorted(tools.ranked_catalogue(asked, docs, as_of(), hits, 6).collect())


def test_sessions_without_history_or_unseen_documents(spark):
    docs = catalogue(spark, [(1, 0, None, "1990-01-01"), (2, 50, None, "1990-01-01"), (3, 90, None, "1990-01-01")])
    recent = spark.createDataFrame([(7, 1, angle(90)), (7, 2, angle(0))], "query_id long, recency int, vector array<double>")
    profiles = spark.createDataFrame([(7, angle(45)), (8, angle(80))], "query_id long, vector array<double>")
    shown = spark.createDataFrame([(7, 3)], "query_id long, doc_id long")
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in tools.ranked_for_sessions(recent, profiles, docs, shown, 2).collect()}
    assert got[7, 1] == (1, 1.0) and got[7, 2][0] == 2 and (7, 3) not in got
    assert [got[8, i][0] for i in (1, 2)] == [3, 2]  # only its profile speaks for session 8


def test_prompt_files(spark):
    text = "name: n\ninput_variables:\n  - name: a\n  - name: b\nsettings:\n  x: 1\ntemplate: |\n  Say {{$a}}:\n\n    {{$b}}\n"
    p = prompts.parse_prompt(text)
    assert (p.name, p.inputs, p.template) == ("n", ("a", "b"), "Say {{$a}}:\n\n  {{$b}}")
    assert one(spark, prompts.render(p.template, {"a": F.lit("{{$b}}"), "b": F.lit(None).cast("string")})) == "Say {{$b}}:\n\n  "
    for bad in (text.replace("name: n\n", ""), text.replace("- name: b", "- name: c"), text.split("template")[0]):
        with pytest.raises(ValueError):
            prompts.parse_prompt(bad)
    assert prompts.shipped("answer").inputs == ("question", "context")


@pytest.mark.parametrize(
    "reply,want",
    [('{"supported": 3, "total": 4}', 0.75), ('```json\n{"supported": 9, "total": 4}\n```', 1.0), ('{"supported": 0, "total": 0}', None), ("no", None), (None, None)],
)
def test_claim_replies(spark, reply, want):
    assert one(spark, replies.claim_share(F.lit(reply).cast("string"))) == want


def test_other_replies(spark):
    assert one(spark, replies.judged_score(F.lit('``` \n{"score": 1.5}\n``` '))) == 1.0
    assert one(spark, replies.judged_score(F.lit("{}"))) is None
    got = one(spark, replies.grades(F.lit('{"scores": [{"index": 2, "score": 11}, {"index": 1, "score": -1}]}')))
    assert [tuple(g) for g in got] == [(2, 10.0), (1, 0.0)]
    assert one(spark, replies.grades(F.lit('{"scores": []}'))) is None
    body = '{"summary": " ' + "word " * 160 + '", "topics": ["a", "b", "c", "d", "e", "f", "g"]}'
    got = one(spark, replies.summary(F.lit(body)))
    assert got.summary == " ".join(["word"] * 150) + " […]" and got.topics == list("abcdef")
    assert one(spark, replies.summary(F.lit('{"summary": "x", "topics": []}'))) is None


def test_answer_metrics(spark):
    rows = [(1, True, "x", '{"score": 0.4}'), (2, True, " INSUFFICIENT_CONTEXT ", None), (3, False, "x", '{"score": 1}'), (4, True, "x", "no json")]
    df = spark.createDataFrame(rows, "case_id int, is_answerable boolean, answer string, reply string")
    assert {r.case_id: r.value for r in metrics.answer_correctness(df).collect()} == {1: 0.4, 2: 0.0, 3: None, 4: None}
    cases = spark.createDataFrame([(1, True, "A", [2, 3]), (2, True, "A", [9]), (3, True, "B", [1]), (4, False, None, [])], "case_id int, is_answerable boolean, gold_doc string, gold_pages array<int>")
    pages = spark.createDataFrame([(1, 3), (2, 9), (3, 1)], "case_id int, page int")
    assert {r.case_id: r.value for r in metrics.ocr_delta(cases, pages, pages.limit(0), "A", 5).collect()} == {1: -1.0, 2: None, 3: None, 4: None}
    got = spark.createDataFrame([(1, "A", 2), (1, "A", 7), (1, "B", 3), (1, "A", 9)], "case_id int, doc string, page int")
    assert {r.case_id: (r.recall, r.precision) for r in metrics.context_metrics(cases, got).collect()} == {1: (1.0, 0.25), 2: (0.0, None), 3: (0.0, None), 4: (None, None)}


def test_ablation_without_varying_axis_names_all(spark):
    runs = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "run_id int, axis string, value string")
    r = metrics.axis_labels(runs).first()
    assert (r.label, r.constants) == ("a=x;b=y", "Held constant: a=x; b=y.")


def test_fetches_caches_and_runs(spark, tmp_path):
    status = lambda size, content: one(spark, ingestion.fetch_status(F.lit(size).cast("int"), F.lit(content).cast("binary")))
    assert [status(5, ""), status(0, ""), status(None, "%PDF-1"), status(None, "<html>"), status(None, None)] == ["kept", "empty", "fetched", "not a pdf", "empty"]
    misses = spark.createDataFrame([("k",), ("l",)], "key string")
    with pytest.raises(ValueError):
        ingestion.checked_values(misses, misses.limit(1))
    assert ingestion.checked_values(misses, misses) is misses
    with ingestion.exclusive_run(spark, str(tmp_path)), pytest.raises(RuntimeError), ingestion.exclusive_run(spark, str(tmp_path)):
        pass
    with ingestion.exclusive_run(spark, str(tmp_path)):
        pass


def test_upsert_ties_and_requests(spark):
    df = lambda rows: spark.createDataFrame(rows, "key long, name string")
    got = lookup.newest_upsert(df([(1, "z"), (2, "s")]), df([(1, "a"), (1, "b")]), "key")
    assert sorted(map(tuple, got.collect())) == [(1, "b"), (2, "s")]
    docs = spark.createDataFrame([(i, f"Title {i}") for i in range(30)], "doc_id long, title string")
    r = lookup.resolve(spark.createDataFrame([("title",), ("TITLE 7",), ("7",)], "request string"), docs, listed=3)
    assert {x.request: (x.status, x.doc_id, x.ambiguous) for x in r.collect()} == {"title": ("ambiguous", None, "0,1,2"), "TITLE 7": ("match", 7, None), "7": ("match", 7, None)}


def test_contained_requests_meet_on_their_rarest_run(spark):
    rng = random.Random(7)
    titles = ["".join(rng.choices("abC d", k=rng.randint(0, 9))) for _ in range(150)] + [None]
    asked = sorted({"".join(rng.choices("abcD ", k=rng.randint(0, 4))) for _ in range(60)} | {"a", "zzz"})
    docs = spark.createDataFrame(list(enumerate(titles, 1_000_000)), "doc_id long, title string")
    for r in lookup.resolve(spark.createDataFrame([(a,) for a in asked], "request string"), docs).collect():
        want = r.request.strip(" ").lower()
        same = [i for i, t in enumerate(titles, 1_000_000) if t is not None and want and t.lower() == want]
        inside = [i for i, t in enumerate(titles, 1_000_000) if t is not None and want and want in t.lower()]
        one = same[0] if same else inside[0] if len(inside) == 1 else None
        many = ",".join(map(str, inside)) if one is None and inside else None
        assert (r.status, r.doc_id, r.ambiguous) == ("match" if one else "ambiguous" if many else "none", one, many)


def test_session_state_over_batches(spark, tmp_path):
    """The keyed state after several batches equals the rule over all turns."""
    rng = random.Random(3)
    turns = [(s, t, [rng.uniform(-1, 1) for _ in range(3)], rng.sample(range(9), 2) if t % 3 else None) for s in (1, 2, 3) for t in range(rng.randint(3, 9))]
    schema = "session_id long, turn long, embedding array<double>, shown array<long>"
    for part in range(3):
        spark.createDataFrame([r for r in turns if r[1] // 3 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = []
    query = streams.session_state(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck"))
    query.foreachBatch(lambda df, _: rows.extend(df.collect())).trigger(availableNow=True).start().awaitTermination()
    last = {r.session_id: r for r in sorted(rows, key=lambda r: r.turns)}
    for s in (1, 2, 3):
        profile, recent, seen, n = streams.update(None, [(t, v, shown or []) for x, t, v, shown in turns if x == s])
        r = last[s]
        assert (r.turns, r.n_recent, r.n_surfaced) == (n, len(recent), len(seen)) and r.profile == pytest.approx(profile)


def test_budget_and_panel(spark):
    words = F.array(*[F.lit(w) for w in ("aa", "bbb", "cccc", "d")])
    assert [one(spark, tx.budget_words(words, n, F.length)) for n in (0, 2, 5, 9, 10)] == [0, 1, 2, 3, 4]
    cited = spark.createDataFrame([(1, 0, "Short", 5), (1, 1, "A Short Title, long", 1)], "answer_id int, nth int, title string, page int")
    passages = spark.createDataFrame([(1, 10, "A short title", 1, 3), (1, 11, "A short title", 4, 6), (1, 12, "Other", 5, 5)], "answer_id int, doc_id int, title string, page int, end_page int")
    got = sorted((r.nth, r.doc_id, r.on_page) for r in guards.panel_matches(cited, passages).collect())
    assert got == [(0, 11, True), (1, 10, True)]


def test_scratch_needs_a_shared_folder_off_local_mode(spark, monkeypatch):
    from lectern.plans import scratch

    monkeypatch.setattr(scratch, "_settings", lambda s: (None, "spark://somewhere:7077"))
    with pytest.raises(RuntimeError):
        scratch.shared_dir(spark)
    monkeypatch.setattr(scratch, "_settings", lambda s: ("hdfs://x/y", "spark://somewhere:7077"))
    assert scratch.shared_dir(spark) == "hdfs://x/y"
    monkeypatch.undo()
    assert Scratch(spark, "t").path
