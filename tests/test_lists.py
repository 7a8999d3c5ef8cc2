"""Recommendation lists of whole rankings against the literal loops over all documents."""

from __future__ import annotations

import pathlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import dense, lists, recommend, whole_lists
from lectern.plans.scratch import Scratch

DOCS = "doc_id long, lineage_group long, published_on string, chunk_count int, embedding array<double>"
ASKED = "query_id long, vector array<double>, seed_id long, seed_group long, seed_vector array<double>"
AS_OF = np.datetime64("2000-01-01")


def store(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("published_on", F.col("published_on").cast("timestamp"))


def cosine(a, b):
    scale = np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))
    return float(np.dot(a, b) / scale) if scale else 0.0


def literal(ranked, about, vector, seed, k, lam, ceiling):
    """The two loops as they are described: duplicates over the whole ranking, then k picks among all that are left."""
    groups = {}
    for d in ranked:
        if about[d][1] is not None:
            groups.setdefault(about[d][1], []).append(d)
    newest = {g: min(ds, key=lambda d: (-np.datetime64(about[d][2]).astype("datetime64[s]").astype(int), d)) for g, ds in groups.items()}
    kept, seen = [], set()
    for d in ranked:
        group = about[d][1]
        if seed and (d == seed[0] or (group is not None and group == seed[1])):
            continue
        if group is not None:
            if group not in seen:
                seen.add(group)
                kept.append(newest[group])
        elif not any(cosine(about[d][4], v) > ceiling for v in [about[x][4] for x in kept] + ([seed[2]] if seed else [])):
            kept.append(d)
    near = {d: round(cosine(about[d][4], vector), 6) for d in kept}
    closest, out = dict.fromkeys(kept, 0.0), []
    while len(out) < k and len(out) < len(kept):
        best = min((d for d in kept if d not in out), key=lambda d: (-round(lam * near[d] - (1 - lam) * closest[d], 9), -near[d], d))
        out.append(best)
        for d in kept:
            closest[d] = max(closest[d], round(cosine(about[d][4], about[best][4]), 6))
    return out


def recency(published):
    age = max(0.0, float((AS_OF - np.datetime64(published)) / np.timedelta64(1, "us")) / 86_400e6)
    return 0.3 + 0.7 * np.exp(-age / 1000)


def documents(rng, n, dim, copies):
    """Lone documents, groups, and many near copies of a few."""
    base = rng.normal(size=(n, dim))
    base[copies:] = base[rng.integers(0, 6, n - copies)] + rng.normal(scale=0.02, size=(n - copies, dim))
    return [(i, int(i % 7) if i % 5 == 0 else None, f"{1990 + int(rng.integers(0, 9))}-0{1 + i % 9}-11", 1 + i % 3, [float(x) for x in v]) for i, v in enumerate(base)]


@pytest.mark.parametrize("lam", [0.7, 0.3])
def test_lists_of_the_scored_catalogue(spark, lam):
    rng = np.random.default_rng(5)
    rows = documents(rng, 240, 5, 120)
    about = {r[0]: r for r in rows}
    vectors = [rows[3][4], [float(x) for x in rng.normal(size=5)], rows[125][4]]
    seeds = [(3, about[3][1], rows[3][4]), None, (125, about[125][1], rows[125][4])]
    asked = spark.createDataFrame([(q, v, *(s or (None, None, None))) for q, (v, s) in enumerate(zip(vectors, seeds, strict=True))], ASKED)
    hits = spark.createDataFrame([(1, 1, 200), (1, 2, 7), (2, 1, 55)], "query_id long, rank int, doc_id long")
    docs = store(spark, rows)
    ranker = lists.ScoredCatalogue(asked, docs, F.lit("2000-01-01").cast("timestamp"), hits)
    got = {}
    for r in lists.pick(ranker, asked, docs, Scratch(spark, "t"), 5, lam, depth=4).collect():
        got.setdefault(r.query_id, {})[r.pick] = r.doc_id
    evidence = {(1, 200): 1 / 61, (1, 7): 1 / 62, (2, 55): 1 / 61}
    for q, (v, seed) in enumerate(zip(vectors, seeds, strict=True)):
        raw = {d: evidence.get((q, d), 0.0) / np.sqrt(max(1, r[3])) for d, r in about.items()}
        most = max(raw.values())
        score = {d: round(0.5 * cosine(r[4], v) + 0.3 * (raw[d] / most if most else 0.0) + 0.2 * recency(r[2]), 6) for d, r in about.items()}
        want = literal(sorted(about, key=lambda d: (-score[d], d)), about, v, seed, 5, lam, recommend.CEILING)
        assert [got[q][i] for i in sorted(got[q])] == want


def test_lists_of_sessions(spark):
    rng = np.random.default_rng(8)
    rows = documents(rng, 160, 4, 90)
    about = {r[0]: r for r in rows}
    recent = {1: [rng.normal(size=4) for _ in range(3)], 2: [rng.normal(size=4)]}
    profile = {q: sum(vs) for q, vs in recent.items()} | {3: rng.normal(size=4)}
    shown = {1: set(range(0, 160, 2)), 2: {5}}
    plain = lambda v: [float(x) for x in v]
    asked = spark.createDataFrame([(q, plain(v), None, None, None) for q, v in profile.items()], ASKED)
    queries = spark.createDataFrame([(q, i + 1, plain(v)) for q, vs in recent.items() for i, v in enumerate(vs)], "query_id long, recency int, vector array<double>")
    seen = spark.createDataFrame([(q, d) for q, ds in shown.items() for d in ds], "query_id long, doc_id long")
    docs = store(spark, rows)
    ranker = lists.SessionAffinity(queries, asked.select("query_id", "vector"), docs, seen)
    got = {}
    for r in lists.pick(ranker, asked, docs, Scratch(spark, "t"), 4, 0.6, depth=3).collect():
        got.setdefault(r.query_id, {})[r.pick] = r.doc_id
    for q, p in profile.items():
        score = {d: max(round(cosine(r[4], v), 6) for v in recent.get(q, [p])) for d, r in about.items() if d not in shown.get(q, ())}
        want = literal(sorted(score, key=lambda d: (-score[d], d)), about, p, None, 4, 0.6, recommend.CEILING)
        assert [got[q][i] for i in sorted(got[q])] == want


def test_more_duplicates_than_any_depth(spark):
    rows = [(i, 1 if i < 300 else None, f"19{70 + i % 20}-01-01", 1, [1.0, 0.001 * (i % 50)]) for i in range(600)] + [(900, None, "1950-01-01", 1, [0.2, 1.0])]
    asked = spark.createDataFrame([(1, [1.0, 0.0], None, None, None)], ASKED)
    docs = store(spark, rows)
    ranker = lists.ScoredCatalogue(asked, docs, F.lit("2000-01-01").cast("timestamp"))
    got = lists.pick(ranker, asked, docs, Scratch(spark, "t"), 5, 0.7, depth=8).orderBy("pick").collect()
    # six hundred copies leave the newest of the group or the first lone one; the group stands before it here
    assert [r.doc_id for r in got][-1] == 900 and len(got) <= 3


def test_opposed_picks_give_no_bonus(spark):
    unit = np.array([[1.0, 0.0], [-1.0, 0.0], [0.6, 0.8]])
    assert recommend.mmr_order(unit @ np.array([0.9, 0.1]), unit @ unit.T, [1, 2, 3], 3, 0.1) == [0, 1, 2]
    assert recommend.mmr_order(np.array([0.5, 0.0, 0.1]), np.array([[1, -1, 0], [-1, 1, 0], [0, 0, 1.0]]), [1, 2, 3], 2, 0.5) == [0, 2]


def test_barred_rows_leave_before_the_top(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.01 * i], None) for i in range(30)], "id long, vector array<double>, scope string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.0], None)], "query_id long, vector array<double>, scope string")
    barred = spark.createDataFrame([(1, i) for i in range(27)], "query_id long, id long")
    got = dense.dense_topk(asked, rows, 2, block=7, barred=barred).collect()
    assert {(r.query_id, r.rank): r.id for r in got} == {(1, 1): 27, (1, 2): 28, (2, 1): 0, (2, 2): 1}


def test_bad_lambda(spark):
    with pytest.raises(ValueError):
        lists.pick(None, None, None, None, 5, 1.5)


def test_a_large_k_makes_small_blocks_of_queries(spark, monkeypatch):
    """Whatever K is, a pair of blocks gives a bounded number of rows, and the ranking is that of all rows."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 6, (150, 8)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(counts)], "id long, vector array<double>, scope string")
    asked = rows.where("id < 40").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(dense, "MOST_FOUND", 300)
    monkeypatch.setattr(dense, "STRIP", 3)
    sizes = []
    dealt = dense._dealt
    monkeypatch.setattr(dense, "_dealt", lambda df, key, n: sizes.append(n) or dealt(df, key, n))
    got = {}
    for r in dense.dense_topk(asked, rows, 100, block=60).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    assert sizes == [8, 3]
    for q in range(40):
        score = {i: np.floor(cosine(counts[q], counts[i]) * 1e6 + 0.5) / 1e6 for i in range(150)}
        order = sorted(score, key=lambda i: (-score[i], i))[:100]
        assert sorted(got[q]) == [(n + 1, i, score[i]) for n, i in enumerate(order)]


def test_vectors_that_are_all_alike_move_few_rows(spark, monkeypatch):
    """Far documents are as good as near ones here, yet no ranking is moved and blocks don't matter."""
    monkeypatch.setattr(whole_lists, "DOCS_A_BLOCK", 150)
    rng = np.random.default_rng(4)
    counts = rng.poisson(rng.gamma(1.0, 6.0, 6), (700, 6)).astype(float)
    rows = [(i, int(i % 20) if i % 10 == 0 else None, f"{1980 + i % 20}-02-03", 1, v.tolist()) for i, v in enumerate(counts)]
    about, vectors = {r[0]: r for r in rows}, [rows[5][4], rows[6][4]]
    asked = spark.createDataFrame([(1, vectors[0], 5, None, vectors[0]), (2, vectors[1], None, 0, None)], ASKED)
    docs, scratch = store(spark, rows), Scratch(spark, "t")
    ranker = lists.ScoredCatalogue(asked, docs, F.lit("2000-01-01").cast("timestamp"))
    got = {}
    for r in lists.pick(ranker, asked, docs, scratch, 5, 0.7, depth=4).collect():
        got.setdefault(r.query_id, {})[r.pick] = r.doc_id
    for q, seed in ((1, (5, None, vectors[0])), (2, (None, 0, None))):
        score = {d: np.floor((0.5 * cosine(r[4], vectors[q - 1]) + 0.2 * recency(r[2])) * 1e6 + 0.5) / 1e6 for d, r in about.items()}
        want = literal(sorted(about, key=lambda d: (-score[d], d)), about, vectors[q - 1], seed if seed[2] else (None, 0, [0.0] * 6), 5, 0.7, recommend.CEILING)
        assert [got[q][i] for i in sorted(got[q])] == want
    folder = pathlib.Path(scratch.path.removeprefix("file://"))
    moved = [spark.read.parquet(f"file://{p}").count() for p in folder.iterdir() if not p.name.endswith(("-blocks", "-asked"))]
    assert max(moved) < 100


def test_documents_move_packed(spark):
    """A block's vectors are few values of bytes, whatever lengths they have; one of another length is far from all."""
    rows = [(i, i // 2 if i % 10 < 2 else None, "1990-01-01", 1, [1.0, float(i % 13), float(i % 7)][: 2 if i == 5 else 3]) for i in range(900)]
    asked, docs, scratch = spark.createDataFrame([(1, [1.0, 9.0, 2.0], None, None, None)], ASKED), store(spark, rows), Scratch(spark, "t")
    ranker = lists.ScoredCatalogue(asked, docs, F.lit("2000-01-01").cast("timestamp"))
    got = {r.pick: r.doc_id for r in lists.pick(ranker, asked, docs, scratch, 5, 0.7).collect()}
    folder = next(p for p in pathlib.Path(scratch.path.removeprefix("file://")).iterdir() if p.name.endswith("-blocks"))
    assert spark.read.parquet(f"file://{folder}").count() < 5
    about, v = {r[0]: r for r in rows}, [1.0, 9.0, 2.0]
    near = lambda d: cosine(about[d][4], v) if len(about[d][4]) == 3 else 0.0
    score = {d: np.floor((0.5 * near(d) + 0.2 * recency(r[2])) * 1e6 + 0.5) / 1e6 for d, r in about.items()}
    about[5] = (*rows[5][:4], [0.0, 0.0, 0.0])
    want = literal(sorted(about, key=lambda d: (-score[d], d)), about, v, None, 5, 0.7, recommend.CEILING)
    assert [got[i] for i in sorted(got)] == want


@pytest.mark.parametrize("spread", [1e-9, 1e-6, 1e-4, 0.5])
def test_what_leads_is_told_in_double_precision(spread):
    """Documents that single precision can't tell apart come in the order of their rounded values, ties by id."""
    rng, n = np.random.default_rng(3), 20_000
    vectors = np.array([3.0, 1.0, 2.0, 5.0]) + rng.normal(scale=spread, size=(n, 4))
    vectors[::7] = vectors[3]
    ids, query = rng.permutation(n), [2.0, 1.0, 2.0, 5.5]
    docs = pd.DataFrame({"j": 0, "doc_id": ids, "grp": 0, "at": 0, "grouped": False, "bonus": 0.0, "vector": list(vectors)})
    told = pd.DataFrame([{"kind": kind, "query_id": 1, "doc_id": 0, "place": 0, "grp": 0, "vector": query} for kind in ("rank", "near")])
    rows = pd.concat([whole_lists.packed(docs).astype(object), told.astype(object)], ignore_index=True).fillna(np.nan).replace({np.nan: None})
    rows = rows.assign(j=0, query_id=rows["query_id"].astype("int64"))
    found = whole_lists.cell_rows(rows, 1.0, 0.7, 1.0, 24, 8)
    score = np.floor(vectors @ query / (np.linalg.norm(vectors, axis=1) * np.linalg.norm(query)) * 1e6 + 0.5) / 1e6
    order = ids[np.lexsort((ids, -score))]
    assert found[found["kind"] == "first"]["doc_id"].tolist() == order[:24].tolist()
    assert found[found["kind"] == "pool"]["doc_id"].tolist() == order[:8].tolist()
