"""Ranked lexical search, spelling variants and exact top-k search against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import lexical_search as ls
from lectern.llm.exact_search import TopK, exact_top_k, search_block
from lectern.llm.lexical_search import LexicalSearch, Posting, best_documents, cut_blocks, rank_documents, terms_of
from lectern.llm.spelling import Spelling, count_words, near_words, roots, spelling_variants
from lectern.plans.scratch import Scratch


# -- exact top-k search --------------------------------------------------------------------------
def brute_top(rows, k, every):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            vectors[i] = min(vectors.get(i, w), w)
    out = set()
    for q in (i for i in vectors if i % every == 0):
        scores = sorted((-sum(x * y for x, y in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("p", [TopK(), TopK(k=3, dims=2, rows_a_block=20, queries_a_block=3, chunk=7)])
def test_top_k_matches_brute_force(spark, p):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=9) * (1 + i % 3)]) for i in range(90)]
    rows += [(100 + i, rows[5][1]) for i in range(12)] + [rows[7], rows[10], (10, [9.0] * 9)]  # copies, repeated rows, an id with two vectors
    rows += [(200, None), (205, [float("nan")] * 9), (210, [None] + [1.0] * 8), (215, [float("inf")] * 9), (220, [1.0, 2.0]), (221, [3.0, -1.0]), (225, []), (226, []), (None, [1.0] * 9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = {tuple(r) for r in exact_top_k(df, df.where("vec_id % 5 = 0"), p).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(rows, p.k, 5)
    assert exact_top_k(df.limit(0), df.limit(0), p).count() == 0


def test_bounds_leave_candidates_out():
    rng = np.random.default_rng(6)
    rows = np.floor(256 * rng.normal(size=(3_000, 64)) / 8).astype(np.int64)
    rows[:, 8:] //= 6  # most mass in the first dimensions
    found, work = search_block(np.array([7, 11]), rows[[7, 11]], np.arange(3_000), rows, TopK(chunk=500))
    assert {(q, i, s) for q, i, s in found} == {(q, i, s) for q in (7, 11) for s, i in [(-s, i) for s, i in sorted((-int(rows[q] @ rows[i]), i) for i in range(3_000) if i != q)[:5]]}
    assert work < 0.6 * 2 * rows.size


def test_top_k_of_large_numbers(spark):
    rows = [(i, [1e6 + i, -2e6, 3e6 - 7 * i]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in exact_top_k(df, df.where("vec_id % 10 = 0")).collect()}
    assert got == brute_top(rows, 5, 10) and any(s > 1 << 53 for *_, s in got)


# -- ranked lexical search -----------------------------------------------------------------------
def brute_rank(docs, items, k):
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(i, words(t)) for i, t in docs if words(t)]
    n_docs, lengths = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    texts = {}
    for i, t in items:
        if i is not None:
            texts[i] = min((x for x in (texts.get(i), t) if x is not None), default=None)
    out = []
    for item, text in texts.items():
        scores = []
        for i, w in held:
            m, tf = 75 + (25 * len(w) * n_docs) // lengths, Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in words(text) if tf[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("p", [LexicalSearch(), LexicalSearch(k=4, shard_docs=17, longest_block=3, block_cost=1e5, items_a_block=2, first_steps=1), LexicalSearch(shard_postings=40, broadcast_terms=2), LexicalSearch(k=1, longest_block=2, block_cost=0.0, first_steps=2)])
def test_ranking_matches_brute_force(spark, p):
    rng = random.Random(9)
    vocabulary = ["the", "of", "Ünder", "naïve", "x9", "ZEBRA", "zebra", "日本", *[f"w{i}" for i in range(40)]]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60))) + rng.choice(["", "!", "\n\t-"])) for i in range(150)]
    docs += [docs[3], docs[4], (500, None), (501, ""), (502, "   ?"), (503, "!?"), (None, "zebra w1 w2"), (504, "zebra " * 3_000), (3, "of another row")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(9)] + [(20, "nothing here matches"), (21, None), (22, ""), (None, "zebra"), (23, "w1"), (23, "the w5")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, term int")
    got = [tuple(r) for r in rank_documents(d, q, Scratch(spark, "t"), p).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == brute_rank(docs, items, p.k)
    assert rank_documents(d.limit(0), q, Scratch(spark, "t"), p).count() == 0
    assert rank_documents(d, q.limit(0), Scratch(spark, "t"), p).count() == 0


def test_terms():
    assert [t.decode() for t in terms_of("A-b_C9 é.Ü\x85x".encode())] == ["a", "b", "c9", "é", "Ü\x85x"]
    assert [t.decode() for t in terms_of("AbÉ9_x".encode())] == ["abÉ9", "x"]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(2)
    lists = [rng.integers(1, 100, n) for n in (1, 2, 5, 9, 9, 12)]
    values, sizes = np.concatenate(lists), np.array([len(x) for x in lists])
    starts = np.cumsum(sizes) - sizes
    for longest, cost in ((3, 40.0), (4, 0.0), (12, 120.0)):
        def price(x, ends):
            return sum((b - a) * max(x[a:b]) - sum(x[a:b]) + cost for a, b in zip([0, *ends[:-1]], ends, strict=True))

        for x, ends in zip(lists, cut_blocks(values, starts, sizes, longest, cost, together=4), strict=True):
            cuts = [[*c, len(x)] for r in range(len(x)) for c in itertools.combinations(range(1, len(x)), r)]
            whole = [c for c in cuts if max(np.diff([0, *c])) <= longest]
            assert price(x.tolist(), ends.tolist()) == pytest.approx(min(price(x.tolist(), c) for c in whole))
            assert max(np.diff([0, *ends])) <= longest and ends[-1] == len(x)


def test_blocks_are_skipped():
    rng = np.random.default_rng(3)
    n = 20_000
    postings = []
    for weight, share in ((6_000, 0.002), (4_500, 0.01), (40, 0.6), (25, 0.8), (10, 0.9)):
        places = np.flatnonzero(rng.random(n) < share)
        impacts = rng.integers(200_000, 800_000, len(places))
        ends = cut_blocks(impacts, np.array([0]), np.array([len(places)]), 32, 400_000.0)[0]
        postings.append(Posting(weight, places, impacts, ends, np.maximum.reduceat(impacts, np.concatenate(([0], ends[:-1])))))
    found, opened = best_documents(postings, n, 20, 64)
    score = np.zeros(n, dtype=np.int64)
    for x in postings:
        score[x.places] += x.weight * x.impacts
    want = np.lexsort((np.arange(n), -score))[:20]
    assert found == [(int(i), int(score[i])) for i in want]
    assert opened < 0.1 * sum(len(x.places) for x in postings)


def test_statistics_and_whole_index(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "B"), (3, None), (4, "?")], "doc_id long, text string")
    assert ls.statistics(docs) == (2, 3)
    index = ls.build_index(docs, 2, 3, LexicalSearch())
    assert {r.term: r.n_docs for r in index.where("term IS NOT NULL").collect()} == {"a": 1, "b": 2}
    few = ls.build_index(docs, 2, 3, LexicalSearch(), frozenset([b"b"]))
    assert [r.term for r in few.where("term IS NOT NULL").collect()] == ["b"]


# -- spelling variants ---------------------------------------------------------------------------
def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs, p):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % p.damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= p.shortest:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= p.least}


def brute_variants(n, ratio):
    forms, out = {}, {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (n[w], len(near), forms[w], n[forms[w]] if forms[w] else None)
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (*out[w], root)
    return out


@pytest.mark.parametrize("damage", [199, 3])
def test_variants_match_brute_force(spark, damage):
    rng = random.Random(damage)
    p = Spelling(shortest=3, least=2, ratio=2, damage=damage, held_words=50)
    base = ["abcabc", "aaaaaa", "straße", "éclairs", "bananas", "banana"] + ["".join(rng.choices("abcé", k=rng.randint(3, 6))) for _ in range(60)]
    docs = []
    for i in range(120):
        words = []
        for w in rng.choices(base, [1 / (k + 1) for k in range(len(base))], k=40):
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abÀ") + w[at:], w[:at] + rng.choice("abÿ") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", "-", "1", "日"]).join(words)))
    docs += [docs[0], docs[0], (None, "banana banana"), (900, None), (901, ""), (902, "x" * 5_000 + " " + "x" * 4_999), (903, "x" * 5_000 + " " + "x" * 4_999), (904, "x" * 5_000 + " " + "x" * 4_999)]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n int")
    words = brute_words(docs, p)
    assert {r.word: r.n for r in count_words(df, p).collect()} == words
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_variants(df, Scratch(spark, "t"), p).collect()}
    assert got == brute_variants(words, p.ratio)
    assert any(v[4] != w for w, v in got.items()) and len(got) > 100
    assert spelling_variants(df.limit(0), Scratch(spark, "t"), p).count() == 0


def test_every_pair_is_met_once(spark):
    words = {"".join(x): 1 for n in (1, 2, 3, 4) for x in itertools.product("ab", repeat=n)} | {"ba" * 5: 3, "ba" * 5 + "b": 2}
    df = Scratch(spark, "t").save(spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(words.items())], "id long, word string, n long"), "words")
    got = {r.word: (r.n_near, r.near) for r in near_words(df, Scratch(spark, "t")).collect()}
    want = {w: [x for x in words if one_edit(w, x)] for w in words}
    assert got == {w: (len(near), min(near, key=lambda x: (-words[x], x))) for w, near in want.items() if near}


def test_long_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(20)], "word string, form string")
    assert {r.word: r.root for r in roots(forms, Scratch(spark, "t")).collect()} == {f"w{i:02}": "w20" for i in range(20)}
    assert roots(forms.limit(0), Scratch(spark, "t")).count() == 0
