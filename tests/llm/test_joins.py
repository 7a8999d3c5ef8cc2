"""Embedding range join, Jaccard join and the pipeline against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

import corpus_pipeline
from lectern.llm.embedding_dedup import RangeJoin, choose_cells, near_duplicates, unit
from lectern.llm.jaccard import JaccardJoin, keep_one, similar_components
from lectern.llm.shingles import Shingler
from lectern.llm.tables import table
from lectern.plans.components import connected_components
from lectern.plans.scratch import Scratch


def components(ids, links):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 3), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = components({x for e in real for x in e}, real)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("cosine", [0.93, 0.5, -0.2])
def test_cells_lose_no_neighbour(cosine):
    rng = np.random.default_rng(1)
    base = unit(rng.normal(size=(60, 8)))
    vectors = unit(np.concatenate([base + rng.normal(scale=0.12, size=base.shape) for _ in range(4)] + [base[:1] + rng.normal(scale=0.03, size=(60, 8))]))
    cells = choose_cells(vectors[::2], 7, RangeJoin(cosine=cosine, dense=3))
    assert len(cells.balls) > 1 and len(cells.pivots) > 1
    home, angle = cells.homes(vectors)
    low, high = (np.array([f(angle[home == k], initial=e) for k in range(len(cells.balls) + len(cells.pivots))]) for f, e in ((np.min, np.inf), (np.max, -np.inf)))
    visits = cells.visits(vectors, home, low, high)
    for x, y in zip(*np.nonzero(vectors @ vectors.T >= cosine), strict=True):
        assert home[x] >= home[y] or visits[x, home[y]]
    if cosine == 0.93:  # dense cells are visited by few
        assert visits[:, : len(cells.balls)].mean() < 0.4


def vectors_table(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    rows = []
    for i in range(90):
        v = base[i % 12] * rng.uniform(0.5, 3) + rng.normal(scale=0.15, size=6)
        rows.append((1000 - i, [float(x) for x in v], int(i % 3)))
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(9)]  # exact copies
    rows += [(3000, None, 1), (3001, [0.0] * 6, 1), (3002, [float("nan")] * 6, 1), (3003, rows[0][1], None), (3004, [1.0, None], 1), (3005, [], 1), (3006, [1.0, 2.0], 1), (3007, [2.0, 4.0], 1), (3008, [float("inf")] * 6, 0)]
    return rows


def test_embedding_join_matches_brute_force(spark):
    rows = vectors_table(spark)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    usable = {i: (lab, np.array(v)) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [
        (a, b)
        for a, (la, x) in usable.items()
        for b, (lb, y) in usable.items()
        if a != b and la == lb and x.size == y.size and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93
    ]
    comp = components([r[0] for r in rows], links)
    want = {i: (sum(a == i for a, _ in links), comp[i], comp[i] == i) for i, _, _ in rows}
    for p in (RangeJoin(), RangeJoin(owners_a_block=4, visitors_a_block=7), RangeJoin(cell_vectors=5, owners_a_block=3, visitors_a_block=2, ball=0.4, dense=2)):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, Scratch(spark, "t"), p).collect()}
        assert got == want
    assert any(v[0] > 5 for v in want.values())
    assert near_duplicates(df.limit(0), Scratch(spark, "t")).count() == 0


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def jaccard_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    rows, n = [], 0
    for _ in range(10):
        base = [rng.choice(words) for _ in range(rng.randint(5, 90))]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    for _ in range(40):  # one star of near copies that are close to its middle only
        copy = list(passage)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(60)] = rng.choice(words)
        rows.append((n, "  ".join(copy).upper() if n % 2 else "\t".join(copy)))
        n += 1
    for _ in range(40):  # a passage that many documents share
        rows.append((n, " ".join(passage + [rng.choice(words) for _ in range(rng.randint(3, 20))])))
        n += 1
    edges = [None, "", " \n", "a", "A", "a b c d", "a b c d", "a b c d e", "é É", "a b", "x " * 4000, "X " * 3999]
    return rows + [(n + 10 * i, t) for i, t in enumerate(edges)]


def test_jaccard_matches_brute_force(spark):
    rows = jaccard_rows()
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n int, component string")
    want = brute(rows)
    for p in (JaccardJoin(), JaccardJoin(hubs=1, rounds=1, few_pairs=1, long_posting=3, block=4, block_tokens=200, max_frequent=20, broadcast_ids=2, filter_bits=8)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(df, Scratch(spark, "t"), p).collect()}
        assert got == want
    kept = keep_one(df, Scratch(spark, "t"))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}
    assert similar_components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_jaccard_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in similar_components(df, Scratch(spark, "t")).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (None, 1)]


def test_jaccard_ids_with_two_texts(spark):
    """An id connects what either of its texts links with."""
    rows = jaccard_rows()
    more = [(rows[i][0], rows[(i * 37 + 11) % 120][1]) for i in range(0, 120, 17)] + [rows[3], rows[3]]
    every = rows + more
    sets = [(i, shingle_set(t)) for i, t in every]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if a != b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    comp = components({i for i, _ in every}, links)
    df = spark.createDataFrame(every, "doc_id long, text string")
    for p in (JaccardJoin(), JaccardJoin(hubs=1, rounds=1, few_pairs=1, long_posting=3, block=4, block_tokens=200, max_frequent=20, broadcast_ids=2, filter_bits=8)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_components(df, Scratch(spark, "t"), p).collect())
        assert got == sorted((i, len(x), comp[i] if x else i) for i, x in sets)


def test_keep_one_with_clashing_names(spark):
    rows = [(1, "a b c", 1, "x"), (2, "a b c", 2, "y"), (None, "a b c", 3, "z"), (3, None, 4, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, gone int, `a.b` string")
    out = keep_one(df, Scratch(spark, "t"))
    assert out.schema == df.schema and sorted(r.gone for r in out.collect()) == [1, 3, 4]


def test_pipeline_stages(spark, sf_dir):
    from lectern.llm import pii, quality, toxicity
    from lectern.llm.packing import token_pieces
    from lectern.llm.queries import tokenizer_path

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scratch = Scratch(spark, "t")
    good = {r.doc_id for r in quality.assess(docs, labels).where("kept").collect()}
    left = scratch.save(corpus_pipeline.STAGES[0][1](spark, docs, sf_dir), "quality")
    assert {r.doc_id for r in left.collect()} == good and left.columns == docs.columns
    mild = {r.doc_id for r in toxicity.score(left, toxicity.fit(left, labels)).where("predicted = 0").collect()}
    left = scratch.save(corpus_pipeline.STAGES[1][1](spark, left, sf_dir), "toxicity")
    assert {r.doc_id for r in left.collect()} == mild
    one = {c for _, c in brute([(r.doc_id, r.text) for r in left.collect()]).values()}
    left = scratch.save(corpus_pipeline.STAGES[2][1](spark, left, sf_dir), "near")
    assert {r.doc_id for r in left.collect()} == one
    redacted = scratch.save(corpus_pipeline.STAGES[3][1](spark, left, sf_dir), "pii")
    assert {r.doc_id for r in redacted.collect()} == one and redacted.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in redacted.collect())
    assert pii.report(redacted).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    packed = corpus_pipeline.STAGES[4][1](spark, redacted, sf_dir)
    assert packed.count() == token_pieces(redacted, tokenizer_path()).count()
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()
    assert Row and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_jaccard", "personal_data", "best_fit_packing"]


def test_stages_with_edge_rows_and_clashing_names(spark, sf_dir):
    from lectern.llm import stages

    docs = table(spark, sf_dir, "documents").limit(60).collect()
    extra = [(*r, 1.5, "t", [1], "row", i % 2 == 0) for i, r in enumerate(docs)]
    extra += [extra[5], (None, "mail x@y.zz " * 60, "en", "s", 1, None, None, None, None, None), (900001, None, None, None, None, None, None, None, None, None), (900002, " \n", "en", "s", 2, 0.0, "", [], "", True)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` double, __text string, __pii array<int>, row string, kept boolean"
    df = spark.createDataFrame(extra, schema)
    for stage in (stages.quality_rules, stages.drop_toxic, stages.drop_near_duplicates, stages.redact_personal_data):
        out = stage(spark, df, sf_dir)
        assert [f.name for f in out.schema] == [f.name for f in df.schema] and out.dtypes == df.dtypes
        rows = out.collect()
        whole = {str(r) for r in df.collect()}
        if stage is stages.redact_personal_data:
            assert len(rows) == len(extra)
            changed = next(r for r in rows if r.doc_id is None)
            assert changed.text == "mail <EMAIL> " * 60 and changed.n_chars == len(changed.text)
        else:
            assert {str(r) for r in rows} <= whole and 0 < len(rows) <= len(extra)
        if stage is stages.quality_rules:
            assert not {900001, 900002} & {r.doc_id for r in rows}
        assert stage(spark, df.limit(0), sf_dir).collect() == []
    packed = stages.pack_sequences(spark, df, sf_dir)
    assert packed.where("doc_id = 900001").first().length == 1
    assert stages.pack_sequences(spark, df.limit(0), sf_dir).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1_024, 4_096])
def test_words_of_regular_patterns_are_told_apart(spark, n):
    """A polynomial modulo a power of two gives such a word and its complement one hash."""
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    shared = " ".join(f"w{i}" for i in range(9))
    texts = [word, other, f"{word} {shared}", f"{other} {shared}", f"x {word} y {word} z {word}", f"x {other} y {other} z {other}", other + " " * 3]
    rows = similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "t")).collect()
    # of documents 2 and 3 only one of six shingles differs from five that are shared: 5 of 7 are too few
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1}


def test_shingle_sets_match_those_of_words():
    rng = random.Random(12)
    texts = [" ".join(rng.choices(["a", "B", "ab", "ba", "aa", "é", "Ü", "x" * 70, "x" * 71], k=rng.randint(0, 30))) for _ in range(200)]
    sets = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in t.split()]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    hashed = [set(s.tolist()) for s in Shingler(5).of_column(pa.array(texts))]
    for a in range(0, 200, 7):
        for b in range(200):
            assert len(hashed[a] & hashed[b]) == len(sets[a] & sets[b]) and len(hashed[a]) == len(sets[a])
