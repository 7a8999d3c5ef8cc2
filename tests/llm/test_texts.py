"""Quality rules, language, HTML, personal data and toxicity."""

from __future__ import annotations

import hashlib
import html
import math
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import langid, oracles, pii, quality, toxicity
from lectern.llm.html_text import INLINE, Extraction, PageWeights, best_region, extract, learn, main_texts, scored
from lectern.llm.tables import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", " \t\n", "one", "a b", "a b c a b c", "x y z\nx y z\n\n \nx y z", "#a *b $c%", "é ü e u\x1cv", "w " * 3000, "a b a b a b a"]


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {p for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, r = len(w), len(rep)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def edge_docs(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(EDGES)] + [(1, "", "again", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, w string, n_words int")


def test_quality_counts_match_brute_force(spark, sf_dir):
    docs = edge_docs(spark).select("doc_id", "text").unionByName(table(spark, sf_dir, "documents").selectExpr("doc_id + 1000 AS doc_id", "text"))
    got = quality.assess(docs, table(spark, sf_dir, "labels")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = sorted((r.doc_id, *[r[n] for n in names]) for r in got)
    assert rows == sorted((r.doc_id, *base_counts(r.text)) for r in docs.collect())
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_keeps_columns_and_rows_that_pass(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "w").withColumnRenamed("lang", "kept")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.assess(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and 0 < len(want) < docs.count()
    none = docs.limit(0)
    assert quality.keep_good(none, labels).count() == quality.assess(none, labels.limit(0)).count() == 0


def test_quality_trusts_every_good_label(spark):
    """21,000 trusted documents have as many words as all documents, so no weight is other than 0."""
    docs = spark.range(21_000).selectExpr("id AS doc_id", "concat('w', id % 7) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    assert set(quality.gram_weights(docs, labels, quality.QualityRules())) == {0}


def test_language_held_out(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)
    out = {r.doc_id: r for r in langid.predict(edge_docs(spark).where("w = 'clash'"), model).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and out[3].lang_pred != "und"
    assert langid.predict(docs.limit(3), None).select("lang_pred").distinct().first()[0] == "und"
    assert langid.predict(docs.limit(0), model).count() == 0


def test_language_sample_holds_rare_languages(spark):
    rows = [(i, "the common words of a text", "en") for i in range(4_000)] + [(10_000 + i, "żółć gęślą jaźń źdźbło", "pl") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, langid.LanguageModel(max_rows=16))
    assert model.languages == ("en", "pl")
    assert langid.predict_texts(["żółć jaźń", "common text of the words"], model)[0][0] == "pl"


def test_language_blocks_cover_whole_texts(spark, sf_dir):
    model = langid.fit(table(spark, sf_dir, "documents"))
    text = "the and of " * 500
    from dataclasses import replace

    small = replace(model.config, block_bytes=101)
    assert abs(langid.averages(text, model.table, small) - langid.averages(text, model.table, model.config)).max() < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T x y z</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=1>Home</a></li><li>b</li></ul></nav>
<div class="ad">Buy now or never again my friends</div><article><h1>Cats &amp; <i>dogs</i></h1><p>One  two<br>three<p>fo<b>ur</b>
five<div class="comments">no no no no</div><form>x <input></form><aside>y</aside>six &lt;b&gt;</article><footer>&copy; z</footer></body></html>"""


COMMENTS = '<div class="comments">no no no no</div>'
#: What weights are learned from: the same page with its comments below the article.
LABELLED = PAGE.replace(COMMENTS, "").replace("</article>", "</article>" + COMMENTS)
WANT = "Cats & dogs\nOne two three\nfour five\nsix <b>"


def test_html_main_text():
    weights = learn([LABELLED] * 3)
    assert extract(PAGE, weights) == extract(LABELLED, weights) == WANT
    assert [extract(x, weights) for x in (None, "", "<p>", "<script>x", "<!-- a")] == [""] * 5
    assert extract("plain words", weights) == "plain words"
    # an article inside the article is a reader comment
    assert extract(PAGE.replace(COMMENTS, "<article><p>no no</p></article>"), weights) == WANT


def test_html_weights_and_scan_decide(monkeypatch):
    from lectern.llm import html_text

    weights = learn([LABELLED] * 3)
    assert all(w > 0 for w in weights.words.values()) and all(w < 0 for w in weights.tags.values())
    assert extract(PAGE, PageWeights({}, {})) != WANT
    level = PageWeights(dict.fromkeys(weights.words, 1.0), dict.fromkeys(weights.tags, -0.1))
    assert "Home" in extract(PAGE, level)
    monkeypatch.setattr(html_text, "best_region", lambda scores: (0, len(scores)))
    assert html_text.extract(PAGE, weights, Extraction(least=-1e9)) != WANT


def brute_force_text(page, weights, c=Extraction()):
    """The text of the region that trying all regions finds, without :func:`best_region`."""
    sequence, closed = scored(page, weights, c)
    score = [e[2] for e in sequence]
    low = [(i, j, inner) for i, j, inner in closed if math.fsum(score[i:j]) < 0]
    bridged = {k for i, j, inner in low if inner for k in range(i, j)}
    score = [c.inner_tag if k in bridged else x for k, x in enumerate(score)]
    spans = [(a, b) for a in range(len(score)) for b in range(a + 1, len(score) + 1)]
    total = {(a, b): math.fsum(score[a:b]) for a, b in spans}
    best = max(total.values(), default=0)
    if best < c.least:
        return ""
    a, b = min(s for s in spans if total[s] >= best - 1e-9)
    gone = {k for i, j, _ in low if a <= i and j <= b for k in range(i, j)}
    out = [""]
    for k in range(a, b):
        kind, value, _ = sequence[k]
        if kind == "text":
            out[-1] += "" if k in gone else value
        elif value == "br":
            out[-1] += " "
        elif value not in INLINE:
            out.append("")
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in out) if t)


def test_html_whole_extraction_matches_brute_force():
    import random

    rng = random.Random(4)
    weights = learn([LABELLED] * 3)
    shapes = ["<p>", "</p>", "<div class=ad>", "</div>", "<nav>", "</nav>", "<ul><li>", "</li></ul>", "<main>", "</main>", "<section>", "</section>", "<br>", "<b>", "</b>", "<footer>", "&amp;", "<", "<x y='"]
    some = 0
    for _ in range(300):
        page = "".join(rng.choice(shapes) if rng.random() < 0.5 else " ".join(["word"] * rng.randint(1, 9)) for _ in range(rng.randint(0, 25)))
        assert "<article" not in page
        want = brute_force_text(page, weights)
        assert extract(page, weights) == want, page
        some += bool(want)
    assert some > 200


@pytest.mark.parametrize("piece", ['<a b="', "<a ", "<a \">\"", "<div></p>", "</script", "<!--", "<a '\"> \"", "<div>"])
def test_html_broken_markup_is_read_in_linear_time(piece):
    page = "some words " + piece * (1_000_000 // len(piece)) + "</p>" * 50_000
    began = time.perf_counter()
    extract(page, learn([LABELLED]))
    assert time.perf_counter() - began < 4


def test_html_rows_repeated_long_and_with_other_columns(spark):
    from lectern.llm.html_text import fit

    long = LABELLED.replace("three", "three " + "many words " * 200_000)
    rows = [(1, "u", LABELLED, "x", 1), (1, "u", LABELLED, "x", 1), (2, None, long, "y", 2), (3, "v", None, "z", 3), (None, "w", "<p>a b c", "z", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = {(r.page_id, r.url): r for r in main_texts(pages, fit(pages)).collect()}
    assert len(got) == 4 and got[1, "u"].text == WANT and got[3, "v"].text == "" and got[None, "w"].text == "a b c"
    assert got[2, None].n_chars == len(WANT) + len(" many words" * 200_000)


def test_html_region_is_the_best():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 9))]
        best = max((sum(s[a:b]) for a, b in itertools.combinations(range(len(s) + 1), 2)), default=0)
        a, b = best_region(s)
        assert sum(s[a:b]) == max(best, 0)


def test_html_table(spark, sf_dir):
    from lectern.llm.html_text import fit

    pages = table(spark, sf_dir, "pages")
    rows = main_texts(pages, fit(pages)).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) and r.text for r in rows)
    assert main_texts(pages.limit(0), fit(pages.limit(0))).count() == 0


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m.group())]
    return [f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


PII_EDGES = [
    None, "", "a.b@c.de", "é a@b.c_d@e.f..g@h.i x@y", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4", "4418452524842581 4418 4525 2484 2581 4418452524842582",
    "+1 (784) 555-8120 +12 +1234567890123456", "1 " * 3000, "1.1" * 2000, "a@" * 2000, "x" * 20000 + "@y.z", "DE89 3704 0044 0532 0130 00, GB82WEST12345698765432",
    "ssn 123-45-6789 but 123-45-6789-1", "@.+-", "9" * 5000, "+1" + "-2" * 6,
]


def test_personal_data_matches_brute_force(spark, sf_dir):
    docs = spark.createDataFrame(list(enumerate(PII_EDGES)), "doc_id long, text string")
    docs = docs.unionByName(table(spark, sf_dir, "documents").selectExpr("doc_id + 100 AS doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.report(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r.doc_id
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k + ":") for x in want) for k, _, _ in BASE)
        assert set(want) <= set(r.spans.split(","))
    by_id = {r.doc_id: r for r in rows}
    assert by_id[11].n_iban == 2 and by_id[12].n_ssn == 1
    assert pii.report(docs.limit(0)).count() == 0


def test_redaction_keeps_columns(spark):
    rows = [(1, "mail a.b@c.de, card 4418 4525 2484 2581.", "x"), (2, None, "y"), (3, "nothing", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["mail <EMAIL>, card <CARD>.", None, "nothing"]


def replaced(text, spans):
    """Spans (start, stop, kind) by start replaced from the left, overlapping ones as the first."""
    out, at = [], 0
    for start, stop, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def test_redaction_matches_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(PII_EDGES)), "doc_id long, text string")
    spans = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.report(docs).collect()}
    for r in pii.redact(docs).collect():
        text = PII_EDGES[r.doc_id]
        assert r.text == (text and replaced(text, [(int(a), int(b), k) for k, a, b in spans[r.doc_id]]))


def test_redaction_with_clashing_names(spark):
    rows = [(1, "a@b.cd", "kept", 2.5, [1], "x"), (None, None, None, None, None, None), (1, "a@b.cd", "kept", 2.5, [1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text string, `a.b` double, __pii array<int>, c1 string")
    out = pii.redact(df)
    assert out.schema == df.schema
    assert sorted(map(str, out.collect())) == sorted(str(r).replace("a@b.cd", "<EMAIL>") for r in df.collect())
    assert pii.redact(df.limit(0)).collect() == []


def test_many_addresses_in_one_text_take_linear_passes(spark):
    """1 MB of addresses: within the time only if no step is repeated for all earlier matches."""
    n = 70_000
    text = " ".join(f"a{i}@b{i % 7}.example" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    row = pii.report(df).first()
    assert row.n_email == n and row.spans.endswith(f":{len(text)}")
    assert pii.redact(df).first().text == " ".join(["<EMAIL>"] * n)
    assert time.perf_counter() - began < 20


def test_native_plans_have_no_python(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    for df in (pii.report(docs), quality.assess(docs, labels)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def toy_texts(n):
    import random

    rng = random.Random(n)
    plain = ["".join(rng.choices(["ba", "lo", "mi", "tu", "re", "sa"], k=rng.randint(1, 4))) for _ in range(400)]
    bad = ["grumblish", "snarkable", "vilecrow"]
    make = lambda marked: " ".join(rng.choice(bad) if marked and rng.random() < 0.08 else rng.choice(plain) for _ in range(120))
    return [make(True) for _ in range(60)], [make(False) for _ in range(120)]


def test_toxicity_tells_planted_words():
    toxic, ordinary = toy_texts(1)
    model = toxicity.fit_texts(toxic[:40], ordinary[:80], 0.3, toxicity.ToxicityModel())
    scorer = toxicity.Scorer(model)
    assert (scorer.scores(toxic[40:]) >= 0.5).mean() > 0.9 and (scorer.scores(ordinary[80:]) < 0.5).mean() > 0.9


def test_toxicity_learns_weak_marks_that_recur():
    import random

    def make(rng, plain, marks):
        words = rng.choices(plain, k=120) + ["vorklich" + rng.choice(plain) for _ in range(marks)]
        rng.shuffle(words)
        return " ".join(words)

    rng = random.Random(4)
    plain = ["".join(rng.choices(["ba", "lo", "mi", "tu", "re", "sa"], k=rng.randint(1, 4))) for _ in range(400)]
    # every toxic text has the mark, and so has one ordinary text of eight, once
    toxic = [make(rng, plain, rng.randint(6, 9)) for _ in range(150)]
    ordinary = [make(rng, plain, int(i % 8 == 0)) for i in range(300)]
    scorer = toxicity.Scorer(toxicity.fit_texts(toxic[:100], ordinary[:200], 0.3, toxicity.ToxicityModel()))
    assert (scorer.scores(toxic[100:]) >= 0.5).mean() > 0.9 and (scorer.scores(ordinary[200:]) < 0.5).mean() > 0.9


def test_toxicity_trains_on_every_ordinary_word(monkeypatch):
    toxic, ordinary = toy_texts(1)
    long = [" ".join([t] * 25) for t in ordinary]  # 240,000 words in the two thirds that train
    seen = {}

    def record(samples, size):
        seen.setdefault(size, sum(len(s.split()) for s in samples))
        return b" ".join(samples[:200])

    monkeypatch.setattr(toxicity, "_dictionary", record)
    monkeypatch.setattr(toxicity, "_speaks", lambda word, known: float("grumblish" in word))
    c = toxicity.ToxicityModel()
    toxicity.fit_texts(toxic, long, 0.3, c)
    assert seen[c.ordinary_bytes] == sum(len(t.split()) for t in long[:80])


@pytest.mark.parametrize("n", [1, 2, 5])
def test_toxicity_fits_few_labels(n):
    toxic, ordinary = toy_texts(1)
    model = toxicity.fit_texts(toxic[:n], ordinary[:n], 0.3, toxicity.ToxicityModel())
    scores = toxicity.Scorer(model).scores
    assert model.weights and scores(toxic[40:]).mean() > scores(ordinary[80:]).mean()
    if n == 5:
        assert (scores(toxic[40:]) >= 0.5).any()


def test_toxicity_table(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.unionByName(spark.createDataFrame([(None, None)], "doc_id long, text string"), allowMissingColumns=True), model).collect()
    assert len(rows) == docs.count() + 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in rows) - (rows[-1].predicted == 0)
    unlabelled = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, unlabelled).where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_scores_match_zstandard(spark):
    """Scores from compressing each window alone, on texts of many kinds."""
    import zstandard

    toxic, ordinary = toy_texts(1)
    model = toxicity.fit_texts(toxic[:40], ordinary[:80], 0.3, toxicity.ToxicityModel())
    c = model.config

    def size(content, window):
        d = zstandard.ZstdCompressionDict(content + toxicity.LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=c.level)
        z = zstandard.ZstdCompressor(level=c.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(z.compress(toxicity.LEAD + b" " + window.encode() + b" " + toxicity.TAIL))

    def brute(text):
        saved = []
        for w in (text or "").lower().split():
            for piece in (w[i : i + c.max_window_chars] for i in range(0, len(w), c.max_window_chars)):
                saved.append(min(max(size(model.ordinary, piece) - size(model.toxic, piece), 0), toxicity.LEVELS))
        x = [math.log1p(sum(v >= k for v in saved)) for k in range(2, 9)] + [max(saved, default=0) / 4, math.log1p(len(saved)), 1.0]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))

    texts = [None, "", " \n", "grumblish", "é" * 200, *toxic[40:44], *ordinary[80:84], "Snarkable " * 3]
    rows = [(i, t, "clash", 0.5, -1) for i, t in enumerate(texts)] + [(1, texts[5], "again", 0.5, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, score double, predicted int")
    got = sorted((r.doc_id, r.score) for r in toxicity.score(docs, model).collect())
    want = sorted((r[0], brute(r[1])) for r in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want, strict=True))
    kept = toxicity.keep_ordinary(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(p < 0.5 for _, p in want)
    # a text of a million words counts all of them
    long = " ".join(["balo"] * 1_000_000 + ["grumblish", "snarkable"] * 2_000)
    counts = toxicity.Scorer(model).compare.document(long)
    assert counts.sum() == 1_004_000 and counts[2:].sum() >= 2_000


def test_samples_are_bounded_and_deterministic(spark):
    from lectern.llm.tables import sample_rows

    rows = [(1, f"text {i} of one id", 0) for i in range(500)] + [(i, f"text of {i}", i % 2) for i in range(2, 60)] + [(2, None, 0), (3, "", 1)]
    df = spark.createDataFrame(rows, "id long, text string, toxic int")
    got = sample_rows(df, 20, 10_000)
    assert got == sample_rows(df.repartition(7, "text"), 20, 10_000) and len(got) == 20 == len({r.id for r in got})
    assert sum(len(r.text) for r in sample_rows(df, 1_000, 100)) <= 100
    assert sample_rows(df.limit(0), 5, 5) == []
    labels = spark.createDataFrame([(i, t) for i in range(40) for t in ([0, 1] if i % 4 == 0 else [i % 2])], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "vile " * 30 if i % 2 else "nice " * 30) for i in range(40)], "doc_id long, text string")
    again = labels.orderBy(F.desc("doc_id"), "toxic").repartition(3)
    assert toxicity.fit(docs, labels) == toxicity.fit(docs.repartition(5), again)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op5_personal_data", "op7_embedding_dedup"])
def test_oracles(spark, sf_dir, name):
    from lectern.llm import queries

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in con.description]
    want = sorted(map(str, con.fetchall()))
    got = queries.queries()[name](spark, sf_dir).select(*columns).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert oracles.OP1 and F


def test_language_logits_match_brute_force():
    """Buckets, averages, softmax and rejection worked out one n-gram at a time from the learned table."""
    texts = ["the cat sat on the mat", "le chat est là, très noir", "der Hund läuft schnell über die Straße", "x", "ÄÖÜ"]
    model = langid.fit_texts(texts[:3] * 8, ["en", "fr", "de"] * 8, langid.LanguageModel(bits=9, epochs=3, least_steps=60))
    c = model.config
    for text, (lang, score, accepted) in zip(texts, langid.predict_texts(texts, model), strict=True):
        raw, sums, n = f" {text.lower()} ".encode(), [0.0] * len(model.languages), 0
        for order in c.orders:
            for i in range(len(raw) - order + 1):
                key = order
                for b in raw[i : i + order]:
                    key = (key * 257 + b) % 2**32
                row = model.table[(key * 2654435761 % 2**32) >> (32 - c.bits)]
                sums, n = [s + float(x) for s, x in zip(sums, row, strict=True)], n + 1
        z = [s / max(n, 1) / model.temperature for s in sums]
        p = [math.exp(x - max(z)) for x in z]
        p = [x / sum(p) for x in p]
        assert lang == model.languages[p.index(max(p))] and score == pytest.approx(max(p), abs=1e-9) and accepted == (max(p) >= model.threshold)


def test_language_embeddings_follow_the_gradient():
    """One step of descent on one text, by differences of the loss."""
    c = langid.LanguageModel(bits=6, dim=3, epochs=1, least_steps=1, batch=1, rate=1.0)
    bag, weight = langid._bag("ab", c)
    rng = np.random.default_rng(1)
    emb, out = rng.normal(size=(64, 3)), rng.normal(size=(3, 2))
    loss = lambda e, o: -math.log(langid._softmax(weight @ e[bag] @ o)[1])
    grad = langid._softmax(weight @ emb[bag] @ out) - np.array([0.0, 1.0])
    for i, b in enumerate(bag):
        step = np.zeros_like(emb)
        step[b, 0] = 1e-6
        assert (loss(emb + step, out) - loss(emb - step, out)) / 2e-6 == pytest.approx(weight[i] * (grad @ out.T)[0], abs=1e-6)
