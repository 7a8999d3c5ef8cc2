"""Language identification (operator 2).

Hashed byte n-grams of the lower-cased text have embeddings, a document is their
average, and a linear softmax over that average gives the language. Embeddings
and weights are trained together by stochastic gradient descent in numpy on a
bounded sample of labelled rows. As both layers are linear, the product of the
two tables is scored: a document's logits are the average of the rows its n-grams
hash to.

Probabilities are calibrated by a temperature, and ``accepted`` tells whether the
best one reaches a threshold below which held-back training rows were too often
wrong.

Cases: a text that is null or holds no letter is ``und`` with score 0 and not
accepted; equal texts get equal results and of equal probabilities the language
that sorts first wins; without any labelled row every text is
``und``; an empty table gives an empty result; other columns are not read. A text
is scored whole, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.tables import fetch_rows, row_keys, slices

_LETTER = regex.compile(r"\p{L}")
_MULTIPLIER = np.uint32(2654435761)
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    #: Rows of the sample, and their characters altogether.
    max_rows: int = 4_000
    sample_chars: int = 30_000_000
    bits: int = 14
    orders: tuple[int, ...] = (2, 3, 4)
    dim: int = 16
    #: Passes over the sample, and steps that small samples get at least.
    epochs: int = 12
    least_steps: int = 1_200
    batch: int = 32
    rate: float = 2.0
    accepted_precision: float = 0.99
    block_bytes: int = 1 << 20


@dataclass(frozen=True)
class FittedLanguages:
    languages: tuple[str, ...]
    table: np.ndarray
    temperature: float
    threshold: float
    config: LanguageModel


def buckets(raw: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte."""
    n = raw.size - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int32)
    key = np.full(n, order, dtype=np.uint32)
    for k in range(order):
        key = key * np.uint32(257) + raw[k : k + n]
    return ((key * _MULTIPLIER) >> np.uint32(32 - bits)).astype(np.int32)


def text_bytes(text: str) -> np.ndarray:
    return np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8)


def averages(text: str, table: np.ndarray, c: LanguageModel) -> np.ndarray:
    """Average row of ``table`` over the n-grams of the whole text."""
    raw = text_bytes(text)
    total, n = np.zeros(table.shape[1]), 0
    for at in range(0, raw.size, c.block_bytes):
        for order in c.orders:  # n-grams that begin in this block
            got = buckets(raw[at : at + c.block_bytes + order - 1], order, c.bits)
            total += np.bincount(got, minlength=len(table)) @ table if got.size > 4 * len(table) else table[got].sum(axis=0)
            n += got.size
    return total / max(n, 1)


def _bag(text: str, c: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    raw = text_bytes(text)
    got, n = np.unique(np.concatenate([buckets(raw, o, c.bits) for o in c.orders]), return_counts=True)
    return got, n / max(n.sum(), 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_texts(texts: list[str], langs: list[str], c: LanguageModel) -> FittedLanguages | None:
    languages = tuple(sorted(set(langs)))
    if not languages:
        return None
    rng = np.random.default_rng(5)
    y = np.searchsorted(languages, langs)
    bags = [_bag(t, c) for t in texts]
    order = rng.permutation(len(texts))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    emb = rng.normal(0, 0.1, (1 << c.bits, c.dim))
    out = np.zeros((c.dim, len(languages)))
    epochs = max(c.epochs, -(-c.least_steps * c.batch // max(len(train), 1)))
    for epoch in range(epochs):
        rate = c.rate * (1 - epoch / epochs)
        train = rng.permutation(train)
        for i in range(0, len(train), c.batch):
            rows = train[i : i + c.batch]
            mean = np.stack([w @ emb[b] for b, w in (bags[r] for r in rows)])
            grad = _softmax(mean @ out)
            grad[np.arange(len(rows)), y[rows]] -= 1
            back = grad @ out.T
            out -= rate / len(rows) * (mean.T @ grad)
            for (b, w), g in zip((bags[r] for r in rows), back, strict=True):
                emb[b] -= rate * np.outer(w, g)
    table = emb @ out
    if not len(held):
        return FittedLanguages(languages, table, 1.0, 0.5, c)
    logits = np.stack([w @ table[b] for b, w in (bags[r] for r in held)])
    grid = np.exp(np.linspace(-3, 3, 61))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y[held]
    # the lowest score from which on held-back rows are right often enough
    by_score = np.argsort(-best)
    precise = np.flatnonzero(np.cumsum(right[by_score]) / np.arange(1, len(held) + 1) >= c.accepted_precision)
    threshold = float(best[by_score[precise[-1]]]) if precise.size else 1.0
    return FittedLanguages(languages, table, temperature, threshold, c)


def fit(docs: DataFrame, c: LanguageModel = LanguageModel()) -> FittedLanguages | None:
    """Learns from labelled rows whose crc32 of the id is not 2 modulo 4, the lowest hashes of each language.

    Languages take turns, so each gives as many rows as any other or all it has. An
    id that repeats gives one text for each language it is labelled with. Texts are
    taken whole; one that would go beyond ``sample_chars`` is passed over.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2))
    keys = row_keys(rows)
    for by in (["lang", F.pmod("h", F.lit(256))], ["lang"]):  # lowest of each share first: no task sorts a whole language
        keys = keys.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))).where(F.col("turn") <= c.max_rows)
    picked = keys.orderBy("turn", "h", "id", "lang").limit(c.max_rows).collect()
    sample = sorted((r.id, r.lang, r.text) for r in fetch_rows(rows, picked, c.sample_chars))
    return fit_texts([t for _, _, t in sample], [lang for _, lang, _ in sample], c)


def predict_texts(texts: list[str | None], m: FittedLanguages | None) -> list[tuple[str, float, bool]]:
    out = []
    for t in texts:
        if m is None or not t or not _LETTER.search(t):
            out.append((UNKNOWN, 0.0, False))
            continue
        p = _softmax(averages(t, m.table, m.config) / m.temperature)
        k = int(p.argmax())
        out.append((m.languages[k], float(p[k]), bool(p[k] >= m.threshold)))
    return out


def predict(docs: DataFrame, model: FittedLanguages | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) for every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score, accepted = zip(*predict_texts(b.column(1).to_pylist(), model), strict=True)
            columns = [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "accepted"])

    src = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    out = src.mapInArrow(run, "doc_id bigint, lang_pred string, score double, accepted boolean")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
