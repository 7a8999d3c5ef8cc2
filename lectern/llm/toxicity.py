"""Toxicity by compression distance (operator 6).

Two zstandard dictionaries are trained, one on ordinary text and one on the text
of toxic documents. Each window of a text is compressed with both;
it speaks for the class whose dictionary makes it shorter. How many windows of a
document lie how many bytes apart is weighed by a calibrated logistic threshold.

A window is one word (``window_words``). On its own it would be stored raw, so it
is compressed between a lead-in that both dictionaries hold and a fixed tail,
which keeps the frames in the compressed form and their lengths comparable.
The words of toxic documents are drawn for training by how much their beginnings
speak for toxic documents: there is no least share or ratio, so weak marks that
recur are trained on beside the strong ones, and the threshold decides what they
are worth. Ordinary words that the toxic dictionary shortens although nothing in
them speaks for toxic documents are added to the ordinary samples, whose
dictionary is trained again.

The model is fitted on a bounded sample of labelled rows (``toxic_docs`` and
``ordinary_docs`` texts of at most ``max_chars`` characters, those whose ids hash
lowest); scoring covers every window of every text.

Cases: null and empty texts have no window and get the score of that; without
sample texts of both classes, or if no beginning is more common in toxic ones, the
score is the share of toxic labels, at most 0.49; any other sample is fitted,
however small, and one text of a class both trains and calibrates;
an id that repeats gives one text, and one with both labels none; equal texts get
equal scores, and a score of just one half is toxic; an empty table gives an empty
result; other columns pass :func:`keep_ordinary` untouched, whatever their names.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tables import sample_rows, slices

LEAD = bytes(range(1, 9)) + bytes(range(14, 26))
TAIL = bytes(range(26, 32)) + b"\x7f\x02\x04"
LEVELS = 12  # differences are told apart up to this many bytes


@dataclass(frozen=True)
class ToxicityModel:
    toxic_docs: int = 1_500
    ordinary_docs: int = 3_000
    #: Characters of a sample text, and of all together.
    max_chars: int = 50_000
    sample_chars: int = 60_000_000
    #: Words drawn from toxic documents to train on.
    drawn_words: int = 36_000
    window_words: int = 1
    max_window_chars: int = 64
    ordinary_bytes: int = 16_384
    toxic_bytes: int = 4_096
    level: int = 12
    cache_windows: int = 250_000


@dataclass(frozen=True)
class Fitted:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    prior: float
    config: ToxicityModel


def windows(text: str, c: ToxicityModel) -> list[str]:
    words = text.lower().split()
    if c.window_words > 1:
        words = [" ".join(words[i : i + c.window_words]) for i in range(0, len(words), c.window_words)]
    if any(len(w) > c.max_window_chars for w in words):
        words = [w[i : i + c.max_window_chars] for w in words for i in range(0, len(w), c.max_window_chars)]
    return words


class Comparer:
    """Bytes that the toxic dictionary saves over the ordinary one, window by window."""

    def __init__(self, ordinary: bytes, toxic: bytes, c: ToxicityModel):
        self.c, self.cache = c, {}
        self._ordinary, self._toxic = self._compressor(ordinary), self._compressor(toxic)

    def _compressor(self, content: bytes):
        d = zstandard.ZstdCompressionDict(content + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=self.c.level)
        return zstandard.ZstdCompressor(
            level=self.c.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
        ).compress

    def saved(self, window: str) -> int:
        raw = LEAD + b" " + window.encode("utf-8", "replace") + b" " + TAIL
        return len(self._ordinary(raw)) - len(self._toxic(raw))

    def document(self, text: str | None) -> np.ndarray:
        """How many windows differ by 0 or less, 1, 2, ... bytes."""
        cache, levels = self.cache, []
        for w in windows(text, self.c) if text else []:
            got = cache.get(w)
            if got is None:
                got = cache[w] = min(max(self.saved(w), 0), LEVELS)
            levels.append(got)
        if len(cache) > self.c.cache_windows:
            cache.clear()
        return np.bincount(np.array(levels, dtype=np.int64), minlength=LEVELS + 1)


def features(counts: np.ndarray) -> np.ndarray:
    """Rows of counts -> how many windows reach each difference, how large the largest is, how many there are."""
    reach = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    top = (reach > 0).sum(axis=1) - 1
    return np.column_stack((np.log1p(reach[:, 2:9]), np.maximum(top, 0) / 4, np.log1p(reach[:, 0]), np.ones(len(counts))))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b" ".join(dict.fromkeys(samples))[-size:]


def _beginnings(word: str) -> set[bytes]:
    b = word.encode()
    return {b[:k] for k in (4, 5, 6) if len(b) >= k} or {b}


def _document_counts(texts: list[str]) -> Counter:
    n: Counter = Counter()
    for t in texts:
        n.update(set().union(*map(_beginnings, set(re.findall(r"\w+", t.lower())))))
    return n


def evidence(toxic: list[str], ordinary: list[str]) -> dict[bytes, float]:
    """Weight of each beginning that has a larger share of toxic than of ordinary documents.

    The weight is its share of toxic documents times the squared log of the ratio of shares.
    """
    t, o = _document_counts(toxic), _document_counts(ordinary)
    ratio = {g: n / len(toxic) * (len(ordinary) + 0.5) / (o[g] + 0.5) for g, n in t.items()}
    return {g: t[g] / len(toxic) * math.log(r) ** 2 for g, r in ratio.items() if r > 1}


def _speaks(word: str, known: dict[bytes, float]) -> float:
    return max(known.get(g, 0.0) for g in _beginnings(word))


def toxic_words(toxic: list[str], known: dict[bytes, float]) -> dict[str, float]:
    """Every word of toxic documents that has evidence -> its occurrences times its evidence."""
    n = Counter(w for t in toxic for w in re.findall(r"\w+", t.lower()))
    return {w: n[w] * e for w in sorted(n) if (e := _speaks(w, known)) > 0}


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for ridge logistic regression with row weights; the last column is not shrunk."""
    beta, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (w * q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hess, x.T @ (w * (y - q)) - shrink * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_texts(toxic: list[str], ordinary: list[str], prior: float, c: ToxicityModel) -> Fitted:
    empty = Fitted(b"", b"", (), prior, c)
    if not toxic or not ordinary:
        return empty
    rng = random.Random(11)
    third = lambda x: (x[: len(x) * 2 // 3], x[len(x) * 2 // 3 :]) if len(x) > 1 else (x, x)
    (t_fit, t_cal), (o_fit, o_cal) = third(toxic), third(ordinary)
    known = evidence(t_fit, o_fit)
    marked = toxic_words(t_fit, known)
    if not marked:
        return empty
    drawn = rng.choices([w.encode() for w in marked], list(marked.values()), k=c.drawn_words)
    toxic_samples = [b" " + b" ".join(drawn[i : i + 12]) + b" " for i in range(0, len(drawn), 12)]
    # the more a word speaks for toxic documents, the fewer of its places train the ordinary dictionary
    places = Counter(w for x in o_fit for w in windows(x, c))
    speaks = {w: _speaks(w, known) for w in places}
    plain = [f" {w} ".encode() for w, n in places.items() for _ in range(n) if rng.random() < math.exp(-20 * speaks[w])]
    rng.shuffle(plain)
    ordinary_samples = [b"".join(plain[i : i + 4]) for i in range(0, len(plain), 4)]
    toxic_dict = _dictionary(toxic_samples, c.toxic_bytes)
    ordinary_dict = _dictionary(ordinary_samples, c.ordinary_bytes)
    for _ in range(2):
        compare = Comparer(ordinary_dict, toxic_dict, c)
        hard = [f" {w} ".encode() for w in places if not speaks[w] and compare.saved(w) >= 3]
        if not hard:
            break
        rng.shuffle(hard)
        ordinary_samples += [b"".join(hard[i : i + 4]) for i in range(0, len(hard), 4)] * 8
        ordinary_dict = _dictionary(ordinary_samples, c.ordinary_bytes)
    compare = Comparer(ordinary_dict, toxic_dict, c)
    x = features(np.array([compare.document(t) for t in t_cal + o_cal]))
    y = np.repeat([1.0, 0.0], [len(t_cal), len(o_cal)])
    share = np.where(y == 1, prior / len(t_cal), (1 - prior) / len(o_cal)) * len(y)
    return Fitted(ordinary_dict, toxic_dict, tuple(_logistic(x, y, share).tolist()), prior, c)


def fit(docs: DataFrame, labels: DataFrame, c: ToxicityModel = ToxicityModel()) -> Fitted:
    """Learns from labelled rows whose crc32 of the id is no multiple of five."""
    # an id with both labels says nothing
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").alias("id"))
    known = known.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    known = known.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    share = known.agg(F.avg("toxic")).first()[0]
    order = [F.xxhash64("id"), F.col("id")]
    sides = [known.where(F.col("toxic") == k).orderBy(*order).limit(n) for k, n in ((1, c.toxic_docs), (0, c.ordinary_docs))]
    picked = F.broadcast(sides[0].unionByName(sides[1]))  # at most toxic_docs + ordinary_docs ids
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= c.max_chars)
    sample = sample_rows(rows.join(picked, "id"), c.toxic_docs + c.ordinary_docs, c.sample_chars)
    found = sorted((r.id, r.toxic, r.text) for r in sample)
    random.Random(7).shuffle(found)
    texts = {k: [t for _, label, t in found if label == k] for k in (0, 1)}
    return fit_texts(texts[1], texts[0], min(max(share or 0.0, 0.01), 0.49), c)


class Scorer:
    def __init__(self, model: Fitted):
        self.model = model
        self.compare = Comparer(model.ordinary, model.toxic, model.config) if model.weights else None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.compare:
            return np.full(len(texts), self.model.prior)
        counts = np.array([self.compare.document(t) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(features(counts) @ np.array(self.model.weights), -30, 30)))


def score(docs: DataFrame, model: Fitted) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores(b.column(1).to_pylist()))], names=["doc_id", "score"])

    src = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    out = src.mapInArrow(run, "doc_id bigint, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, model: Fitted) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in slices(batches):
            yield b.filter(pa.array(scorer.scores(b.column(at).to_pylist()) < 0.5))

    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
