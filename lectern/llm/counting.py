"""Token counts by the whole-token shortcut (operator 10).

Once a process, every vocabulary string is put through the pre-tokenizer and the
merges: the strings that are one pre-token and end as one id form the proven
table. A pre-token in that table counts one without being merged; only the rest
is merged, with a bounded cache.

Cases: a null text has no bytes and no tokens, like an empty one; special strings
count as their one special id; a text of any length is counted whole; a text of just
the limit is not over it; rows that repeat, share an id or have none are counted each;
an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import Encoder, Vocabulary, vocabulary
from lectern.llm.tables import slices

_PROVEN: dict[str, frozenset[str]] = {}


def whole_tokens(vocab: Vocabulary) -> frozenset[str]:
    """Strings proven to encode alone as one token."""
    texts = []
    for i, raw in enumerate(vocab.token_bytes):
        try:
            t = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if t and t not in vocab.special and vocab.pretokens(t) == [t]:
            texts.append(t)
    _, counts = vocab.encode_pieces([t.encode() for t in texts])
    return frozenset(t for t, n in zip(texts, counts.tolist(), strict=True) if n == 1)


def proven(path: str) -> frozenset[str]:
    if path not in _PROVEN:
        _PROVEN[path] = whole_tokens(vocabulary(path))
    return _PROVEN[path]


class _Rest(Encoder):
    """Sees only the pre-tokens outside the proven table."""

    def __init__(self, vocab: Vocabulary, whole: frozenset[str]):
        self.whole, self.direct = whole, []
        super().__init__(vocab)

    def _words(self, text: str) -> list:
        every = super()._words(text)
        rest = [w for w in every if w not in self.whole]
        self.direct.append(len(every) - len(rest))
        return rest


def token_counts(df: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``df`` (doc_id, text).

    Repeated rows are counted each; an empty table gives an empty result; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = _Rest(vocabulary(path), proven(path))
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            merged = list(rest.count(texts))
            direct, rest.direct = iter(rest.direct), []
            n = [m + (next(direct) if t else 0) for m, t in zip(merged, texts, strict=True)]
            columns = [b.column(0), b.column(2), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])

    src = df.select(
        F.col("doc_id").cast("bigint"),
        F.col("text").cast("string"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    out = src.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
