"""BPE encoding and decoding by forced boundaries (operator 3).

The merging itself is in :mod:`lectern.llm.bpe`. A null text is an empty one and
has no ids; special strings inside a text become their special id, as the
tokenizers library does by default; rows that repeat are encoded each; only the
two named columns are read, so other columns may have any name; an empty table
gives an empty result. A text is encoded whole, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import Encoder, vocabulary
from lectern.llm.tables import slices


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as little-endian unsigned 32-bit integers in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for b in slices(batches):
            ids = [x.astype("<u4").tobytes() for x in encoder.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    src = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = dict(src.dtypes)["key"]
    return src.mapInArrow(run, f"key {kind}, ids binary").withColumnRenamed("key", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of what :func:`encode` made; special ids give their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in slices(batches):
            texts = [vocab.decode(np.frombuffer(x or b"", dtype="<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    src = df.select(F.col(id_col).alias("key"), F.col(ids_col).alias("ids"))
    kind = dict(src.dtypes)["key"]
    return src.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", id_col)


def round_trip_digests(df: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes each text in one pass; digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder = Encoder(vocab)
        for b in slices(batches):
            counts, ids_sha, text_sha = [], [], []
            for ids in encoder.encode(b.column(1).to_pylist()):
                counts.append(ids.size)
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(vocab.decode(ids).encode("utf-8")).hexdigest())
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return df.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, out)
