"""Vector functions on array columns; sums are taken in double precision.

A null or empty vector, vectors of different lengths and a zero norm give a
similarity of 0, never NULL or NaN.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lectern.plans.scratch import workers_import_package


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (scale > 0)
    return F.when(usable, dot(a, b) / scale).otherwise(F.lit(0.0))


def bucket_of(token: str, dim: int) -> int:
    """Bucket of a token: the first eight hex digits of its md5, modulo ``dim``."""
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % dim


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` with those of ``b``: the product over that of the lengths, 0 for a length of 0.

    Products of counts are whole numbers, so that those cosines are the same however they are summed.
    """
    sides = [np.sqrt((x * x).sum(axis=1)) for x in (a, b)]
    sims, scale = a @ b.T, np.outer(*sides)
    np.divide(sims, scale, out=sims, where=scale > 0)
    return sims


def hash_embedding(df: DataFrame, key: list[str], tokens: str, dim: int = 64) -> DataFrame:
    """(key, embedding): token counts by bucket as an array<double> of ``dim``; no tokens give zeros.

    One row for each row of ``df``, without a shuffle. Each different token of an Arrow
    batch is hashed once, and the buckets of all its rows are counted together.
    """
    workers_import_package(df.sparkSession)
    schema = StructType([*df.select(*key).schema.fields, StructField("embedding", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(len(key)).fill_null([])
            coded = column.flatten().drop_null().dictionary_encode()
            sizes = pc.list_value_length(column).to_numpy()
            if column.flatten().null_count:
                sizes = np.array([sum(t is not None for t in row) for row in column.to_pylist()])
            place = np.array([bucket_of(t, dim) for t in coded.dictionary.to_pylist()], dtype=np.int64)
            row = np.repeat(np.arange(b.num_rows), sizes)
            counts = np.bincount(row * dim + place[coded.indices.to_numpy()], minlength=b.num_rows * dim) if row.size else np.zeros(b.num_rows * dim)
            offsets = pa.array(np.arange(b.num_rows + 1) * dim, pa.int32())
            embedding = pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(key))], embedding], names=[*key, "embedding"])

    return df.select(*key, F.col(tokens).cast("array<string>").alias("_tokens")).mapInArrow(run, schema)


def centroid(df: DataFrame, key: str, vector: str, n_dims: str = "pos") -> DataFrame:
    """(key, pos, value): mean of each dimension, then scaled to length one; a zero mean stays as it is."""
    mean = df.select(key, F.posexplode(_double(F.col(vector))).alias("pos", "v")).groupBy(key, "pos").agg(F.avg("v").alias("v"))
    length = mean.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    scaled = F.when(F.col("length") > 0, F.col("v") / F.col("length")).otherwise(F.col("v"))
    return mean.join(length, key).select(key, F.col("pos").alias(n_dims), scaled.alias("value"))


def named_cosines(named: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cosine): ``named`` pairs (a, b) of which both are in ``vectors`` (id, embedding), to four places."""
    sides = [vectors.select(F.col("id").alias(k), F.col("embedding").alias(f"v{k}")) for k in "ab"]
    joined = named.join(sides[0], "a").join(sides[1], "b")
    return joined.select("a", "b", F.format_string("%.4f", F.round(cosine(F.col("va"), F.col("vb")), 4) + F.lit(0.0)).alias("cosine"))
