"""Best-fit packing by minimum bin slack (operator 9).

Pieces of one length are interchangeable, so the plan is made on the histogram
of lengths, which has at most ``capacity`` entries however many documents there
are. For each bin, the largest length left is taken and a bitset subset-sum over
the lengths left finds the fullest way to fill the remainder; the combination is
removed as often as the histogram allows. Pieces then find their place by their
rank among the pieces of their length: the rank is a count within the task that
made the piece plus the counts of the tasks before it, so no task ever holds all
pieces of one length.

Cases: null and empty texts give one piece, the closing id; a null id is packed like
any other; rows that repeat or share an id are packed each; a text of any length is
cut into pieces and read whole; pieces of one length are placed in the order of the
input; an empty table gives an empty result; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bpe import Encoder, vocabulary
from lectern.llm.tables import slices
from lectern.plans.scratch import Scratch

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]
    + [("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())]
)


def token_pieces(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every (doc_id, text), ``end_id`` appended.

    A null text is empty and gives one piece of one id. Of a longer document the
    first piece may be shorter, the others are full. ``nth`` counts the earlier
    pieces of the same length in the same task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(vocabulary(path)), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in slices(batches):
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                n = len(raw) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    rows.append((doc, piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), task, seen[size]))
                    seen[size] += 1
                    at, piece = at + size, piece + 1
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=SCHEMA)

    return df.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of the available lengths with the largest sum that is at most ``room``."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for x in sorted((x for x, n in available.items() if n and x <= room), reverse=True):
        steps.append((x, reach))
        for _ in range(min(available[x], room // x)):
            grown = reach | (reach << x) & mask
            if grown == reach:
                break
            reach = grown
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, {}
    for x, before in reversed(steps):
        n = 0
        while not before >> left & 1:
            left, n = left - x, n + 1
        if n:
            chosen[x] = n
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, number of bins filled so) until all lengths are used."""
    left = {x: n for x, n in counts.items() if n}
    if any(not 0 < x <= capacity for x in left):
        raise ValueError("lengths must be from 1 to the capacity")
    plan = []
    while left:
        top = max(left)
        left[top] -= 1
        combo = fullest(left, capacity - top)
        left[top] += 1
        combo[top] = combo.get(top, 0) + 1
        times = min(left[x] // n for x, n in combo.items())
        plan.append((combo, times))
        for x, n in combo.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies a bin, first bin, first offset), sorted."""
    used: dict[int, int] = {}
    rows, bins = [], 0
    for combo, times in plan:
        offset = 0
        for x in sorted(combo, reverse=True):
            rows.append((x, used.get(x, 0), combo[x], bins, offset))
            used[x] = used.get(x, 0) + combo[x] * times
            offset += x * combo[x]
        bins += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to what :func:`token_pieces` made."""
    pieces = scratch.save(pieces, "pieces")
    by_task = scratch.save(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    totals = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(minimum_bin_slack(totals, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = (places[:, 0] << 40) + places[:, 1]
        for b in batches:
            size, rank = b["length"].to_numpy(), b.pop("rank").to_numpy()
            row = places[np.searchsorted(keys, (size << 40) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield b.assign(sequence_id=row[:, 3] + nth // row[:, 2], offset=row[:, 4] + nth % row[:, 2] * size)

    ranked = pieces.join(base, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank")
    )
    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInPandas(run, out)


def pack_documents(df: DataFrame, path: str, scratch: Scratch, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Packs every (doc_id, text) of ``df``; an empty table packs into nothing.

    Ties between pieces of one length are settled by their place in the input.
    Repeated rows are packed each.
    """
    return pack(token_pieces(df, path, capacity, end_id), scratch, capacity)
