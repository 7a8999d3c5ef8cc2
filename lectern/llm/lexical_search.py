"""Ranked lexical search (operator 11): variable-block-max WAND over shards.

Index: each task inverts the documents it reads, some tens of thousands at a time,
so a shard is a row set made without a shuffle: one row a term with the places of
its documents in the shard and their impacts. The impact of a posting is the part
of the score that depends on the document. A list is cut into blocks by dynamic
programming over all cuts into blocks of at most ``longest_block`` postings: least
is the sum of what the block maxima overrate, plus ``block_cost`` for each block.

Search, exact in every shard: a block bounds the score between its first and last
document by weight times maximum, so the sum of an item's blocks is a step function
over the documents of the shard. WAND's test, whether the bounds at a document reach
the k-th best score so far, is made for all steps at once. The highest steps are
scored first; of the others only those that still reach the k-th best. In these, the
pivots are the documents of lists that can reach it; the blocks of the other lists
bound each pivot, and are opened, the strongest list first, only for pivots that can
still make it.

Statistics (documents with a term, terms altogether, documents of each term) come
from all documents. ``terms`` may restrict the index to the terms that will be
asked for, which changes no result.

Cases: null texts and texts without a term hold nothing and count nowhere; rows
that share an id are documents of their own, and each is ranked; a document without
an id ranks behind others of its score; items without an id are left out, and of
rows that share an item_id the least text counts; equal scores go by ascending id;
a text of any length is read whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.tables import slices
from lectern.plans.scratch import Scratch

#: Letters, digits and all bytes beyond ASCII make terms; A-Z are lower-cased.
_TERM_BYTES = bytes(b + 32 if chr(b).isalpha() and 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class LexicalSearch:
    k: int = 20
    #: Bounds of a shard.
    shard_docs: int = 32_768
    shard_postings: int = 6_000_000
    longest_block: int = 32
    #: What one more block costs, in units of impact.
    block_cost: float = 200_000.0
    items_a_block: int = 256
    #: Most distinct terms of the items that are broadcast; more are joined.
    broadcast_terms: int = 200_000
    #: Steps that are scored to get a first k-th best score.
    first_steps: int = 64


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TERM_BYTES).split()


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def statistics(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, their terms with repeats)."""
    is_term = np.frombuffer(_TERM_BYTES, dtype=np.uint8) != 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for b in slices(batches):
            for raw in _texts(b.column(0)):
                inside = is_term[np.frombuffer(raw or b"", dtype=np.uint8)]
                n = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[:1].sum())
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
        yield pa.RecordBatch.from_pydict({"n_docs": [n_docs], "n_terms": [n_terms]})

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "n_docs bigint, n_terms bigint")
    got = counted.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return int(got[0] or 0), int(got[1] or 0)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(i, t.decode(), n) for i, raw in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True) for t, n in Counter(terms_of(raw or b"")).items()]
            yield pa.RecordBatch.from_pydict(dict(zip(("item_id", "term", "times"), map(list, zip(*found, strict=True)), strict=True)) if found else {"item_id": pa.array([], pa.int64()), "term": pa.array([], pa.string()), "times": pa.array([], pa.int64())})

    single = items.where("item_id IS NOT NULL").groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.min(F.col("text").cast("string")).alias("text"))
    return single.mapInArrow(run, "item_id bigint, term string, times bigint")


def cut_blocks(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, longest: int, cost: float, together: int = 2_048) -> list[np.ndarray]:
    """Ends of the blocks of each list ``values[start : start + size]``, counted from its start.

    Of all cuts into blocks of at most ``longest`` values, one with the least sum
    of (block maximum - value) over all values plus ``cost`` a block. Many lists
    are cut at once: step j extends all lists that have a j-th value, and a slot
    holds one start of the block that value j ends.
    """
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(sizes)
    order = np.argsort(-sizes, kind="stable")
    slots = np.arange(longest)
    for at in range(0, len(order), together):
        lists = order[at : at + together]
        begin, size = starts[lists], sizes[lists]
        n = int(size[0])
        back = np.zeros((len(lists), n), dtype=np.int16)
        least = np.zeros(len(lists))
        high, total, base = np.zeros((len(lists), longest)), np.zeros((len(lists), longest)), np.full((len(lists), longest), np.inf)
        alive = np.searchsorted(-size, -np.arange(1, n + 1), side="right")
        for j in range(n):
            a, s = int(alive[j]), j % longest
            v = values[begin[:a] + j].astype(np.float64)
            high[:a, s], total[:a, s], base[:a, s] = v, 0.0, least[:a]
            np.maximum(high[:a], v[:, None], out=high[:a])
            total[:a] += v[:, None]
            length = (j - slots) % longest + 1
            whole = base[:a] + high[:a] * length - total[:a]
            pick = whole.argmin(axis=1)
            least[:a] = whole[np.arange(a), pick] + cost
            back[:a, j] = length[pick]
        ends, open_ = [[] for _ in lists], size.copy()
        live = np.flatnonzero(open_ > 0)
        while live.size:
            for k, e in zip(live.tolist(), open_[live].tolist(), strict=True):
                ends[k].append(e)
            open_[live] -= back[live, open_[live] - 1]
            live = live[open_[live] > 0]
        for k, e in zip(lists.tolist(), ends, strict=True):
            out[k] = np.array(e[::-1], dtype=np.int32)
    return out


def impact(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * times) // (1_000 * times + 12 * m)


def length_norm(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - 25 + (25 * n * n_docs) // n_terms


_INDEX = "shard bigint, term string, n_docs int, places array<int>, impacts array<int>, ends array<int>, highs array<int>, doc_ids array<bigint>"


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), pa.int32()), pa.array(flat, kind))


def build_index(docs: DataFrame, n_docs: int, n_terms: int, p: LexicalSearch, terms: frozenset[bytes] | None = None) -> DataFrame:
    """Shards of ``docs``: a row for each term, and one without a term that holds the shard's doc_ids in their order."""

    def shard(number: int, ids: list, norms: list[int], names: dict[bytes, int], term: list, place: list, times: list) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        term, place, times = (np.array(x, dtype=np.int64) for x in (term, place, times))
        impacts, place = impact(times, np.array(norms, dtype=np.int64)[place]), rank[place]
        by = np.lexsort((place, term))
        term, place, impacts = term[by], place[by].astype(np.int32), impacts[by].astype(np.int32)
        sizes = np.bincount(term, minlength=len(names))
        starts = np.cumsum(sizes) - sizes
        ends = cut_blocks(impacts, starts, sizes, p.longest_block, p.block_cost)
        words = list(names)
        for a in range(0, len(words), 4_096):
            some = [k for k in range(a, min(a + 4_096, len(words))) if sizes[k]]
            cut = [slice(starts[k], starts[k] + sizes[k]) for k in some]
            highs = [np.maximum.reduceat(impacts[c], np.concatenate(([0], ends[k][:-1]))) for k, c in zip(some, cut, strict=True)]
            columns = [_lists([place[c] for c in cut], pa.int32()), _lists([impacts[c] for c in cut], pa.int32()), _lists([ends[k] for k in some], pa.int32()), _lists(highs, pa.int32())]
            head = [pa.array([number] * len(some), pa.int64()), pa.array([words[k].decode() for k in some], pa.string()), pa.array(sizes[some], pa.int32())]
            yield pa.RecordBatch.from_arrays([*head, *columns, pa.nulls(len(some), pa.list_(pa.int64()))], names=names_of)
        none = [pa.nulls(1, pa.list_(pa.int32()))] * 4
        own = pa.array([[ids[k] for k in order]], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), *none, own], names=names_of)

    names_of = [c.split()[0] for c in _INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, norms, names, term, place, times = [], [], {}, [], [], []
        for b in slices(batches):
            for i, raw in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                found = terms_of(raw or b"")
                if not found:
                    continue
                counts = Counter(found)
                for t in counts if terms is None else terms.intersection(counts):
                    term.append(names.setdefault(t, len(names)))
                    place.append(len(ids))
                    times.append(counts[t])
                ids.append(i)
                norms.append(length_norm(len(found), n_docs, n_terms))
                if len(ids) >= p.shard_docs or len(term) >= p.shard_postings:
                    yield from shard(number, ids, norms, names, term, place, times)
                    number += 1
                    ids, norms, names, term, place, times = [], [], {}, [], [], []
        if ids:
            yield from shard(number, ids, norms, names, term, place, times)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, _INDEX)


@dataclass
class Posting:
    weight: int
    places: np.ndarray
    impacts: np.ndarray
    ends: np.ndarray
    highs: np.ndarray

    def __post_init__(self) -> None:
        self.begins = np.concatenate(([0], self.ends[:-1]))
        self.first, self.last = self.places[self.begins], self.places[self.ends - 1]
        self.most = self.weight * int(self.highs.max())

    def opened(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, impacts) of the blocks with a live place; ``seen``: live places before each place."""
        hit = seen[self.last + 1] > seen[self.first]
        if hit.all():
            return self.places, self.impacts
        begin, size = self.begins[hit], (self.ends - self.begins)[hit]
        own = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return self.places[own], self.impacts[own]

    def bounds(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, what it may add) at each place; between two blocks nothing."""
        block = np.minimum(np.searchsorted(self.last, places), len(self.last) - 1)
        return block, np.where((self.first[block] <= places) & (places <= self.last[block]), self.weight * self.highs[block], 0)

    def impacts_at(self, places: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
        return np.where(self.places[at] == places, self.weight * self.impacts[at], 0)


def _steps(postings: list[Posting]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, bound): the places between two block boundaries, and the sum of the blocks over them."""
    at = np.concatenate([y for x in postings for y in (x.first, x.last + 1)])
    change = np.concatenate([y for x in postings for y in (x.weight * x.highs, -x.weight * x.highs)]).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, bound = at[order], np.cumsum(change[order])
    step = np.flatnonzero(np.append(at[1:] != at[:-1], False) & (bound > 0))  # the last change at a place holds for it
    return at[step], at[step + 1], bound[step]


def _score_steps(postings: list[Posting], begin: np.ndarray, end: np.ndarray, n_places: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, postings opened) of the documents in the steps that score ``least`` or more.

    ``postings`` by rising maximum. Lists that even together stay below ``least``
    name no document; their blocks are opened only for documents of the other lists
    that still can reach it.
    """
    live = np.zeros(n_places + 1, dtype=np.int64)
    np.add.at(live, begin, 1)
    np.add.at(live, end, -1)
    live = np.cumsum(live)[:n_places] > 0
    seen = np.concatenate(([0], np.cumsum(live)))
    n_minor = int(np.searchsorted(np.cumsum([x.most for x in postings]), least))
    score, opened = np.zeros(n_places, dtype=np.int64), 0
    for x in postings[n_minor:]:
        places, impacts = x.opened(seen)
        opened += len(places)
        score[places] += x.weight * impacts
    places = np.flatnonzero(live & (score > 0))
    score = score[places]
    minor = postings[:n_minor][::-1]
    blocks = [x.bounds(places) for x in minor]
    rest = np.sum([b for _, b in blocks], axis=0) if minor else np.zeros(len(places), dtype=np.int64)
    left = np.arange(len(places))
    for x, (block, bound) in zip(minor, blocks, strict=True):
        keep = score[left] + rest[left] >= least
        left = left[keep]
        here = left[bound[left] > 0]
        opened += int((x.ends - x.begins)[np.unique(block[here])].sum())
        score[here] += x.impacts_at(places[here])
        rest[left] -= bound[left]
    left = left[score[left] >= least]
    return places[left], score[left], opened


def best_documents(postings: list[Posting], n_places: int, k: int, first_steps: int) -> tuple[list[tuple[int, int]], int]:
    """((place, score) of the k best, ties to the lower place; postings opened)."""
    postings = sorted((x for x in postings if x.weight > 0), key=lambda x: x.most)
    if not postings:
        return [], 0
    # a list of k blocks has k documents that reach its k-th highest block maximum
    least = max(1, *(x.weight * int(np.partition(x.highs, -k)[-k]) if len(x.highs) >= k else 1 for x in postings))
    begin, end, bound = _steps(postings)
    todo = np.argsort(-bound, kind="stable")
    found_at, found, opened = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    while todo.size:
        chosen = todo[:first_steps]
        todo, first_steps = todo[first_steps:], 1 << 62
        here, score, made = _score_steps(postings, begin[chosen], end[chosen], n_places, least)
        opened += made
        found_at, found = np.concatenate((found_at, here)), np.concatenate((found, score))
        if len(found) > k:
            best = np.lexsort((found_at, -found))[:k]
            found_at, found = found_at[best], found[best]
        if len(found) == k:
            least = max(least, int(found.min()))
        todo = todo[bound[todo] >= least]
    best = np.lexsort((found_at, -found))
    return list(zip(found_at[best].tolist(), found[best].tolist(), strict=True)), opened


def search(index: DataFrame, wanted: DataFrame, n_docs: int, p: LexicalSearch) -> DataFrame:
    """(item_id, rank, doc_id, score) of ``wanted`` (item_id, term, times) in a stored ``index``."""
    n_blocks = -(-wanted.select("item_id").distinct().count() // p.items_a_block) or 1
    postings = index.where("term IS NOT NULL")
    asked = wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int"))
    asked = asked.groupBy("term", "block").agg(F.collect_list(F.struct("item_id", "times")).alias("items"))
    few = asked.count() <= p.broadcast_terms
    asked = F.broadcast(asked) if few else asked
    df = postings.groupBy("term").agg(F.sum("n_docs").alias("df")).join(asked.select("term").distinct(), "term", "left_semi")
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighted = asked.join(df.select("term", weight.alias("weight")), "term")
    weighted = F.broadcast(weighted) if few else weighted
    sized = index.where("term IS NULL").select("shard", "doc_ids")
    rows = postings.join(weighted, "term").select("shard", "block", "weight", "items", "places", "impacts", "ends", "highs")
    schema = pa.schema([("shard", pa.int64()), ("item_id", pa.int64()), ("place", pa.int32()), ("score", pa.int64())])
    k, first_steps = p.k, p.first_steps

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        number = group.column("shard")[0].as_py()
        arrays = {}
        for name in ("places", "impacts", "ends", "highs"):
            column = group.column(name).combine_chunks()
            flat, cut = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            arrays[name] = [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        by_item: dict[int, list[Posting]] = {}
        for r, (w, items) in enumerate(zip(group.column("weight").to_pylist(), group.column("items").to_pylist(), strict=True)):
            base = Posting(w, arrays["places"][r].astype(np.int64), arrays["impacts"][r].astype(np.int64), arrays["ends"][r], arrays["highs"][r].astype(np.int64))
            for x in items:
                own = base if x["times"] == 1 else Posting(w * x["times"], base.places, base.impacts, base.ends, base.highs)
                by_item.setdefault(x["item_id"], []).append(own)
        n_places = 1 + max(int(x.places[-1]) for own in by_item.values() for x in own)
        found = [(number, i, place, score) for i, own in by_item.items() for place, score in best_documents(own, n_places, k, first_steps)[0]]
        return pa.table(list(zip(*found, strict=True)) if found else [[]] * 4, schema=schema)

    hits = rows.groupBy("shard", "block").applyInArrow(run, "shard bigint, item_id bigint, place int, score bigint")
    named = hits.join(sized, "shard").select("item_id", F.get("doc_ids", F.col("place")).alias("doc_id"), "score")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, scratch: Scratch, p: LexicalSearch = LexicalSearch()) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    n_docs, n_terms = statistics(docs)
    wanted = scratch.save(item_terms(items), "items")
    names = wanted.select("term").distinct().limit(p.broadcast_terms + 1).collect()
    terms = frozenset(r.term.encode() for r in names) if len(names) <= p.broadcast_terms else None
    index = scratch.save(build_index(docs, n_docs, n_terms, p, terms), "index")
    return search(index, wanted, n_docs, p)
