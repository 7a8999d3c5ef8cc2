"""Spelling variants of a corpus' words (operator 12): merging errata tries.

The words form a trie; its nodes are prefixes, kept as rows. Of each node that
branches, the child with most words below it continues the heavy path, all others
are light. Two words that differ by one edit part at one node, that of their
longest common prefix, and there at most one of them is on the heavy path. So
only words of light subtrees move (small-to-large: a word has at most as many light
edges as the number of words has binary digits), and each is merged in three forms:

* its branching character replaced by any other: light words of a node whose rests
  coincide form one terminal, and the heavy child's rest is met by a join;
* its branching character skipped: the rest coincides with a word below the node,
  unless it goes on with the skipped character, as then the two part further down;
* the heavy child's character put before it: it coincides with a heavy word of which
  that character is skipped.

Every pair of near words is met exactly once. Terminals of replaced characters are
counted and ranked whole, and hold at most one word for each character. A node is
named by a hash of its prefix: should two nodes share a name, they share a heavy
child, and any choice of it gives the same pairs.

Cases: null texts have no words; rows that share an id are documents of their own; a
null id is written as nothing before the colon; words of any length are handled (a
node's row does not hold its prefix); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tables import slices
from lectern.plans.scratch import Scratch

#: Latin-1 bytes: A-Z are lower-cased, a-z and 0xC0 to 0xFF stay, all else parts words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_MIX, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


@dataclass(frozen=True)
class Spelling:
    shortest: int = 6
    least: int = 5
    #: A form is that many times as frequent as its variant.
    ratio: int = 5
    #: One run in so many loses a character.
    damage: int = 199
    #: Words and characters that a task counts before it passes them on.
    held_words: int = 200_000
    held_chars: int = 16_000_000


def runs_of(text: str) -> list[bytes]:
    """Runs of letters, one Latin-1 byte a code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def damaged(word: bytes, prefix: int, p: Spelling) -> bytes:
    """``word`` less one code point where the checksum of document and word asks for it."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
    if h % p.damage:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def count_words(docs: DataFrame, p: Spelling) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        chars = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in slices(batches, 100):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(b"%s:" % ("" if i is None else str(i)).encode())
                for word, n in Counter(runs_of(text or "")).items():
                    if len(word) >= p.shortest:
                        word = damaged(word, prefix, p)
                        if len(word) >= p.shortest:
                            if word not in held:
                                chars += len(word)
                            held[word] += n
                if len(held) >= p.held_words or chars >= p.held_chars:
                    yield flush()
                    held, chars = Counter(), 0
        yield flush()

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= p.least)


def trie_edges(words: DataFrame) -> DataFrame:
    """(id, depth, node, branch): a row for each node on a word's way, and the character by which it goes on ('' at its end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2_000):
            ids, depths, nodes, branches = [], [], [], []
            for i, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                node = 1
                for depth, c in enumerate([*word, ""]):
                    ids.append(i)
                    depths.append(depth)
                    nodes.append(node - (1 << 63))
                    branches.append(c)
                    if c:
                        node = (node ^ ord(c)) * _MIX & _MASK
                        node ^= node >> 29
                if len(ids) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(depths, pa.int32()), pa.array(nodes, pa.int64()), pa.array(branches, pa.string())], names=names)
                    ids, depths, nodes, branches = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(depths, pa.int32()), pa.array(nodes, pa.int64()), pa.array(branches, pa.string())], names=names)

    names = ["id", "depth", "node", "branch"]
    return words.select("id", "word").mapInArrow(run, "id bigint, depth int, node bigint, branch string")


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n_near, near, near_n) of the words that have near ones, from (id, word, n); near: the most frequent."""
    edges = scratch.save(trie_edges(words), "edges")
    children = edges.groupBy("node", "branch").agg(F.count("*").alias("below"))
    heaviest = F.max_by("branch", F.struct((F.col("branch") != "").alias("goes_on"), "below", "branch"))
    paths = scratch.save(children.groupBy("node").agg(heaviest.alias("heavy"), F.count("*").alias("k")).where("k > 1").select("node", "heavy"), "paths")
    light = edges.join(paths, "node").where("branch <> heavy").select("id", "depth", "branch", "heavy").join(words, "id")
    rest = light.select(
        "word", "n", "branch", F.expr("left(word, depth)").alias("head"), "heavy", F.expr("substring(word, depth + 1)").alias("tail"), F.expr("substring(word, depth + 2)").alias("after")
    )
    rest = scratch.save(rest, "light")
    inner = F.col("branch") != ""
    forms = F.array(
        F.when(inner, F.concat("head", "heavy", "after")),
        F.when(inner & (F.substring("after", 1, 1) != F.col("branch")), F.concat("head", "after")),
        F.concat("head", "heavy", "tail"),
    )
    met = rest.select("word", "n", F.explode(forms).alias("other")).where("other IS NOT NULL")
    met = met.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    both = F.explode(F.array(F.struct(F.col("word").alias("w"), F.col("other").alias("near"), F.col("other_n").alias("near_n")), F.struct(F.col("other").alias("w"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    single = met.select(both.alias("x")).select(F.col("x.w").alias("word"), F.lit(1).alias("c"), (-F.col("x.near_n")).alias("m"), F.col("x.near").alias("near"))
    # a terminal holds one word for each character at most
    terminal = rest.where(inner).groupBy(F.concat("head", F.lit("*"), "after").alias("terminal")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))).alias("all")).where("size(all) > 1")
    first = F.col("all")[0]
    best = F.when(first.word == F.col("own.word"), F.col("all")[1]).otherwise(first)
    shared = terminal.select(F.explode("all").alias("own"), "all").select("own.word", F.size("all").alias("c"), best.alias("best"))
    shared = shared.select("word", (F.col("c") - 1).alias("c"), F.col("best.m").alias("m"), F.col("best.word").alias("near"))
    found = single.unionByName(shared).groupBy("word").agg(F.sum("c").alias("n_near"), F.min(F.struct("m", "near")).alias("best"))
    return found.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) from (word, form), by joining the table with itself until no root has a form.

    A form is more frequent than its word by a factor, so there are no circles
    and the rounds are few.
    """
    state = scratch.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = state.join(ahead, "root", "left")
        state = scratch.save(moved.select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        if not state.where("moved").limit(1).count():
            return state.select("word", "root")
        state = state.select("word", "root")


def spelling_variants(docs: DataFrame, scratch: Scratch, p: Spelling = Spelling()) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs``."""
    words = scratch.save(count_words(docs, p).withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(words, scratch)
    clear = F.col("near_n") >= p.ratio * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(clear, F.col("near")).alias("form"), F.when(clear, F.col("near_n")).alias("form_n")
    )
    joined = scratch.save(joined, "variants")
    last = roots(joined.where("form IS NOT NULL").select("word", "form"), scratch)
    return joined.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
