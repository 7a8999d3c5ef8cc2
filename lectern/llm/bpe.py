"""Byte-level BPE in numpy: pre-tokens, forced cuts, merges, exact decoding.

A pair of bytes that occurs inside no vocabulary token can never end up in one
token, so the text may be cut between the two for certain. Pre-tokens are cut at
all such pairs and each fragment is merged on its own; the ids are concatenated.

Fragments of many pre-tokens are merged at once: in each round every fragment
merges all occurrences of its lowest-ranked pair. That equals merging one pair at
a time because a pair holding a merged token always ranks behind the merge that
made the token.
"""

from __future__ import annotations

import json
import re
from itertools import repeat

import numpy as np
import regex

#: Characters of the byte-level alphabet, a fixed format of such vocabulary files.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: The published pre-token pattern of these vocabularies (fixed value), with white space spelt out.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
ASCII_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
    r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)

NONE = np.int64(1 << 40)
CHUNK_CHARS = 300_000
CACHE_WORDS = 250_000
#: Bytes of pre-tokens and ids that the cache may hold when a chunk begins.
CACHE_BYTES = 64_000_000


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and forced cuts of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], byte_alphabet()
        pre = spec.get("pre_tokenizer") or {}
        if (
            model.get("type") != "BPE"
            or pre.get("type") != "ByteLevel"
            or pre.get("add_prefix_space")
            or spec.get("normalizer")
            or model.get("ignore_merges")
            or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"])
        ):
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for t, i in model["vocab"].items():
            if t not in self.special:
                self.token_bytes[i] = bytes(to_byte[c] for c in t)
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        self.byte_id = np.array([model["vocab"][c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], dtype=np.int64)
        self.size = np.int64(size)
        keys, news = [], []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            keys.append(model["vocab"][a] * size + model["vocab"][b])
            news.append(model["vocab"][a + b])
        self._hash_merges(np.array(keys, dtype=np.int64), np.array(news, dtype=np.int64))
        self.inside = np.zeros((256, 256), dtype=bool)
        for t in self.token_bytes:
            b = np.frombuffer(t, dtype=np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.flat = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)
        self.widths = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self.begins = np.cumsum(self.widths) - self.widths
        self._split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._any = regex.compile(PATTERN)
        self._ascii = re.compile(ASCII_PATTERN)

    # -- merges as an open-addressed table -------------------------------------------------
    def _hash_merges(self, keys: np.ndarray, news: np.ndarray) -> None:
        self._bits = 19
        slots = 1 << self._bits
        self.slot_key = np.full(slots, -1, dtype=np.int64)
        self.slot_rank = np.full(slots, NONE, dtype=np.int64)
        self.slot_new = np.zeros(slots, dtype=np.int64)
        at = self._slot(keys)
        for rank, (k, n, s) in enumerate(zip(keys.tolist(), news.tolist(), at.tolist(), strict=True)):
            while self.slot_key[s] not in (-1, k):
                s = (s + 1) % slots
            if self.slot_key[s] == -1:
                self.slot_key[s], self.slot_rank[s], self.slot_new[s] = k, rank, n

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self._bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a free slot (rank NONE) where the pair does not merge."""
        at = self._slot(keys)
        held = self.slot_key[at]
        todo = np.flatnonzero((held != keys) & (held != -1))
        while todo.size:
            at[todo] = (at[todo] + 1) & ((1 << self._bits) - 1)
            held = self.slot_key[at[todo]]
            todo = todo[(held != keys[todo]) & (held != -1)]
        return at

    # -- encoding --------------------------------------------------------------------------
    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece, one after the other, and how many each has."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        if not raw.size:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(pieces), dtype=np.int64)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        new = np.ones(raw.size, dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | ~self.inside[raw[:-1], raw[1:]]
        fragment = np.cumsum(new) - 1
        out_ids, out_at = [], []
        ids, frag, at = self.byte_id[raw], fragment, np.arange(raw.size)
        while True:
            same = frag[1:] == frag[:-1]
            slot = self._find(ids[:-1] * self.size + ids[1:])
            rank = np.where(same, self.slot_rank[slot], NONE)
            rank = np.append(rank, NONE)
            first = np.flatnonzero(np.concatenate(([True], frag[1:] != frag[:-1])))
            low = np.minimum.reduceat(rank, first)
            lens = np.diff(np.append(first, frag.size))
            low = np.repeat(low, lens)
            done = low == NONE
            if done.any():
                out_ids.append(ids[done])
                out_at.append(at[done])
                live = ~done
                if not live.any():
                    break
                ids, frag, at, rank, low = ids[live], frag[live], at[live], rank[live], low[live]
                slot = np.append(slot, 0)[live]
            else:
                slot = np.append(slot, 0)
            hit = np.flatnonzero(rank == low)
            start = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
            run = hit[start][np.cumsum(start) - 1]
            hit = hit[(hit - run) % 2 == 0]  # of pairs that overlap, the leftmost ones
            ids = ids.copy()
            ids[hit] = self.slot_new[slot[hit]]
            keep = np.ones(ids.size, dtype=bool)
            keep[hit + 1] = False
            ids, frag, at = ids[keep], frag[keep], at[keep]
        ids, at = np.concatenate(out_ids), np.concatenate(out_at)
        order = np.argsort(at, kind="stable")
        ids, at = ids[order].astype(np.uint32), at[order]
        return ids, np.bincount(owner[at], minlength=len(pieces)).astype(np.int64)

    def pretokens(self, text: str) -> list[str]:
        return (self._ascii if text.isascii() else self._any).findall(text)

    def parts(self, text: str) -> list[str]:
        """The text split at special strings, which are kept as parts of their own."""
        if self._split is None or not any(s in text for s in self.special):
            return [text]
        return [p for p in self._split.split(text) if p]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        w = self.widths[ids]
        ends = np.cumsum(w)
        total = int(ends[-1]) if ids.size else 0
        at = np.arange(total) + np.repeat(self.begins[ids] - (ends - w), w)
        return self.flat[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class Encoder:
    """Encodes texts with a cache of pre-tokens met before, bounded by their number and bytes.

    It is emptied between chunks of texts, so it may go beyond its bounds by one chunk.
    """

    def __init__(self, vocab: Vocabulary, cache_words: int = CACHE_WORDS, cache_bytes: int = CACHE_BYTES):
        self.vocab, self.cache_words, self.cache_bytes = vocab, cache_words, cache_bytes
        self._clear()

    def _full(self) -> bool:
        return len(self.code) > self.cache_words or self.held > self.cache_bytes

    def _clear(self) -> None:
        self.held = 0
        self.code: dict[str, int] = {}
        self.lens = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)
        for s, i in self.vocab.special.items():
            self._add([("\0special", s)], np.array([i], dtype=np.uint32), np.array([1]))

    def _add(self, words: list, ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.code)
        self.code.update(zip(words, range(n, n + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, self.ids.size + np.cumsum(counts) - counts))
        self.lens = np.concatenate((self.lens, counts))
        self.ids = np.concatenate((self.ids, ids))
        self.held += sum(map(len, words)) + 4 * ids.size

    def _codes(self, words: list) -> np.ndarray:
        got = np.fromiter(map(self.code.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        miss = np.flatnonzero(got < 0)
        if miss.size:
            fresh = list(dict.fromkeys(words[i] for i in miss.tolist()))
            ids, counts = self.vocab.encode_pieces([w.encode("utf-8", "replace") for w in fresh])
            self._add(fresh, ids, counts)
            got[miss] = [self.code[words[i]] for i in miss.tolist()]
        return got

    def _words(self, text: str) -> list:
        if not any(s in text for s in self.vocab.special):
            return self.vocab.pretokens(text)
        out: list = []
        for p in self.vocab.parts(text):
            out += [("\0special", p)] if p in self.vocab.special else self.vocab.pretokens(p)
        return out

    def encode(self, texts: list[str | None]):
        """Per text its ids as uint32; null texts have none. Yields in order."""
        for words, sizes in self._chunks(texts):
            codes = self._codes(words)
            lens = self.lens[codes]
            ends = np.cumsum(lens)
            total = int(ends[-1]) if lens.size else 0
            ids = self.ids[np.arange(total) + np.repeat(self.starts[codes] - (ends - lens), lens)]
            cut = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield ids[a:b]

    def count(self, texts: list[str | None]):
        """Per text the number of its ids."""
        for words, sizes in self._chunks(texts):
            codes = self._codes(words)  # before the lookup: it may add lengths
            ends = np.concatenate(([0], np.cumsum(self.lens[codes])))
            cut = ends[np.concatenate(([0], np.cumsum(sizes)))]
            yield from np.diff(cut).tolist()

    def _chunks(self, texts: list[str | None]):
        words, sizes, chars = [], [], 0
        for t in texts:
            w = self._words(t) if t else []
            words += w
            sizes.append(len(w))
            chars += len(t or "")
            if chars > CHUNK_CHARS:
                yield words, sizes
                words, sizes, chars = [], [], 0
                if self._full():
                    self._clear()
        if sizes:
            yield words, sizes
        if self._full():
            self._clear()


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a worker process; ``path`` names a file every node has."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]
