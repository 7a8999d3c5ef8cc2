"""BPE, counts and packing against the tokenizers library and brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm.bpe import Encoder, vocabulary
from lectern.llm.counting import proven, token_counts
from lectern.llm.encoding import decode, encode, round_trip_digests
from lectern.llm.packing import fullest, minimum_bin_slack, pack_documents
from lectern.plans.scratch import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", "Hello  world\n\n x", "it's 12 ½ ²³ été 一二 😀", "<|endoftext|> a<|endoftext|>b", "a" * 4000, "\u0085 \x1c x", "ab " * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (1, "a"), (None, "b c")]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_encoder_equals_library(text):
    lib = Tokenizer.from_file(PATH) if not hasattr(test_encoder_equals_library, "lib") else test_encoder_equals_library.lib
    test_encoder_equals_library.lib = lib
    vocab = vocabulary(PATH)
    text = text.encode("utf-8", "ignore").decode()
    got = next(Encoder(vocab).encode([text]))
    # the library's tables of letters may be of another Unicode version than ours
    import unicodedata

    if any(unicodedata.category(c) in ("Cn", "Co", "Cs") or ord(c) > 0x2FFFF for c in text) or not text.isascii() and any(ord(c) > 0x5FF for c in text):
        assert vocab.decode(got) == text
    else:
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids


def test_small_cache_gives_the_same(library):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abc thé's ll12\n ", k=50)) for _ in range(300)]
    encoder = Encoder(vocabulary(PATH), cache_words=5)
    for a in range(0, 300, 7):
        part = texts[a : a + 7]
        assert [x.tolist() for x in encoder.encode(part)] == [ids_of(library, t) for t in part]


def test_encode_decode_and_digests(spark, library):
    df = docs(spark)
    pairs = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in encode(df, PATH).collect()]
    want = [(r.doc_id, ids_of(library, r.text)) for r in df.collect()]
    assert sorted(pairs, key=str) == sorted(want, key=str)
    back = sorted([(r.doc_id, r.text) for r in decode(encode(df, PATH), PATH).collect()], key=str)
    assert back == sorted([(r.doc_id, r.text or "") for r in df.collect()], key=str)
    for r in round_trip_digests(df.where("doc_id = 4"), PATH).collect():
        ids = ids_of(library, TEXTS[4])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(TEXTS[4].encode()).hexdigest()


def test_counts(spark, library):
    df = docs(spark)
    got = sorted([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, PATH).collect()], key=str)
    want = [(r.doc_id, len((r.text or "").encode()), len(ids_of(library, r.text))) for r in df.collect()]
    assert got == sorted([(*w, w[2] > 512) for w in want], key=str)


def test_proven_tokens_are_single(library):
    some = sorted(proven(PATH))[::997]
    assert all(len(ids_of(library, t)) == 1 for t in some)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert round_trip_digests(none, PATH).count() == token_counts(none, PATH).count() == 0
    assert pack_documents(none, PATH, Scratch(spark, "t")).count() == 0


def test_fullest_is_the_fullest():
    rng = random.Random(3)
    for _ in range(200):
        available = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(0, 60)
        chosen = fullest(available, room)
        every = [x for x, n in available.items() for _ in range(n)]
        best = max((sum(c) for k in range(len(every) + 1) for c in itertools.combinations(every, k) if sum(c) <= room), default=0)
        assert sum(x * n for x, n in chosen.items()) == best
        assert all(n <= available[x] for x, n in chosen.items())


def test_plan_uses_every_piece_and_is_tight():
    rng = random.Random(4)
    counts = {x: rng.randint(0, 20) for x in range(1, 101)}
    plan = minimum_bin_slack(counts, 100)
    used = dict.fromkeys(counts, 0)
    for combo, times in plan:
        assert 0 < sum(x * n for x, n in combo.items()) <= 100
        for x, n in combo.items():
            used[x] += n * times
    assert used == counts
    total = sum(x * n for x, n in counts.items())
    large = sum(n for x, n in counts.items() if x > 50)  # no two of them go together
    assert sum(t for _, t in plan) <= 1.05 * max(-(-total // 100), large) + 2
    with pytest.raises(ValueError):
        minimum_bin_slack({101: 1}, 100)


def test_packing_places_every_id(spark, library):
    df = docs(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(3)
    rows = pack_documents(df, PATH, Scratch(spark, "t"), capacity=64).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by_doc) == df.count()
    for r in df.collect():
        ids, at = np.array([*ids_of(library, r.text), 2], "<u4"), 0
        for i, piece in enumerate(sorted(by_doc[r.doc_id], key=lambda x: x.piece)):
            assert (piece.piece, piece.start) == (i, at) and piece.ids_crc32 == zlib.crc32(ids[at : at + piece.length].tobytes())
            assert i == 0 or piece.length == 64
            at += piece.length
        assert at == len(ids)
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_and_counts_of_nulls_and_repeated_ids(spark, library):
    """Each row is packed and counted by itself; clashing names of other columns change nothing."""
    rows = [(1, "ab ab"), (1, "ab ab"), (1, "other text"), (None, None), (None, "x"), (2, ""), (3, "word " * 700)]
    df = spark.createDataFrame([(*r, "9", 7) for r in rows], "doc_id long, text string, length string, sequence_id int")
    got = pack_documents(df, PATH, Scratch(spark, "t"), capacity=100).collect()
    want = []
    for i, t in rows:
        ids = np.array([*ids_of(library, t), 2], "<u4")
        first = len(ids) % 100 or 100
        cuts = [0, *range(first, len(ids), 100), len(ids)] if len(ids) > 100 else [0, len(ids)]
        want += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(a[0] != b[0] and b[1] == 0 or a[0] == b[0] and a[1] + a[2] == b[1] for a, b in zip(places[:-1], places[1:], strict=True))
    counted = sorted((str(r.doc_id), r.n_tokens) for r in token_counts(df, PATH).collect())
    assert counted == sorted((str(i), len(ids_of(library, t))) for i, t in rows)


def test_cache_is_bounded_by_bytes():
    """Words that never come again and are long do not stay."""
    encoder = Encoder(vocabulary(PATH), cache_bytes=400_000)
    for i in range(12):
        text = chr(97 + i) * 100_000 + f" {i}"
        [ids] = encoder.encode([text])
        assert encoder.vocab.decode(ids) == text
        assert encoder.held <= 400_000
