"""Tokens, the packing plan and packed sequences."""

import random
import zlib

import numpy as np
import pytest

from kinweave.llm import packing as P
from kinweave.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


TEXTS = [
    "", " ", "The cat's hat, don't!! It'S", "<|endoftext|> a<|startoftext|>b", "Straße ÀÉÿ ×a÷ aª º", "café ́x", "a\x1cb c\x85d\xa0e",
    "ΣΑΣ İstanbul ǅ", "1234 5.6%, (x) #tag&&& word***", "日本語 🤣🤣", "a\x00b ﻿", "x" * 500, "ﬁ ½",
]


def test_word_by_word_equals_whole_texts(plain):
    words = P.WordTokens(tokenizer_path())
    for text, got in zip(TEXTS, words.encode([t.encode() for t in TEXTS])):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_forgetting_words_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(P, "_KEPT_WORDS", 3)
    test_word_by_word_equals_whole_texts(plain)


def first_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = next((i for i, r in enumerate(rooms) if r >= n), None)
        if k is None:
            rooms.append(capacity)
            k = -1
        rooms[k] -= n
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once_and_tightly(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 60, 128])
    lengths = [rng.randint(1, rng.choice([capacity, capacity // 3])) for _ in range(rng.choice([1, 40, 600]))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = P.plan(histogram, capacity)
    assert plan.sequences <= first_fit(lengths, capacity)
    assert plan.sequences >= -(-sum(lengths) // capacity)
    fill: dict[int, list] = {}
    for n, count in histogram.items():
        sequence, offset = plan.look_up(np.full(count, n), np.arange(count))
        for s, o in zip(sequence, offset):
            fill.setdefault(int(s), []).append((int(o), n))
    for places in fill.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(fill) == plan.sequences


def test_empty_histogram_has_an_empty_plan():
    assert P.plan({}, 8).sequences == 0


def test_pack_rows(spark, plain):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 90)))) for i in range(120)] + [(7, None), (7, None), (None, "x"), (500, "alpha " * 700)]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, length int, id int").repartition(5)
    out = P.pack(docs, tokenizer_path(), capacity=64).toPandas()
    streams = {}
    for i, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            piece = ids[at:at + 64]
            streams.setdefault((i if i is not None else -1, k, at, len(piece), zlib.crc32(piece.tobytes())), []).append(1)
    got = {}
    for r in out.fillna({"doc_id": -1}).itertuples():
        got.setdefault((int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert got == streams
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 64
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 64) + 2
    assert P.pack(docs.limit(0), tokenizer_path()).count() == 0
