"""Encoding through the word table and decoding, against the tokeniser on whole texts."""

import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from kinweave.llm import word_table as T
from kinweave.llm.queries import op11, tokenizer_path
from kinweave.llm.words import Texts

PATH = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, block long, words string, ids int, id int"
TEXTS = [
    "", " ", "\n\n", "The cat's hat, don't!! It'S", "a<|endoftext|>b  <|endoftext|> \n c<|endoftext|>", "<|endoftext|", "a  b   c \t\n d ",
    "x  y　 z   w\u0085 v\x1c u\x1f t\x0b s\x0c r\r\nq", "“quoted” — dash… 日本語 テスト、 です。 русский текст", "🤣🤣 👩‍👩‍👧 é é ﷽", "x" * 3000,
    "1234 5.6% ½ ² Ⅷ", "\x00 \x7f a", None, "end  ", "  start", "don 't we 'll", "   a  b",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


def words_of(texts):
    t = Texts(pa.array(texts, pa.string()))
    borders = np.append(T.word_borders(t), len(t.data))
    first = np.searchsorted(borders[:-1], t.at)
    whole = bytes(t.data)
    return [[whole[borders[k]:borders[k + 1]].decode() for k in range(first[i], first[i + 1])] for i in range(len(texts))]


def check(plain, texts):
    for text, words in zip(texts, words_of(texts)):
        assert "".join(words) == (text or "")
        assert [i for w in words for i in plain.encode(w, add_special_tokens=False).ids] == plain.encode(text or "", add_special_tokens=False).ids, text


def test_words_of_a_text_have_its_ids(plain):
    check(plain, TEXTS)
    assert words_of(["ab cd\n ef", "", "gh"]) == [["ab", " cd", "\n ef"], [], ["gh"]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(
    st.sampled_from(list(" \n\t\r\x0b\x0c\x1c\x1f\u0085       　'sdmtllve.,!<|>endoftext’、日")),
    st.characters(exclude_categories=["Cs"]))), min_size=1, max_size=4))
def test_words_of_any_text_have_its_ids(plain, texts):
    check(plain, texts)


def expected(plain, rows):
    out = []
    for doc_id, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids
        said = plain.decode(ids, skip_special_tokens=False)
        out.append((-1 if doc_id is None else doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), said))
    return sorted(out)


def round_trip(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], SCHEMA).repartition(3)
    encoded = T.encode(docs, PATH)
    ids = {(r.doc_id, r.ids_sha256): r.ids for r in encoded.collect()}
    assert all(hashlib.sha256(struct.pack(f"<{len(v)}I", *v)).hexdigest() == k[1] for k, v in ids.items())
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.text) for r in T.decode(encoded, PATH).collect())


@pytest.mark.parametrize("block, bucket", [(1 << 25, 1 << 24), (200, 100)])
def test_round_trip_equals_the_library(spark, plain, monkeypatch, block, bucket):
    from kinweave.llm import words

    monkeypatch.setattr(T, "BLOCK_BYTES", block)
    monkeypatch.setattr(T, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(T, "STEP", min(block // 10, T.STEP))
    monkeypatch.setattr(words, "SLICE_BYTES", min(block, words.SLICE_BYTES))
    rng = random.Random(7)
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (None, None), (3, "The cat's hat, don't!! It'S"), (3, "again")]
    rows += [(100 + i, " ".join(rng.choice(["the", "cat,", "Sat.", "\nonce", f"w{rng.randint(0, 999)}", "naïve"]) for _ in range(rng.randint(0, 200)))) for i in range(60)]
    assert round_trip(spark, rows) == expected(plain, rows)


def test_empty_table_and_a_very_long_text(spark, plain):
    assert round_trip(spark, []) == []
    rows = [(1, "the very long text of words, " * 60_000), (2, "y" * 200_000), (3, "")]
    assert round_trip(spark, rows) == expected(plain, rows)


def test_decoding_of_any_ids(spark, plain, monkeypatch):
    monkeypatch.setattr(T, "DECODED_AT_ONCE", 7)
    rng = random.Random(8)
    rows = [(i, [rng.randint(0, 50256) for _ in range(rng.randint(0, 12))]) for i in range(80)]  # mostly no UTF-8 at the seams
    odd = [(900, None), (901, [None, 50256, -1, 99999, 64]), (902, [])]
    got = {r.k: r.text for r in T.decode(spark.createDataFrame(rows + odd, "k int, ids array<int>"), PATH).collect()}
    assert [got[i] for i, _ in rows] == [plain.decode(ids, skip_special_tokens=False) for _, ids in rows]
    assert (got[900], got[901], got[902]) == (None, "<|endoftext|>a", "")


def test_borders_do_not_depend_on_the_step(monkeypatch):
    t = Texts(pa.array(TEXTS * 3, pa.string()))
    whole = T.word_borders(t).tolist()
    for step in (1, 2, 3, 5, 64):
        monkeypatch.setattr(T, "STEP", step)
        assert T.word_borders(t).tolist() == whole


def test_texts_that_come_back_otherwise_end_the_job(spark):
    from pyspark.sql import functions as F

    odd = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), (F.rand() * F.monotonically_increasing_id()).cast("string")).alias("text"))
    docs = odd.select("doc_id", F.udf(lambda t: f"{t} {random.random()}", "string").asNondeterministic()("text").alias("text"))
    with pytest.raises(Exception, match="came back otherwise"):
        T.encode(docs, PATH).collect()


def test_equal_blocks_are_kept_apart(spark, plain):
    rows = [(1, "same text here"), (2, "and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.n_tokens) for r in T.encode(docs.unionByName(docs), PATH).collect())
    assert got == sorted([(i, len(plain.encode(t).ids)) for i, t in rows] * 2)


def test_other_tokenisers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        T.tokenizer(tokenizer_path("word_bpe_49k.json"))


def test_registered_query_over_the_smallest_tables(spark, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = [(i, n, sha, hashlib.sha256(said.encode()).hexdigest()) for i, n, sha, said in expected(plain, docs)]
    assert sorted(map(tuple, op11(spark, "/root/testdata/sf0.001").collect())) == want
