"""Byte-level BPE through a table of distinct words: every word is encoded once, whatever the size of the corpus.

* **Split.** A word is a run of white space with the characters up to the next one. The tokeniser never joins
  characters over such a border, so a text's ids are those of its words, one after the other. A task turns
  a few megabytes of texts into one block: its distinct words, most frequent first, and for every position the
  number of its word.
* **Encode.** The distinct words of all blocks meet in buckets by hash. A bucket encodes each of its words once
  and answers every block that asked.
* **Join back.** A block and its answers meet; each position takes the ids of its word.
* **Decode.** Ids are joined to the table of pieces, which is as long as the vocabulary, and the bytes put together.

Word lists, answers and positions travel packed and compressed, so texts themselves are never shuffled. A word
stands in a block's list once, so no bucket grows with the frequency of a word, only with the number of blocks.
Texts are split twice, once for the words and once for the positions, which costs less than to write either down.
Blocks are known by a digest of their contents: should the input come back otherwise the second time, the job
fails and says so; nothing is joined wrongly.

Null texts count as empty and have no ids; null rows decode to null. Repeated rows and ids are kept, other
columns ignored. A text longer than a block is a block of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.words import Texts, blocks_of

#: Text that makes up a block.
BLOCK_BYTES = 8 << 20
#: Text whose distinct words go to one bucket, on average.
BUCKET_BYTES = 8 << 20
#: Text looked at once for borders, and positions joined at once.
STEP = 1 << 18
#: Words hashed, and given to the tokeniser, at once.
ENCODED_AT_ONCE = 8192
#: Ids decoded at once.
DECODED_AT_ONCE = 1 << 18


# ----------------------------------------------------------------- packing ----


def pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers, of any lengths, as one binary: by byte planes, since upper bytes are mostly alike."""
    head = np.array([len(columns), *[x for c in columns for x in (len(c), c.itemsize)]], "<u4")
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return head.tobytes() + zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    head = np.frombuffer(data, "<u4", 2 * n, 4)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[4 + 8 * n:]), np.uint8)
    out, at = [], 0
    for length, size in head.reshape(-1, 2).tolist():
        out.append(np.ascontiguousarray(planes[at:at + length * size].reshape(size, length).T).view(f"<u{size}").ravel())
        at += length * size
    return out


#: Numbers of frequent words are written in one byte, those of the next ones in two.
_RANGES = (0, 128, 128 + (1 << 12))


def pack_codes(codes: np.ndarray, repeated: int) -> bytes:
    """Numbers of the words of some texts: short for frequent words; words from ``repeated`` on occur once, in order, and need none."""
    kind = np.searchsorted(np.array(_RANGES, codes.dtype), codes, side="right").astype(np.uint8)
    kind[codes >= repeated] = 0
    parts = [(codes[kind == k + 1] - _RANGES[k]).astype(t) for k, t in enumerate(("<u1", "<u2", "<u4"))]
    return pack(kind, *parts)


def unpack_codes(data: bytes, repeated: int) -> np.ndarray:
    kind, *parts = unpack(data)
    out = np.empty(len(kind), np.int32)
    for k, part in enumerate(parts):
        out[kind == k + 1] = part.astype(np.int32) + _RANGES[k]
    once = kind == 0
    out[once] = repeated + np.arange(once.sum(), dtype=np.int32)
    return out


def _words(letters: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Words from their bytes and lengths."""
    at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(letters)])


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of words."""
    texts = Texts(words)
    return texts.data, np.diff(texts.at).astype("<u4")


# ------------------------------------------------------------------- split ----


def word_borders(texts: Texts) -> np.ndarray:
    """Places where a word begins: before ASCII white space that follows something else, and at the start of each text.

    After a character beyond ASCII only if its bytes cannot be those of a wide space; a border left out makes one
    longer word and no other ids.
    """
    border = np.zeros(len(texts.data) + 1, bool)
    for begin in range(0, len(texts.data), STEP):
        b = texts.data[max(0, begin - 3):begin + STEP + 1]  # three bytes before and one behind the step
        space = (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))
        before = np.concatenate([np.zeros(2, np.uint8), b])
        two, three = before[1:-1], before[:-2]  # the bytes one and two places back
        # U+0085 and U+00A0; U+1680; U+2000 to U+207F; U+3000 to U+303F.
        maybe = ((two == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((three == 0xE1) & (two == 0x9A)) \
            | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
        ends = ((b > 0x20) & (b < 0x7F)) | ((b >= 0x80) & ~maybe)
        found = np.flatnonzero(ends[:-1] & space[1:]) + 1 + max(0, begin - 3)
        border[found[(found > begin) | (begin == 0)]] = True
    border[texts.at] = True
    return np.flatnonzero(border[:-1])


class Block:
    """A few megabytes of texts as numbers of their distinct words, the most frequent ones first."""

    def __init__(self, task: int, number: int, column: pa.Array):
        texts = Texts(column)
        borders = word_borders(texts)
        found = pa.Array.from_buffers(
            pa.large_binary(), len(borders), [None, pa.py_buffer(np.append(borders, len(texts.data))), pa.py_buffer(texts.data)],
        ).dictionary_encode()
        times = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
        order = np.argsort(-times, kind="stable")  # words that occur once stay in the order of the texts
        self.found, self.order = found.indices, order
        self.words = found.dictionary.take(pa.array(order))
        self.repeated = int((times > 1).sum())
        self.lengths = np.diff(np.searchsorted(borders, texts.at)).astype(np.int32)
        said = hashlib.blake2b(texts.data, digest_size=8, key=b"%d %d" % (task, number))
        said.update(texts.at.tobytes())
        self.key = int.from_bytes(said.digest(), "little", signed=True)

    def codes(self) -> np.ndarray:
        """The number of the word at every position."""
        rank = np.empty(len(self.order), np.int32)
        rank[self.order] = np.arange(len(self.order), dtype=np.int32)
        return rank[self.found.to_numpy()]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block]]:
    task = TaskContext.get().partitionId()
    for number, batch in enumerate(blocks_of(batches, "text", BLOCK_BYTES)):
        yield batch, Block(task, number, batch.column("text"))
        pa.default_memory_pool().release_unused()


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, owners, lengths, n_words, repeated, codes): ids and numbers of words of the texts, and the words in order."""
    for batch, block in _blocks(batches):
        yield pa.RecordBatch.from_arrays([
            pa.array([block.key], pa.int64()), _one(batch.column("id")), _one(pa.array(block.lengths)),
            pa.array([len(block.words)], pa.int64()), pa.array([block.repeated], pa.int64()),
            pa.array([pack_codes(block.codes(), block.repeated)], pa.binary()),
        ], ["block", "owners", "lengths", "n_words", "repeated", "codes"])


def _one(values: pa.Array) -> pa.Array:
    """A column of one row that holds all values as a list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


# ------------------------------------------------------------------ encode ----


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokeniser of a file, without truncation and padding; once for each Python worker.

    Only byte-level tokenisers fit that take texts as they are, and whose special tokens hold no white space:
    for these no token reaches over a border of :func:`word_borders`.
    """
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
    out = Tokenizer.from_file(path)
    says = json.loads(out.to_str())
    first = says["pre_tokenizer"] or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not says["normalizer"]
    if not plain or any(x["lstrip"] or x["rstrip"] or any(c.isspace() for c in x["content"]) for x in says["added_tokens"]):
        raise ValueError("the tokeniser is not byte-level, changes texts, or has special tokens with white space")
    out.no_truncation()
    out.no_padding()
    return out


def _asked(buckets: int):
    """(bucket, block, asked): the distinct words of each block with their numbers, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches):
            bucket = np.empty(len(block.words), np.int32)
            for begin in range(0, len(bucket), ENCODED_AT_ONCE):
                texts = Texts(block.words.slice(begin, ENCODED_AT_ONCE))
                bucket[begin:begin + len(texts)] = texts.hashes(texts.at[:-1], texts.at[1:]) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for begin, end in zip(at, np.append(at[1:], len(order))):
                these = order[begin:end]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(bucket[order[begin]])], pa.int64()), pa.array([block.key], pa.int64()),
                    pa.array([pack(np.diff(these, prepend=0).astype("<u4"), *_letters(block.words.take(pa.array(these))))], pa.binary()),
                ], ["bucket", "block", "asked"])

    return run


def _answered(path: str):
    """(block, answer): one encoding of each distinct word of a bucket, given to all blocks that asked for it."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        asked = [unpack(x.as_py()) for x in rows["asked"]]
        every = pa.concat_arrays([_words(*x[1:]) for x in asked]).dictionary_encode()
        ids, lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for begin in range(0, len(every.dictionary), ENCODED_AT_ONCE):
            some = [x.decode() for x in every.dictionary.slice(begin, ENCODED_AT_ONCE).to_pylist()]
            found = [x.ids for x in tokenizer(path).encode_batch_fast(some, add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(found), "<u4"))
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
        known = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(np.concatenate(lengths))]), np.concatenate(ids))
        packed, at = [], 0
        for codes, _, sizes in asked:
            mine = known.take(every.indices.slice(at, len(sizes)))
            packed.append(pack(codes, mine.value_lengths().to_numpy().astype("<u4"), mine.flatten().to_numpy().astype("<u4")))
            at += len(sizes)
        return pa.table({"block": rows["block"], "answer": pa.array(packed, pa.binary())})

    return run


def _joined():
    """The ids of the texts of a block, from the numbers of their words and the ids of each word."""

    def run(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        given = [unpack(x.as_py()) for x in answers["answer"]]
        order = np.full(max(blocks["n_words"].to_pylist(), default=0), -1, np.int64)
        if given:
            number = np.concatenate([np.cumsum(code, dtype=np.int64) for code, _, _ in given])
            order[number[number < len(order)]] = np.flatnonzero(number < len(order))
        sizes = np.concatenate([np.zeros(0, "<u4"), *[size for _, size, _ in given]])
        known = pa.LargeListArray.from_arrays(
            np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.concatenate([np.zeros(0, "<u4"), *[x for _, _, x in given]]))
        if not len(blocks) or (order < 0).any():
            raise RuntimeError("texts came back otherwise when read again; write them to a table first and encode that")
        for row in range(len(blocks)):  # more than one only where blocks are equal
            codes = unpack_codes(blocks["codes"][row].as_py(), blocks["repeated"][row].as_py())
            owners, lengths = (blocks[c][row].values for c in ("owners", "lengths"))
            at = np.concatenate([[0], np.cumsum(lengths.to_numpy(), dtype=np.int64)])
            begin = 0
            while begin < len(lengths):
                end = max(begin + 1, int(np.searchsorted(at, at[begin] + STEP, side="right")) - 1)
                ids = known.take(pa.array(order[codes[at[begin]:at[end]]]))
                flat = ids.flatten().to_numpy()
                cuts = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])[at[begin:end + 1] - at[begin]]
                digests = [hashlib.sha256(flat[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(cuts, cuts[1:])]
                out.append(pa.RecordBatch.from_arrays([
                    owners.slice(begin, end - begin), pa.array(np.diff(cuts), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32())), pa.array(digests, pa.string()),
                ], ["id", "n_tokens", "ids", "ids_sha256"]))
                begin = end
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out)

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, ids_sha256): every text as the tokeniser of the file encodes it, without added special tokens.

    ``ids_sha256`` is the digest of the ids as little-endian 32-bit integers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    asked = plain.mapInArrow(_asked(buckets), "bucket long, block long, asked binary")
    answers = asked.groupBy("bucket").applyInArrow(_answered(path), "block long, answer binary")
    blocks = plain.mapInArrow(
        _positions, f"block long, owners array<{kind}>, lengths array<int>, n_words long, repeated long, codes binary")
    found = blocks.groupBy("block").cogroup(answers.groupBy("block")) \
        .applyInArrow(_joined(), f"id {kind}, n_tokens long, ids array<int>, ids_sha256 string")
    return found.withColumnRenamed("id", id_col)


# ------------------------------------------------------------------ decode ----


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself where it prints, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def pieces(path: str) -> pa.Array:
    """The bytes of every id of a byte-level tokeniser; ids without a piece have null. As long as the vocabulary."""
    letters = byte_letters()
    known = tokenizer(path).get_vocab(with_added_tokens=True)
    out: list[bytes | None] = [None] * (max(known.values(), default=-1) + 1)
    for piece, i in known.items():
        out[i] = bytes(letters[x] for x in piece) if all(x in letters for x in piece) else piece.encode()
    return pa.array(out, pa.large_binary())


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The table with ``text_col`` in place of ``ids_col``: the pieces of the ids, special ones included, put together.

    Ids are dense, so the join with the pieces is a look-up by place. Ids without a piece and null ids add nothing;
    bytes that are no UTF-8 become U+FFFD.
    """
    table = encoded.sparkSession.sparkContext.broadcast(pieces(path))
    kept = [f for f in encoded.schema.fields if f.name not in (ids_col, text_col)]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for whole in batches:
            size = np.cumsum(pc.fill_null(pc.list_value_length(whole.column(ids_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < whole.num_rows:
                end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + DECODED_AT_ONCE, side="right")))
                batch = whole.slice(begin, end - begin)
                begin = end
                lists = batch.column(ids_col)
                ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
                found = known.take(pa.array(np.where((ids >= 0) & (ids < len(known)), ids, 0), mask=(ids < 0) | (ids >= len(known))))
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(found), 0).to_numpy())]).astype(np.int64)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                data = found.buffers()[2].to_pybytes() if found.buffers()[2] else b""
                at = ends[np.concatenate([[0], np.cumsum(counts)])]
                texts = [data[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(at, at[1:], pc.is_valid(lists).to_pylist())]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(texts, pa.string())], [*[f.name for f in kept], text_col])

    return encoded.select(*[f.name for f in kept], ids_col).mapInArrow(run, schema)

