"""Best-fit packing of tokenised documents into sequences of fixed capacity.

1. Each document becomes its token ids and an end id; longer ones are cut into pieces
   of the capacity (``pieces``, one Arrow scan; a word is tokenised once per worker).
2. The histogram of piece lengths, at most ``capacity`` numbers, goes to the driver.
3. There a configuration linear program is solved by multiplicative weights: a
   length's price falls as its demand is covered, a knapsack dynamic program finds the best
   filling at the current prices, for every length the best filling with it. The
   fractional solution is rounded down and the rest is placed by best fit (``plan``).
   Work and plan depend on the capacity, not on the number of documents.
4. Pieces of a length are numbered across tasks (counts per task and length, running
   sums) and each number looks its sequence and offset up in the plan (``pack``).

No group of rows is ever sorted or gathered, so a length that a third of all
pieces share costs nothing. A null or empty text is one piece with the end id
alone. Repeated rows and ids are packed one by one; rows without id keep a null id; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from kinweave.llm.words import slices
from kinweave.operators.skew import cut

# ------------------------------------------------------------- tokens ----

_TOKENS: dict[str, tuple] = {}
_KEPT_WORDS = 800_000
#: Marks that the tokenizer parts from the letters before them and keeps together.
MARKS = ".,;:!?|#$%&*()"
#: Letters that normalisation only lower-cases.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Byte-level vocabularies write a byte that is no printable Latin-1 character as the next free letter from 256 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class WordTokens(dict):
    """Word (UTF-8 bytes) -> its token ids as little-endian 32-bit numbers.

    The tokenizer never joins what white space separates, so a text's ids are those
    of its words in order. A word that is not here yet is encoded and kept; when there are
    too many, all are forgotten and the common ones are soon back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "WordTokens":
        if path not in _TOKENS:
            _TOKENS[path] = cls(path)
        return _TOKENS[path]

    def part(self, text: str) -> bytes:
        """Ids of what is one part for the tokenizer: only letters, or only marks, in lower case."""
        if (ids := self.parts.get(text)) is None:
            plain = text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_LETTERS)
            found = [t.id for t in self.model.tokenize(plain)]
            ids = self.parts[text] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def __missing__(self, word: bytes) -> bytes:
        """Letters and following marks are encoded part by part, anything else as the tokenizer splits it."""
        if len(self) >= _KEPT_WORDS:
            self.clear()
            self.parts.clear()
        text = word.decode()
        stem = text.rstrip(MARKS)
        if stem.isascii() and stem.isalpha() or PLAIN.fullmatch(stem):
            ids = self.part(stem.lower())
            if len(stem) < len(text):
                ids += self.part(text[len(stem):])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of UTF-8 texts; bytes split at space and 0x09-0x0D only."""
        ids_of = self.__getitem__
        return [b"".join(map(ids_of, text.split())) for text in texts]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, number): ``number`` counts a task's pieces of the same length."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = WordTokens.of(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for part in slices(batches, "text"):
            owner, out = [], []
            for i, ids in enumerate(tokens.encode(part.column(1).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at:at + 4 * capacity]
                    size = len(piece) // 4
                    out.append((k, at // 4, size, zlib.crc32(piece), seen[size]))
                    seen[size] += 1
                    owner.append(i)
            k, start, size, crc, number = (np.array(c, np.int64) for c in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owner)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc),
                 pa.array(np.full(len(out), task, np.int64)), pa.array(number)],
                ["id", "piece", "start", "length", "ids_crc32", "task", "number"],
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(scan, f"id {kind}, piece int, start long, length long, ids_crc32 long, task long, number long")


# --------------------------------------------------------------- plan ----


def best_fillings(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the best worth of every capacity up to ``capacity``, and the length put in last (0: none)."""
    worth, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        n = np.searchsorted(lengths, c, side="right")
        if n:
            gain = worth[c - lengths[:n]] + price[:n]
            k = int(gain.argmax())
            if gain[k] > worth[c - 1]:
                worth[c], last[c] = gain[k], lengths[k]
                continue
        worth[c] = worth[c - 1]
    return worth, last


def filling(last: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
            room -= int(last[room])
        else:
            room -= 1
    return out


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, eta: float = 4.0) -> dict[tuple[int, ...], float]:
    """A fractional solution of the covering program: how often to use which filling.

    In each round every length asks for 1 / rounds of its demand, through the best
    filling that has it at the round's prices; prices are the lengths' sizes, times a
    factor that shrinks exponentially with what is covered beyond the asking.
    """
    covered = np.zeros(len(lengths))
    place = {int(n): i for i, n in enumerate(lengths)}
    use: dict[tuple[int, ...], float] = {}
    for t in range(rounds):
        price = lengths / capacity * np.exp(-eta * np.clip(covered / demand - t / rounds, -1, 1))
        _, last = best_fillings(price, lengths, capacity)
        asked = (t + 1) / rounds * demand
        for i in np.argsort(-lengths):
            lack = asked[i] - covered[i]
            if lack <= 0:
                continue
            config = tuple(sorted([int(lengths[i]), *filling(last, capacity - int(lengths[i]))], reverse=True))
            amount = lack / config.count(int(lengths[i]))
            use[config] = use.get(config, 0.0) + amount
            for n in config:
                covered[place[n]] += amount
    return use


def best_fit(left: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """Best fit by decreasing length on a histogram; equal sequences are handled together."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for n in sorted((n for n, k in left.items() if k), reverse=True):
        k = left[n]
        while k:
            room = min((r for r in open_ if r >= n and open_[r]), default=None)
            if room is None:
                room, config, many = capacity, (), k
            else:
                config, many = open_[room].popitem()
            used = min(k, many)
            if many > used and config:
                open_[room][config] = many - used
            into = open_.setdefault(room - n, {})
            into[config + (n,)] = into.get(config + (n,), 0) + used
            if not config:  # a new sequence takes as many of this length as fit before the next one is opened
                fit = min(capacity // n, k)
                used, into[(n,)] = 0, into[(n,)] - used
                if not into[(n,)]:
                    del into[(n,)]
                whole, rest = divmod(k, fit)
                for count, size in ((whole, fit), (1, rest)):
                    if count and size:
                        group = open_.setdefault(capacity - size * n, {})
                        group[(n,) * size] = group.get((n,) * size, 0) + count
                k = 0
            k -= used
    out: dict[tuple[int, ...], int] = {}
    for group in open_.values():
        for config, many in group.items():
            out[config] = out.get(config, 0) + many
    return out


@dataclass(frozen=True)
class Plan:
    """Places of the pieces: those of a length numbered from ``begin`` on go to sequences from ``sequence`` on, at ``offset``."""

    length: np.ndarray
    begin: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def look_up(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            mine, rows = slice(*np.searchsorted(self.length, [n, n + 1])), np.flatnonzero(length == n)
            at = np.searchsorted(self.begin[mine], number[rows], side="right") - 1
            out[0][rows] = self.sequence[mine][at] + number[rows] - self.begin[mine][at]
            out[1][rows] = self.offset[mine][at]
        return out


def plan(histogram: dict[int, int], capacity: int, rounds: int = 40) -> Plan:
    """Solve the program, round down what fills sequences to the brim, place the rest by best fit.

    Sequences that are not full are left to best fit, which may find better company for
    their pieces. Should best fit alone need fewer sequences, its answer is taken.
    """
    left = {n: k for n, k in histogram.items() if k}
    chosen: dict[tuple[int, ...], int] = {}
    lengths = np.array(sorted(left), np.int64)
    use = solve(lengths, np.array([left[int(n)] for n in lengths], float), capacity, rounds) if left else {}
    for config, amount in sorted(use.items(), key=lambda u: (-u[1], u[0])):
        many = 0 if sum(config) < capacity else min([int(amount + 1e-9), *(left[n] // config.count(n) for n in set(config))])
        if many > 0:
            chosen[config] = many
            for n in config:
                left[n] -= many
    for config, many in best_fit(left, capacity).items():
        chosen[config] = chosen.get(config, 0) + many
    alone = best_fit(histogram, capacity)
    if sum(alone.values()) < sum(chosen.values()):
        chosen = alone
    rows, first, next_number = [], 0, dict.fromkeys(histogram, 0)
    for config, many in sorted(chosen.items()):
        offset = 0
        for n in config:
            rows.append((n, next_number[n], first, offset))
            next_number[n] += many
            offset += n
        first += many
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(*table.T, sequences=first)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece; offsets of a sequence have no gaps."""
    found = cut(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    counts = cut(found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    places = plan({r["length"]: r.n for r in total}, capacity)
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    numbered = found.join(shifts, ["task", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("shift")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.look_up(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = found.schema["id"].dataType.simpleString()
    return numbered.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
