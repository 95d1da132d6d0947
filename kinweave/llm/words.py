"""Words, lines and their 64-bit hashes for whole Arrow batches of texts.

A word is a run of bytes other than space and 0x09-0x0D. All work is on the UTF-8
bytes of many texts at once, in slices of a few megabytes, so memory stays
bounded whatever a batch holds (one text longer than a slice is its own slice).
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_STEP = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    up, down = _POWERS["up"][:n], _POWERS["down"][:n]
    if n > 8 * SLICE_BYTES:  # do not keep the tables of one giant text
        _POWERS.clear()
    return up, down


class Texts:
    """The bytes of some texts, one after the other; ``at`` has their n + 1 borders."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.at = at - at[0]
        size = int(at[-1] - at[0])
        self.data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if size else np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.at) - 1

    def runs(self, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes that are not ``apart``, and per text its first run (n + 1 borders)."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self) + 1, np.int64)
        before = np.empty_like(apart)
        before[0], before[1:] = True, apart[:-1]
        before[self.at[:-1][self.at[:-1] < len(apart)]] = True
        after = np.empty_like(apart)
        after[-1], after[:-1] = True, apart[1:]
        after[self.at[1:][self.at[1:] > 0] - 1] = True
        starts, ends = np.flatnonzero(~apart & before), np.flatnonzero(~apart & after) + 1
        return starts, ends, np.searchsorted(starts, self.at)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each stretch of bytes, which depends on nothing but these bytes."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        up, down = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_LETTER[LOWER[self.data] if lower else self.data] * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in the mask."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]


def windows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, the word each begins with, and per text its first window."""
    n = np.maximum(np.diff(first) - size + 1, 0)
    borders = np.concatenate([[0], np.cumsum(n)])
    begin = np.arange(borders[-1]) + np.repeat(first[:-1] - borders[:-1], n)
    out = np.zeros(len(begin), np.uint64)
    for i in range(size):
        out += words[begin + i] * _STEP[i]
    return mix(out), begin, borders


def shingle_sets(texts: Texts, size: int) -> list[np.ndarray]:
    """Per text its distinct word windows as sorted hashes; a text of fewer words is one window, none is empty."""
    starts, ends, first = texts.runs(SPACE[texts.data])
    words = texts.hashes(starts, ends, lower=True)
    hashes, _, borders = windows(words, first, size)
    out = []
    for i in range(len(texts)):
        if borders[i + 1] > borders[i]:
            out.append(np.unique(hashes[borders[i]:borders[i + 1]]))
        else:
            few = words[first[i]:first[i + 1]]
            whole = np.sum(few * _STEP[:len(few)], dtype=np.uint64, keepdims=True) + np.uint64(len(few))
            out.append(mix(mix(whole)) if len(few) else np.zeros(0, np.uint64))
    return out


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds a few megabytes of text, or one longer text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def blocks_of(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batches cut and joined again to blocks of up to ``size`` bytes of text, or one slice that is larger."""
    held, filled = [], 0
    for piece in slices(batches, text):
        more = pc.sum(pc.binary_length(piece.column(piece.schema.get_field_index(text)))).as_py() or 0
        if held and filled + more > size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, filled = [], 0
        held.append(piece)
        filled += more
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
