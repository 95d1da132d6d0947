"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line with a word is labelled good or bad from its own features, those of the
lines before and after it, and the label of its neighbours. A text's quality is the
mean of its lines' chances of being good (forward-backward marginals), weighted by
their length, mapped to a probability by a logistic curve.

Only texts carry labels, so in training every line has the label of its text. A clean
line inside junk is learnt as an exception; its neighbours and the weighting by length
make up for it when texts are scored.

Training reads a bounded sample: the ``max_texts`` labelled texts with the smallest
hash of their id, of those only texts of up to ``max_lines`` lines. Scoring
covers every text, whole, in one Arrow scan without a shuffle.

A null or empty text, or one without a word, has no lines; its score is the
share of good texts among the sample. Without labels of both kinds every score is
that share (0.5 without any). Null labels are ignored, of repeated labels of an id the lower
counts, repeated rows get a score each, an empty table gives an empty result. Other
columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kinweave.llm.quality_rules import CAPITALS, LETTERS, SMALL, STOPS, SYMBOLS, repeated
from kinweave.llm.words import SPACE, Texts, mix, slices, windows

DIGITS = np.zeros(256, bool)
DIGITS[ord("0"):ord("9") + 1] = True

OWN = ("bias", "words", "capitals", "symbols", "marks", "pipes", "stutter", "loops", "again", "stops", "short_words",
       "digits", "word_length", "starts_capital")
#: What a line sees of the lines before and after it.
NEAR = ("words", "capitals", "symbols", "pipes", "stutter", "loops", "again")
FEATURES = (*OWN, *(f"before_{n}" for n in NEAR), *(f"after_{n}" for n in NEAR), "first", "last")


def line_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all lines with a word, their lengths in bytes, and per text its first line (n + 1 borders)."""
    data, n = texts.data, len(texts)
    word_start, word_end, word_first = texts.runs(SPACE[data])
    begin, end, _ = texts.runs(data == 0x0A)
    first_word, past_word = np.searchsorted(word_start, begin), np.searchsorted(word_start, end)
    filled = past_word > first_word
    begin, end, first_word, past_word = (x[filled] for x in (begin, end, first_word, past_word))
    borders = np.searchsorted(begin, texts.at)
    owner = np.repeat(np.arange(n), np.diff(borders))
    words = texts.hashes(word_start, word_end)
    word_owner = np.repeat(np.arange(n), np.diff(word_first))

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[end] - total[begin]

    def count_words(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[past_word] - total[first_word]

    three, at, window_first = windows(words, word_first, 3)
    three ^= mix(np.repeat(np.arange(n), np.diff(window_first)).astype(np.uint64))
    at = at[np.isin(three, repeated(three))]
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[at + i] = True
    stutter = np.zeros(len(words), bool)
    stutter[1:] = (words[1:] == words[:-1]) & (word_owner[1:] == word_owner[:-1])
    lines = texts.hashes(begin, end) ^ mix(owner.astype(np.uint64))
    again = np.ones(len(lines), bool)
    again[np.unique(lines, return_index=True)[1]] = False

    lead = (data & 0xC0) != 0x80
    chars = np.maximum(count(lead & ~SPACE[data]), 1)
    letters = np.maximum(count(LETTERS[data] & lead), 1)
    n_words = (past_word - first_word).astype(float)
    size = word_end - word_start
    own = np.stack([
        np.ones(len(begin)), np.log1p(n_words) / 5, count(CAPITALS[data]) / letters, count(SYMBOLS[data]) / chars,
        np.minimum(count(data == ord("!")) / n_words, 2), np.minimum(count(data == ord("|")) / n_words, 1),
        count_words(stutter) / n_words, count_words(covered) / n_words, again,
        np.minimum(count(STOPS[data]) / n_words, 1), count_words((size <= 3) & LETTERS[data[word_start]]) / n_words,
        count(DIGITS[data]) / chars, np.minimum(chars / n_words / 20, 2), CAPITALS[data[word_start[first_word]]],
    ], axis=1) if len(begin) else np.zeros((0, len(OWN)))
    near = own[:, [OWN.index(c) for c in NEAR]]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    top = np.zeros(len(begin), bool)
    top[borders[:-1][np.diff(borders) > 0]] = True
    bottom = np.roll(top, -1)
    before[top], after[bottom] = 0, 0
    return np.concatenate([own, before, after, top[:, None], bottom[:, None]], axis=1), end - begin, borders


def forward_backward(score: np.ndarray, borders: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of good per line, and chances (from, to) of the label pairs summed over all neighbouring lines.

    ``score`` is the log-odds of good from the features alone, ``step`` the 2 x 2 scores
    of neighbouring labels. All chains advance together, longest first.
    """
    length = np.diff(borders)
    order = np.argsort(-length, kind="stable")
    first, length = borders[:-1][order], length[order]
    if not len(length) or not length[0]:
        return np.zeros(0), np.zeros((2, 2))
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # chains with a line at each step
    node = np.stack([np.zeros_like(score), score], axis=1)
    ahead, behind = np.zeros_like(node), np.zeros_like(node)
    for t in range(length[0]):
        i = first[:alive[t]] + t
        ahead[i] = node[i]
        if t:
            ahead[i] += np.logaddexp(ahead[i - 1][:, :1] + step[0], ahead[i - 1][:, 1:] + step[1])
    pairs = np.zeros((2, 2))
    for t in range(length[0] - 2, -1, -1):
        i = first[:alive[t + 1]] + t
        after = node[i + 1] + behind[i + 1]
        behind[i] = np.stack([np.logaddexp(step[y, 0] + after[:, 0], step[y, 1] + after[:, 1]) for y in (0, 1)], axis=1)
        joint = ahead[i][:, :, None] + step + after[:, None, :]
        joint -= np.logaddexp(ahead[i, 0] + behind[i, 0], ahead[i, 1] + behind[i, 1])[:, None, None]
        pairs += np.exp(joint).sum(0)
    both = ahead + behind
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60))), pairs


def weighted_mean(good: np.ndarray, length: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Per text the mean of ``good`` weighted by length; nan without lines."""
    def total(x):
        return np.diff(np.concatenate([[0], np.cumsum(x)])[borders])

    with np.errstate(invalid="ignore"):
        return total(good * length) / total(length)


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 0.0
    shift: float = 0.0
    share: float = 0.5

    def marginals(self, features: np.ndarray, borders: np.ndarray) -> np.ndarray:
        return forward_backward(features @ self.weights, borders, self.step)[0]

    def scores(self, mean: np.ndarray) -> np.ndarray:
        if not self.weights.any():  # nothing was learnt
            return np.full(len(mean), self.share)
        with np.errstate(invalid="ignore"):
            out = 1 / (1 + np.exp(-np.clip(self.slope * mean + self.shift, -30, 30)))
        return np.where(np.isnan(mean), self.share, out)


def train(features: np.ndarray, length: np.ndarray, borders: np.ndarray, quality: np.ndarray, steps: int = 60, penalty: float = 1e-4) -> Model:
    """Fit on texts given by their lines; ``quality`` is 0 or 1 per text.

    The chain maximises the conditional likelihood of the line labels (Adam), then a
    logistic curve maps the texts' means to chances.
    """
    model = Model(share=float(quality.mean()) if len(quality) else 0.5)
    if len(np.unique(quality)) < 2 or not len(features):
        return model
    labels = quality[np.repeat(np.arange(len(quality)), np.diff(borders))]
    inside = np.ones(len(labels), bool)
    inside[borders[:-1][np.diff(borders) > 0]] = False
    follow = np.flatnonzero(inside)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (labels[follow - 1], labels[follow]), 1)
    params = np.zeros(len(FEATURES) + 4)
    drift, square = np.zeros_like(params), np.zeros_like(params)
    for i in range(1, steps + 1):
        good, pairs = forward_backward(features @ params[:-4], borders, params[-4:].reshape(2, 2))
        slope = np.concatenate([features.T @ (labels - good), (seen_pairs - pairs).ravel()]) / len(labels) - penalty * params
        drift, square = 0.9 * drift + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        params += 0.1 * (drift / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    model.weights, model.step = params[:-4], params[-4:].reshape(2, 2)
    mean = weighted_mean(model.marginals(features, borders), length, borders)
    known = ~np.isnan(mean)
    x, y = mean[known], quality[known].astype(float)
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps of a logistic curve with a little ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        grad = np.array([((y - p) * x).sum() - 0.5 * a, (y - p).sum()])
        curve = np.array([[(w * x * x).sum() + 0.5, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(curve, grad)
        a, b = a + np.clip(move[0], -5, 5), b + np.clip(move[1], -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    model.slope, model.shift = float(a), float(b)
    return model


def fit(docs: DataFrame, labels: DataFrame, max_texts: int = 3000, max_lines: int = 300, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Train on the bounded sample; at most ``max_texts`` ids and ``max_texts * max_lines`` lines reach the driver."""
    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("quality"))
        .orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(max_texts)
    )
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            features, length, borders = line_features(Texts(part.column(0)))
            keep = np.flatnonzero(np.diff(borders) <= max_lines)
            lines = [slice(borders[i], borders[i + 1]) for i in keep]
            yield pa.RecordBatch.from_arrays([
                part.column(1).take(pa.array(keep)), part.column(2).take(pa.array(keep)),
                pa.array([features[s].astype(np.float32).tobytes() for s in lines], pa.binary()),
                pa.array([length[s].astype(np.int64).tobytes() for s in lines], pa.binary()),
            ], ["id", "quality", "features", "length"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.select("text", "id", "quality").mapInArrow(scan, f"id {kind}, quality int, features binary, length binary").collect()
    rows = sorted(rows, key=lambda r: (r.id, r.quality, bytes(r.features)))  # the order of tasks must not matter
    features = np.frombuffer(b"".join(r.features for r in rows), np.float32).reshape(-1, len(FEATURES)).astype(float)
    length = np.frombuffer(b"".join(r.length for r in rows), np.int64)
    borders = np.concatenate([[0], np.cumsum([len(r.length) // 8 for r in rows], dtype=np.int64)]).astype(np.int64)
    return train(features, length, borders, np.array([r.quality for r in rows], np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_lines, n_bad_lines) per row; lines with a chance of good below a half are bad."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            features, length, borders = line_features(Texts(part.column(1)))
            good = model.marginals(features, borders)
            bad = np.concatenate([[0], np.cumsum(good < 0.5)])[borders]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(model.scores(weighted_mean(good, length, borders))),
                pa.array(np.diff(borders)), pa.array(np.diff(bad).astype(np.int64)),
            ], ["id", "score", "n_lines", "n_bad_lines"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(scan, f"id {kind}, score double, n_lines long, n_bad_lines long").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns whose score is at least ``least``; nothing is joined or shuffled."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, names[at]):
            features, length, borders = line_features(Texts(part.column(at)))
            scores = model.scores(weighted_mean(model.marginals(features, borders), length, borders))
            yield part.filter(pa.array(scores >= least))

    return docs.toDF(*names).mapInArrow(scan, schema).toDF(*docs.columns)
