"""Weak supervision of text quality: rules vote or abstain, EM weighs them, a posterior decides.

1. One scan counts a few things per text (``measure``).
2. Every rule turns the counts into a vote: 1 good, -1 bad, 0 no opinion (``RULES``).
3. The votes of all texts are summed up as a histogram of vote patterns: at most
   3 ** len(rules) rows, whatever the number of texts.
4. Expectation-maximisation on the histogram estimates how common good texts are
   and how often each rule votes which way on good and on bad texts (``fit``).
5. The posterior of a pattern is looked up again for each text (``judge``).

Nothing needs a label, and no single rule removes a text.

Null and empty texts have zero words and no votes but those of rules about
length; their posterior follows from these. Repeated rows are counted and judged
one by one, ties at the threshold are kept, an empty table gives an empty result.
Columns of the input other than the id and the text are not read, so their names
cannot clash. Only the histogram reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinweave.llm.words import SPACE, Texts, mix, slices, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STOPS = np.zeros(256, bool)
STOPS[list(b".,;:?")] = True
CAPITALS = np.zeros(256, bool)
CAPITALS[ord("A"):ord("Z") + 1] = True
SMALL = np.zeros(256, bool)
SMALL[ord("a"):ord("z") + 1] = True
LETTERS = CAPITALS | SMALL
LETTERS[0x80:] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stops", "n_capitals", "n_small", "n_short_words")


def repeated(keys: np.ndarray) -> np.ndarray:
    """The values that occur twice or more."""
    keys = np.sort(keys)
    return np.unique(keys[1:][keys[1:] == keys[:-1]])


def count_batch(texts: Texts) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for each text."""
    data, n = texts.data, len(texts)
    apart = SPACE[data]
    starts, ends, first = texts.runs(apart)
    words = texts.hashes(starts, ends)
    owner = np.repeat(np.arange(n), np.diff(first))
    lead = (data & 0xC0) != 0x80  # the first byte of a code point

    # 3-word windows that the same text has twice: mark every word they cover.
    three, begin, borders = windows(words, first, 3)
    three ^= mix(np.repeat(np.arange(n), np.diff(borders)).astype(np.uint64))
    again = begin[np.isin(three, repeated(three))]
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[again + i] = True

    # Lines with a word that equal an earlier line of the same text.
    line_start, line_end, line_first = texts.runs(data == 0x0A)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_owner = np.repeat(np.arange(n), np.diff(line_first))[has_word]
    lines = texts.hashes(line_start, line_end)[has_word] ^ mix(line_owner.astype(np.uint64))
    kept = np.unique(lines, return_index=True)[1]

    return {
        "n_words": np.diff(first),
        "word_chars": texts.counts(lead & ~apart),
        "n_symbols": texts.counts(SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_owner, minlength=n) - np.bincount(line_owner[kept], minlength=n),
        "n_repeat_words": np.bincount(owner[covered], minlength=n),
        "n_stops": texts.counts(STOPS[data]),
        "n_capitals": texts.counts(CAPITALS[data]),
        "n_small": texts.counts(SMALL[data]),
        "n_short_words": np.bincount(owner[(ends - starts <= 3) & LETTERS[data[starts]]], minlength=n),
    }


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and counts per row, one Arrow scan without a shuffle."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts = count_batch(Texts(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], ["id", *COUNTS]
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(scan, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str = "false"


#: Ratios are written as products, so no rule divides by zero. A rule that knows one kind of junk only
#: abstains elsewhere: its silence says nothing about other kinds.
RULES = (
    Rule("symbols", "20 * n_symbols > 3 * n_words", "100 * n_symbols < n_words"),
    Rule("noise", "n_symbols > n_words"),
    Rule("repeats", "10 * n_repeat_words > 3 * n_words", "50 * n_repeat_words < n_words AND n_words >= 30"),
    Rule("lines", "n_dup_lines >= 3 AND n_repeat_words * 10 > n_words"),
    Rule("capitals", "n_capitals > n_small AND n_words > 0"),
    Rule("little_words", "20 * n_short_words < n_words", "6 * n_short_words > n_words"),
    Rule("sentences", "60 * n_stops < n_words", "25 * n_stops > n_words AND 2 * n_stops < n_words AND n_words >= 30"),
    Rule("word_length", "n_words > 0 AND (word_chars > 12 * n_words OR word_chars < 2 * n_words)"),
    Rule("length", "n_words < 20", "n_words >= 50"),
)


def votes(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> Column:
    """One number per row that spells its votes in base 3 (0 abstain, 1 good, 2 bad)."""
    out = F.lit(0)
    for r in rules:
        out = out * 3 + F.expr(f"CASE WHEN {r.bad} THEN 2 WHEN {r.good} THEN 1 ELSE 0 END")
    return out.cast("int")


def spelled(patterns: np.ndarray, n_rules: int) -> np.ndarray:
    """Votes (0, 1, 2) of each pattern, a column per rule in the order of the rules."""
    return np.stack([patterns // 3 ** (n_rules - 1 - i) % 3 for i in range(n_rules)], axis=1)


@dataclass(frozen=True)
class Model:
    """Share of good texts, and per rule the chances of (abstain, good, bad) on bad [0] and good [1] texts."""

    good_share: float
    chances: np.ndarray

    def posterior(self, table: np.ndarray) -> np.ndarray:
        logs = np.log(self.chances)
        rules = np.arange(table.shape[1])
        good = np.log(self.good_share) + logs[1][rules, table].sum(1)
        bad = np.log1p(-self.good_share) + logs[0][rules, table].sum(1)
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def fit(table: np.ndarray, weight: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> Model:
    """EM over a histogram of vote patterns.

    It starts from the belief that a bad vote outweighs a good one (junk of one
    kind looks fine to the rules for the others) and stops when the posteriors
    stand still. Smoothing keeps every chance above zero.
    """
    good_votes, bad_votes = (table == 1).sum(1), (table == 2).sum(1)
    belief = 1 / (1 + np.exp(6.0 * bad_votes - 1.0 * good_votes))
    total = weight.sum()
    model = Model(0.5, np.full((2, table.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        chances = np.empty((2, table.shape[1], 3))
        for side, share in ((0, (1 - belief) * weight), (1, belief * weight)):
            for v in range(3):
                chances[side, :, v] = ((table == v) * share[:, None]).sum(0) + smooth
            chances[side] /= chances[side].sum(1, keepdims=True)
        model = Model(float(np.clip(((belief * weight).sum() + smooth) / (total + 2 * smooth), 1e-6, 1 - 1e-6)), chances)
        fresh = model.posterior(table)
        if np.abs(fresh - belief).max(initial=0) < 1e-9:
            break
        belief = fresh
    return model


def judge(counts: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``counts`` with ``pattern``, ``posterior`` (of being good) and ``good`` (posterior at or above the threshold).

    ``counts`` is read twice, so pass a table that is written or cheap to scan. The
    histogram and the looked-up posteriors have at most 3 ** len(rules) rows.
    """
    spark = counts.sparkSession
    voted = counts.withColumn("pattern", votes(counts, rules))
    rows = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    patterns = np.array([r.pattern for r in rows], np.int64)
    table = spelled(patterns, len(rules))
    model = fit(table, np.array([r.n for r in rows], float))
    found = spark.createDataFrame(
        [(int(p), float(q)) for p, q in zip(patterns, model.posterior(table))], "pattern int, posterior double"
    )
    return voted.join(F.broadcast(found), "pattern").withColumn("good", F.col("posterior") >= threshold)
