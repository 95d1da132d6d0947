"""Benchmark decontamination by template canonicalisation.

Texts become sequences of lower-cased words without outer punctuation in which
numbers, names and units are typed placeholders. Windows of these templates are
hash-joined with the benchmark's, so a question comes up again when its numbers or
names were replaced. The replacement must be consistent: along an alignment of a
document with an item, equal values of the item stand for equal values of the document,
and different names for different names (numbers drawn anew may well coincide). Windows
that hold a value for which this fails are left out, all others of the alignment count,
so windows without placeholders always do. Windows with numbers or units are also compared
word for word, and an item is covered by the better of two readings: by its consistent
windows, or by those that stand in the document as they are. A document leaks an item
when enough of it is covered.

* number: a word of digits and marks, or digits with up to three letters ("5km");
* unit: a word of ``UNITS`` after a number;
* name: a plain capital followed by a small letter, not at the start of a line or sentence. Windows
  with names are also compared with the names as they stand, whatever the case; such a name stands for itself.

Windows have ``size`` words; an item with fewer words is one window of its own
length. Templates of which less than half are literal words say nothing, so such windows
are compared word for word only; items of fewer than ``least`` words are skipped.

A null or empty text has no windows. Documents without id cannot be named and are left
out of the result; rows that share an id are one document; repeated items are reported
each; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from kinweave.llm.quality_rules import CAPITALS, LETTERS, SMALL
from kinweave.llm.words import SPACE, Texts, mix, slices, windows
from kinweave.operators.skew import cut, cut_counted

UNITS = (
    "%|percent|mm|cm|m|km|inch|inches|foot|feet|yard|yards|mile|miles|mg|g|kg|t|ton|tons|oz|lb|lbs|pound|pounds|ml|l|"
    "litre|litres|liter|liters|gallon|gallons|s|sec|second|seconds|min|minute|minutes|h|hour|hours|day|days|week|weeks|"
    "month|months|year|years|cent|cents|dollar|dollars|euro|euros|usd|eur|hz|khz|mhz|ghz|w|kw|kwh|v|j|kj|cal|kcal|"
    "degrees|celsius|fahrenheit|kb|mb|gb|tb|mph|kmh"
).split("|")

#: So many benchmark window hashes (8 bytes each) are sent to every task; beyond, document windows are shuffled to them.
SENT = 2_000_000

_DIGITS = np.zeros(256, bool)
_DIGITS[ord("0"):ord("9") + 1] = True
_WORD = LETTERS | _DIGITS
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True
_NUMBER, _NAME, _UNIT = (np.uint64(i) for i in (1, 2, 3))


def _unit_hashes() -> np.ndarray:
    units = Texts(pa.array(UNITS))
    return np.sort(units.hashes(units.at[:-1], units.at[1:]))


def _inner_words(texts: Texts) -> tuple[np.ndarray, ...]:
    """(begin, past, start, end, text) of the words with a letter or digit: without and with their outer marks."""
    start, end, first = texts.runs(SPACE[texts.data])
    inner = np.flatnonzero(_WORD[texts.data])
    low, high = np.searchsorted(inner, start), np.searchsorted(inner, end)
    kept = high > low
    low, high = low[kept], high[kept]
    return inner[low], inner[high - 1] + 1, start[kept], end[kept], np.repeat(np.arange(len(texts)), np.diff(first))[kept]


def template(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash and own hash of every word, whether it is a placeholder, whether a name, and per text its first word (n + 1 borders)."""
    texts, small = Texts(column), Texts(pc.utf8_lower(column))
    data = texts.data
    begin, past, start, end, owner = _inner_words(texts)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool), first
    own = small.hashes(*_inner_words(small)[:2])

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        return total[past] - total[begin]

    letters = count(LETTERS)
    number = _DIGITS[data[begin]] & (letters <= 3)
    follows = np.zeros(len(start), bool)
    follows[1:] = owner[1:] == owner[:-1]
    unit = np.zeros(len(start), bool)
    unit[1:] = number[:-1] & follows[1:] & np.isin(own[1:], _unit_hashes())
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    inside = follows.copy()
    inside[1:] &= ~_STOP[data[end[:-1] - 1]] & (breaks[start[1:]] == breaks[end[:-1]])
    second = np.minimum(begin + 1, len(data) - 1)
    name = inside & CAPITALS[data[begin]] & (past - begin > 1) & (SMALL[data[second]] | (data[second] >= 0x80)) & ~unit
    slot = number | unit | name
    kind = np.where(number, _NUMBER, np.where(unit, _UNIT, _NAME))
    return np.where(slot, mix(kind), own), own, slot, name, first


def _windows(column: pa.Array, widths: tuple[int, ...]) -> Iterator[tuple]:
    """(width, text, hash, place, slots, shown, words per text) for the windows of each width.

    Templates are those that are at least half literal. ``slots`` are the values of the placeholders,
    ``shown`` those of names, numbers and units that stand as plain words.
    Windows with names come a second time with the names as plain words, for texts that are
    all in capitals or small letters, and windows with numbers or units once more with all words
    as they stand, however many of them are literal.
    """
    words, own, slot, name, first = template(column)
    values = own & ~np.uint64(1) | name.astype(np.uint64)  # the lowest bit tells names
    none = np.zeros(len(slot), bool)
    for text, marked, must in ((words, slot, None), (np.where(name, own, words), slot & ~name, name), (own, none, slot & ~name)):
        if must is not None:
            if not must.any():
                continue
            must_before = np.concatenate([[0], np.cumsum(must)])
        slots_before, shown_before = (np.concatenate([[0], np.cumsum(m)]) for m in (marked, slot & ~marked))
        hidden, shown = values[marked].view(np.int64), values[slot & ~marked].view(np.int64)
        for width in widths:
            hashes, begin, borders = windows(text, first, width)
            hashes = mix(hashes + np.uint64(width))
            owner = np.repeat(np.arange(len(column)), np.diff(borders))
            n_slots = slots_before[begin + width] - slots_before[begin]
            fine = 2 * n_slots <= width
            if must is not None:
                fine &= must_before[begin + width] > must_before[begin]
            n_shown = shown_before[begin + width] - shown_before[begin]
            yield (width, owner[fine], hashes[fine], (begin - first[owner])[fine], (slots_before[begin][fine], n_slots[fine], hidden),
                   (shown_before[begin][fine], n_shown[fine], shown), np.diff(first))


def _lists(slots: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> pa.Array:
    begin, n, values = slots[0][at], slots[1][at], slots[2]
    border = np.concatenate([[0], np.cumsum(n)])
    index = np.repeat(begin - border[:-1], n) + np.arange(border[-1])
    return pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(values[index]))


def item_windows(items: DataFrame, size: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """(item, n_words, place, width, hash, slots, shown) for every window of every item."""
    source = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for width, owner, hashes, place, slots, shown, n in _windows(part.column(1), tuple(range(least, size + 1))):
                mine = np.flatnonzero(n[owner] == width if width < size else n[owner] >= size)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner[mine])), pa.array(n[owner[mine]]), pa.array(place[mine]),
                     pa.array(np.full(len(mine), width)), pa.array(hashes[mine].view(np.int64)), _lists(slots, mine), _lists(shown, mine)],
                    ["item", "n_words", "place", "width", "hash", "slots", "shown"],
                )

    kind = source.schema["item"].dataType.simpleString()
    return source.mapInArrow(scan, f"item {kind}, n_words long, place long, width long, hash long, slots array<long>, shown array<long>")


def document_windows(docs: DataFrame, widths: tuple[int, ...], wanted: np.ndarray | None, id_col: str, text_col: str) -> DataFrame:
    """(id, at, hash, slots) for every window of every document, or those whose hash is in the sorted ``wanted``."""
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for _, owner, hashes, place, slots, _, _ in _windows(part.column(1), widths):
                signed = hashes.view(np.int64)
                mine = np.arange(len(signed))
                if wanted is not None:
                    found = np.minimum(np.searchsorted(wanted, signed), max(len(wanted) - 1, 0))
                    mine = np.flatnonzero(wanted[found] == signed) if len(wanted) else mine[:0]
                if len(mine):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(owner[mine])), pa.array(place[mine]), pa.array(signed[mine]), _lists(slots, mine)],
                        ["id", "at", "hash", "slots"],
                    )

    return source.mapInArrow(scan, f"id {source.schema['id'].dataType.simpleString()}, at long, hash long, slots array<long>")


def _clashing(pairs: str, field: str) -> Column:
    """Item values of the sorted distinct ``pairs`` that share their ``field`` with a neighbour."""
    same = lambda p, i: F.get(F.col(pairs), i)[field] == p[field]
    return F.transform(F.filter(pairs, lambda p, i: same(p, i - 1) | same(p, i + 1)), lambda p: p.item)


def leaks(
    docs: DataFrame, items: DataFrame, size: int = 8, least: int = 4, share: float = 0.6, enough: int = 25,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, item, n_words, covered, n_slots, n_changed): documents that hold ``share`` of an item or ``enough`` words of it.

    ``covered`` counts the item's words in windows of the better reading, ``n_slots`` the distinct
    placeholder values of the item among them, ``n_changed`` those with another value in the document.
    """
    bench, n = cut_counted(item_windows(items.where(F.col(item_id).isNotNull()), size, least, item_id, item_text))
    widths = tuple(sorted(r.width for r in bench.select("width").distinct().collect()))  # at most ``size`` of them
    wanted = None
    if n <= SENT:  # a checked size: tasks look the hashes up, only matching windows leave them
        wanted = np.unique(np.array([r.hash for r in bench.select("hash").distinct().collect()], np.int64))
    found = document_windows(docs, widths, wanted, id_col, text_col)
    met = cut(
        found.join(bench.withColumnsRenamed({"slots": "item_slots"}), "hash")
        .select("id", "item", "n_words", "place", "width", (F.col("at") - F.col("place")).alias("shift"), (F.size("item_slots") == 0).alias("exact"),
                F.concat(
                    F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("item"), d.alias("doc"))),
                    F.transform("shown", lambda v: F.struct(v.alias("item"), v.alias("doc"))),
                ).alias("values"))
    )
    # An alignment has each place of an item at most once per document text, so its groups are as small as items.
    aligned = met.groupBy("id", "item", "n_words", "shift").agg(
        F.collect_set(F.struct("place", "width", "values", "exact")).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set("values"))).alias("pairs"),
    )
    named = F.filter("pairs", lambda p: p.item.bitwiseAND(1) == 1)
    sides = aligned.withColumns({
        "by_item": F.array_sort("pairs"),
        "by_name": F.array_sort(F.transform(named, lambda p: F.struct(p.doc.alias("doc"), p.item.alias("item")))),
    }).withColumn("bad", F.array_union(_clashing("by_item", "item"), _clashing("by_name", "doc")))
    fits = lambda w: ~F.arrays_overlap(w.getField("values").getField("item"), F.col("bad"))
    readings = sides.withColumns({
        "consistent": F.when(F.size("bad") == 0, F.col("windows")).otherwise(F.filter("windows", fits)),
        "verbatim": F.filter("windows", lambda w: w.exact),
    })
    places = lambda windows: F.array_sort(F.array_distinct(F.flatten(F.collect_set(
        F.transform(windows, lambda w: F.struct(w.place.alias("place"), w.width.alias("width")))))))
    values = lambda windows: F.array_distinct(F.flatten(F.flatten(F.collect_set(f"{windows}.values"))))
    # Words under the union of the windows: each adds what the next one leaves to it.
    covered = lambda places: F.expr(f"""aggregate(transform({places}, (p, i) ->
        least(p.width, coalesce(get({places}, i + 1).place - p.place, p.width))), 0L, (a, x) -> a + x)""")  # noqa: E731
    joined = readings.groupBy("id", "item", "n_words").agg(
        places("consistent").alias("places"), values("consistent").alias("values"),
        places("verbatim").alias("same_places"), values("verbatim").alias("same_values"),
    ).withColumns({"covered": covered("places"), "same": covered("same_places")})
    joined = joined.withColumn("values", F.when(F.col("same") > F.col("covered"), F.col("same_values")).otherwise(F.col("values"))) \
        .withColumn("covered", F.greatest("covered", "same"))
    return joined.select(
        F.col("id").alias(id_col), F.col("item").alias(item_id), "n_words", "covered",
        F.size("values").cast("long").alias("n_slots"),
        F.size(F.filter("values", lambda v: v.item != v.doc)).cast("long").alias("n_changed"),
    ).where((F.col("covered") >= F.col("n_words") * share) | (F.col("covered") >= enough))
