"""N-gram join and decontamination against brute force."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from kinweave.llm import decontaminate as D, ngram_join as J


def grams(words, n):
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows, n, t):
    sets = [(i, grams((text or "").lower().split(), n)) for i, text in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1:]:
            if x and y and len(x & y) * t.denominator >= len(x | y) * t.numerator:
                i2, j2 = find(i), find(j)
                root[max(i2, j2)] = min(i2, j2)
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize("t", ["0.85", "0.8"])
@pytest.mark.parametrize("size", [70, 200, 1000, 3000, 8000])
def test_unrelated_sets_hardly_share_keys(t, size):
    """Parts that happen to be empty must not bring sets together."""
    tiles, rng = J.Tiles(Fraction(t)), np.random.default_rng(size)
    keys = [set(J.keys_of(np.unique(rng.integers(0, 1 << 64, size, np.uint64)), tiles).tolist()) for _ in range(120)]
    shared = sum(len(a & b) for i, a in enumerate(keys) for b in keys[i + 1:])
    assert shared <= 0.02 * len(keys) * (len(keys) - 1) / 2


@pytest.mark.parametrize("t", ["0.85", "0.8", "0.5"])
def test_linked_sets_always_share_a_key(t):
    """The pigeonhole promise, over all sizes from one element to thousands."""
    t, rng = Fraction(t), np.random.default_rng(1)
    tiles = J.Tiles(t)
    for size in [*range(1, 60), 75, 100, 180, 320, 700, 1500]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            most = int((1 - t) / (1 + t) * 2 * size) + 1
            out, new = rng.integers(0, most + 1), rng.integers(0, most + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[min(out, len(a)):], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and both * t.denominator >= len(np.union1d(a, b)) * t.numerator and J.class_of(a) != J.class_of(b):
                assert len(np.intersect1d(J.keys_of(a, tiles), J.keys_of(b, tiles))), (size, len(b), both)


def test_signatures_bound_the_overlap_from_above():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 4000, n).astype(np.uint64)) for n in (1, 5, 100, 100, 400, 3000)]
    signs = J.Signatures([J.bitmap_of(s) for s in sets], np.array([len(s) for s in sets]))
    x, y = map(np.array, zip(*[(i, j) for i in range(6) for j in range(6)]))
    true = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)])
    assert (signs.overlap_bound(x, y) >= true).all()


@pytest.mark.parametrize("n,t", [(4, "0.85"), (5, "0.8")])
def test_components_equal_brute_force(spark, n, t, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)  # so that keys with many sets are compared in blocks
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    passage = rng.choices(vocabulary, k=60)
    for group in range(25):
        base = rng.choices(vocabulary, k=rng.choice([4, 6, 9, 15, 40, 120, 300]))
        for _ in range(rng.choice([1, 2, 3, 12])):
            words = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if group % 5 == 0:
                words = words + passage
            rows.append((k * 7 % 1000, " ".join(words)))
            k += 1
    rows += [(2001, None), (2002, ""), (2003, "one two"), (2004, "One  two"), (2005, "one two three"), (None, rows[0][1]), rows[3], rows[3]]
    docs = spark.createDataFrame([(i, x, 0, "c") for i, x in rows], "doc_id long, text string, n_shingles int, class string")
    out = J.similar_components(docs, n, t).collect()
    assert len(out) == len(rows)
    want = brute(rows, n, Fraction(t))
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert {r.doc_id: r.n_shingles for r in out}[2001] == 0
    assert len(set(want.values())) < len(want)


def test_no_rows_no_components(spark):
    assert J.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- decontamination ----

ITEM = ("Anna bought 12 apples and gave 5 apples to Ben before noon, so how many apples does Anna still have "
        "when she walks 3 km home with Ben and the dog")


def leaks(spark, texts, items=((1, ITEM),), **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.leaks(docs, bench, **options).collect()}


def test_reworded_slots_are_found_and_must_be_consistent(spark):
    changed = ITEM.replace("Anna", "Carla").replace("Ben", "Dora").replace("12", "40").replace("5", "7")
    mixed = ITEM.replace("5 apples to Ben", "12 apples to Ben").replace("3 km", "9 miles").replace("home with Ben", "home with Anna")
    texts = [
        "before it " + ITEM + " and after", "said. " + changed, ITEM.upper(), mixed, "Nothing of the kind is here at all, really not.",
        ITEM[:60], None, "", " ".join(str(i) for i in range(80)), "intro " * 3000 + ITEM,
    ]
    found = leaks(spark, texts)
    assert {d for d, _ in found} == {0, 1, 2, 9}
    assert found[0, 1].n_changed == 0 and found[1, 1].n_changed >= 3


def test_both_ways_of_meeting_give_the_same(spark, monkeypatch):
    texts = [ITEM, "x " + ITEM.replace("12", "13"), "unrelated words only in this short text"]
    sent = leaks(spark, texts)
    monkeypatch.setattr(D, "SENT", 0)
    assert leaks(spark, texts) == sent and len(sent) == 2


def test_short_items_empty_tables_and_nulls(spark):
    items = [(1, "the quick brown fox"), (2, "too short"), (3, None), (None, ITEM), (4, "")]
    found = leaks(spark, ["see the quick brown fox run", ITEM, "too short"], items)
    assert set(found) == {(0, 1)}
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert D.leaks(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0
    assert D.leaks(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_a_clash_drops_only_the_windows_that_hold_it(spark):
    item = "Tom had 12 pears and 5 plums in the old basket that his aunt had left for him behind the door of the shed and ate 12 of them"
    n = len(item.split())
    texts = [
        item.replace("12 pears", "4 pears").replace("5 plums", "4 plums").replace("12 of", "4 of"),  # two numbers have become one
        item.replace("12 of", "13 of"),  # one of two mentions has changed
        item.replace("12 pears", "1 pears").replace("5 plums", "2 plums").replace("12 of", "3 of"),
    ]
    found = leaks(spark, texts, [(1, item)])
    assert {d for d, _ in found} == {0, 1, 2}
    assert (found[0, 1].covered, found[0, 1].n_slots, found[0, 1].n_changed) == (n, 2, 2)
    # The 23 words from pears to ate lie in windows without a 12; the only other value in them is the 5.
    assert found[1, 1].covered >= 23 and found[1, 1].n_changed == 0
    assert (found[2, 1].covered, found[2, 1].n_slots, found[2, 1].n_changed) == (23, 1, 1)


def test_questions_with_numbers_drawn_anew_are_found_whatever_numbers_coincide(spark):
    item = "A box with 3 red and 7 blue and 11 green and 19 white balls is shaken well before any of them is drawn"
    rng = random.Random(5)
    texts = [re.sub(r"\d+", lambda _: str(rng.randint(1, 20)), item) for _ in range(60)]
    found = leaks(spark, texts, [(1, item)])
    assert len(found) == 60 and {r.covered for r in found.values()} == {len(item.split())}


def test_verbatim_copies_of_items_dense_in_numbers_are_found(spark):
    table = "Rates 1.5 2.5 3.5 4.5 and 12 km 13 km 14 km 15 km 16 km 17 km 18 km"
    items = [(1, "Compute 12 + 35 - 7"), (2, table), (3, "7 8 9 10 11"), (4, ITEM)]
    texts = [
        "now compute 12 + 35 - 7 please", "compute 12 + 35 - 8", "SEE " + table.upper(), table.replace("2.5", "9.5"), table.replace("km", "miles"), "6 7 8 9 10 11 12",
        ITEM, ITEM.replace("apples does", "apples, for 9 did") + " " + ITEM.replace("12", "5"), "7 8 9 10",
    ]
    found = leaks(spark, texts, items)
    assert set(found) == {(0, 1), (2, 2), (3, 2), (5, 3), (6, 4), (7, 4)}
    assert found[0, 1].covered == 4 and (found[2, 2].covered, found[2, 2].n_changed) == (found[2, 2].n_words, 0)


def test_a_verbatim_copy_is_found_beside_a_clashing_row_of_the_same_id(spark):
    changed = ITEM.replace("12", "40").replace("5", "40").replace("3", "7").replace("Ben", "Dora", 1)
    docs = spark.createDataFrame([(1, ITEM), (1, changed)], "doc_id long, text string")
    rows = D.leaks(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()
    assert [(r.covered, r.n_changed) for r in rows] == [(rows[0].n_words, 0)]
