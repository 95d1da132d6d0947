"""Divergence of sources: brute force in plain numbers, many blocks, edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from kinweave.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, value long, term string, n int, total string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, top):
    texts = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    held, count, groups = defaultdict(set), Counter(), defaultdict(set)
    for i, (lang, source, terms) in enumerate(texts):
        groups[lang].add(source)
        for t in terms:
            held[lang, t].add(i)
            count[lang, source, t] += 1
    out = []
    for lang, sources in groups.items():
        vocabulary = [t for (x, t), docs in held.items() if x == lang and len(docs) >= 3]

        def p(counts):
            whole = sum(counts.values()) + len(vocabulary)
            return {t: 1 + 10**9 * (counts[t] + 1) // whole for t in vocabulary}

        own = {s: {t: count[lang, s, t] for t in vocabulary} for s in sources}
        every = p({t: sum(own[s][t] for s in sources) for t in vocabulary})
        ps = {s: p(own[s]) for s in sources}
        for s in sources:
            pairs = [(sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in vocabulary), o) for o in sources if o != s]
            terms = [((ps[s][t] - every[t]) ** 2 // every[t], t) for t in vocabulary if own[s][t] and ps[s][t] > every[t]]
            for part, values, limit in (("pair", pairs, None), ("term", terms, top)):
                values.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(values[:limit])]
    return sorted(out)


def made(seed, docs, sources, words):
    rng = random.Random(seed)
    rows = []
    for i in range(docs):
        source = "hot" if rng.random() < 0.4 else rng.choice([None, "", *[f"s{k}" for k in range(sources)]])
        text = rng.choice([None, "", "12 -- 7", " ".join(rng.choice([f"w{chr(97 + w % 26)}{chr(97 + w // 26)}", "The", "ÉtÉ", "naïve", "ſK"])
                                                       for w in (int(rng.paretovariate(0.7)) % words for _ in range(rng.randint(1, 60))))])
        rows.append((i % 50, text, rng.choice(["en", "en", "de", None, ""]), source, 1, "x", 2, "y"))
    return rows


@pytest.mark.parametrize("seed, docs, sources, words, blocks, terms", [(1, 90, 4, 60, 32, 4096), (2, 150, 9, 200, 2, 7), (3, 5, 3, 5, 1, 1)])
def test_brute_force(spark, monkeypatch, seed, docs, sources, words, blocks, terms):
    monkeypatch.setattr(D, "SOURCES", blocks)
    monkeypatch.setattr(D, "TERMS", terms)
    rows = made(seed, docs, sources, words)
    got = D.audit(spark.createDataFrame(rows, SCHEMA), top=15)
    assert sorted(map(tuple, got.collect())) == brute(rows, 15)


def test_totals_joined_by_a_shuffle_give_the_same(spark, monkeypatch):
    rows = made(4, 60, 3, 40)
    monkeypatch.setattr(D, "SENT", 0)
    assert sorted(map(tuple, D.audit(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows, 200)


def test_small_blocks_of_text_give_the_same(spark, monkeypatch):
    import pyarrow as pa

    rows = made(5, 40, 3, 30)
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "" for r in rows], "source": [r[3] or "" for r in rows], "text": [r[1] or "" for r in rows]})

    def total():
        out = Counter()
        for b in D._count_terms(iter([batch])):
            for x in b.to_pylist():
                out[x["lang"], x["source"], x["term"], "n"] += x["n"]
                out[x["lang"], x["source"], x["term"], "docs"] += x["docs"]
        return out

    whole = total()
    from kinweave.llm import words

    monkeypatch.setattr(words, "SLICE_BYTES", 50)
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)
    assert total() == whole and whole


def test_empty_table_and_one_very_long_text(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "ab " * 2_000_000, "en", "a", 1, "", 1, ""), (2, "ab cd", "en", "b", 1, "", 1, ""), (3, "ab cd", "en", "b", 1, "", 1, "")]
    assert sorted(map(tuple, D.audit(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows, 200)


def test_whole_numbers_stay_exact_for_large_counts(spark):
    count, total = 5 * 10**14 + 12345, 9 * 10**15 - 1
    want = 1 + 10**9 * count // total
    assert spark.range(1).select(D.probability(str(count), f"{total}").alias("p")).first()["p"] == want
    import numpy as np

    assert D.probabilities(np.array([count]), np.array([total])).tolist() == [want]


def test_top_terms_are_cut_before_the_shuffle(spark):
    rows = made(6, 20, 2, 20)
    assert "WindowGroupLimit" in D.audit(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().toString()
