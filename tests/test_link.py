"""Linking and components against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinweave import schema as S
from kinweave.operators import link, skew
from kinweave.operators.components import connected_components


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def people(spark, rows):
    """rows: (id, name, city, country, emails)"""
    d = spark.createDataFrame(rows, "candidate_id string, full_name string, city string, country string, emails array<string>")
    return S.conform(
        d.select(
            "candidate_id", "full_name", "emails",
            F.struct("city", F.lit(None).cast("string").alias("region"), "country", F.lit(None).cast("string").alias("raw")).alias("location"),
        )
    )


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rnd = random.Random(3)
    if shape == "chain":
        pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60) if i % 20 != 19]
    elif shape == "star":
        pairs = [("n500", f"n{i:03}") for i in range(80)]
    else:
        pairs = [(f"n{rnd.randrange(90):03}", f"n{rnd.randrange(90):03}") for _ in range(70)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == roots(nodes, [p for p in pairs if p[0] != p[1]])


def test_components_with_heavy_keys(spark, monkeypatch):
    """The broadcast path for heavy keys gives the same components."""
    real = skew.join_counted
    seen = []

    def tiny(left, right, on, how="inner", count="n", total=None, **_):
        seen.append(1)
        return real(left, right, on, how, count, total, share=4, parts=3)

    import kinweave.operators.components as comp

    monkeypatch.setattr(comp, "join_counted", tiny)
    pairs = [("n000", f"n{i:03}") for i in range(1, 40)] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(40, 60)] + [("n039", "n045")]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert seen and got == roots({x for p in pairs for x in p}, pairs)


def test_join_counted_is_a_plain_join(spark):
    left = spark.createDataFrame([(i % 3 if i < 60 else i, i) for i in range(100)], "k int, v int")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    want = sorted(map(tuple, left.join(right.drop("n"), "k").collect()))
    assert sorted(map(tuple, skew.join_counted(left, right, ["k"], share=10, parts=3).collect())) == want


def _brute(rows):
    sets = {}
    for cid, name, city, country, _ in rows:
        s = sets.setdefault(cid, (set(), set()))
        if name:
            s[0].add(frozenset(name.lower().split()))
        for p in ((("city", city.lower()) if city else None), (("country", country) if country else None)):
            if p:
                s[1].add(p)
    pairs = []
    for a, b in itertools.combinations(sorted(sets), 2):
        close = any(len(x & y) * 20 >= 17 * len(x | y) for x in sets[a][0] for y in sets[b][0])
        if close and sets[a][1] & sets[b][1]:
            pairs.append((a, b))
    return {k: v for k, v in roots(sets, pairs).items() if any(k in p for p in pairs)}


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 3), (3, 1)])
def test_names_of_up_to_forty_words_match_all_pairs(spark, monkeypatch, seed, block):
    """Families of near copies with stars of several hubs, names of common words only, several names per candidate."""
    monkeypatch.setattr(link, "BLOCK_SETS", block)
    rnd = random.Random(seed)
    rows = []
    for i in range(150):
        family = rnd.randrange(6)
        base = [f"f{family}_{k}" for k in range(14 + 4 * family)] if family else rnd.sample([f"common{k}" for k in range(24)], 20)
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            base[rnd.randrange(len(base))] = rnd.choice([f"own{i}", f"shared{rnd.randrange(9)}"])
        if rnd.random() < 0.3:
            base = base[rnd.randrange(4):]
        rnd.shuffle(base)
        rows.append((f"c{i % 140:03}", " ".join(base), rnd.choice(["Rome", "Oslo", "Oslo"]), rnd.choice(["IT", None]), []))
    got = {r["id"]: r["root"] for r in connected_components(link.weak_edges(people(spark, rows))).collect()}
    assert got == _brute(rows)


def test_edges_of_a_large_family_stay_linear(spark):
    """Three hundred names, each like each other: stars and one edge for each star, no table of pairs."""
    base = [f"w{k}" for k in range(40)]
    rows = [(f"c{i:03}", " ".join([*base[:i % 40], f"own{i}", *base[i % 40 + 1:]]), "Rome", None, []) for i in range(300)]
    edges = link.weak_edges(people(spark, rows))
    assert {r["root"] for r in connected_components(edges).collect()} == {"c000"}
    assert edges.count() < 300 * 8


@pytest.mark.parametrize("limit", [19, 13, 9, 6])
def test_weak_links_match_all_pairs(spark, limit):
    """Near-equal long names, short names, places split over records; the two ways of matching
    long names meet at different lengths."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(160):
        n = rnd.choice([1, 2, 3, 6, 7, 8, 13, 14, 15, 20, 21, 22])
        base = words[(i % 7): (i % 7) + n]
        if rnd.random() < 0.5:
            base = base + [rnd.choice(words)]
        if rnd.random() < 0.3 and len(base) > 6:
            base = base[1:]
        rnd.shuffle(base)
        rows.append((f"c{i % 130:03}", " ".join(base), rnd.choice(["Rome", "rome", "Oslo", None]), rnd.choice(["IT", "NO", None]), []))
    got = {r["id"]: r["root"] for r in connected_components(link.weak_edges(people(spark, rows), limit)).collect()}
    assert got == _brute(rows)


def test_three_records_become_one(spark):
    rows = [
        ("derived_linda", "Linda Park", "San Francisco", "US", ["linda@example.com"]),
        ("synthetic_a", "Linda Park", "San Francisco", "US", []),
        ("synthetic_b", "Linda Park", None, None, ["linda@example.com"]),
        ("other", "Linda Park", "Oslo", "NO", []),
    ]
    audit = link.merge_audit(link.resolve(people(spark, rows)))
    assert sorted(map(tuple, audit.collect())) == [("synthetic_a", "derived_linda"), ("synthetic_b", "derived_linda")]


def test_hot_phone_links_everyone(spark):
    n = 400
    d = spark.range(n).selectExpr("format_string('p%04d', id) AS candidate_id", "array('+14155550000') AS phones")
    rewrite = link.resolve(S.conform(d))
    assert rewrite.where("new_id <> 'p0000'").count() == 0 and rewrite.count() == n


def test_predicates(spark):
    row = spark.range(1).select(
        link.name_match(F.lit("Ann  LEE"), F.lit("lee ann")).alias("a"), link.name_match(F.lit("Ann"), F.lit(None).cast("string")).alias("b"),
        link.name_match(F.lit("a b c d e f"), F.lit("a b c d e f g")).alias("c"), link.name_match(F.lit("a b c d e"), F.lit("a b c d e f")).alias("d"),
        link.signal_overlap(F.array(F.lit("x")), F.array(F.lit("x"), F.lit("y"))).alias("e"),
    ).first()
    assert tuple(row) == (True, False, True, False, True)


def test_written_tables_go_when_asked(spark, tmp_path):
    import pathlib

    skew.tidy(spark)
    folder = pathlib.Path(skew.shared_folder(spark).removeprefix("file:"))
    rows = [("a", "Ann Lee", "Rome", "IT", []), ("b", "Lee Ann", "Rome", "IT", [])]
    assert link.resolve(people(spark, rows)).count() == 2
    assert list(folder.glob("kinweave-*"))
    assert skew.tidy(spark) > 0 and not list(folder.glob("kinweave-*")) and skew.tidy(spark) == 0


def test_parities_bound_the_tokens_that_differ(spark):
    """Pairs are ruled out by their bits, never one that is similar."""
    from kinweave.operators import link as L

    base = [f"w{i}" for i in range(40)]
    sets = [(i, base[i % 5: 40 - i % 4] + [f"own{i}_{j}" for j in range(i % 3)]) for i in range(60)] + [(60 + i, [f"z{i}_{j}" for j in range(37)]) for i in range(10)]
    d = spark.createDataFrame(sets, "id int, tokens array<string>").withColumn("bits", L._token_bits("tokens"))
    x, y = d.alias("x"), d.alias("y")
    sizes = F.size("x.tokens") + F.size("y.tokens")
    allowed, alike = L._bits_allow(F.col("x.bits"), F.col("y.bits"), sizes), L._similar(F.col("x.tokens"), F.col("y.tokens"))
    n = x.join(y, F.col("x.id") < F.col("y.id")).agg(
        F.count_if(alike).alias("alike"), F.count_if(alike & ~allowed).alias("lost"), F.count_if(~alike & ~allowed).alias("spared")).first()
    assert n["alike"] > 100 and n["lost"] == 0 and n["spared"] > 500
