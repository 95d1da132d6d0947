"""Terms of a table against one pattern of all terms, and brute force."""

import random
import re

import pytest

from kinweave import schema as S
from kinweave.functions import text as X
from kinweave.operators import lexicon as L


def brute(texts, terms):
    out = set()
    for i, t in texts:
        for term in terms:
            if term and term.strip() and t and re.search(rf"(?<![A-Za-z]){re.escape(term.lower())}(?![A-Za-z])", t.lower()):
                out.add((i, term))
    return sorted(out)


def tagged(spark, texts, terms, **more):
    t = spark.createDataFrame(texts, "id long, text string")
    lex = spark.createDataFrame([(x, 1) for x in terms], "term string, id int")
    return sorted(map(tuple, L.tag(t, lex, **more).collect()))


TEXTS = [
    (1, "SQL Server and node.js, C++/C#; ASP .NET .net x.net"), (2, "sql serverless (SQL) servers"), (3, None), (4, ""), (5, "go go-to GO1 ago"),
    (6, "machine  learning\nmachine learning"), (7, "3d 13d a3d 3D"), (8, "c++c ++ C+"), (9, "éSQL SQLé straße"), (9, "again sql"), (10, "deep " * 4000 + "learning"),
]


@pytest.mark.parametrize("sent", [200_000, 0])
def test_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(L, "SENT_TERMS", sent)
    terms = ["SQL", "sql server", "Server", "Node.js", "C++", "C#", ".NET", "asp .net", "Go", "Machine Learning", "3D", "C", "", "  ", "SQL", "straße", "deep learning", "deep deep deep"]
    assert tagged(spark, TEXTS, terms) == brute(TEXTS, terms)


def test_the_fixed_terms_give_the_same_as_one_pattern(spark):
    rnd = random.Random(3)
    bits = [*S.DOCUMENT_TERMS, "gone", "x", "Reacts", "a-", "sqlite", "Java/", "scikit", "REST", "APIs"]
    texts = [(i, rnd.choice([" ", ", ", "/", ""]).join(rnd.choice(bits) for _ in range(30))) for i in range(200)]
    t = spark.createDataFrame(texts, "id long, text string")
    from pyspark.sql import functions as F

    one = sorted(map(tuple, t.select("id", F.explode(X.terms(F.col("text"), S.DOCUMENT_TERMS)).alias("term")).collect()))
    assert tagged(spark, texts, S.DOCUMENT_TERMS) == one


def test_a_hundred_thousand_terms(spark):
    """Many terms begin alike; the work for a text must not grow with the lexicon."""
    terms = [f"alpha beta{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)} x" for i in range(100_000)]
    texts = [(i, f"see Alpha {terms[i * 37].split()[1].upper()} x, alpha alpha beta") for i in range(300)]
    assert tagged(spark, texts, terms) == sorted((i, terms[i * 37]) for i in range(300))


def test_empty_tables(spark):
    assert tagged(spark, [], ["a"]) == [] and tagged(spark, TEXTS, []) == [] and tagged(spark, TEXTS, [" "]) == []


def test_terms_of_words_are_looked_up_whole(spark, monkeypatch):
    """No place of a text takes along as many characters as the longest term of few words has."""
    monkeypatch.setattr(L, "_places", lambda *a: pytest.fail("asked by place"))
    terms = ["deep", "Deep learning", "a" * 3000, "go, go", "x y z w", "b"]
    texts = [(1, "Deep  learning, deep\nlearning"), (2, "b " * 3000 + "A" * 3000), (3, "deep learning; GO, go go"), (4, "x y z w x"), (5, "xdeep learningx")]
    assert tagged(spark, texts, terms) == brute(texts, terms)


def test_terms_that_end_in_a_line_break(spark):
    assert tagged(spark, [(1, "one\n two"), (2, "one two")], ["one\n", "one"]) == [(1, "one"), (1, "one\n"), (2, "one")]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_found_terms_are_not_shuffled(spark):
    """Rows that were found stay where they are, as no two texts share an id."""
    texts = [(i, t) for i, (_, t) in enumerate(TEXTS)]
    t = spark.createDataFrame(texts, "id long, text string")
    lex = spark.createDataFrame([("SQL",), ("sql",), ("deep learning",), ("go",)], "term string")
    assert shuffles(L.tag(t, lex)) == 0


@pytest.mark.parametrize("sent", [3, 40, 400])
def test_a_part_of_the_terms_is_sent(spark, monkeypatch, sent):
    """Terms that are sent, terms that are not, ids that several texts share, and no id give what one look-up gives."""
    monkeypatch.setattr(L, "SENT_TERMS", sent)
    rnd = random.Random(sent)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 3))) for _ in range(120)]
    term = lambda: rnd.choice([" ", ", ", "-"]).join(rnd.choice(words) for _ in range(rnd.choice([1, 1, 2, 2, 3, 6])))
    terms = [rnd.choice([str, str.upper, str.title, lambda x: x + "+"])(term()) for _ in range(400)]
    texts = [(rnd.choice([i, i, i, 7, None]), " ".join(term() for _ in range(30))) for i in range(60)]
    found = L.tag(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in terms], "term string"))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    known = {(i, x) for i, t in texts for _, x in brute([(0, t)], terms)}
    assert sorted(map(tuple, found.collect()), key=key) == sorted(known, key=key)


def test_only_marked_keys_are_asked_by_a_shuffle(spark):
    index = spark.range(0, 3000).selectExpr("concat('term ', id) AS key")
    asked = spark.range(0, 60_000).selectExpr("id", "concat('term ', id) AS key")
    kept = {r["id"] for r in L._marked(asked, index, 3000).collect()}
    assert kept >= set(range(3000)) and len(kept) < 6000
