"""HTML rendering, URL filters, licence scans and chat formatting."""

import hashlib
import html as H
import json
import math
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kinweave.llm import chat_format as C, html_extract as X, license_scan as LS, url_filter as U

# ---- HTML ----

PAGES = {
    "<p>a<p>b": "a\n\nb",
    "<ul><li>x<li>y<ul><li>z</ul><li>w</ul>": "- x\n- y\n  - z\n- w",
    "<ol start=9><li>a<li>b<ol><li>c</ol></ol>": "9. a\n10. b\n    1. c",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>after": "a     bbb\ncccc  d\n\nafter",
    "<table><tr><th>H<th>I<tr><td colspan=2>wide one<tr><td>1<td>2</table>": "H  I\nwide one\n1  2",
    "<table><tr><td>a<br>b<td>c</table>": "a  c\nb",
    "<table><tr><td><table><tr><td>in<td>x</table><td>q</table>": "in  x  q",
    "a <b>b</b>  c<br>d<br><br>e": "a b c\nd\n\ne",
    "x<pre> 1\n  2</pre>y": "x\n\n 1\n  2\n\ny",
    "<div hidden>n</div><i style='color:red; Display : none'>n</i><input value=n>y": "y",
    "<head><title>n</title><style>n{}</style><body>y": "y",
    "<script>if (a<b) '</p>'</script>x<!-- n -->y<!-- n": "xy",
    "<details><summary>s</summary>n<p>n</details><details open><summary>t</summary>u</details>": "s\nt\nu",
    "x < y & z &amp; &lt; &nbsp;&copy;": "x < y & z & <  ©",
    "<dl><dt>a<dd>b<dt>c</dl>": "a\n  b\nc",
    "<h1>T</h1>x<hr>y</div></p>z": "T\n\nx\n\ny\n\nz",
    "": "", "<": "<", "</": "</", "<a <b>x": "<a x", "<td>alone": "alone", "<li>lone": "- lone",
    "<select><option>a<option>b</select><textarea>\nq\n r</textarea>": "a\nb\n\nq\n r",
}


@pytest.mark.parametrize("page", PAGES)
def test_rendering(page):
    got = X.render(page)
    if "&nbsp;" in page or "textarea" in page:
        assert got.split() == PAGES[page].split()
    else:
        assert got == PAGES[page]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<ul>", "</ul>", "<li>", "<ol>", "<b>", "</b>", "<br>",
                                 "<div>", "</div>", "<caption>", "<pre>", "</pre>", "<dl>", "<dd>", "<blockquote>", "<tbody>", "</tr>", "word ", "x&amp;y", "\n"]), max_size=30))
def test_no_visible_text_is_lost_or_moved_out_of_order(tags):
    """Against a plain removal of tags: the same words (order may differ only where cells stand side by side)."""
    page = "".join(tags)
    want = Counter("".join(H.unescape(re.sub("<[^>]*>", "\n", page)).split()))
    got = Counter("".join(re.sub(r"(?m)^((?:.*  )?\s*)(?:- |\d+\. )+", r"\1", X.render(page)).split()))
    want = Counter({k: v for k, v in want.items()})
    assert got["w"] == want["w"] and got["y"] == want["y"] and got["&"] == want["&"]


def test_hostile_pages_take_linear_time():
    began = time.time()
    for page in ("<div>" * 50_000 + "x", "<a " * 50_000, '<a "' * 30_000, "<table><tr><td>" * 1_000 + "x", "<!--" * 50_000, "<p>x" * 50_000):
        X.render(page)
    assert time.time() - began < 60


def test_extract_rows(spark):
    rows = [(1, "<p>a", "u"), (1, "<p>a", "u"), (None, None, None), (2, "", "v"), (3, "<p>" + "long " * 200_000, "w")]
    out = X.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert [(r.page_id, r.text) for r in out[:4]] == [(1, "a"), (1, "a"), (None, None), (2, "")] and len(out[4].text) == 999_999
    assert X.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


# ---- URLs ----

RULES = tuple(U.host_rule(v, n) for v, n in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))) + (
    U.word_rule("block", "casino"), U.Rule("ends", "/download$", ("download",), "block", 5))
URLS = [
    "http://a.example.net/en/1", "https://Example.NET/de/2?x#y", "http://example.net", "http://www.example.com/de/x", "http://badexample.com/de/x",
    "http://big-casino.org/fr/1", "http://big-casino.org/en/1", "http://bigcasino.org/en/1", "ftp://x.y/a/download", "http://x.y/download?z", None, "",
    "no scheme /net/", "http://", "http://q?net/", "HTTP://X.NET/#frag", "http://a.net/://b.org/fr/", "http://a.net/\nnew",
]


def plain_verdict(url):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(U.UPPER, U.LOWER)), m[2]) if m else ("", "")
    fits = [r for r in RULES if host + path and re.search(r.pattern, host + path)]
    best = min(fits, key=lambda r: (-r.weight, r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


@pytest.mark.parametrize("sent", [100_000, 0])
def test_urls_against_running_every_rule(spark, monkeypatch, sent):
    monkeypatch.setattr(U, "SENT", sent)
    rows = [(i, u, "b", "c") for i, u in enumerate(URLS + URLS[:3])]
    out = U.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string, token string"), RULES).collect()
    assert sorted((r.page_id, r._host, r._path, r._rule, r._verdict) for r in out if r.page_id >= 0) == sorted(
        (i, *plain_verdict(u)) for i, u, _, _ in rows)
    assert {r.verdict for r in out} == {"b"}


def test_no_urls_and_no_rules(spark):
    assert U.judge(spark.createDataFrame([], "url string"), RULES).count() == 0
    assert [r._verdict for r in U.judge(spark.createDataFrame([("http://a.net/",)], "url string"), ()).collect()] == ["allow"]


# ---- chat ----

LAYOUTS = [
    ({"messages": [{"role": "user", "content": "a"}, {"content": None, "role": "x:y\n"}]}, "messages", [("user", "a"), ("x:y\n", "")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations", [("user", "a"), ("assistant", "b")]),
    ({"completion": "b", "prompt": "a"}, "prompt", [("user", "a"), ("assistant", "b")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction_input", [("system", "i"), ("user", ""), ("assistant", "o")]),
    ({"instruction": "i", "output": None}, "instruction", [("user", "i"), ("assistant", "")]),
    ({"question": "q", "answer": 5}, "question", [("user", "q"), ("assistant", "5")]),
    ({"messages": []}, "messages", []), ({"other": 1}, None, None), ({"messages": [{"role": "user", "content": {"a": 1}}]}, None, None),
]


def test_layouts_are_told_by_their_fields(spark):
    rows = [(i, json.dumps(x), "k") for i, (x, _, _) in enumerate(LAYOUTS)] + [(98, "no json", "k"), (99, None, "k")]
    out = {r.id: r for r in C.canonical(spark.createDataFrame(rows, "id int, raw string, role string")).collect()}
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        assert out[i].layout == layout
        assert (None if out[i].turns is None else [tuple(t) for t in out[i].turns]) == turns
    assert out[98].turns is None and out[99].turns is None


def test_format_and_back(spark):
    odd = ["", "\\", "\\\\h", "###", "####", "</turn>", "</turn>\n", "\\### Assistant: </turn> ok", "a: b", "\\s\\h\\t", "##", "#", "</turn", "é🤣\n\n", "### user: x"]
    talks = [[("user", a), ("assistant", b), ("a:b \\c ###", a)] for a in odd for b in odd[:8]] + [[], [("assistant", "x" * 100_000)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(talks)], "i int, turns array<struct<role:string,text:string>>")
    out = df.select("i", C.render(F.col("turns")).alias("o")).select(
        "i", C.read(F.col("o.text")).alias("turns"), C.under_mask(F.col("o.text"), F.col("o.mask")).alias("loss"), "o.text")
    for r in out.collect():
        assert [tuple(t) for t in r.turns] == talks[r.i]
        assert r.loss == "".join(t for role, t in talks[r.i] if role == "assistant")
        assert r.text.count("</turn>") == r.text.count("### ") == len(talks[r.i])


def test_conversation_query_against_plain_code(spark):
    from kinweave.llm import queries

    sf = "/root/testdata/sf0.001"
    talks = {-7: [(0, "user", r"\### Assistant: </turn> ok"), (1, "assistant", r"\### Assistant: </turn> ok")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    out = {r.conv_id: r for r in queries.op10(spark, sf).collect()}
    assert out.keys() == talks.keys()
    for i, turns in talks.items():
        said = "".join(f"{a}\n{b}\n" for _, a, b in sorted(turns))
        loss = "".join(b for _, a, b in sorted(turns) if a == "assistant")
        assert (out[i].n_turns, out[i].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (out[i].loss_chars, out[i].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# ---- licences ----


def plain_scores(said, templates):
    words = lambda t: Counter(re.findall(r"[a-z0-9]+(?:[.][a-z0-9]+)*", t.lower()))
    df = Counter(w for _, t in said for w in words(t))
    weigh = lambda t: {w: n * (1 + math.log((1 + len(said)) / (1 + df[w]))) for w, n in words(t).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for key, text in said:
        v = weigh(text)
        scored = [(round(sum(v[w] * u[w] for w in v if w in u) / size(v) / size(u), 6), name) for name, u in ((n, weigh(t)) for n, t in templates) if size(v)]
        best = max(scored, key=lambda s: (s[0], [-ord(c) for c in s[1]]))
        if best[0] >= 0.6:
            out[key] = best
    return out


def test_licences_and_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [
        ("LICENSE", mit + "\nCopyright somebody"), ("a/COPYING.txt", gpl), ("a/b/one.py", "code"), ("a/b/two.py", None), ("a/x.c", "/* Licensed under the Apache License, Version 2.0. */\n" + "z " * 5000),
        ("other/deep/er/q.txt", ""), ("root.txt", "some words about a licence of no kind at all, really"), (None, "x"), ("a/b/one.py", "code"), ("ab/n.txt", "n"),
    ]
    df = spark.createDataFrame([(p, t, 1, "k") for p, t in files], "path string, text string, line int, license string")
    templates = spark.createDataFrame(list(LS.TEMPLATES), "license string, text string")
    said = LS.statements(df).cache()
    lines = [((r.path, r.line), r.text) for r in said.collect()]
    scored = {(r.path, r.line): (round(r.cosine, 6), r.license) for r in LS.score(said, templates).collect()}
    assert scored == plain_scores(lines, LS.TEMPLATES)
    got = {r.path: (r.license, r.origin, r.found_in) for r in LS.scan(df, said, templates).collect()}
    assert len(got) == len({p for p, _ in files if p})
    assert got["LICENSE"][:2] == ("MIT", "file") and got["a/COPYING.txt"][:2] == ("GPL-3.0", "file")
    assert got["a/b/one.py"] == got["a/b/two.py"] == ("GPL-3.0", "inherited", "a") and got["a/x.c"][:2] == ("Apache-2.0", "statement")
    assert got["other/deep/er/q.txt"] == got["ab/n.txt"] == ("MIT", "inherited", "") and got["root.txt"] == ("MIT", "inherited", "")
    none = df.limit(0)
    assert LS.scan(none, LS.statements(none), templates).count() == 0


def test_wrapped_headers_are_found(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and
or sell copies of the Software, subject to the following conditions:"""
    gpl = """frob: turns frobs into knobs
This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
    marked = lambda mark, text: "\n".join(mark + x for x in text.split("\n"))
    one = dict((t, n) for n, t in LS.TEMPLATES if t.startswith("Permission"))
    files = [("m.py", marked("# ", "Copyright 2020 me\n\n" + mit) + "\nimport os\n"), ("g.c", "/*\n" + marked(" * ", gpl) + "\n */\nint x;"),
             ("b.js", marked("// ", bsd)), ("l.txt", "x y z\n" + next(iter(one)) + "\nq"), ("no.txt", "of the in and to a this is\nany the of to"), ("n", None)]
    df = spark.createDataFrame(files, "path string, text string")
    templates = spark.createDataFrame(list(LS.TEMPLATES), "license string, text string")
    said = LS.statements(df).cache()
    got = {r.path: r.license for r in LS.scan(df, said, templates, more=LS.passages(df, said, templates).cache()).collect()}
    assert got == {"m.py": "MIT", "g.c": "GPL-3.0", "b.js": "BSD-3-Clause", "l.txt": "MIT", "no.txt": None, "n": None}


def _room():
    """Weights of three templates without any corpus."""
    from math import sqrt

    from kinweave.llm import license_scan as L

    holders, idf = {}, {}
    for number, text in enumerate(("Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "This is free software")):
        found = L.TERM.findall(text.lower())
        size = sqrt(sum(found.count(t) ** 2 for t in set(found)))
        for t in set(found):
            idf[t] = 1.0
            holders.setdefault(t, []).append((number, found.count(t) / size))
    return L.Room(idf, holders), holders


def test_passages_of_a_repeated_line_do_not_grow_with_the_square():
    from kinweave.llm import license_scan as L

    room, _ = _room()
    text = "Released under the MIT License.\n" * 2000
    found = L.passages_of(text, room, 0.6, heaviest=8.0)
    assert len(found) <= 2 * 2000 and sum(len(t) for _, t in found) < 4 * len(text)


def test_marked_terms_lose_no_passage():
    import random
    import re

    from kinweave.llm import license_scan as L

    room, holders = _room()
    for threshold in (0.5, 0.6, 0.8):
        marks = L.markers(holders, threshold)
        marked = re.compile("|".join(map(re.escape, sorted(marks))))
        rng = random.Random(3)
        words = [*holders, "of", "a", "house", "x.y", "under.the", "2.0.1"]
        for _ in range(400):
            text = "".join(rng.choice(words) + rng.choice([" ", " ", "\n", ". ", "\n\n"]) for _ in range(rng.randint(1, 40)))
            assert L.passages_of(text, room, threshold, marked) == L.passages_of(text, room, threshold)
        assert len(marks) < len(holders)
