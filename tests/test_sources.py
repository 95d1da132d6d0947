"""Folder input of every type, enrichment and the whole job."""

import json

import pytest

from kinweave.operators import enrich as E
from kinweave.plans import config as C
from kinweave.plans.unify import unify, unify_folder
from kinweave.sources import files as IO

CSV_A = (
    'candidate_id,name,email,phone,location,headline,years_experience,skills,linkedin,github\n'
    'p1,ADA BYRON,ada@x.org,(415) 222-3344,"London, UK",Engineer,7,"python;go",linkedin.com/in/ada,github.com/ada\n'
    ',Grace Hop,grace@navy.org,,"Arlington, VA, USA","Rear ""Admiral""",not_a_number,,,\n'
    '\n'
    'p3,,,,,,,,,\n'
    ',,,,Nowhere,,,,,\n'
    ',Only Name,,,,,2019-2023,"cobol\n|js",,,extra\n'
)
ATS = [
    {"candidate_id": "p1", "full_name": "Ada Byron", "emails": ["ada@x.org"], "phones": ["+1 415 222 3344"], "location": "London, GB",
     "headline": "Lead", "years_experience": 9, "skills": ["Python", "ML"], "links": [{"url": "https://github.com/ada", "type": "x"}],
     "experience": [{"company": "Acme", "title": "Lead", "start_date": "Jan 2020", "end_date": "Present"}],
     "education": [{"institution": "UCL", "degree": "BS", "graduation_date": "2012"}]},
    {"id": "p9", "name": "Solo", "email": "solo@x.org", "years_experience": "abc"},
    {"full_name": "No Id"},
]
NOTES = (
    "CANDIDATE_ID: p1\nCurrently a Staff Engineer at Acme. ~8 years. Kafka, Go. ada@x.org\n\n---\n\n"
    "no id here\n---\nCANDIDATE_ID: p7\nLoves node.js. 5 yrs.\n"
)
LABELLED = (
    "NAME: grace hop\nEMAIL: grace@navy.org\nLOCATION: Arlington, VA, US\nYEARS: 12\nSKILLS: a, b\n\nSKILLS:\n- COBOL\n\n"
    "EXPERIENCE:\n- Navy | Admiral | 2021-01 - Present\n- bad | row\n\nEDUCATION:\n- Yale | PhD | 1934\n"
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "structured").mkdir()
    (d / "structured" / "list.csv").write_text(CSV_A)
    (d / "structured" / "other.CSV").write_text("Full_Name,Work_Email\nOther One,other@x.org\n")
    (d / "structured" / "ats.json").write_text(json.dumps(ATS))
    (d / "structured" / "broken.json").write_text('[{"id": ')
    (d / "my_notes.txt").write_text(NOTES)
    (d / "resume_g.txt").write_text(LABELLED)
    (d / "cv_zed.pdf").write_text("Zed Zedson\nData Engineer\nBerlin, Germany\nzed@x.org 5 years\nSkills\nsql, js\nEducation\nTU | MSc | 2010\n")
    (d / "photo.png").write_text("x")
    return str(d)


@pytest.fixture(scope="module")
def recs(spark, folder):
    return IO.read_folder(spark, folder, as_of_year=2024).cache()


def test_ids_and_counts(recs):
    got = sorted((r["source"], r["candidate_id"] or "") for r in recs.select("source", "candidate_id").collect())
    assert got == sorted([
        ("recruiter_csv", "p1"), ("recruiter_csv", "derived_grace"), ("recruiter_csv", "p3"), ("recruiter_csv", "derived_row_4"),
        ("recruiter_csv", "derived_only_name"), ("recruiter_csv", "derived_other"), ("ats_json", "p1"), ("ats_json", "p9"),
        ("ats_json", ""), ("recruiter_notes", "p1"), ("recruiter_notes", "p7"), ("resume", "derived_grace"), ("resume", "derived_zed"),
    ])


def test_row_numbers_survive_file_splits(spark, tmp_path):
    lines = "name,email,headline\n" + "".join(f",,role {i}\n" if i % 3 else f"n{i},,\n" for i in range(2000))
    (tmp_path / "big.csv").write_text(lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000b")
    try:
        r = IO.read_delimited(spark, str(tmp_path), multi_line=False)
        got = {x["candidate_id"]: x["headline"] for x in r.where("full_name IS NULL").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"derived_row_{i + 1}": f"role {i}" for i in range(2000) if i % 3}


def test_notes_split_across_reads(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("\n---\n".join(f"CANDIDATE_ID: n{i}\n~{i % 60} years" for i in range(900)) + "\n ---  \nCANDIDATE_ID: last\n3 yrs")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
    try:
        r = IO.read_notes(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {x["candidate_id"]: x["years_experience"] for x in r} == {**{f"n{i}": float(i % 60) for i in range(900)}, "last": 3.0}


def test_values(recs):
    by = {(r["source"], r["candidate_id"]): r for r in recs.collect()}
    ada = by["recruiter_csv", "p1"]
    assert ada["full_name"] == "Ada Byron" and ada["phones"] == ["+14152223344"] and ada["location"]["country"] == "UK"
    assert ada["skills"] == ["Python", "Go"] and [x["type"] for x in ada["links"]] == ["linkedin", "github"]
    assert by["recruiter_csv", "derived_grace"]["headline"] == 'Rear "Admiral"' and by["recruiter_csv", "derived_grace"]["years_experience"] is None
    only = by["recruiter_csv", "derived_only_name"]
    assert only["years_experience"] == 4.0 and only["skills"] == ["Cobol", "JavaScript"]
    assert by["ats_json", "p9"]["emails"] == ["solo@x.org"] and by["ats_json", "p9"]["years_experience"] is None
    assert tuple(by["ats_json", "p1"]["experience"][0]) == ("Acme", "Lead", "2020-01", "present", None)
    notes = by["recruiter_notes", "p1"]
    assert notes["headline"] == "Staff Engineer at Acme" and notes["skills"] == ["Go", "Kafka"] and notes["years_experience"] == 8.0
    assert by["recruiter_notes", "p7"]["skills"] == ["Node.js"]
    grace = by["resume", "derived_grace"]
    assert grace["skills"] == ["COBOL"] and [tuple(e) for e in grace["experience"]] == [("Navy", "Admiral", "2021-01", None, None)]
    zed = by["resume", "derived_zed"]
    assert zed["skills"] == ["SQL", "JavaScript"] and float(zed["confidence"]) == 0.7 and zed["location"]["country"] == "DE"


def test_ingest_report(spark, folder, recs):
    rep = {r["file"].split("/")[-1]: (r["records"], r["source"], r["problem"]) for r in IO.ingest_report(IO.discover(spark, folder), recs).collect()}
    assert rep["list.csv"] == (5, "recruiter_csv", None) and rep["ats.json"] == (3, "ats_json", None)
    assert rep["broken.json"] == (0, None, "no records") and rep["photo.png"] == (0, None, "ignored") and rep["my_notes.txt"][0] == 2


def test_problems_of_files(spark, tmp_path):
    (tmp_path / "broken.json").write_text('[{"id": ')
    (tmp_path / "odd.json").write_text('[{"id": "a"}, 7, null, "x", {"id": "b"}]')
    (tmp_path / "blank.json").write_text(" \n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "ragged.csv").write_text('id,name,email\n1,"Ann, ""A""",a@x.org\n2,Bob\n\n3,"Cy\nD",c@x.org,spare,spare\n4,Di,d@x.org\n5\n')
    (tmp_path / "wide.csv").write_text("id,name,email,phone,x\n6,F,f@x.org,,\n7,G,g@x.org,1,2,3\n")
    (tmp_path / "photo.png").write_text("x")
    got = sorted((r["file"].split("/")[-1], r["place"], r["problem"], r["text"].strip()) for r in IO.ingest_problems(spark, str(tmp_path)).collect())
    assert [x for x in got if x[0].endswith("json")] == [
        ("blank.json", None, "empty text", ""), ("broken.json", None, "no JSON", '[{"id":'), ("empty.json", None, "empty file", ""),
        ("odd.json", 1, "no object", "7"), ("odd.json", 2, "no object", "null"), ("odd.json", 3, "no object", '"x"')]
    assert [x for x in got if x[0].endswith("csv")] == [
        ("empty.csv", None, "empty file", ""), ("ragged.csv", 2, "2 cells under a header of 3", "2,Bob"),
        ("ragged.csv", 3, "5 cells under a header of 3", '3,"Cy\nD",c@x.org,spare,spare'), ("ragged.csv", 5, "1 cells under a header of 3", "5"),
        ("wide.csv", 2, "6 cells under a header of 5", "7,G,g@x.org,1,2,3")]
    u = unify_folder(spark, str(tmp_path), C.DEFAULT)
    rep = {r["file"].split("/")[-1]: (r["records"], r["problem"], r["problems"], r["place"], r["text"]) for r in u.stats["files"].collect()}
    assert rep["ragged.csv"] == (5, "2 cells under a header of 3", 3, 2, "2,Bob") and rep["broken.json"] == (0, "no JSON", 1, None, '[{"id": ')
    assert rep["empty.csv"] == (0, "empty file", 1, None, "") and rep["photo.png"] == (0, "ignored", 0, None, None) and rep["odd.json"][:3] == (5, "no object", 3)


def test_whole_folder(spark, folder, tmp_path):
    u = unify_folder(spark, folder, C.DEFAULT, as_of_year=2024)
    p = {r["candidate_id"]: r for r in u.profiles.collect()}
    assert p["p1"]["years_experience"] == 9.0 and p["p1"]["full_name"] == "Ada Byron"
    # "London, UK" and "London, GB" differ as whole places, so they are a conflict.
    assert "location" in p["p1"]["conflicts"] and len(p["derived_grace"]["experience"]) == 2
    totals = u.stats["totals"].first()
    assert (totals["total_records"], totals["orphan_records"], totals["files"]) == (13, 1, 8)
    u.write(str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out" / "profiles"))
    assert back.count() == len(p) and back.where("candidate_id = 'p1'").first()["output"]["full_name"] == "Ada Byron"
    assert spark.read.json(str(tmp_path / "out" / "stats" / "totals")).first()["groups_after"] == len(p)


def _snapshots(spark):
    prof = spark.createDataFrame(
        [("github", "ADA", 200, "ada b", " I  do\nmaths ", "@Acme", "London, England", "ada@x.org", "ada.dev/"), ("github", "gone", 500, None, None, None, None, None, None),
         ("linkedin", "ada", 200, "Ada B", "Countess", None, "London, GB", None, None)],
        "provider string, handle string, status int, name string, bio string, company string, location string, email string, blog string",
    )
    repos = spark.createDataFrame(
        [("ada", lang, fork) for lang, n, fork in (("python", 3, False), ("c", 2, False), ("go", 9, True), ("zig", 1, False)) for _ in range(n)],
        "handle string, language string, fork boolean",
    )
    return prof, repos


def _linked(spark, rows):
    from kinweave import schema as S

    d = spark.createDataFrame(rows, "pos long, candidate_id string, url string")
    return S.conform(d.selectExpr("struct('l' AS origin, 0L AS block, pos) AS record_seq", "'resume' AS source", "candidate_id", "array(struct(url, 'x' AS type)) AS links"))


def test_enrichment(spark):
    prof, repos = _snapshots(spark)
    r = _linked(spark, [(1, "a", "https://github.com/ada"), (2, "a", "https://github.com/Ada"), (3, "b", "https://github.com/gone"),
                        (4, "c", "https://linkedin.com/in/ada"), (5, "c", "https://linkedin.com/in/jane-doe-9x"), (6, None, "https://github.com/ada")])
    got = {(x["candidate_id"], x["source"], x["links"][0]["url"]): x for x in E.enrich(r, prof, repos).collect()}
    assert len(got) == 4
    ada = got["a", "github", "https://github.com/Ada"]
    assert ada["skills"] == ["Python", "C", "Zig"] and ada["headline"] == "I do maths" and ada["experience"][0]["company"] == "Acme"
    assert [x["url"] for x in ada["links"]] == ["https://github.com/Ada", "https://ada.dev"] and ada["github_meta"]["handle"] == "Ada"
    gone = got["b", "github", "https://github.com/gone"]
    assert float(gone["confidence"]) == 0.0 and gone["error"] == "GitHub /users/gone → 500"
    assert float(got["c", "linkedin", "https://linkedin.com/in/ada"]["confidence"]) == 0.85
    jane = got["c", "linkedin", "https://linkedin.com/in/jane-doe-9x"]
    assert float(jane["confidence"]) == 0.35 and jane["full_name"] == "Jane Doe" and jane["note"]
    only = E.enrich(r, prof, repos, github=False)
    assert {x["source"] for x in only.collect()} == {"linkedin"}


def test_extra_links_and_toggles(spark):
    prof, repos = _snapshots(spark)
    links = spark.createDataFrame([("https://github.com/ada",), ("https://github.com/none",), ("https://linkedin.com/in/jane-doe",), ("https://a.org",)], "url string")
    ids = sorted(r["candidate_id"] for r in E.extra_link_records(links, prof, repos).collect())
    assert ids == ["derived_ada", "derived_gh_none", "derived_li_jane_doe"]
    base = _linked(spark, [(1, "a", "https://github.com/ada")])
    on = unify(base, None, prof, repos, extra_links=links)
    assert on.stats["enrichment"].where("source = 'github'").first()["records"] == 3
    # The extra record shares the account of candidate a, so both become one profile.
    assert [tuple(r) for r in on.stats["merges"].collect()] == [("derived_ada", "a")]
    off = unify(base, None, prof, repos, enrich=False)
    assert off.records.count() == 1


def test_doubled_headers_take_the_first_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,Email,email,name\n1,a@x.org,b@x.org,Ann\n2,c@x.org,,Bob\n")
    got = {r["candidate_id"]: r["emails"] for r in IO.read_delimited(spark, str(tmp_path)).collect()}
    assert got == {"1": ["a@x.org"], "2": ["c@x.org"]}


def test_confidence_out_of_range_is_an_error_of_its_record(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "a", "confidence": 95}, {"id": "b", "confidence": 0.5}, {"id": "c"}]')
    got = {r["candidate_id"]: (float(r["confidence"]), r["error"]) for r in IO.read_json(spark, str(tmp_path)).collect()}
    assert got == {"a": (0.95, "confidence out of range"), "b": (0.5, None), "c": (0.95, None)}


def test_positions_hold_beyond_a_thousand_partitions(spark):
    """Ids of partition 1,024 and later use up to 45 bits; nothing may multiply them."""
    from pyspark.sql import functions as F
    from kinweave.sources import records as R

    d = spark.range(0, 3000, 1, 1500).select(
        F.lit('[{"id": "a"}, {"id": "b"}]').alias("value"), R.seq("f", 0, F.monotonically_increasing_id()).alias("record_seq"))
    got = R.json_records(d).select("record_seq").distinct()
    assert got.count() == 6000 and got.agg(F.max("record_seq.item")).first()[0] == 1


def test_lists_with_many_headers_are_one_scan(spark, tmp_path, monkeypatch):
    """Twelve layouts over sixty files: columns in other places, other spellings, unknown and quoted names, a mark at the start."""
    spellings = [("id", "name", "email"), ("Email", "Candidate_ID", "FULLNAME"), ("x", "e-mail", "y", "name", "id"), ('"na,me"', "work_email", " name ", "id")]
    want = {}
    for i in range(60):
        columns = list(spellings[i % 4]) + [f"extra{k}" for k in range(i % 3)]
        lines = ["﻿" * (i % 5 == 0) + ",".join(columns)]
        for j in range(3):
            cells = []
            for c in columns:
                plain = c.strip().lower()
                cells.append(f"p{i}_{j}" if plain in ("id", "candidate_id") else f"P{i}x{j}@x.org" if "mail" in plain else
                             f'"Ann, {i}"' if plain in ("name", "fullname") else "?")
            lines.append(",".join(cells) + (",spare,spare" if j == 2 else ""))
            want[f"p{i}_{j}"] = ([f"p{i}x{j}@x.org"], f"Ann, {i}")
        (tmp_path / f"f{i}.csv").write_text("\n" * (i % 2) + "\n".join(lines) + "\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "short.csv").write_text("name,email,id\nBob\nEve,eve@x.org\n")
    want |= {"derived_bob": ([], "Bob"), "derived_eve": (["eve@x.org"], "Eve")}
    frame = IO.read_delimited(spark, str(tmp_path))
    got = {r["candidate_id"]: (r["emails"], r["full_name"]) for r in frame.collect()}
    assert got == want
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 5  # rows twice (named and numbered), headers twice, and the row counts: not one for each header
    monkeypatch.setattr(IO, "SENT_FILES", 0)
    joined = {r["candidate_id"]: (r["emails"], r["full_name"]) for r in IO.read_delimited(spark, str(tmp_path)).collect()}
    assert joined == want


def _people_of(frame):
    return sorted((r["candidate_id"] or "", r["full_name"] or "", tuple(r["skills"] or ()), r["headline"] or "") for r in frame.collect())


TRICKY = [
    {"id": "a}", "name": 'Brace "} {" Bob', "skills": ["[x", "y]", "}{"], "headline": "back\\slash \\\" } ,"},
    {"id": "b", "experience": [{"company": "C}", "title": "T"}, {"company": "D{"}], "education": []}, 7, "text } with [ brackets", [1, [2, {"id": "inner"}]], None, {}, {"id": "ü}ñ", "headline": "{\n}"},
    {"id": "long", "headline": "x" * 3000},
]


@pytest.mark.parametrize("indent, split, chunk", [(None, "700b", 200), (2, "300b", 1), (None, "100000b", 1 << 20)])
def test_large_arrays_are_cut_between_elements(spark, tmp_path, indent, split, chunk):
    folder = tmp_path / "j"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(TRICKY * 7, indent=indent, ensure_ascii=False))
    (folder / "b.json").write_text(" \n" + json.dumps([{"id": f"n{i}", "name": f"Nn {i}"} for i in range(200)], indent=indent) + "\n\n")
    (folder / "one.json").write_text(json.dumps({"id": "single", "skills": ["a}", {"x": 1}], "experience": [{"company": "Z"}]}))
    (folder / "two.json").write_text(json.dumps({"id": "double", "name": "Du Al"}) + "\n")
    (folder / "empty.json").write_text("[]")
    (folder / "nothing.json").write_text("")
    (folder / "cut.json").write_text('[{"id": "lost1"}, {"id": "lost2"')
    (folder / "cut2.json").write_text('[{"id": "lost3"}, {"id": "lost4"}')
    (folder / "middle.json").write_text('[{"id": "lost6"}, {bad}, {"id": "lost7"}]')
    whole = IO.R.json_records(IO._text_files(spark, str(folder), "*.json", IO.JSON, wholetext=True)).cache()
    whole.count()
    (folder / "more.json").write_text('[{"id": "lost5"}] x')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        cut = IO.array_texts(spark, str(folder), "*.json", chunk=chunk)
        got = _people_of(IO.R.json_records(cut))
        if split != "100000b":
            assert cut.where("record_seq.origin LIKE '%/b.json'").count() > 5
        # Order within a file is that of the elements.
        order = [r["candidate_id"] for r in IO.R.json_records(cut).where("record_seq.origin LIKE '%/b.json'").orderBy("record_seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == _people_of(whole) and "single" in [x[0] for x in got]
    assert order == [f"n{i}" for i in range(200)]
    assert not [x for x in got if x[0].startswith("lost")]


def test_only_large_files_are_cut(spark, tmp_path):
    (tmp_path / "small.json").write_text('[{"id": "s"}]')
    (tmp_path / "large.json").write_text(json.dumps([{"id": f"l{i}"} for i in range(50)]))
    got = IO.read_json(spark, str(tmp_path), split_bytes=100)
    assert sorted(r["candidate_id"] for r in got.collect()) == sorted(["s", *[f"l{i}" for i in range(50)]])
    whole = IO.read_json(spark, str(tmp_path))
    assert _people_of(whole) == _people_of(got)


def test_problems_of_large_arrays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IO, "SPLIT_BYTES", 100)
    monkeypatch.setattr(IO, "ARRAY_CHUNK", 50)
    people = [{"id": f"p{i}"} for i in range(30)]
    (tmp_path / "odd.json").write_text(json.dumps([*people, 7, *people, None, {"id": "z"}]))
    (tmp_path / "short.json").write_text(json.dumps(people)[:-1])
    (tmp_path / "bad.json").write_text(json.dumps(people)[:-1] + ', {bad}, {"id": "y"}]')
    (tmp_path / "small.json").write_text("[1]")
    got = sorted((r["file"].split("/")[-1], r["place"], r["problem"]) for r in IO.ingest_problems(spark, str(tmp_path)).collect())
    assert got == [("bad.json", None, "no JSON"), ("odd.json", 30, "no object"), ("odd.json", 61, "no object"),
                   ("short.json", None, "array without end"), ("small.json", 0, "no object")]
    assert sorted(r["candidate_id"] for r in IO.read_json(spark, str(tmp_path), split_bytes=100).where("record_seq.origin LIKE '%odd%'").where("candidate_id <> ''").collect()) == sorted([*[f"p{i}" for i in range(30)] * 2, "z"])


def test_a_json_person_is_cast_once_and_not_path_by_path(spark):
    texts = ['{"id": {"x": 1}, "emails": "a@b.co", "email": "C@d.co", "confidence": "abc", "skills": ["go", 1, null, ["c"]]}',
             '[null, 5, {"links": ["github.com/x", {"url": null}, {"url": "x.com"}, 5], "experience": [{"title": "T", "end": "now"}, "x"]}]']
    d = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, value string").selectExpr(
        "struct('o' AS origin, 0L AS block, bigint(i) AS pos) AS record_seq", "value")
    got = IO.R.json_records(d)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # Text to array, person, and two kinds of a link.
    assert plan.count("variant_get(") <= 5
    rows = {(r["record_seq"]["pos"], r["record_seq"]["item"]): r for r in got.collect()}
    assert set(rows) == {(0, 0), (1, 0), (1, 1), (1, 2)}
    first, last = rows[0, 0], rows[1, 2]
    assert (first["candidate_id"], first["emails"], first["skills"]) == ('{"x":1}', ["c@d.co"], ["Go", "1", '["c"]'])
    assert [x["url"] for x in last["links"]] == ["https://github.com/x", "https://x.com"]
    assert [(e["title"], e["end_date"]) for e in last["experience"]] == [("T", "present")]
    assert rows[1, 0]["candidate_id"] is None and rows[1, 1]["full_name"] is None


def test_the_sink_takes_its_ranges_from_facts_and_makes_profiles_once(spark, tmp_path, monkeypatch):
    from workload.base import rec_records

    run = unify(rec_records(spark, "/root/testdata/sf0.001"), C.HIRING)
    seen = {}
    real = IO.write_result
    monkeypatch.setattr(IO, "write_result", lambda documents, stats, *a, **k: (seen.update(k, documents=documents), real(documents, {}, *a, **k)))
    run.write(str(tmp_path / "out"))
    plan = seen["documents"]._jdf.queryExecution().optimizedPlan().toString()
    assert seen["ranged"] and plan.index("Aggregate") < plan.index("RepartitionByExpression")
    files = sorted((tmp_path / "out" / "profiles").glob("part-*"))
    ids = [json.loads(line)["candidate_id"] for f in files for line in f.read_text().splitlines()]
    assert ids == sorted(ids) and len(ids) == run.profiles.count()
    run.close()


def test_a_folder_is_listed_and_its_headers_read_once(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("id,name\nc1,Ann Lee\nc2\n")
    calls = []
    for name in ("discover", "header_table"):
        real = getattr(IO, name)
        monkeypatch.setattr(IO, name, lambda *a, real=real, name=name, **k: (calls.append(name), real(*a, **k))[1])
    u = unify_folder(spark, str(tmp_path), C.DEFAULT, multi_line=False)
    rep = [(r["records"], r["problem"]) for _ in range(2) for r in u.stats["files"].collect()]
    assert rep == [(2, "1 cells under a header of 2")] * 2 and sorted(calls) == ["discover", "header_table"]
