"""Fusion, paging of very long profiles, projection, configuration checks, reports."""

import json

import pytest
from pyspark.sql import functions as F

from kinweave import schema as S
from kinweave.operators import fuse
from kinweave.plans import config as C, project as P, report
from kinweave.plans.unify import unify


def records(spark, rows):
    d = spark.createDataFrame(
        rows,
        "pos long, source string, candidate_id string, confidence double, full_name string, years_experience double, "
        "emails array<string>, skills array<string>",
    )
    return S.conform(d.withColumn("record_seq", F.expr("struct('t' AS origin, 0L AS block, pos)")))


ROHAN = [
    (1, "recruiter_csv", "c14", None, "R. Mehta", 8.0, ["r@x.org"], ["Go", "Python"]),
    (2, "ats_json", "c14", None, "Rohan Mehta", 10.0, ["R@x.org"], ["python", "Go", "Go"]),
    (3, "resume", "c14", None, "Rohan Mehta", 9.0, [], None),
    (4, "mystery", "c14", None, None, None, ["m@x.org"], []),
]


@pytest.fixture(scope="module")
def rohan(spark):
    return fuse.profiles(fuse.gather(fuse.facts(records(spark, ROHAN)))).first()


def test_votes(rohan):
    assert rohan["full_name"] == "Rohan Mehta" and rohan["years_experience"] == 10.0
    assert rohan["field_confidence"]["years_experience"] == 0.418
    assert rohan["field_confidence"]["full_name"] == 0.664
    assert rohan["field_confidence"]["candidate_id"] == 1.0
    c = rohan["conflicts"]["years_experience"]
    assert c["winner"] == "10" and [(a["value"], a["weight"]) for a in c["alternates"]] == [("8", 0.765), ("9", 0.56)]
    assert set(rohan["conflicts"]) == {"full_name", "years_experience"}
    assert rohan["scalar_provenance"]["full_name"] == ["ats_json", "resume"]


def test_lists(rohan):
    # First spelling wins; repeated items count every time they are listed.
    assert rohan["skills"] == ["Go", "Python"] and rohan["emails"] == ["r@x.org", "m@x.org"]
    assert rohan["list_provenance"]["emails"]["m@x.org"] == ["mystery"]
    assert rohan["field_confidence"]["skills"] == 1.0
    # Unknown source: weight 0.3 and confidence 0.5; (0.765 + 0.95 + 0.15) / 2 = 0.9325, halves go up.
    assert rohan["field_confidence"]["emails"] == 0.933
    assert rohan["field_confidence"]["phones"] == 0.0


def test_overall(rohan):
    present = [v for v in rohan["field_confidence"].values() if v > 0]
    assert rohan["overall_confidence"] == pytest.approx(sum(present) / len(present), abs=5e-4)


def test_zero_weight_gives_zero_confidence(spark):
    p = fuse.profiles(fuse.gather(fuse.facts(records(spark, [(1, "github", "z", 0.0, "A B", None, [], [])])))).first()
    assert p["full_name"] == "A B" and p["field_confidence"]["full_name"] == 0.0 and p["overall_confidence"] == 0.0


def test_long_form_equals_row_form(spark):
    f = fuse.facts(records(spark, ROHAN))
    long = {r["field"]: r["confidence"] for r in fuse.field_confidence(fuse.field_totals(f)).collect()}
    row = fuse.profiles(fuse.gather(f)).first()
    assert long == {k: v for k, v in row["field_confidence"].items() if k in long}
    assert fuse.overall_confidence(fuse.field_confidence(fuse.field_totals(f))).first()["overall_confidence"] == row["overall_confidence"]


def test_a_long_list_is_one_profile_and_one_document(spark):
    """Five and fifty thousand entries have the same form; the long table holds the same order."""
    n = 50_000
    many = spark.range(n).selectExpr(
        "struct('t' AS origin, 0L AS block, id AS pos) AS record_seq", "IF(id % 3 > 0, 'ats_json', 'resume') AS source", "'big' AS candidate_id",
        "concat('Name ', id % 9) AS full_name", "array(concat('e', lpad(id, 6, '0'), '@x.org')) AS emails")
    few = records(spark, [(i, "resume", "small", None, "A", 3.0, [f"b{i}@x.org"], ["Go"]) for i in range(5)])
    f = fuse.facts(S.conform(many).unionByName(few))
    p = fuse.profiles(fuse.gather(f))
    rows = {r["candidate_id"]: r for r in p.collect()}
    assert sorted(rows) == ["big", "small"] and len(rows["big"]["emails"]) == n and len(rows["small"]["emails"]) == 5
    docs = {r["candidate_id"]: json.loads(r["output"]) for r in P.documents(p, C.DEFAULT).collect()}
    assert docs["big"]["emails"] == rows["big"]["emails"] and docs["small"]["emails"] == rows["small"]["emails"]
    long = fuse.items(f).where("candidate_id = 'big' AND field = 'emails'").collect()
    assert [r["value"] for r in sorted(long, key=lambda r: r["position"])] == rows["big"]["emails"]
    assert sorted(r["position"] for r in long) == list(range(n))
    assert rows["big"]["emails"][0] == "e000001@x.org" and rows["big"]["emails"][-1] == f"e{(n - 1) // 3 * 3:06}@x.org"


def test_rows_that_lack_a_value_are_set_apart(spark):
    rows = [(1, "ats_json", "a", None, "Ann Lee", 3.0, ["a@x.org"], []), (2, "ats_json", "b", None, None, 3.0, [], []), (3, "ats_json", "c", None, "Cy", None, [], [])]
    p = fuse.profiles(fuse.gather(fuse.facts(records(spark, rows))))
    cfg = {"fields": [{"key": "id", "from": "candidate_id"}, {"key": "name", "from": "full_name"}, {"key": "mail", "from": "emails[0]"}], "missing_policy": "error"}
    split = P.quarantine(p, cfg)
    assert [(r["id"], r["name"], r["mail"]) for r in split.outputs.collect()] == [("a", "Ann Lee", "a@x.org")]
    need = "Missing required field for output: "
    assert sorted((r["candidate_id"], tuple(r["errors"])) for r in split.rejected.collect()) == [("b", (need + "name", need + "mail")), ("c", (need + "mail",))]
    assert split.counts == {"passed": 1, "rejected": 2}


def test_same_result_for_any_partitioning(spark):
    rows = [(i, ["ats_json", "resume", "recruiter_csv"][i % 3], f"c{i % 11}", None, f"N{i % 4}", float(i % 5), [f"e{i % 13}@x.org"], [f"s{i % 6}"]) for i in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "8", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            u = unify(records(spark, rows).repartition(int(n)), C.DEFAULT)
            seen.append(sorted(map(tuple, u.documents.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and seen[0]


def test_slim_preset_omits_missing_keys(spark):
    p = fuse.profiles(fuse.gather(fuse.facts(records(spark, [(1, "ats_json", "x", None, "ann LEE", 3.0, ["a@x.org"], [])]))))
    out = json.loads(P.documents(p, C.SLIM).first()["output"])
    assert out["id"] == "x" and out["name"] == "Ann Lee" and out["primary_email"] == "a@x.org" and out["yoe"] == 3.0
    assert "primary_phone" not in out and "top_skills" not in out and "primary_phone" not in out["field_confidence"]
    assert "provenance" not in out and out["overall_confidence"] > 0


def test_null_policy_keeps_keys(spark):
    p = fuse.profiles(fuse.gather(fuse.facts(records(spark, [(1, "ats_json", "x", None, None, None, [], [])]))))
    out = json.loads(P.documents(p, C.DEFAULT).first()["output"])
    assert out["full_name"] is None and out["emails"] is None and out["candidate_id"] == "x"
    assert out["provenance"]["scalars"]["full_name"] == []


def test_error_policy_stops_the_job(spark):
    p = fuse.profiles(fuse.gather(fuse.facts(records(spark, [(1, "ats_json", "x", None, None, None, [], [])]))))
    cfg = {"fields": [{"key": "name", "from": "full_name"}], "missing_policy": "error"}
    with pytest.raises(Exception, match="Missing required field for output: name"):
        P.project(p, cfg).collect()


def test_only_needed_fields_are_fused(spark):
    cfg = {"fields": [{"key": "mail", "from": "emails[0]"}], "include_provenance": False, "include_confidence": False}
    assert C.fields_needed(cfg) == ("candidate_id", "emails") and C.fields_needed(C.DEFAULT) is None
    u = unify(records(spark, ROHAN), cfg)
    assert {r["field"] for r in u.facts.select("field").distinct().collect()} == {"candidate_id", "emails"}
    assert u.outputs.first()["mail"] == "r@x.org"


def test_config_checks():
    bad = {"missing_policy": "skip", "fields": [{"key": "a"}, {"key": "a", "normalize": "rot13"}, {"from": "x"}, 3]}
    v = C.validate(bad)
    assert not v.ok and len(v.errors) == 5 and any("unknown field 'a'" in w for w in v.warnings)
    assert C.validate([]).ok is False and C.validate({"fields": {}}).ok is False
    assert C.validate({}).ok and C.validate({}).warnings and C.validate({"fields": []}).warnings
    assert any("null" in w for w in C.validate({"fields": [{"key": "field_confidence"}]}).warnings)
    assert all(C.validate(p) == (True, [], []) for p in C.PRESETS.values())
    with pytest.raises(ValueError):
        C.checked(bad)


def test_paths():
    assert C.path_parts("a.b[0].c") == ["a", "b", 0, "c"] and C.root_of("emails[0]") == "emails"


def test_reports(spark, rohan):
    p = fuse.profiles(fuse.gather(fuse.facts(records(spark, ROHAN))))
    t = report.profile_table(p).first()
    assert (t["name"], t["id"], t["email"], t["n_skills"], t["n_conflicts"]) == ("Rohan Mehta", "c14", "r@x.org", 2, 2)
    assert report.conflict_report(p).count() == 5
    assert report.profile_search(p, "mehta").count() == 1 and report.profile_search(p, "nobody").count() == 0
    assert report.profile_sources(p).first()["sources"] == ["ats_json", "mystery", "recruiter_csv", "resume"]


def test_locale_order_is_an_option(spark):
    rows = [(i, "ats_json", "x", None, None, None, [], [s]) for i, s in enumerate(["b", "A", "a2", "B2"])]
    f = fuse.facts(records(spark, rows))

    def skills(collation):
        listed = fuse.items(f, collation).where("field = 'skills'").orderBy("position").collect()
        whole = fuse.profiles(fuse.gather(f, collation)).first()["skills"]
        assert [r["value"] for r in listed] == whole
        return whole

    assert skills(None) == ["A", "B2", "a2", "b"] and skills("UNICODE") == ["A", "a2", "b", "B2"]


def test_summary_shows_the_account(spark):
    r = records(spark, ROHAN).withColumn(
        "github_meta",
        F.expr("named_struct('handle', 'rohan', 'public_repos', 3L, 'followers', record_seq.pos, 'following', 0L, 'avatar_url', '', 'html_url', '')"),
    )
    r = S.conform(r)
    p = fuse.profiles(fuse.gather(fuse.facts(r)))
    row = report.profile_summary(p, skills_shown=1, meta=fuse.latest_meta(r)).first()
    assert row["account"] == "@rohan (3 repos, 4 followers)" and row["skills"] == "Go +1 more" and row["place"] == "—"


def test_first_spelling_inside_a_record_stays(spark):
    rows = [(2, "resume", "a", None, None, None, [], ["ros"]), (1, "resume", "a", None, None, None, [], ["ROS", "Ros", "go", "GO"])]
    got = {r["key"]: r["value"] for r in fuse.facts(records(spark, rows), ("skills",)).collect()}
    assert got == {"ros": "ROS", "go": "go"}


def test_profile_means_the_same_at_every_size(spark):
    """Counts and places in lists."""
    rows = [(i, "ats_json", "big", None, "N", None, [f"e{i:02}@x.org"], [f"s{i:02}"]) for i in range(23)]
    cfg = {"fields": [{"key": "mail", "from": "emails[0]"}, {"key": "third", "from": "skills[2]"}, {"key": "n", "from": "skills.length"}],
           "include_provenance": False, "include_confidence": False}
    p = fuse.profiles(fuse.gather(fuse.facts(records(spark, rows))))
    out = P.project(p, cfg).collect()
    assert len(out) == 1 and (out[0]["mail"], out[0]["third"], out[0]["n"]) == ("e00@x.org", "s02", 23)
    assert report.profile_table(p).first()["n_skills"] == 23


def test_omit_drops_keys_but_no_nulls_inside_values(spark):
    one = records(spark, [(1, "ats_json", "x", None, None, None, [], [])]).withColumn(
        "location", F.expr("cast(named_struct('city', 'Ulm', 'region', null, 'country', 'DE', 'raw', 'Ulm') AS " + S.LOCATION.simpleString() + ")"))
    p = fuse.profiles(fuse.gather(fuse.facts(S.conform(one))))
    cfg = {"fields": [{"key": "place", "from": "location"}, {"key": "name", "from": "full_name"}], "missing_policy": "omit"}
    out = json.loads(P.documents(p, cfg).first()["output"])
    assert out["place"] == {"city": "Ulm", "region": None, "country": "DE", "raw": "Ulm"} and "name" not in out
    assert "conflicts" not in json.loads(P.documents(p, cfg | {"missing_policy": "null"}).first()["output"])


def test_results_hold_profile_output_and_validation(spark):
    p = fuse.profiles(fuse.gather(fuse.facts(records(spark, ROHAN))))
    row = json.loads(P.results(p, C.SLIM).toJSON().first())
    assert row["canonical"]["candidate_id"] == "c14" and row["output"]["id"] == "c14" and row["validation"]["valid"]


def test_long_lists_become_text_in_blocks(spark, monkeypatch):
    """Documents of lists written in blocks are those of the profile in a row, without an array of all entries."""
    monkeypatch.setattr(fuse, "BLOCK_VALUES", 2)
    rows = [(i, "ats_json", f"c{i % 3}", None, f"A{i % 2}", None, [f'a"{i}\n@x.org'], ["Go"] if i % 3 else None) for i in range(20)]
    facts = fuse.facts(records(spark, rows))
    fields = [{"key": "id", "from": "candidate_id"}, {"key": "name", "from": "full_name"}, {"key": "mails", "from": "emails"}, {"key": "skills"}]
    for policy in ("null", "omit"):
        cfg = {"fields": fields, "missing_policy": policy, "include_provenance": False, "include_confidence": True}
        want = {r["candidate_id"]: r["output"] for r in P.documents(fuse.profiles(fuse.gather(facts)), cfg).collect()}
        got = P.long_documents(fuse.long_profiles(facts), cfg)
        assert {r["candidate_id"]: r["output"] for r in got.collect()} == want
        assert len(want) == 3


def test_search_text_is_no_part_of_a_filter(spark):
    """The filter of a search reads a finished text: inside a filter, parts that occur twice are made twice."""
    p = fuse.profiles(fuse.gather(fuse.facts(records(spark, ROHAN))))
    found = report.profile_search(p, "Mehta", C.HIRING, outputs=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter " in line]
    assert filters and not any("StructsToJson" in line for line in filters)
    assert found.count() == 1 and report.profile_search(p, "nobody", C.HIRING, outputs=True).count() == 0


def test_provenance_of_scalars_and_lists_comes_from_one_fusion(spark):
    from workload.output import project_provenance

    plan = project_provenance(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "c_custkey" in line for line in plan.splitlines()) == 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fields_are_slices_of_the_entries(spark):
    gathered = fuse.gather(fuse.facts(records(spark, ROHAN)))
    row = gathered.first()
    held = [e["field"] for e in row["entries"]]
    assert {f: n for f, n in row["counts"].asDict().items() if n} == {f: held.count(f) for f in held} and held == sorted(held)
    # No entry is searched for by the name of its field.
    assert ".field = " not in _plan(fuse.profiles(gathered)) and "field = emails" not in _plan(fuse.profiles(gathered)).split("Aggregate")[0]


def test_confidence_query_makes_its_map_once(tmp_path):
    import __spark_entry__ as E
    from pyspark.sql import SparkSession

    plan = _plan(E.queries()["project_confidence"](SparkSession.getActiveSession(), "/root/testdata/sf0.001"))
    assert not [line for line in plan.splitlines() if "Filter" in line and "map_from_entries" in line]


@pytest.mark.parametrize("conflicts", [True, False])
def test_documents_are_written_as_one_object(spark, conflicts):
    p = fuse.profiles(fuse.gather(fuse.facts(records(spark, ROHAN if conflicts else ROHAN[:1]))))
    text = P.documents(p, C.DEFAULT).first()["output"]
    doc = json.loads(text)
    row = P.project(p, C.DEFAULT).drop("missing_keys").first().asDict(recursive=True)
    assert list(doc) == [k for k in row if k != "conflicts" or conflicts] and ("conflicts" in doc) == conflicts
    assert {k: doc[k] for k in doc} == {k: row[k] for k in doc}
    assert _plan(P.documents(p, C.DEFAULT)).count("to_json(") + _plan(P.documents(p, C.DEFAULT)).count("StructsToJson") < 12
