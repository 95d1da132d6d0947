"""Column standardisers and text mining on fixed inputs."""

import pytest
from pyspark.sql import functions as F

from kinweave.functions import standardize as N, text as X

CASES = {
    "phone": (lambda c: N.phone(c), {
        "(415) 222-3344": "+14152223344", "not-a-number": None, "+1 (415) 555-0199": "+14155550199",
        "+52 55 1234 5678": "+525512345678", "+44 (0)20 7946 0958": "+442079460958", "+81 75 555 1212": "+81755551212",
        "1-415-555-2266 ext 12": "+14155552266", "+999123": None, "555-123": None, None: None,
    }),
    "phone_de": (lambda c: N.phone(c, "DE"), {"030 12345678": "+493012345678", "+1 415 222 3344": "+14152223344"}),
    "skill": (lambda c: N.skill(c), {
        "js": "JavaScript", "rust": "Rust", "nodejs": "Node.js", "Node.js": None, "ROS": "ROS", "iOS": "Ios",
        "Objective-C": "Objective-c", "a/b": None, " machine   learning ": "Machine Learning", "": None,
    }),
    "skill_alias_first": (lambda c: N.skill(c, alias_first=True), {"Node.js": "Node.js", "other.js": None}),
    "month": (N.month, {
        "2021-01": "2021-01", "Jan 2021": "2021-01", "Present": "present", "2021": "2021-01", "3/2020": "2020-03",
        "2021-13": "2021-13", "soon": None, "Sept. 2020": "2020-09", "": None,
    }),
    "country": (lambda c: N.country(c), {"USA": "US", "Atlantis": None, "UK": "UK", "england": "GB"}),
    "country_iso": (lambda c: N.country(c, known_codes=("GB", "DE", "IT")), {"UK": "GB", "ZQ": None, "de": "DE", "it": "IT"}),
    "location": (lambda c: N.location(c), {
        "San Francisco, CA": ("San Francisco", None, "CA", "San Francisco, CA"),
        "Mexico City, Mexico": ("Mexico City", "Mexico", None, "Mexico City, Mexico"),
        "Unknown": ("Unknown", None, None, "Unknown"),
        "Bengaluru, KA, India": ("Bengaluru", "KA", "IN", "Bengaluru, KA, India"), " , ": None,
    }),
    "name": (N.name, {"JOHN SMITH": "John Smith", "maya m. wong": "Maya M. Wong", "o'brien-smith": "O'brien-smith", " ": None}),
    "email": (N.email, {"diego@bad-email": None, " A@B.CO ": "a@b.co", ".a@b.co": None, None: None}),
    "years": (lambda c: N.years(c, 2024), {
        "7": 7.0, "not_a_number": None, "2024-2025": 1.0, "85": None, "7d": None, "NaN": None, "Aug 2018 - present": 6.0,
    }),
    "years_no_clock": (lambda c: N.years(c), {"2018 - present": None, "2018-2020": 2.0}),
    "url": (N.url, {
        "example.com/": "https://example.com", "HTTP://Ex.COM:80/a/?q=1#f": "http://ex.com/a?q=1", "https://a b.com": None,
        "https://u:p@x.io:8443/p/": "https://x.io:8443/p", "ftp://x.com/a": None, "localhost": None, "https://1.2.3.4/a": "https://1.2.3.4/a",
    }),
    "link_type": (N.link_type, {"https://netflix.com": "twitter", "https://github.com/a": "github", "https://a.org": "other"}),
    "slug_name": (N.name_from_slug, {"jane-doe-3a4b1c": "Jane Doe", "janedoe": None}),
    "gh": (N.github_handle, {"https://www.github.com/jane-doe/x": "jane-doe", "https://github.com/settings": None, "https://github.com/a_b": None}),
    "li": (N.linkedin_handle, {"https://linkedin.com/in/jane?x": "jane", "https://linkedin.com/company/x": None}),
    "cue": (X.role_cue, {"Currently a Staff Engineer at Acme Corp. Good": "Staff Engineer at Acme Corp", "engineer at Acme.": None}),
    "years_cue": (X.years_cue, {"~8 years experience": 8.0, "2.5+ yrs": 2.5, "many years": None}),
    "terms": (lambda c: X.terms(c, ("Java", "JavaScript", "SQL", "SQL Server", "C++")), {
        "javascript and java,c++ sql server": ["Java", "JavaScript", "SQL", "SQL Server", "C++"],
        "SQL Server only": ["SQL", "SQL Server"], "mysql javas": [],
    }),
}


@pytest.mark.parametrize("name", CASES)
def test_column(spark, name):
    fn, cases = CASES[name]
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", fn(F.col("v")).alias("o"))
    got = {r["v"]: r["o"] for r in df.collect()}
    want = {k: tuple(v) if isinstance(v, tuple) else v for k, v in cases.items()}
    assert {k: tuple(v) if hasattr(v, "asDict") else v for k, v in got.items()} == want


def test_skill_list_keeps_first_spelling_and_sorts(spark):
    a = F.array(*[F.lit(x) for x in ("rust", "RUST", "js", "a@b", "zig")])
    row = spark.range(1).select(N.skill_list(a).alias("x"), N.skill_list(a, collation="UNICODE").alias("y")).first()
    assert row["x"] == ["JavaScript", "Rust", "Zig"] and row["y"] == ["JavaScript", "Rust", "Zig"]


def test_sections_and_history(spark):
    text = (
        "Jane Doe\nSenior Engineer\nBerlin, Germany\nSummary\nx\nWork Experience:\nAcme | Dev | Jan 2020 - now | NY\n"
        "Lead at Globex (May 2018 - present)\nnoise\nEducation\nMIT, BS, 2012\nSkills: all\npython, go; js\n"
    )
    ln = X.lines(F.lit(text))
    from kinweave import schema as S

    row = spark.range(1).select(
        X.first_name_line(ln).alias("name"), X.first_role_line(ln).alias("role"), X.first_place_line(ln).alias("place"),
        X.free_text_experience(X.section(ln, S.SECTION_HEADINGS["experience"])).alias("exp"),
        X.free_text_education(X.section(ln, S.SECTION_HEADINGS["education"])).alias("edu"),
        X.section(ln, S.SECTION_HEADINGS["skills"]).alias("skills"),
    ).first()
    assert row["name"] == "Jane Doe" and row["role"] == "Senior Engineer" and row["place"]["country"] == "DE"
    assert [tuple(e) for e in row["exp"]] == [
        ("Acme", "Dev", "2020-01", "present", "NY"), ("Globex", "Lead", "2018-05", "present", None),
    ]
    assert [tuple(e) for e in row["edu"]] == [("MIT", "BS", None, "2012-01")]
    assert row["skills"] == ["python, go; js", ""]
