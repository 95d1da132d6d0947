"""Column standardisers and text mining over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import standardize as N, text as X
from kinweave.operators import lexicon
from kinweave.sources import records as R
from workload.base import REC, STD, query, rec, spread, table

# ------------------------------------------------------ contact columns ----


@query("std_email", f"WITH {STD} SELECT k, source, email FROM std")
def std_email(spark, sf):
    return rec(spark, sf).select("k", "source", N.email(F.col("raw_email")).alias("email"))


@query("std_phone", f"WITH {STD} SELECT k, source, phone FROM std")
def std_phone(spark, sf):
    return rec(spark, sf).select("k", "source", N.phone(F.col("raw_phone")).alias("phone"))


# Numbers of five countries built from order keys, in national and international spelling.
@query(
    "std_phone_countries",
    """
WITH n AS (SELECT o_orderkey AS k, lpad((o_orderkey * 7919 % 10000000)::VARCHAR, 7, '0') AS d, o_orderkey % 6 AS kind FROM orders),
raw AS (SELECT k, d, kind, CASE kind
  WHEN 0 THEN '+44 (0)20 ' || d || '1' WHEN 1 THEN '+91 98' || d || '0' WHEN 2 THEN '+65 ' || d || '0'
  WHEN 3 THEN '1-212-' || d WHEN 4 THEN '+49-30-' || d WHEN 5 THEN '+1 (' || substr(d, 1, 3) || ') ' || d END AS raw FROM n)
SELECT k, raw, CASE kind
  WHEN 0 THEN '+4420' || d || '1'
  WHEN 1 THEN '+9198' || d || '0'
  WHEN 2 THEN CASE WHEN substr(d, 1, 1) IN ('3', '6', '8', '9') THEN '+65' || d || '0' END
  WHEN 3 THEN '+1212' || d
  WHEN 4 THEN '+4930' || d
  WHEN 5 THEN CASE WHEN substr(d, 1, 1) BETWEEN '2' AND '9' THEN '+1' || substr(d, 1, 3) || d END END AS phone
FROM raw
""",
)
def std_phone_countries(spark, sf):
    k = F.col("o_orderkey")
    d = F.lpad((k * 7919 % 10000000).cast("string"), 7, "0")
    kind = k % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit("+44 (0)20 "), d, F.lit("1")))
        .when(kind == 1, F.concat(F.lit("+91 98"), d, F.lit("0")))
        .when(kind == 2, F.concat(F.lit("+65 "), d, F.lit("0")))
        .when(kind == 3, F.concat(F.lit("1-212-"), d))
        .when(kind == 4, F.concat(F.lit("+49-30-"), d))
        .otherwise(F.concat(F.lit("+1 ("), F.substring(d, 1, 3), F.lit(") "), d))
    )
    d = spread(table(spark, sf, "orders").select(k.alias("k"), raw.alias("raw")))
    return d.select("k", "raw", N.phone(F.col("raw")).alias("phone"))


@query("std_name", f"WITH {STD} SELECT k, source, full_name FROM std")
def std_name(spark, sf):
    return rec(spark, sf).select("k", "source", N.name(F.col("raw_name")).alias("full_name"))


@query("std_location", f"WITH {STD} SELECT k, source, city, region, country, raw_location AS raw FROM std")
def std_location(spark, sf):
    place = rec(spark, sf).select("k", "source", N.location(F.col("raw_location")).alias("p"))
    return place.select("k", "source", "p.city", "p.region", "p.country", "p.raw")


@query(
    "std_country",
    """
WITH raw AS (
  SELECT n_nationkey AS k, n_name || '-' || o AS label, CASE o WHEN 0 THEN n_name
         WHEN 1 THEN chr((97 + n_nationkey)::INT) || chr((97 + n_nationkey % 7)::INT)
         WHEN 2 THEN upper(['united states', 'india', 'united kingdom', 'deutschland', 'u.s.a.', 'brazil', 'atlantis'][n_nationkey % 7 + 1])
         ELSE ' ' || ['japan', 'china', 'singapore', 'australia', 'france', 'canada', 'england', 'bharat'][n_nationkey % 8 + 1] || ' ' END AS raw
  FROM nation, (VALUES (0), (1), (2), (3)) v(o))
SELECT label, raw, CASE WHEN regexp_matches(lower(trim(raw)), '^[a-z]{2}$') THEN upper(trim(raw)) ELSE
  CASE lower(trim(raw)) WHEN 'united states' THEN 'US' WHEN 'india' THEN 'IN' WHEN 'united kingdom' THEN 'GB'
    WHEN 'deutschland' THEN 'DE' WHEN 'u.s.a.' THEN 'US' WHEN 'brazil' THEN 'BR' WHEN 'japan' THEN 'JP' WHEN 'china' THEN 'CN'
    WHEN 'singapore' THEN 'SG' WHEN 'australia' THEN 'AU' WHEN 'france' THEN 'FR' WHEN 'canada' THEN 'CA'
    WHEN 'england' THEN 'GB' WHEN 'bharat' THEN 'IN' END END AS country
FROM raw
""",
)
def std_country(spark, sf):
    k = F.col("n_nationkey")

    def choice(words, n):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (k % n + 1).cast("int"))

    spellings = F.array(
        F.col("n_name"),
        F.concat(F.char(k + 97), F.char(k % 7 + 97)),
        F.upper(choice(["united states", "india", "united kingdom", "deutschland", "u.s.a.", "brazil", "atlantis"], 7)),
        F.concat(
            F.lit(" "),
            choice(["japan", "china", "singapore", "australia", "france", "canada", "england", "bharat"], 8),
            F.lit(" "),
        ),
    )
    raw = table(spark, sf, "nation").select("n_name", F.posexplode(spellings).alias("o", "raw"))
    return raw.select(
        F.concat("n_name", F.lit("-"), F.col("o").cast("string")).alias("label"), "raw",
        N.country(F.col("raw")).alias("country"),
    )


_MONTH_WORDS = ["Jan", "February", "mar.", "APRIL", "May", "june", "Jul", "Aug.", "sept", "October", "Nov", "december"]


@query(
    "std_month",
    """
WITH d AS (SELECT o_orderkey AS k, year(o_orderdate)::VARCHAR AS y, month(o_orderdate) AS m, o_orderkey % 8 AS kind FROM orders),
raw AS (SELECT k, y, m, kind, CASE kind WHEN 0 THEN y || '-' || m WHEN 1 THEN y || '/' || lpad(m::VARCHAR, 2, '0')
  WHEN 2 THEN m || '/' || y WHEN 3 THEN ' ' || lpad(m::VARCHAR, 2, '0') || '-' || y || ' ' WHEN 4 THEN y
  WHEN 5 THEN ['Jan', 'February', 'mar.', 'APRIL', 'May', 'june', 'Jul', 'Aug.', 'sept', 'October', 'Nov', 'december'][m] || ' ' || y
  WHEN 6 THEN ['Present', 'current', 'NOW', 'soon'][m % 4 + 1] ELSE y || '-' || m || '-01' END AS raw FROM d)
SELECT k, raw, CASE WHEN kind = 4 THEN y || '-01' WHEN kind = 6 THEN CASE WHEN m % 4 <> 3 THEN 'present' END
  WHEN kind = 7 THEN NULL ELSE y || '-' || lpad(m::VARCHAR, 2, '0') END AS month_text
FROM raw
""",
)
def std_month(spark, sf):
    y = F.year("o_orderdate").cast("string")
    m = F.month("o_orderdate")
    mt = m.cast("string")
    m2 = F.lpad(mt, 2, "0")
    kind = F.col("o_orderkey") % 8
    words = F.array(*[F.lit(w) for w in _MONTH_WORDS])
    now = F.array(*[F.lit(w) for w in ("Present", "current", "NOW", "soon")])
    raw = (
        F.when(kind == 0, F.concat_ws("-", y, mt))
        .when(kind == 1, F.concat_ws("/", y, m2))
        .when(kind == 2, F.concat_ws("/", mt, y))
        .when(kind == 3, F.concat(F.lit(" "), m2, F.lit("-"), y, F.lit(" ")))
        .when(kind == 4, y)
        .when(kind == 5, F.concat_ws(" ", F.element_at(words, m), y))
        .when(kind == 6, F.element_at(now, m % 4 + 1))
        .otherwise(F.concat_ws("-", y, mt, F.lit("01")))
    )
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), raw.alias("raw"))
    return d.select("k", "raw", N.month(F.col("raw")).alias("month_text"))


@query(
    "std_years",
    """
WITH d AS (SELECT o_orderkey AS k, o_orderkey % 8 AS kind, 1950 + o_orderkey % 75 AS a, o_orderkey % 97 AS n FROM orders),
raw AS (SELECT *, CASE kind WHEN 0 THEN n::VARCHAR WHEN 1 THEN ' ' || n || '.5 ' WHEN 2 THEN a || '-' || (a + n - 10)
  WHEN 3 THEN 'Aug ' || a || ' - Present' WHEN 4 THEN n || 'd' WHEN 5 THEN 'NaN' WHEN 6 THEN '-' || n ELSE 'since ' || a END AS raw FROM d)
SELECT k, raw, CASE kind WHEN 0 THEN CASE WHEN n < 80 THEN n::DOUBLE END
  WHEN 1 THEN CASE WHEN n + 0.5 < 80 THEN n + 0.5::DOUBLE END
  WHEN 2 THEN CASE WHEN n - 10 BETWEEN 0 AND 79 THEN (n - 10)::DOUBLE END
  WHEN 3 THEN CASE WHEN 2024 - a BETWEEN 0 AND 79 THEN (2024 - a)::DOUBLE END
  WHEN 6 THEN CASE WHEN n = 0 THEN 0.0::DOUBLE END END AS yoe
FROM raw
""",
)
def std_years(spark, sf):
    k = F.col("o_orderkey")
    kind, a, n = k % 8, k % 75 + 1950, k % 97
    at, nt = a.cast("string"), n.cast("string")
    raw = (
        F.when(kind == 0, nt)
        .when(kind == 1, F.concat(F.lit(" "), nt, F.lit(".5 ")))
        .when(kind == 2, F.concat(at, F.lit("-"), (a + n - 10).cast("string")))
        .when(kind == 3, F.concat(F.lit("Aug "), at, F.lit(" - Present")))
        .when(kind == 4, F.concat(nt, F.lit("d")))
        .when(kind == 5, "NaN")
        .when(kind == 6, F.concat(F.lit("-"), nt))
        .otherwise(F.concat(F.lit("since "), at))
    )
    d = table(spark, sf, "orders").select(k.alias("k"), raw.alias("raw"))
    return d.select("k", "raw", N.years(F.col("raw"), 2024).alias("yoe"))


# --------------------------------------------------------------- skills ----

_SKILL_SQL = """
  CASE WHEN trim(s) = '' OR regexp_matches(s, '(?i)^https?://|[@/]|\\.[a-z]{2,}\\b') THEN NULL
       WHEN map_contains(al, lower(s)) THEN al[lower(s)]
       WHEN regexp_matches(s, '^[A-Z0-9+#.]{2,}$') THEN s
       ELSE array_to_string(list_transform(string_split(s, ' '), lambda w: CASE WHEN length(w) <= 2 THEN upper(w)
            ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') END"""
_ALIASES = """MAP {'js': 'JavaScript', 'golang': 'Go', 'nodejs': 'Node.js', 'c++': 'C++', 'ml': 'Machine Learning', 'sql': 'SQL'} AS al"""
_SPICE = ["js", "GoLang", "Node.js", "nodejs", "C++", "ml", "a/b", "x@y", "ROS", "SQL", "of"]


def _spice(k):
    return F.element_at(F.array(*[F.lit(w) for w in _SPICE]), (k % 11 + 1).cast("int"))


_SPICE_SQL = "['js', 'GoLang', 'Node.js', 'nodejs', 'C++', 'ml', 'a/b', 'x@y', 'ROS', 'SQL', 'of']"


@query(
    "std_skill",
    f"""
WITH raw AS (SELECT p_partkey AS k, unnest([p_name, {_SPICE_SQL}[p_partkey % 11 + 1]]) AS s, {_ALIASES} FROM part)
SELECT k, s AS raw, {_SKILL_SQL} AS skill FROM raw
""",
)
def std_skill(spark, sf):
    k = F.col("p_partkey")
    d = table(spark, sf, "part").select(k.alias("k"), F.explode(F.array("p_name", _spice(k))).alias("raw"))
    return d.select("k", "raw", N.skill(F.col("raw")).alias("skill"))


@query(
    "std_skill_list",
    f"""
WITH raw AS (SELECT p_partkey AS k, i, s, {_ALIASES} FROM (
  SELECT p_partkey, unnest(string_split(p_name, ' ') || [upper(string_split(p_name, ' ')[1]), {_SPICE_SQL}[p_partkey % 11 + 1]]) AS s,
         generate_subscripts(string_split(p_name, ' ') || ['', ''], 1) AS i FROM part)),
clean AS (SELECT k, i, {_SKILL_SQL} AS skill FROM raw),
firsts AS (SELECT k, lower(skill), arg_min(skill, i) AS skill FROM clean WHERE skill IS NOT NULL GROUP BY k, lower(skill))
SELECT p_partkey AS k, coalesce(string_agg(skill, '|' ORDER BY skill), '') AS skills
FROM part LEFT JOIN firsts ON k = p_partkey GROUP BY p_partkey
""",
)
def std_skill_list(spark, sf):
    k = F.col("p_partkey")
    words = F.split("p_name", " ")
    listed = F.concat(words, F.array(F.upper(F.element_at(words, 1)), _spice(k)))
    d = table(spark, sf, "part").select(k.alias("k"), listed.alias("s"))
    return d.select("k", F.array_join(N.skill_list(F.col("s")), "|").alias("skills"))


@query(
    "skill_split",
    f"""
WITH raw AS (SELECT p_partkey AS k, unnest(string_split_regex(replace(p_name, ' ', '; ') || ' |' || p_type || ', ' ||
  {_SPICE_SQL}[p_partkey % 11 + 1], '[,;|]')) AS x, generate_subscripts(string_split_regex(replace(p_name, ' ', '; ') || ' |' || p_type || ', z', '[,;|]'), 1) AS i FROM part),
clean AS (SELECT k, i, {_SKILL_SQL} AS skill FROM (SELECT k, i, trim(x) AS s, {_ALIASES} FROM raw))
SELECT k, string_agg(skill, '|' ORDER BY i) AS skills FROM clean WHERE skill IS NOT NULL GROUP BY k
""",
)
def skill_split(spark, sf):
    k = F.col("p_partkey")
    text = F.concat(F.replace("p_name", F.lit(" "), F.lit("; ")), F.lit(" |"), "p_type", F.lit(", "), _spice(k))
    d = table(spark, sf, "part").select(k.alias("k"), text.alias("t"))
    return d.select("k", F.array_join(X.split_skills(F.col("t")), "|").alias("skills"))


# ---------------------------------------------------------------- links ----


@query(
    "std_url",
    """
SELECT page_id, url AS raw,
  lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) ||
  regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/$', '') ||
  regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS url
FROM pages
""",
)
def std_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.col("url").alias("raw"), N.url(F.col("url")).alias("url"))


_LINKS = [
    "linkedin.com/in/a-b-{}", "https://GitHub.com/u{}", "twitter.com/{}", "https://netflix.com/{}",
    "stackoverflow.com/users/{}", "https://example.org/{}", "http://github.com/settings/{}", "https://www.linkedin.com/in/U-{}?x=1",
]


def _link_text(k):
    pick = F.element_at(F.array(*[F.lit(t) for t in _LINKS]), (k % 8 + 1).cast("int"))
    return F.replace(pick, F.lit("{}"), k.cast("string"))


_LINK_SQL = (
    "replace([" + ", ".join(f"'{t}'" for t in _LINKS) + "][c_custkey % 8 + 1], '{}', c_custkey::VARCHAR)"
)


@query(
    "link_class",
    f"""
WITH u AS (SELECT url FROM pages UNION ALL SELECT {_LINK_SQL} FROM customer)
SELECT url, CASE WHEN lower(url) LIKE '%linkedin.com%' THEN 'linkedin' WHEN lower(url) LIKE '%github.com%' THEN 'github'
  WHEN lower(url) LIKE '%twitter.com%' OR lower(url) LIKE '%x.com%' THEN 'twitter'
  WHEN lower(url) LIKE '%stackoverflow.com%' THEN 'stackoverflow' ELSE 'other' END AS link_type
FROM u
""",
)
def link_class(spark, sf):
    u = table(spark, sf, "pages").select("url").unionByName(
        table(spark, sf, "customer").select(_link_text(F.col("c_custkey")).alias("url"))
    )
    return u.select("url", N.link_type(F.col("url")).alias("link_type"))


@query(
    "handle_gh",
    f"""
WITH u AS (SELECT c_custkey AS k, {_LINK_SQL} AS url FROM customer),
h AS (SELECT k, url, regexp_extract(url, '(?i)^https?://(?:www\\.)?github\\.com/([^/?#]+)(?:[/?#]|$)', 1) AS h FROM u)
SELECT k, url, CASE WHEN h <> '' AND h <> 'settings' THEN h END AS handle FROM h
""",
)
def handle_gh(spark, sf):
    u = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), _link_text(F.col("c_custkey")).alias("url"))
    return u.select("k", "url", N.github_handle(F.col("url")).alias("handle"))


@query(
    "handle_li",
    f"""
WITH u AS (SELECT c_custkey AS k, {_LINK_SQL} AS url FROM customer),
h AS (SELECT k, url, regexp_extract(url, '(?i)^https?://(?:www\\.)?linkedin\\.com/in/([^/?#]+)(?:[/?#]|$)', 1) AS h FROM u)
SELECT k, url, CASE WHEN h <> '' THEN h END AS handle FROM h
""",
)
def handle_li(spark, sf):
    u = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), _link_text(F.col("c_custkey")).alias("url"))
    return u.select("k", "url", N.linkedin_handle(F.col("url")).alias("handle"))


@query(
    "name_from_slug",
    """
WITH s AS (SELECT p_partkey AS k, replace(p_name, ' ', '-') || CASE p_partkey % 3 WHEN 0 THEN '-3a4b' WHEN 1 THEN '' ELSE '-PLUS-x-y' END AS slug FROM part),
w AS (SELECT k, slug, list_filter(string_split(slug, '-'), lambda p: regexp_matches(p, '^[a-zA-Z]+$')) AS ws FROM s)
SELECT k, slug, CASE WHEN len(ws) >= 2 THEN array_to_string(list_transform(ws[1:3], lambda x: upper(x[1]) || lower(x[2:])), ' ') END AS guessed
FROM w
""",
)
def name_from_slug(spark, sf):
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, "-3a4b").when(k % 3 == 1, "").otherwise("-PLUS-x-y")
    s = table(spark, sf, "part").select(
        k.alias("k"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), tail).alias("slug")
    )
    return s.select("k", "slug", N.name_from_slug(F.col("slug")).alias("guessed"))


# ------------------------------------------------------------------ ids ----


@query(
    "derive_id",
    f"""
WITH {REC}
SELECT k, source, coalesce(candidate_id,
  'derived_' || trim(regexp_replace(lower(split_part(trim(raw_email), '@', 1)), '[^a-z0-9]+', '_', 'g'), '_'),
  'derived_' || trim(regexp_replace(lower(raw_name), '[^a-z0-9]+', '_', 'g'), '_'), 'derived_row_' || (k + 1)) AS candidate_id
FROM rec
""",
)
def derive_id(spark, sf):
    return rec(spark, sf).select(
        "k", "source",
        N.row_id(F.col("candidate_id"), N.trim(F.col("raw_email")), F.col("raw_name"), F.col("k") + 1).alias("candidate_id"),
    )


@query(
    "enrich_headline",
    """
SELECT doc_id, CASE WHEN text <> '' THEN substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 140) ELSE 'Working at ' || source END AS headline
FROM documents
""",
)
def enrich_headline(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return d.select("doc_id", N.headline_from_bio(F.col("text"), F.col("source")).alias("headline"))


# --------------------------------------------------------- text mining ----

_TEXTS = """texts AS (SELECT 'd' || doc_id AS id, text AS t FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages)"""


def _texts(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("t"))
    p = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("t"))
    return spread(d.unionByName(p))


@query(
    "mine_contacts",
    f"""
WITH {_TEXTS},
found AS (
  SELECT id, 'email' AS kind, unnest(list_distinct(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'))) AS raw FROM texts
  UNION ALL
  SELECT id, 'phone', unnest(list_distinct(regexp_extract_all(t, '\\+?\\d[\\d\\s().-]{{7,}}\\d'))) FROM texts
  UNION ALL
  SELECT id, 'link', unnest(list_distinct(regexp_extract_all(t, 'https?://[^\\s)>,]+'))) FROM texts),
digits AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM found),
plan AS (SELECT *, CASE WHEN kind = 'phone' AND raw LIKE '+%'
  THEN regexp_replace(d, '^(44|91|49|33|61|55|81|86|82|98)0', '\\1') ELSE d END AS n FROM digits)
SELECT id, kind, raw, CASE
  WHEN kind = 'email' THEN CASE WHEN regexp_matches(lower(raw), '^[a-z0-9_]') THEN lower(raw) END
  WHEN kind = 'link' THEN lower(regexp_extract(raw, '^(https?://[^/?#]+)', 1)) ||
    regexp_replace(regexp_extract(raw, '^https?://[^/?#]+([^?#]*)', 1), '/$', '') || regexp_extract(raw, '^[^?#]*(\\?[^#]*)', 1)
  WHEN raw LIKE '+%' THEN CASE WHEN regexp_matches(n, '^(1[2-9]\\d{{9}}|52[1-9]\\d{{9}}|44[1-9]\\d{{8,9}}|91[1-9]\\d{{9}}|49[1-9]\\d{{5,10}}|33[1-9]\\d{{8}}|61[1-578]\\d{{8}}|65[3689]\\d{{7}}|55[1-9]\\d{{9,10}}|81[1-9]\\d{{8,9}}|86[1-9]\\d{{9,10}}|82[1-9]\\d{{7,9}}|98[1-9]\\d{{9}})$')
    THEN '+' || n END
  WHEN regexp_matches(n, '^1?[2-9][0-9]{{9}}$') THEN '+1' || right(n, 10) END AS clean
FROM plan
""",
)
def mine_contacts(spark, sf):
    """Raw matches of mail addresses, numbers and links with their clean form."""
    t = F.col("t")

    def hits(kind, pattern, clean):
        return F.transform(
            X.matches(t, pattern), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("raw"), clean(r).alias("clean"))
        )

    found = F.concat(
        hits("email", X.NOTE_EMAIL, N.email),
        hits("phone", X.PHONE, lambda r: N.phone(r)),
        hits("link", X.NOTE_LINK, N.url),
    )
    return _texts(spark, sf).select("id", F.explode(found).alias("h")).select("id", "h.kind", "h.raw", "h.clean")


@query(
    "mine_links",
    f"""
WITH {_TEXTS},
m AS (SELECT id, unnest(list_distinct(regexp_extract_all(t,
  '(?:(?:https?|ftp)://)?(?:www\\.)?[a-zA-Z0-9][a-zA-Z0-9-]*(?:\\.[a-zA-Z0-9][a-zA-Z0-9-]*)*\\.[a-zA-Z]{{2,}}(?:/[^\\s]*)?'))) AS raw FROM texts)
SELECT id, raw FROM m
WHERE NOT contains(lower(raw), '@') AND NOT contains(lower(raw), 'gmail.com') AND NOT contains(lower(raw), 'yahoo.com')
  AND NOT contains(lower(raw), 'outlook.com')
  AND NOT regexp_matches(lower(raw), '\\.(js|e|pdf|doc|docx|txt|jpg|png|gif|css|html|xml|json|exe|dll|so|dylib|zip|tar|gz)$')
  AND length(raw) >= 5
""",
)
def mine_links(spark, sf):
    m = F.filter(X.matches(F.col("t"), X.DOCUMENT_LINK), X.real_link)
    return _texts(spark, sf).select("id", F.explode(m).alias("raw"))


_TERMS = ("the", "que", "und", "con", "est", "los", "des", "der", "por que", "que de", "Python", "C++", "SQL")
_TERM_SQL = "[" + ", ".join(f"'{t}'" for t in _TERMS) + "]"


@query(
    "tag_terms",
    f"""
WITH terms AS (SELECT unnest({_TERM_SQL}) AS term)
SELECT doc_id, term FROM documents JOIN terms
  ON regexp_matches(lower(text), '(^|[^a-z])' || replace(lower(term), '+', '\\+') || '([^a-z]|$)')
""",
)
def tag_terms(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.explode(X.terms(F.col("text"), _TERMS)).alias("term"))


_PHRASES = """phrases AS (
  SELECT DISTINCT term FROM (
    SELECT trim(regexp_extract(text, '[A-Za-z]+(, |. | )[A-Za-z]+')) AS term FROM documents
    UNION ALL SELECT regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1) FROM documents
    UNION ALL SELECT p_name FROM part) WHERE term <> '')"""


@query(
    "tag_terms_table",
    f"""
WITH {_PHRASES}
SELECT doc_id, term FROM (SELECT doc_id, lower(text) AS low FROM documents) JOIN (SELECT term, lower(term) AS t FROM phrases)
  ON contains(low, t) AND regexp_matches(low, '(^|[^a-z])' || regexp_escape(t) || '([^a-z]|$)')
""",
)
def tag_terms_table(spark, sf):
    """A lexicon that grows with the tables: a phrase and the last word of every document, and all part names."""
    docs, parts = table(spark, sf, "documents"), table(spark, sf, "part")
    said = lambda pattern, group: F.regexp_extract("text", pattern, group).alias("term")
    # The last word is the first one of the text read backwards, found without trying every word.
    last = F.reverse(F.regexp_extract(F.reverse("text"), "^[^A-Za-z]*+([A-Za-z]++)", 1))
    phrases = docs.select(F.trim(said("[A-Za-z]+(, |. | )[A-Za-z]+", 0)).alias("term")) \
        .unionByName(docs.select(last.alias("term"))).unionByName(parts.select(F.col("p_name").alias("term")))
    return lexicon.tag(spread(docs.select("doc_id", "text")), phrases, id_col="doc_id")


@query(
    "tag_terms_by_table",
    f"""
WITH terms AS (SELECT unnest({_TERM_SQL}) AS term)
SELECT doc_id, term FROM documents JOIN terms
  ON regexp_matches(lower(text), '(^|[^a-z])' || replace(lower(term), '+', '\\+') || '([^a-z]|$)')
""",
)
def tag_terms_by_table(spark, sf):
    """The fixed terms as a table: the same rows as by one pattern."""
    terms = spark.createDataFrame([(t,) for t in _TERMS], "term string")
    return lexicon.tag(spread(table(spark, sf, "documents").select("doc_id", "text")), terms, id_col="doc_id")


@query(
    "years_cue",
    """
WITH t AS (SELECT o_orderkey AS k, 'Joined ' || strftime(o_orderdate, '%Y-%m-%d') || ', ' || CASE o_orderkey % 5
  WHEN 0 THEN '~' || o_orderkey % 40 || ' years of work' WHEN 1 THEN (o_orderkey % 40) || '.5+ yrs, then 3 years'
  WHEN 2 THEN 'many years' WHEN 3 THEN (o_orderkey % 40) || 'Years.' ELSE 'yrsx 4 yearsx 7  YRS' END AS txt FROM orders)
SELECT k, try_cast(regexp_extract(txt, '(?i)(\\d+(?:\\.\\d+)?)\\s*\\+?\\s*(?:years|yrs)\\b', 1) AS DOUBLE) AS yoe FROM t
""",
)
def years_cue(spark, sf):
    k = F.col("o_orderkey")
    n = (k % 40).cast("string")
    tail = (
        F.when(k % 5 == 0, F.concat(F.lit("~"), n, F.lit(" years of work")))
        .when(k % 5 == 1, F.concat(n, F.lit(".5+ yrs, then 3 years")))
        .when(k % 5 == 2, "many years")
        .when(k % 5 == 3, F.concat(n, F.lit("Years.")))
        .otherwise("yrsx 4 yearsx 7  YRS")
    )
    t = F.concat(F.lit("Joined "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", "), tail)
    return table(spark, sf, "orders").select(k.alias("k"), X.years_cue(t).alias("yoe"))


@query(
    "headline_cue",
    """
WITH t AS (SELECT c_custkey AS k, c_mktsegment AS s, c_custkey % 4 AS kind FROM customer)
SELECT k, CASE kind WHEN 0 THEN s || ' lead at Acme Corp' WHEN 1 THEN s || ' at B&B' WHEN 2 THEN NULL ELSE 'Old/' || s || ' at ' || s END AS headline FROM t
""",
)
def headline_cue(spark, sf):
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    t = (
        F.when(k % 4 == 0, F.concat(F.lit("Spoke today. Currently a "), s, F.lit(" lead at Acme Corp. Nice.")))
        .when(k % 4 == 1, F.concat(F.lit("x\ncurrently an "), s, F.lit("  @ B&B\n")))
        .when(k % 4 == 2, F.concat(F.lit("currently "), s, F.lit(" at Acme.")))
        .otherwise(F.concat(F.lit("CURRENTLY A Old/"), s, F.lit(" at "), s, F.lit(".")))
    )
    return table(spark, sf, "customer").select(k.alias("k"), X.role_cue(t).alias("headline"))


@query(
    "section_slice",
    """
WITH l AS (
  SELECT page_id, unnest(string_split(regexp_replace(html, '>\\s*<', '>' || chr(10) || '<', 'g'), chr(10))) AS line,
         generate_subscripts(string_split(regexp_replace(html, '>\\s*<', '>' || chr(10) || '<', 'g'), chr(10)), 1) AS pos FROM pages),
h AS (SELECT *, trim(regexp_replace(lower(trim(line)), ':.*$', '')) AS head FROM l),
s AS (SELECT page_id, min(pos) AS start FROM h WHERE head = '<nav>' GROUP BY page_id),
e AS (SELECT page_id, min(pos) AS stop FROM h JOIN s USING (page_id) WHERE pos > start AND head IN ('<nav>', '<article>') GROUP BY page_id)
SELECT h.page_id, h.pos - start AS line_no, line FROM h JOIN s USING (page_id) LEFT JOIN e USING (page_id)
WHERE pos > start AND (stop IS NULL OR pos < stop)
""",
)
def section_slice(spark, sf):
    ln = X.lines(F.regexp_replace("html", r">\s*<", ">\n<"))
    cut = X.section(ln, ("<nav>",), ("<nav>", "<article>"))
    d = table(spark, sf, "pages").select("page_id", F.posexplode(cut).alias("i", "line"))
    return d.select("page_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


@query(
    "history_rows",
    """
WITH o AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus AS st, o_orderpriority AS pr, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderkey % 4 AS kind FROM orders)
SELECT k, CASE kind WHEN 3 THEN pr ELSE 'Company ' || o_custkey END AS company,
  CASE kind WHEN 0 THEN 'Clerk ' || st WHEN 1 THEN 'Clerk' WHEN 3 THEN 'Status ' || st END AS title,
  CASE kind WHEN 0 THEN y || '-01' WHEN 1 THEN y || '-' || lpad(m::VARCHAR, 2, '0') WHEN 3 THEN y || '-05' END AS start_date,
  CASE kind WHEN 1 THEN 'present' WHEN 3 THEN (y + 1) || '-01' END AS end_date,
  CASE kind WHEN 0 THEN 'Here' END AS place
FROM o WHERE kind <> 2
""",
)
def history_rows(spark, sf):
    """Piped rows of two shapes, rows too short to count, and prose rows."""
    k, y, m = F.col("o_orderkey"), F.year("o_orderdate"), F.month("o_orderdate")
    yt = y.cast("string")
    months = F.array(*[F.lit(w) for w in _MONTH_WORDS])
    company = F.concat(F.lit("Company "), F.col("o_custkey").cast("string"))
    raw = (
        F.when(k % 4 == 0, F.concat(company, F.lit(" | Clerk "), "o_orderstatus", F.lit(" | "), yt, F.lit("-13 - Present | Here")))
        .when(k % 4 == 1, F.concat(company, F.lit("|Clerk| "), F.element_at(months, m), F.lit(" "), yt, F.lit(" – now")))
        .when(k % 4 == 2, F.concat(company, F.lit(" | Clerk")))
        .otherwise(
            F.concat(F.lit("Status "), "o_orderstatus", F.lit(" at "), "o_orderpriority", F.lit(" (May "), yt, F.lit(" - "), (y + 1).cast("string"), F.lit(")"))
        )
    )
    o = spread(table(spark, sf, "orders").select(k.alias("k"), raw.alias("raw")))
    d = o.select("k", F.explode(X.free_text_experience(F.array("raw"))).alias("e"))
    return d.select("k", "e.company", "e.title", "e.start_date", "e.end_date", F.col("e.location").alias("place"))


@query(
    "education_rows",
    """
WITH o AS (SELECT o_orderkey AS k, o_custkey, year(o_orderdate) AS y, o_orderkey % 3 AS kind FROM orders)
SELECT k, 'School ' || o_custkey AS institution, 'BS' AS degree, CASE kind WHEN 0 THEN y || '-01' END AS graduation_date
FROM o WHERE kind <> 2
""",
)
def education_rows(spark, sf):
    k = F.col("o_orderkey")
    school = F.concat(F.lit("School  "), F.col("o_custkey").cast("string"))
    raw = (
        F.when(k % 3 == 0, F.concat(school, F.lit(" | BS | "), F.year("o_orderdate").cast("string")))
        .when(k % 3 == 1, F.concat(school, F.lit(", BS")))
        .otherwise(school)
    )
    d = table(spark, sf, "orders").select(k.alias("k"), F.explode(X.free_text_education(F.array(raw))).alias("e"))
    return d.select("k", "e.institution", "e.degree", "e.graduation_date")


_LINES_SQL = "string_split_regex(text, '\\r?\\n')"


@query(
    "first_name_line",
    f"""
WITH l AS (SELECT doc_id, list_transform({_LINES_SQL}[1:10], lambda s: trim(s, ' \t\r\n')) AS ls FROM documents)
SELECT doc_id, list_filter(ls, lambda s: regexp_matches(s, '^[A-Z][a-zA-Z''.-]*(\\s+[A-Z][a-zA-Z''.-]*){{1,4}}$'))[1] AS name_line FROM l
""",
)
def first_name_line(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", X.first_name_line(X.lines(F.col("text"))).alias("name_line"))


@query(
    "first_cue_lines",
    """
SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' Engineer' WHEN 1 THEN 'team lead, ' || c_mktsegment ELSE 'second engineer, UK' END AS role_line,
  CASE c_custkey % 3 WHEN 2 THEN 'Berlin' ELSE 'Town ' || c_custkey END AS city,
  CASE c_custkey % 3 WHEN 1 THEN 'US' WHEN 2 THEN 'DE' ELSE 'CA' END AS country
FROM customer
""",
)
def first_cue_lines(spark, sf):
    """First role-like and first place-like line of a short text per customer."""
    k = F.col("c_custkey")
    town = F.concat(F.lit("Town "), k.cast("string"))
    role = F.when(k % 3 == 0, F.concat("c_mktsegment", F.lit(" Engineer"))).when(
        k % 3 == 1, F.concat(F.lit("team lead, "), "c_mktsegment")
    ).otherwise("leader of sales")
    place = F.when(k % 3 == 0, F.concat(town, F.lit(", CA"))).when(k % 3 == 1, F.concat(town, F.lit(", North, USA"))).otherwise("Berlin, Germany")
    t = F.concat(F.lit("a text\r\n\n  "), role, F.lit("\n"), place, F.lit("\nsecond engineer, UK"), F.lit(" " * 70))
    d = table(spark, sf, "customer").select(k.alias("k"), X.lines(t).alias("l"))
    d = d.select("k", X.first_role_line(F.col("l")).alias("role_line"), X.first_place_line(F.col("l")).alias("p"))
    return d.select("k", "role_line", "p.city", "p.country")


@query(
    "alias_match",
    """
SELECT c_custkey::VARCHAR AS candidate_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'alt ' || c_custkey END AS name,
       NULL::VARCHAR AS email, c_nationkey::VARCHAR AS phone, 'n' || c_nationkey AS location, c_mktsegment AS headline,
       NULL::VARCHAR AS company, NULL::VARCHAR AS years, NULL::VARCHAR AS skills, NULL::VARCHAR AS linkedin,
       NULL::VARCHAR AS github, NULL::VARCHAR AS portfolio
FROM customer
""",
)
def alias_match(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" ID "),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_name")).otherwise("  ").alias("Name"),
        F.concat(F.lit("alt "), F.col("c_custkey").cast("string")).alias("candidate"),
        F.col("c_nationkey").alias("Mobile"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("CITY"),
        F.col("c_mktsegment").alias("Role"),
    )
    return R.alias_match(c)
