"""Shared inputs of the registered queries.

``rec`` turns customers and nations into contact records of four sources; the
Spark and SQL forms below build the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave import schema as S
from kinweave.functions import standardize as N
from kinweave.operators import fuse
from kinweave.plans.config import fields_needed
from kinweave.sources.records import one_or_none, seq

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of one small unsplittable file to all cores before costly text work.

    A scan that already has a split per core is left alone, so nothing is
    shuffled on data of any size worth a cluster.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ------------------------------------------------------------------ rec ----


def rec(spark: SparkSession, sf: str) -> DataFrame:
    """Raw contact rows: four sources over the customers."""
    people = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    people = spread(people).selectExpr(
        "c_custkey AS k", "string(c_custkey) AS t", "lpad(string(c_custkey % 10000), 4, '0') AS last4",
        "concat('Person ', substring(c_name, 10)) AS person", "c_mktsegment AS seg",
        "concat('p', c_custkey, '@example.com') AS mail", "concat('Springfield, ', n_name) AS town",
    )
    columns = "source candidate_id confidence raw_name raw_email raw_phone raw_location headline yoe".split()

    def row(keep, *values):
        named = ", ".join(f"{v} AS {c}" for v, c in zip(values, columns))
        return f"CASE WHEN {keep} THEN struct({named}) END"

    rows = [
        row("k % 3 <> 2", "'ats_json'", "concat('cand_', t)", "cast(0.95 AS decimal(4,3))", "person", "mail",
            "concat('+1415555', last4)", "concat(town, ', US')", "seg", "int(k % 20)"),
        row("k % 4 <> 3", "'recruiter_csv'", "CASE WHEN k % 5 <> 0 THEN concat('csv_', t) END",
            "cast(0.90 AS decimal(4,3))", "upper(person)", "concat('  P', t, '@Example.COM ')",
            "concat('(415) 555-', last4)", "town", "seg", "int(k % 20 + if(k % 4 = 0, 1, 0))"),
        row("k % 2 = 0", "'resume'", "concat('res_', t)", "cast(0.80 AS decimal(4,3))", "person",
            "if(k % 6 = 0, 'not-an-email', mail)", "string(null)", "'Springfield'", "lower(seg)", "int(k % 20)"),
        row("k % 7 = 0", "'recruiter_notes'", "concat('cand_', t)", "cast(0.55 AS decimal(4,3))", "string(null)",
            "string(null)", "concat('415.555.', last4)", "string(null)", "string(null)", "int(k % 20 + 2)"),
    ]
    return (
        people.selectExpr("k", f"posexplode(array({', '.join(rows)})) AS (block, r)")
        .where("r IS NOT NULL")
        .select(seq("rec", F.col("block"), F.col("k")).alias("record_seq"), "k", "r.*")
    )


REC = """
rec AS (
  WITH p AS (
    SELECT c_custkey AS k, c_custkey::VARCHAR AS t, lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS last4,
           'Person ' || substr(c_name, 10) AS person, c_mktsegment AS seg, n_name,
           'p' || c_custkey::VARCHAR || '@example.com' AS mail
    FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT k, 0 AS block, 'ats_json' AS source, 'cand_' || t AS candidate_id, 0.95::DECIMAL(4,3) AS confidence,
         person AS raw_name, mail AS raw_email, '+1415555' || last4 AS raw_phone,
         'Springfield, ' || n_name || ', US' AS raw_location, seg AS headline, (k % 20)::INT AS yoe
  FROM p WHERE k % 3 <> 2
  UNION ALL
  SELECT k, 1, 'recruiter_csv', CASE WHEN k % 5 <> 0 THEN 'csv_' || t END, 0.90,
         upper(person), '  P' || t || '@Example.COM ', '(415) 555-' || last4,
         'Springfield, ' || n_name, seg, (k % 20 + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END)::INT
  FROM p WHERE k % 4 <> 3
  UNION ALL
  SELECT k, 2, 'resume', 'res_' || t, 0.80, person,
         CASE WHEN k % 6 = 0 THEN 'not-an-email' ELSE mail END, NULL, 'Springfield', lower(seg), (k % 20)::INT
  FROM p WHERE k % 2 = 0
  UNION ALL
  SELECT k, 3, 'recruiter_notes', 'cand_' || t, 0.55, NULL, NULL, '415.555.' || last4, NULL, NULL, (k % 20 + 2)::INT
  FROM p WHERE k % 7 = 0
)"""

# Standardised columns of rec, spelled out for these inputs.
STD = REC + """,
std AS (
  SELECT k, block, source, candidate_id, confidence,
         CASE WHEN raw_name IS NOT NULL THEN array_to_string(list_transform(string_split(raw_name, ' '),
              lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') END AS full_name,
         CASE WHEN regexp_matches(lower(trim(raw_email)), '^[a-z0-9_][a-z0-9._%+-]*@[a-z0-9.-]+\\.[a-z]{2,}$')
              THEN lower(trim(raw_email)) END AS email,
         CASE WHEN raw_phone LIKE '+%' THEN raw_phone
              WHEN raw_phone IS NOT NULL THEN '+1' || regexp_replace(raw_phone, '[^0-9]', '', 'g') END AS phone,
         CASE WHEN raw_location IS NOT NULL THEN 'Springfield' END AS city,
         CASE WHEN raw_location LIKE '%,%' THEN trim(string_split(raw_location, ',')[2]) END AS region,
         CASE WHEN raw_location LIKE '%, US' THEN 'US' END AS country,
         raw_location, headline, yoe
  FROM rec)"""

# Trust of the four sources.
TRUST = """,
voter AS (
  SELECT *, (CASE source WHEN 'ats_json' THEN 1.0 WHEN 'recruiter_csv' THEN 0.85 WHEN 'resume' THEN 0.7
                         WHEN 'recruiter_notes' THEN 0.4 ELSE 0.3 END)::DECIMAL(4,3) * confidence AS w
  FROM std WHERE candidate_id IS NOT NULL)"""


def rec_records(spark: SparkSession, sf: str) -> DataFrame:
    """``rec`` standardised into the shared record layout."""
    r = rec(spark, sf)
    return S.conform(
        r.select(
            "record_seq", "source", "candidate_id", "confidence", "headline",
            N.name(F.col("raw_name")).alias("full_name"),
            one_or_none(N.email(F.col("raw_email"))).alias("emails"),
            one_or_none(N.phone(F.col("raw_phone"))).alias("phones"),
            N.location(F.col("raw_location")).alias("location"),
            F.col("yoe").cast("double").alias("years_experience"),
        )
    )


def rich_records(spark: SparkSession, sf: str) -> DataFrame:
    """``rec`` with skills, links and history from parts and orders.

    Skills: words of the part with the customer's key. Links: one account link
    per source. Experience and education: the customer's own rows.
    """
    base = rec_records(spark, sf).withColumn("k", F.col("record_seq.pos"))
    words = table(spark, sf, "part").selectExpr("p_partkey AS k", "split(p_name, ' ') AS words", "p_brand", "p_type")
    raw = base.join(words, "k", "left").selectExpr(
        "*",
        """CASE source WHEN 'ats_json' THEN words WHEN 'recruiter_csv' THEN transform(words, w -> upper(w))
           WHEN 'resume' THEN slice(words, 1, 1) END AS raw_skills""",
        "concat('HTTPS://GitHub.com/user', k, '/') AS gh",
        "concat('linkedin.com/in/user-', k) AS li",
    ).drop("skills", "links", "experience", "education")
    return S.conform(
        raw.selectExpr(
            "*",
            "CASE source WHEN 'ats_json' THEN array(gh, li) WHEN 'recruiter_csv' THEN array(gh) WHEN 'resume' THEN array(li) END AS raw_links",
            """CASE WHEN words IS NOT NULL AND source <> 'recruiter_notes' THEN array(struct(
                 p_brand AS company, coalesce(p_type, headline) AS title, if(source = 'ats_json', '2020-01', null) AS start_date,
                 string(null) AS end_date, location.city AS location)) END AS experience""",
            """CASE WHEN source IN ('ats_json', 'resume') THEN array(struct(
                 concat('School ', k % 9) AS institution, if(k % 2 = 0, 'BS', 'MS') AS degree, string(null) AS field,
                 concat(k % 30 + 1980, '-01') AS graduation_date)) END AS education""",
        )
        .withColumn("skills", N.compact(F.transform("raw_skills", lambda w: N.skill(w))))
        .withColumn("links", N.link_list(F.col("raw_links")))
    )


# SQL form of the lists of rich_records: (candidate_id, field, key, value, block, k, source, w).
RICH = STD + TRUST + """,
rich AS (
  SELECT v.*, p_brand, p_type, string_split(p_name, ' ') AS words,
         'https://github.com/user' || k AS gh, 'https://linkedin.com/in/user-' || k AS li
  FROM voter v LEFT JOIN part ON p_partkey = k),
items AS (
  SELECT candidate_id, 'emails' AS field, email AS key, email AS value, block, k, source, w FROM rich WHERE email IS NOT NULL
  UNION ALL
  SELECT candidate_id, 'phones', phone, phone, block, k, source, w FROM rich WHERE phone IS NOT NULL
  UNION ALL
  SELECT candidate_id, 'links', lower(u), '{"url":"' || u || '","type":"' || t || '"}', block, k, source, w
  FROM (SELECT *, gh AS u, 'github' AS t FROM rich WHERE source IN ('ats_json', 'recruiter_csv')
        UNION ALL SELECT *, li AS u, 'linkedin' AS t FROM rich WHERE source IN ('ats_json', 'resume'))
  UNION ALL
  SELECT candidate_id, 'skills', lower(s), s, block, k, source, w
  FROM (SELECT *, unnest(CASE source
               WHEN 'ats_json' THEN list_transform(words, lambda x: upper(x[1]) || lower(x[2:]))
               WHEN 'recruiter_csv' THEN list_transform(words, lambda x: upper(x))
               WHEN 'resume' THEN list_transform(words[1:1], lambda x: upper(x[1]) || lower(x[2:])) END) AS s
        FROM rich WHERE words IS NOT NULL)
  UNION ALL
  SELECT candidate_id, 'experience', lower(p_brand) || '|' || lower(p_type) || '|' ||
         CASE WHEN source = 'ats_json' THEN '2020-01' ELSE '' END,
         '{"company":"' || p_brand || '","title":"' || p_type || '","start_date":' ||
         CASE WHEN source = 'ats_json' THEN '"2020-01"' ELSE 'null' END ||
         ',"end_date":null,"location":"Springfield"}', block, k, source, w
  FROM rich WHERE words IS NOT NULL AND source <> 'recruiter_notes'
  UNION ALL
  SELECT candidate_id, 'education', 'school ' || k % 9 || '|' || CASE WHEN k % 2 = 0 THEN 'bs' ELSE 'ms' END,
         '{"institution":"School ' || k % 9 || '","degree":"' || CASE WHEN k % 2 = 0 THEN 'BS' ELSE 'MS' END ||
         '","field":null,"graduation_date":"' || k % 30 + 1980 || '-01"}', block, k, source, w
  FROM rich WHERE source IN ('ats_json', 'resume'))"""

SCALARS = """,
votes_in AS (
  SELECT candidate_id, 'full_name' AS field, full_name AS value, '"' || full_name || '"' AS txt, source, w, block, k
  FROM voter WHERE full_name IS NOT NULL
  UNION ALL
  SELECT candidate_id, 'headline', headline, '"' || headline || '"', source, w, block, k
  FROM voter WHERE headline IS NOT NULL
  UNION ALL
  SELECT candidate_id, 'location', l, l, source, w, block, k
  FROM (SELECT *, '{"city":"' || city || '","region":' || coalesce('"' || region || '"', 'null') || ',"country":' ||
               coalesce('"' || country || '"', 'null') || ',"raw":"' || raw_location || '"}' AS l
        FROM voter) WHERE l IS NOT NULL
  UNION ALL
  SELECT candidate_id, 'years_experience', yoe::VARCHAR, yoe::VARCHAR, source, w, block, k FROM voter
  UNION ALL
  SELECT candidate_id, 'candidate_id', candidate_id, '"' || candidate_id || '"', source, w, block, k FROM voter)"""

# Votes and items fused per candidate, field and key, without resolution first.
FUSED = RICH + SCALARS + """,
facts AS (
  SELECT candidate_id, field, value AS key, min(value) AS value, min(txt) AS txt, sum(w) AS weight,
         list_sort(list(DISTINCT source)) AS sources
  FROM votes_in GROUP BY candidate_id, field, value
  UNION ALL
  SELECT candidate_id, field, key, value,
         CASE WHEN field IN ('links', 'experience', 'education') THEN value ELSE '"' || value || '"' END,
         weight, sources
  FROM (SELECT candidate_id, field, key, arg_min(value, (block, k)) AS value, sum(w) AS weight,
               list_sort(list(DISTINCT source)) AS sources
        FROM items GROUP BY candidate_id, field, key)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY candidate_id, field ORDER BY weight DESC, txt) AS rn,
         sum(weight) OVER (PARTITION BY candidate_id, field) AS total,
         count(*) OVER (PARTITION BY candidate_id, field) AS n
  FROM facts),
conf AS (
  SELECT candidate_id, field,
         CASE WHEN field IN ('full_name', 'headline', 'location', 'years_experience', 'candidate_id')
              THEN round(weight::DECIMAL(18,6) / total, 3)::DOUBLE
              ELSE least(1.0, round(total / n, 3)::DOUBLE) END AS confidence
  FROM ranked WHERE rn = 1)"""


def fused(spark: SparkSession, sf: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Facts of ``rich_records`` by candidate id, without resolution."""
    return fuse.facts(rich_records(spark, sf), fields)


def canonical(spark: SparkSession, sf: str, config: dict | None = None) -> DataFrame:
    """Nested profiles of ``rich_records`` by candidate id; with a configuration, of the fields that it reads."""
    fields = fields_needed(config)
    return fuse.profiles(fuse.gather(fused(spark, sf, fields)), fields)


# ----------------------------------------------------------- components ----

EDGES = """,
signals AS (
  SELECT DISTINCT candidate_id, 'email' AS kind, email AS key FROM std WHERE candidate_id IS NOT NULL AND email IS NOT NULL
  UNION
  SELECT DISTINCT candidate_id, 'phone', phone FROM std WHERE candidate_id IS NOT NULL AND phone IS NOT NULL),
strong AS (
  SELECT DISTINCT h.a, s.candidate_id AS b
  FROM signals s JOIN (SELECT kind, key, min(candidate_id) AS a FROM signals GROUP BY kind, key) h USING (kind, key)
  WHERE h.a <> s.candidate_id),
pairs AS (
  SELECT DISTINCT n.candidate_id, n.tokens, p.place
  FROM (SELECT DISTINCT candidate_id, list_sort(list_distinct(string_split(lower(full_name), ' '))) AS tokens
        FROM std WHERE candidate_id IS NOT NULL AND full_name IS NOT NULL) n
  JOIN (SELECT DISTINCT candidate_id, 'city:' || lower(city) AS place FROM std WHERE candidate_id IS NOT NULL AND city IS NOT NULL
        UNION SELECT DISTINCT candidate_id, 'country:' || country FROM std WHERE candidate_id IS NOT NULL AND country IS NOT NULL) p
  USING (candidate_id)),
weak AS (
  SELECT DISTINCT h.a, s.candidate_id AS b
  FROM pairs s JOIN (SELECT tokens, place, min(candidate_id) AS a FROM pairs GROUP BY tokens, place) h USING (tokens, place)
  WHERE h.a <> s.candidate_id),
edges AS (SELECT a, b FROM strong UNION SELECT a, b FROM weak),
sym AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges),
reach(x, y) AS (
  SELECT x, x FROM sym
  UNION
  SELECT r.x, s.y FROM reach r JOIN sym s ON s.x = r.y),
rewrite AS (SELECT x AS old_id, min(y) AS new_id FROM reach GROUP BY x)"""
