"""Folders of source files, written from the tables and read back: many headers, large arrays, problems, the whole job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.operators.skew import cut, shared_folder
from kinweave.plans import config as C
from kinweave.plans.unify import unify_folder
from kinweave.sources import files as IO, records as R
from workload.base import query, table


def folder_of(spark: SparkSession, lines: DataFrame, named: str | None = "csv") -> str:
    """Write (file, rank, line) as one text file for each ``file``, lines in the order of ``rank``."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    # With their number given, the parts are not put together again: a task makes many files one after another.
    parts = spark.sparkContext.defaultParallelism
    ordered = lines.repartition(parts, "file").sortWithinPartitions("file", "rank").select("file", "line")
    if named == "csv":
        # One column whose separator and quote never occur is written as it stands.
        ordered.write.partitionBy("file").options(sep="\u0001", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        ordered.write.partitionBy("file").text(path)
    return path


# ------------------------------------------------------------- many headers ----

_FILE = "concat('f', c_custkey % 4, '_', c_custkey div 400)"
_HEADERS = ["id,name,email", "Email,Candidate_ID,FULLNAME,phone", 'x,e-mail,"y, z",name,id', "work_email, name ,pad,id,pad"]
_ROWS = [
    "concat_ws(',', concat('c', c_custkey), c_name, mail)", "concat_ws(',', mail, concat('c', c_custkey), c_name, '')",
    "concat_ws(',', 'x', mail, concat('\"', c_mktsegment, ', \"\"z\"\"\"'), c_name, concat('c', c_custkey))", "concat_ws(',', mail, c_name, '', concat(' c', c_custkey, ' '), 'p')",
]


def _pick(values: list[str]) -> str:
    return "CASE c_custkey % 4 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query(
    "delimited_folder",
    """SELECT 'c' || c_custkey AS candidate_id, 'Customer#' || substr(c_name, 10) AS full_name, 'm' || c_custkey || '@x.org' AS emails FROM customer""",
)
def delimited_folder(spark, sf):
    """Customers in files of 100 rows; 500 headers at most: four layouts, and a column named after the file."""
    c = table(spark, sf, "customer").withColumn("mail", F.expr("concat('M', c_custkey, '@x.org')"))
    rows = c.selectExpr(f"{_FILE} AS file", "c_custkey AS rank", f"{_pick(_ROWS)} AS line")
    quoted = [f"'{h}'" for h in _HEADERS]
    heads = c.selectExpr(f"{_FILE} AS file", "-1L AS rank", f"concat({_pick(quoted)}, ',extra', c_custkey div 400 % 125) AS line").distinct()
    return IO.read_delimited(spark, folder_of(spark, rows.unionByName(heads))).select(
        "candidate_id", "full_name", F.array_join("emails", "|").alias("emails"))


# --------------------------------------------------------------- large arrays ----


@query(
    "json_array_folder",
    """SELECT 'c' || c_custkey AS candidate_id, 'Customer#' || substr(c_name, 10) AS full_name, 'A}|[B|Go' AS skills,
  'in ' || c_mktsegment || ' "} ] {" \\' AS headline, c_custkey % 3 AS roles FROM customer
UNION ALL SELECT 'end_' || f, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT c_custkey // 700 AS f FROM customer)""",
)
def json_array_folder(spark, sf):
    """Customers as JSON arrays with brackets and quotes inside texts, cut between elements while they are read."""
    c = table(spark, sf, "customer")
    person = """to_json(named_struct('id', concat('c', c_custkey), 'name', c_name, 'skills', array('a}', '[b', 'go'),
        'headline', concat('in ', c_mktsegment, ' "} ] {" \\\\'), 'experience', transform(sequence(0, 2), i -> named_struct('company', IF(i < c_custkey % 3, concat('F', i), '')))))"""
    file = "string(c_custkey div 700) AS file"
    lines = c.selectExpr(file, "c_custkey AS rank", f"concat({person}, ',') AS line").unionByName(
        c.selectExpr(file).distinct().selectExpr("file", "explode(array(-1L, 9000000000000000000L)) AS rank")
        .withColumn("line", F.expr("IF(rank < 0, ' [ ', concat('{\"id\": \"end_', file, '\"} ]'))")))
    texts = IO.array_texts(spark, folder_of(spark, lines, None), "*", any_name=True, chunk=1 << 14)
    return R.json_records(texts).select(
        "candidate_id", "full_name", F.array_join("skills", "|").alias("skills"), "headline", F.size("experience").cast("long").alias("roles"))


# ------------------------------------------------------------------ problems ----


@query(
    "ingest_problems",
    """SELECT 'f' || c_custkey // 300 AS file, row_number() OVER (PARTITION BY c_custkey // 300 ORDER BY c_custkey) AS place,
  CASE WHEN c_custkey % 10 = 0 THEN '4' ELSE '2' END || ' cells under a header of 3' AS problem,
  'c' || c_custkey || ',"' || c_mktsegment || ', Inc"' || CASE WHEN c_custkey % 10 = 0 THEN ',x,y' ELSE '' END AS text
FROM customer QUALIFY c_custkey % 10 IN (0, 1)
UNION ALL SELECT 'orders', NULL, 'no JSON', '{"id": ' || o_orderkey FROM orders WHERE o_orderkey % 11 = 5
UNION ALL SELECT 'orders', 1, 'no object', '"o' || o_orderkey || '"' FROM orders WHERE o_orderkey % 11 = 6""",
)
def ingest_problems(spark, sf):
    """Rows with other numbers of cells than their header, texts that are no JSON, and elements that are no objects."""
    c = table(spark, sf, "customer")
    file = "concat('f', c_custkey div 300) AS file"
    line = """concat('c', c_custkey, ',"', c_mktsegment, ', Inc"', CASE c_custkey % 10 WHEN 0 THEN ',x,y' WHEN 1 THEN '' ELSE ',x' END) AS line"""
    lines = c.selectExpr(file, "c_custkey AS rank", line).unionByName(c.selectExpr(file, "-1L AS rank", "'id,name,headline' AS line").distinct())
    ragged = IO.delimited_problems(spark, folder_of(spark, lines), multi_line=False)
    o = table(spark, sf, "orders").selectExpr(
        "struct('orders' AS origin, 0L AS block, o_orderkey AS pos, 0L AS item) AS record_seq",
        """CASE o_orderkey % 11 WHEN 5 THEN concat('{"id": ', o_orderkey) WHEN 6 THEN concat('[{"id": 1}, "o', o_orderkey, '"]')
           ELSE concat('{"id": ', o_orderkey, '}') END AS value""")
    return ragged.withColumn("file", F.regexp_extract("file", "file=([^/]+)", 1)).unionByName(IO.json_problems(o))


# ------------------------------------------------------------- the whole job ----

_EVERYTHING = """
accounts AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY user_id),
languages AS (SELECT user_id AS u, event_type, count(*) AS n FROM events WHERE event_id % 9 <> 0 GROUP BY ALL),
people AS (SELECT c_custkey AS k, c_custkey % 3 <> 2 AS csv, c_custkey % 2 = 0 AS js, c_custkey % 3 <> 2 AND u IS NOT NULL AND u % 11 <> 0 AS gh, c_mktsegment FROM customer LEFT JOIN accounts ON u = c_custkey),
skills AS (
  SELECT k, unnest(['Python', 'Go']) AS s FROM people WHERE csv
  UNION ALL SELECT k, unnest(['Kafka', 'Go']) FROM people WHERE js
  UNION ALL SELECT k, upper(event_type[1]) || event_type[2:] FROM people JOIN languages ON u = k WHERE gh),
counts AS (SELECT count(*) FILTER (csv) AS n_csv, count(*) FILTER (js) AS n_js, count(*) FILTER (csv AND js) AS merged, count(*) FILTER (csv OR js) AS everyone FROM people)"""


@query(
    "unify_everything",
    f"""WITH {_EVERYTHING}
SELECT 'profile' AS kind, 'c' || k AS key, concat_ws('/', 'Customer#' || lpad(k::VARCHAR, 9, '0'), 'm' || k || '@x.org',
    CASE WHEN js THEN 'Lead of ' ELSE '' END || c_mktsegment,
    (SELECT string_agg(DISTINCT s, '|' ORDER BY s) FROM skills x WHERE x.k = p.k)) AS value FROM people p WHERE csv OR js
UNION ALL SELECT 'total', 'records', (2 * n_csv + n_js)::VARCHAR FROM counts
UNION ALL SELECT 'total', 'merges', '0' FROM counts
UNION ALL SELECT 'total', 'files', (SELECT count(DISTINCT c_custkey // 500) FROM customer WHERE c_custkey % 3 <> 2)::VARCHAR
UNION ALL SELECT 'enrichment', 'github', n_csv || ' records, ' || (SELECT count(*) FROM people WHERE csv AND NOT gh) || ' failed' FROM counts
UNION ALL SELECT 'valid', 'true', everyone::VARCHAR FROM counts
UNION ALL SELECT 'account', 'c' || k, '@u' || k || ' (' || (SELECT n FROM accounts WHERE u = k) || ' repos, ' || k || ' followers)' FROM people WHERE gh""",
)
def unify_everything(spark, sf):
    """The whole job over a folder: lists of two kinds, enrichment from snapshots, a configuration, documents, statistics."""
    c = table(spark, sf, "customer")
    file = "concat('f', c_custkey div 500) AS file"
    row = """concat_ws(',', concat('c', c_custkey), c_name, concat('m', c_custkey, '@x.org'), c_mktsegment, '"python; go"', concat('https://github.com/u', c_custkey)) AS line"""
    listed = c.where("c_custkey % 3 <> 2")
    lines = listed.selectExpr(file, "c_custkey AS rank", row).unionByName(
        listed.selectExpr(file, "-1L AS rank", "'id,name,email,title,skills,github' AS line").distinct())
    path = folder_of(spark, lines)
    people = c.where("c_custkey % 2 = 0").selectExpr(
        "concat('c', c_custkey) AS candidate_id", "c_name AS full_name", "array(concat('M', c_custkey, '@x.org')) AS emails",
        "concat('Lead of ', c_mktsegment) AS headline", "array('kafka', 'golang') AS skills")
    people.write.json(f"{path}/people")
    e = table(spark, sf, "events")
    accounts = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "'github' AS provider", "concat('u', user_id) AS handle", "if(user_id % 11 = 0, 500, 200) AS status", "n AS public_repos", "user_id AS followers")
    repos = e.selectExpr("concat('u', user_id) AS handle", "event_type AS language", "event_id % 9 = 0 AS fork")
    run = unify_folder(spark, path, C.SLIM, multi_line=False, json_lines=True, profile_snapshot=accounts, repo_snapshot=repos)
    # Read twice, for the profiles and for the verdicts.
    written = cut(run.documents)
    doc = F.from_json("output", "name string, primary_email string, title string, top_skills array<string>")
    profiles = written.select(F.lit("profile").alias("kind"), F.col("candidate_id").alias("key"), doc.alias("d")).select(
        "kind", "key", F.concat_ws("/", "d.name", "d.primary_email", "d.title", F.array_join("d.top_skills", "|")).alias("value"))
    totals, enriched = run.stats["totals"], run.stats["enrichment"]
    csv_files = run.stats["files"].where("source_kind = 'recruiter_csv'").agg(F.count(F.lit(1)).cast("string").alias("value"))

    def named(kind: str, key: str, frame: DataFrame, value: str) -> DataFrame:
        return frame.select(F.lit(kind).alias("kind"), F.lit(key).alias("key"), F.col(value).cast("string").alias("value"))

    valid = written.groupBy(F.col("valid").cast("string").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    lookups = enriched.select(
        F.lit("enrichment").alias("kind"), F.col("source").alias("key"), F.format_string("%d records, %d failed", "records", "failed").alias("value"))
    summary = run.summary.where("account IS NOT NULL").select(F.lit("account").alias("kind"), F.col("candidate_id").alias("key"), F.col("account").alias("value"))
    return (
        profiles.unionByName(named("total", "records", totals, "total_records")).unionByName(named("total", "merges", totals, "merges"))
        .unionByName(named("total", "files", csv_files, "value")).unionByName(lookups)
        .unionByName(valid.select(F.lit("valid").alias("kind"), "key", "value")).unionByName(summary)
    )
