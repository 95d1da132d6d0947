"""Sources: texts and rows of every kind turned into records, enrichment, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave import schema as S
from kinweave.operators import enrich as E
from kinweave.sources import files as IO, records as R
from workload.base import STD, query, rec_records, spread, table

# ------------------------------------------------------------ detection ----

_NAMES = """names AS (
  SELECT 'p' || page_id AS id, url || ['', '.csv', '.JSON', '/notes.txt', '.pdf', '.txt', '/my_notes', '.docx'][page_id % 8 + 1] AS name FROM pages
  UNION ALL SELECT 'd' || doc_id, source || ['.csv', '.json', '-Notes.md', '.doc', '.txt', '.md'][doc_id % 6 + 1] FROM documents)"""


@query(
    "detect_source",
    f"""WITH {_NAMES}, n AS (SELECT id, name, lower(name) AS l FROM names)
SELECT id, name, CASE WHEN l LIKE '%.csv' THEN 'recruiter_csv' WHEN l LIKE '%.json' THEN 'ats_json' WHEN contains(l, 'notes') THEN 'recruiter_notes'
  WHEN regexp_matches(l, '[^/]\\.(pdf|docx|doc)$') THEN 'resume_doc' WHEN l LIKE '%.txt' THEN 'resume' END AS source_kind,
  CASE WHEN regexp_matches(l, '[^/]\\.(pdf|docx|doc)$') THEN 'resume_doc' WHEN l LIKE '%.csv' THEN 'recruiter_csv' WHEN l LIKE '%.json' THEN 'ats_json'
  WHEN contains(l, 'notes') THEN 'recruiter_notes' WHEN l LIKE '%.txt' THEN 'resume' END AS in_memory_kind
FROM n""",
)
def detect_source(spark, sf):
    p = table(spark, sf, "pages").selectExpr(
        "concat('p', page_id) AS id",
        "concat(url, element_at(array('', '.csv', '.JSON', '/notes.txt', '.pdf', '.txt', '/my_notes', '.docx'), int(page_id % 8 + 1))) AS name",
    )
    d = table(spark, sf, "documents").selectExpr(
        "concat('d', doc_id) AS id",
        "concat(source, element_at(array('.csv', '.json', '-Notes.md', '.doc', '.txt', '.md'), int(doc_id % 6 + 1))) AS name",
    )
    n = F.col("name")
    return p.unionByName(d).select(
        "id", "name", IO.detect_source(n).alias("source_kind"), IO.detect_source(n, True).alias("in_memory_kind")
    )


# ------------------------------------------------------- source parsers ----


@query(
    "delimited_source",
    """SELECT coalesce(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'c' || c_custkey END,
    CASE WHEN c_custkey % 10 <> 0 THEN 'derived_mail_' || c_custkey END, 'derived_customer_' || substr(c_name, 10)) AS candidate_id,
  'Customer#' || substr(c_name, 10) AS full_name, CASE WHEN c_custkey % 10 <> 0 THEN 'mail.' || c_custkey || '@x.org' ELSE '' END AS emails,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '+1415555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS phones,
  'Town' AS city, CASE WHEN c_nationkey % 2 = 0 THEN 'DE' END AS country, c_mktsegment AS headline, (c_custkey % 50)::DOUBLE AS yoe,
  'Python|Go' AS skills, 'github:https://github.com/c' || c_custkey || '|other:https://c' || c_custkey || '.example.org/me' AS links,
  'Firm ' || c_nationkey || '/' || c_mktsegment AS experience
FROM customer""",
)
def delimited_source(spark, sf):
    """A people list with other column names."""
    c = table(spark, sf, "customer").selectExpr(
        "struct('customer' AS origin, 0L AS block, c_custkey AS pos) AS record_seq",
        "if(c_custkey % 5 = 0, ' ', concat('c', c_custkey)) AS ID",
        "c_name AS FullName", "if(c_custkey % 10 <> 0, concat(' Mail.', c_custkey, '@X.org'), '') AS work_email",
        "if(c_custkey % 3 = 0, 'none', concat('415 555 ', lpad(string(c_custkey % 10000), 4, '0'))) AS mobile",
        "concat('Town, ', if(c_nationkey % 2 = 0, 'Germany', 'Nowhere')) AS address", "c_mktsegment AS title",
        "concat('Firm ', c_nationkey) AS employer", "string(c_custkey % 50) AS yoe", "'python; go | ' AS technical_skills",
        "concat('GitHub.com/c', c_custkey) AS github_url", "concat('https://C', c_custkey, '.example.org/me/') AS website",
    ).withColumn("github_url", F.concat(F.lit("https://"), "github_url"))
    r = R.delimited_records(spread(c))
    return r.select(
        "candidate_id", "full_name", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"),
        "location.city", "location.country", "headline", F.col("years_experience").alias("yoe"),
        F.array_join("skills", "|").alias("skills"),
        F.expr("array_join(transform(links, l -> concat(l.type, ':', l.url)), '|')").alias("links"),
        F.expr("array_join(transform(experience, e -> concat(e.company, '/', e.title)), '|')").alias("experience"),
    )


@query(
    "json_source",
    """SELECT 'o' || o_custkey || '_' || (o_orderkey // 7) AS candidate_id, o_orderkey AS pos, 0.9::DOUBLE AS confidence,
  'Order ' || o_orderkey AS full_name, 'o' || o_orderkey || '@x.org' AS emails, CASE WHEN o_orderkey % 2 = 0 THEN '+4920' || lpad((o_orderkey % 1000000)::VARCHAR, 8, '1') ELSE '' END AS phones,
  o_orderpriority AS headline, (o_orderkey % 30)::DOUBLE AS yoe, 'Kafka|' || o_orderstatus || 'OO' AS skills,
  'github' AS link_types, o_orderstatus || '//' || year(o_orderdate) || '-' || lpad(month(o_orderdate)::VARCHAR, 2, '0') AS experience, 'Uni' AS school
FROM orders WHERE o_orderkey % 11 <> 5""",
)
def json_source(spark, sf):
    """People as JSON texts of several shapes; a share of the texts is broken."""
    o = table(spark, sf, "orders").selectExpr(
        "struct('orders' AS origin, 0L AS block, o_orderkey AS pos) AS record_seq",
        """concat(if(o_orderkey % 11 = 5, '{"broken": [', ''), if(o_orderkey % 3 = 0, '[', ''),
           '{"', if(o_orderkey % 2 = 0, 'candidate_id', 'id'), '":"o', o_custkey, '_', o_orderkey div 7, '","confidence":0.9,',
           if(o_orderkey % 2 = 0, concat('"full_name":"ORDER ', o_orderkey, '","emails":["O', o_orderkey, '@x.org","bad"],"phones":["+49 (0)20 ', lpad(string(o_orderkey % 1000000), 8, '1'), '"],'),
              concat('"name":" order  ', o_orderkey, '","email":"o', o_orderkey, '@X.org",')),
           '"title":"', o_orderpriority, '","years_experience":', if(o_orderkey % 4 = 0, concat('"', o_orderkey % 30, '"'), string(o_orderkey % 30)),
           ',"skills":["kafka","', o_orderstatus, 'OO","a/b"],"links":[', if(o_orderkey % 2 = 0, '"github.com/x"', '{"url":"https://github.com/x"}'),
           '],"experience":[{"company":"', o_orderstatus, '","start":"', date_format(o_orderdate, 'M/yyyy'), '"},{"location":"x"}],"education":[{"school":"Uni"}]}',
           if(o_orderkey % 3 = 0, ']', '')) AS value""",
    )
    r = R.json_records(spread(o))
    return r.select(
        "candidate_id", "record_seq.pos", F.col("confidence").cast("double").alias("confidence"), "full_name",
        F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"), "headline",
        F.col("years_experience").alias("yoe"), F.array_join("skills", "|").alias("skills"),
        F.expr("array_join(transform(links, l -> l.type), '|')").alias("link_types"),
        F.expr("array_join(transform(experience, e -> concat(coalesce(e.company, ''), '/', coalesce(e.title, ''), '/', e.start_date)), '|')").alias("experience"),
        F.expr("array_join(transform(education, e -> e.institution), '|')").alias("school"),
    )


@query(
    "events_props_json",
    """SELECT event_id, 'e' || json_extract_string(props, '$.k') AS candidate_id FROM events""",
)
def events_props_json(spark, sf):
    """The JSON column of the events read as people texts."""
    e = table(spark, sf, "events").selectExpr(
        "struct('events' AS origin, 0L AS block, event_id AS pos) AS record_seq",
        "replace(replace(props, '\"k\": ', '\"id\": \"e'), '}', '\"}') AS value",
    )
    return R.json_records(e).select(F.col("record_seq.pos").alias("event_id"), "candidate_id")


@query(
    "note_blocks",
    """WITH c AS (SELECT *, 'conv_' || conv_id || '_' || turn AS id FROM conversations)
SELECT id AS candidate_id, length(trim('CANDIDATE_ID: ' || id || chr(10) || text, ' \t\r\n')) AS n_chars FROM c
UNION ALL SELECT id || '_again', length(trim('see below' || chr(10) || 'CANDIDATE_ID: ' || id || '_again ' || role, ' \t\r\n')) FROM c""",
)
def note_blocks(spark, sf):
    """Every turn as a note text of three blocks, the middle one without an id."""
    value = """concat('CANDIDATE_ID: conv_', conv_id, '_', turn, '\\n', text, '\\n ---  \\n', text, '\\n\\n---\\nsee below\\nCANDIDATE_ID: conv_',
               conv_id, '_', turn, '_again ', role, '\\n') AS value"""
    notes = table(spark, sf, "conversations").selectExpr(
        "struct('conversations' AS origin, conv_id AS block, turn AS pos) AS record_seq", value
    )
    return R.note_blocks(notes).select("candidate_id", F.length("block").cast("long").alias("n_chars"))


@query(
    "notes_source",
    """SELECT 'cand_' || c_custkey AS candidate_id, 'n' || c_custkey || '@x.org' AS emails,
  '+1415555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phones, c_mktsegment || ' lead at Acme' AS headline,
  (c_custkey % 40)::DOUBLE AS yoe, CASE WHEN c_custkey % 2 = 0 THEN 'Python|Go|Node.js' ELSE 'Java|Machine Learning' END AS skills,
  'https://github.com/n' || c_custkey AS links FROM customer""",
)
def notes_source(spark, sf):
    """Two note blocks per text; all facts mined from prose."""
    c = table(spark, sf, "customer").selectExpr(
        "struct('notes' AS origin, 0L AS block, c_custkey * 10 AS pos) AS record_seq",
        """concat('preamble without id\\n---\\n\\nCANDIDATE_ID: cand_', c_custkey, '\\nMet today. Currently a ', c_mktsegment, ' lead at Acme. ~', c_custkey % 40,
           ' yrs. ', if(c_custkey % 2 = 0, 'Strong node.js, PYTHON and Go', 'Machine  learning? machine learning, java'), '. Mail N', c_custkey, '@x.org, (415) 555-',
           lpad(string(c_custkey % 10000), 4, '0'), ' or https://github.com/n', c_custkey, ')\\n') AS value""",
    )
    r = R.note_records(spread(c))
    return r.select(
        "candidate_id", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"), "headline",
        F.col("years_experience").alias("yoe"), F.array_join("skills", "|").alias("skills"),
        F.expr("array_join(transform(links, l -> l.url), '|')").alias("links"),
    )


@query(
    "labelled_source",
    """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'r' || c_custkey WHEN c_custkey % 3 = 1 THEN 'derived_r_' || c_custkey END AS candidate_id, c_custkey AS k,
  'Jane Doe' AS full_name, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'r-' || c_custkey || '@x.org' END AS emails, c_mktsegment AS headline, (c_custkey % 45)::DOUBLE AS yoe,
  'Python|Rust' AS skills, 'https://github.com/r' || c_custkey AS links,
  'Acme/' || c_mktsegment || '/2021-01/present/SF' AS experience, 'MIT/BS/2018-01' AS education FROM customer""",
)
def labelled_source(spark, sf):
    """Labelled texts with three list sections, one of them with an inline value that must not open a section."""
    c = table(spark, sf, "customer").selectExpr(
        "struct('labelled' AS origin, 0L AS block, c_custkey AS pos) AS record_seq",
        """concat(if(c_custkey % 3 = 0, concat('CANDIDATE_ID: r', c_custkey, '\\n'), ''), 'NAME: JANE  doe\\r\\n',
           if(c_custkey % 3 = 2, '', concat('EMAIL: R-', c_custkey, '@x.org\\n')), 'HEADLINE: first\\nHEADLINE: ', c_mktsegment,
           '\\nYEARS: ', c_custkey % 45, '\\nSKILLS: inline, ignored\\n- lost\\nLINKS: a@b.co, photo.png, https://github.com/r', c_custkey,
           '\\n\\nSKILLS:\\n- python\\n -rust\\nnot a bullet\\n\\nEXPERIENCE:\\n- Acme | ', c_mktsegment, ' | Jan 2021 – Present | SF\\n- too | short\\n\\nEDUCATION:\\n- MIT | BS | 2018\\n') AS value""",
    )
    r = R.labelled_records(spread(c))
    return r.select(
        "candidate_id", F.col("record_seq.pos").alias("k"), "full_name", F.array_join("emails", "|").alias("emails"), "headline",
        F.col("years_experience").alias("yoe"), F.array_join("skills", "|").alias("skills"),
        F.expr("array_join(transform(links, l -> l.url), '|')").alias("links"),
        F.expr("array_join(transform(experience, e -> concat_ws('/', e.company, e.title, e.start_date, e.end_date, e.location)), '|')").alias("experience"),
        F.expr("array_join(transform(education, e -> concat_ws('/', e.institution, e.degree, e.graduation_date)), '|')").alias("education"),
    )


@query(
    "documents_records",
    """
WITH m AS (
  SELECT doc_id, text, source || '_' || doc_id || '.pdf' AS file,
    list_transform(list_filter(list_distinct(regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b')),
      lambda e: regexp_matches(e, '^[A-Za-z0-9_]')), lambda e: lower(e)) AS emails,
    list_transform(string_split_regex(text, '\\r?\\n')[1:10], lambda s: trim(s, ' \t\r\n')) AS head FROM documents)
SELECT doc_id, coalesce(regexp_extract(text, 'CANDIDATE_ID:\\s*(\\S+)', 1, 's')  , '') AS marker,
  CASE WHEN len(emails) > 0 THEN 'derived_' || trim(regexp_replace(lower(split_part(emails[1], '@', 1)), '[^a-z0-9]+', '_', 'g'), '_')
       ELSE 'uploaded_' || source_slug END AS candidate_id,
  array_to_string(emails, '|') AS emails,
  list_filter(head, lambda s: regexp_matches(s, '^[A-Z][a-zA-Z''.-]*(\\s+[A-Z][a-zA-Z''.-]*){1,4}$'))[1] IS NOT NULL AS has_name,
  try_cast(regexp_extract(text, '(?i)(\\d+(?:\\.\\d+)?)\\s*\\+?\\s*(?:years|yrs)\\b', 1) AS DOUBLE) AS yoe
FROM (SELECT *, trim(regexp_replace(lower(regexp_replace(file, '\\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '_') AS source_slug FROM m)
""",
)
def documents_records(spark, sf):
    """Whole documents as free-text people files."""
    d = table(spark, sf, "documents").select(
        R.seq("documents", 0, F.col("doc_id")).alias("record_seq"),
        F.col("text").alias("value"), F.expr("concat(source, '_', doc_id, '.pdf')").alias("file_name"),
    )
    r = R.free_text_records(spread(d))
    return r.select(
        F.col("record_seq.pos").alias("doc_id"), F.lit("").alias("marker"), "candidate_id",
        F.array_join("emails", "|").alias("emails"), F.col("full_name").isNotNull().alias("has_name"),
        F.col("years_experience").alias("yoe"),
    )


@query(
    "free_text_fields",
    """SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'ft' || c_custkey WHEN 1 THEN 'derived_ada_' || c_custkey ELSE 'uploaded_cv_' || c_custkey END AS candidate_id,
  0.7::DOUBLE AS confidence, 'Ada Byron' AS full_name, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'ada.' || c_custkey || '@x.org' END AS emails,
  '+1415555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phones, 'Springfield/IL/US' AS place, 'Lead ' || c_mktsegment || ' Engineer' AS headline,
  (c_custkey % 30 + 0.5)::DOUBLE AS yoe, CASE WHEN c_custkey % 2 = 0 THEN 'Go|Kafka|Python' ELSE 'Docker|SQL' END AS skills,
  CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'other:https://x.org|' END || 'github:https://github.com/a' || c_custkey || '|other:https://b' || c_custkey || '.example.org/x' AS links,
  'Acme/Engineer/2020-01/present/Ulm|Firm ' || c_nationkey || '/Analyst/2015-03/2019-01/-' AS experience, 'TU Ulm/MSc/2010-01|MIT/BS/-' AS education
FROM customer""",
)
def free_text_fields(spark, sf):
    """Free text with every field: marker, mail or file name as id, name, place, role, phone, links, skills, history of both forms."""
    text = """concat('Ada Byron\r\n', 'Lead ', c_mktsegment, ' Engineer\n', 'Springfield, IL, US\n', IF(c_custkey % 3 = 2, '', concat('Ada.', c_custkey, '@X.org\n')),
        'Tel (415) 555-', lpad(string(c_custkey % 10000), 4, '0'), ' and https://github.com/a', c_custkey, '\nwww: b', c_custkey, '.example.org/x\nabout ', c_custkey % 30, '.5+ years\n',
        IF(c_custkey % 3 = 0, concat('CANDIDATE_ID: ft', c_custkey, '\n'), ''), IF(c_custkey % 2 = 0, 'Technical Skills:\ngolang, kafka; python\n', 'worked with SQL and docker\n'),
        'Work Experience\nAcme | Engineer | Jan 2020 - Present | Ulm\nno row here\nAnalyst at Firm ', c_nationkey, ' (Mar 2015 - 2019)\n\nEDUCATION\nTU Ulm | MSc | 2010\nMIT, BS\n') AS value"""
    d = table(spark, sf, "customer").selectExpr(
        "c_custkey AS k", "struct('free' AS origin, 0L AS block, c_custkey AS pos, 0L AS item) AS record_seq", text, "concat('CV ', c_custkey, '.PDF') AS file_name")
    r = R.free_text_records(spread(d))
    dash = lambda *cells: ", '/', ".join(f"coalesce({c}, '-')" for c in cells)
    return r.select(
        F.col("record_seq.pos").alias("k"), "candidate_id", F.col("confidence").cast("double").alias("confidence"), "full_name",
        F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"),
        F.concat_ws("/", "location.city", "location.region", "location.country").alias("place"), "headline", F.col("years_experience").alias("yoe"),
        F.array_join("skills", "|").alias("skills"), F.expr("array_join(transform(links, l -> concat(l.type, ':', l.url)), '|')").alias("links"),
        F.expr(f"array_join(transform(experience, e -> concat({dash('e.company', 'e.title', 'e.start_date', 'e.end_date', 'e.location')})), '|')").alias("experience"),
        F.expr(f"array_join(transform(education, e -> concat({dash('e.institution', 'e.degree', 'e.graduation_date')})), '|')").alias("education"),
    )


@query(
    "assemble_records",
    f"""WITH {STD}
SELECT k, source, candidate_id, confidence::DOUBLE AS confidence, full_name, coalesce(email, '') AS emails, coalesce(phone, '') AS phones,
  city, country, headline, yoe::DOUBLE AS yoe FROM std""",
)
def assemble_records(spark, sf):
    return rec_records(spark, sf).select(
        F.col("record_seq.pos").alias("k"), "source", "candidate_id", F.col("confidence").cast("double").alias("confidence"),
        "full_name", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"),
        "location.city", "location.country", "headline", F.col("years_experience").alias("yoe"),
    )


@query(
    "union_sources",
    """SELECT 'customer' AS origin, c_custkey AS pos, 'recruiter_csv' AS source FROM customer
UNION ALL SELECT 'supplier', s_suppkey, 'recruiter_csv' FROM supplier
UNION ALL SELECT 'documents', doc_id, 'resume' FROM documents
UNION ALL SELECT 'documents', doc_id, 'resume' FROM documents""",
)
def union_sources(spark, sf):
    """Bag union: the documents come twice and stay twice."""
    c = table(spark, sf, "customer").select(R.seq("customer", 0, F.col("c_custkey")).alias("record_seq"), F.col("c_name").alias("name"))
    s = table(spark, sf, "supplier").select(R.seq("supplier", 0, F.col("s_suppkey")).alias("record_seq"), F.col("s_name").alias("Candidate"))
    d = table(spark, sf, "documents").select(
        R.seq("documents", 0, F.col("doc_id")).alias("record_seq"), F.lit("resume").alias("source")
    )
    u = IO.union_sources([R.delimited_records(c), R.delimited_records(s), d, d])
    return u.select("record_seq.origin", "record_seq.pos", "source")


@query(
    "ingest_report",
    """WITH files AS (SELECT DISTINCT source || '.csv' AS file FROM documents UNION ALL SELECT 'empty.json' UNION ALL SELECT 'photo.png'),
n AS (SELECT source || '.csv' AS file, count(*) AS n FROM documents GROUP BY source)
SELECT file, coalesce(n, 0) AS records, CASE WHEN n > 0 THEN 'recruiter_csv' END AS source,
  CASE WHEN n IS NULL THEN CASE WHEN file LIKE '%.png' THEN 'ignored' ELSE 'no records' END END AS problem
FROM files LEFT JOIN n USING (file)""",
)
def ingest_report(spark, sf):
    """Documents counted by the file they came from, with one empty and one ignored file."""
    d = table(spark, sf, "documents").select(
        R.seq(F.concat("source", F.lit(".csv")), 0, F.col("doc_id")).alias("record_seq"), F.lit("recruiter_csv").alias("source")
    )
    names = d.select(F.col("record_seq.origin").alias("file")).distinct().unionByName(
        spark.createDataFrame([("empty.json",), ("photo.png",)], "file string")
    )
    files = names.select("file", IO.detect_source(F.col("file")).alias("source_kind"))
    return IO.ingest_report(files, d).drop("source_kind")


# ----------------------------------------------------------- enrichment ----


def _people(spark, sf):
    """Customers with one account link each: four in five on GitHub, the rest on LinkedIn."""
    c = table(spark, sf, "customer").selectExpr(
        "struct('customer' AS origin, 0L AS block, c_custkey AS pos) AS record_seq", "'recruiter_csv' AS source",
        "concat('c', c_custkey) AS candidate_id",
        """array(struct(if(c_custkey % 5 = 0, concat('https://linkedin.com/in/jane-doe-', c_custkey, 'x'),
           concat('https://github.com/', if(c_custkey % 2 = 0, 'U', 'u'), c_custkey % 150)) AS url, '' AS type)) AS links""",
    )
    return S.conform(c)


def _snapshots(spark, sf):
    """Accounts of the event users; every 11th has failed."""
    e = table(spark, sf, "events")
    accounts = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "'github' AS provider", "concat('u', user_id) AS handle", "if(user_id % 11 = 0, 500, 200) AS status",
        "concat('user  ', user_id) AS name", "if(user_id % 3 = 0, concat(' Bio \\n of ', user_id), null) AS bio", "concat('@Firm', user_id % 7) AS company",
        "'Berlin, Germany' AS location", "if(user_id % 4 = 0, concat('U', user_id, '@x.org'), null) AS email", "'blog.example.org/' AS blog",
        "if(user_id % 6 = 0, 'tw', null) AS twitter", "n AS public_repos", "user_id AS followers",
    )
    repos = e.selectExpr("concat('u', user_id) AS handle", "event_type AS language", "event_id % 9 = 0 AS fork")
    return accounts, repos


_ENRICH = """
acc AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY user_id),
cnt AS (SELECT user_id AS u, event_type, count(*) AS n FROM events WHERE event_id % 9 <> 0 GROUP BY user_id, event_type),
lang AS (SELECT u, string_agg(upper(event_type[1]) || event_type[2:], '|' ORDER BY n DESC, event_type) AS langs FROM cnt GROUP BY u),
looked AS (
  SELECT u, u IN (SELECT u FROM acc) AND u % 11 <> 0 AS ok FROM (SELECT unnest(range(150)) AS u)),
gh AS (SELECT c_custkey AS k, 'c' || c_custkey AS candidate_id, c_custkey % 150 AS u, CASE WHEN c_custkey % 2 = 0 THEN 'U' ELSE 'u' END || c_custkey % 150 AS asked
  FROM customer WHERE c_custkey % 5 <> 0)"""


@query(
    "enrich",
    f"""WITH {_ENRICH}
SELECT candidate_id, 'github' AS source, CASE WHEN ok THEN 0.75 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN ok THEN 'User ' || u END AS full_name,
  CASE WHEN ok AND u % 4 = 0 THEN 'u' || u || '@x.org' ELSE '' END AS emails,
  CASE WHEN ok THEN 'DE' END AS country, CASE WHEN ok THEN CASE WHEN u % 3 = 0 THEN 'Bio of ' || u ELSE 'Working at @Firm' || u % 7 END END AS headline,
  CASE WHEN ok THEN coalesce(langs, '') ELSE '' END AS skills,
  'https://github.com/' || asked || CASE WHEN ok THEN '|https://blog.example.org' || CASE WHEN u % 6 = 0 THEN '|https://twitter.com/tw' ELSE '' END ELSE '' END AS links,
  CASE WHEN ok THEN 'Firm' || u % 7 ELSE '' END AS company,
  CASE WHEN NOT ok THEN 'GitHub /users/' || asked || ' → ' || CASE WHEN u IN (SELECT u FROM acc) THEN '500' ELSE '404' END END AS error
FROM gh JOIN looked USING (u) LEFT JOIN lang USING (u)
UNION ALL
SELECT 'c' || c_custkey, 'linkedin', 0.35, 'Jane Doe', '', NULL, NULL, '', 'https://linkedin.com/in/jane-doe-' || c_custkey || 'x', '', NULL
FROM customer WHERE c_custkey % 5 = 0""",
)
def enrich(spark, sf):
    return E.enrich(_people(spark, sf), *_snapshots(spark, sf)).select(
        "candidate_id", "source", F.col("confidence").cast("double").alias("confidence"), "full_name",
        F.coalesce(F.array_join("emails", "|"), F.lit("")).alias("emails"), "location.country", "headline",
        F.coalesce(F.array_join("skills", "|"), F.lit("")).alias("skills"),
        F.expr("array_join(transform(links, l -> l.url), '|')").alias("links"),
        F.expr("coalesce(array_join(transform(experience, e -> e.company), '|'), '')").alias("company"), "error",
    )


@query(
    "extra_links",
    f"""WITH {_ENRICH}
SELECT CASE WHEN ok AND u % 4 = 0 THEN 'derived_u' || u ELSE 'derived_gh_u' || u END AS candidate_id, 'github' AS source, count(*) AS records
FROM gh JOIN looked USING (u) GROUP BY 1, 2
UNION ALL
SELECT 'derived_li_jane_doe_' || c_custkey || 'x', 'linkedin', 1 FROM customer WHERE c_custkey % 5 = 0""",
)
def extra_links(spark, sf):
    """The same links without candidates: ids come from the accounts."""
    links = _people(spark, sf).select(F.col("links")[0]["url"].alias("url"))
    out = E.extra_link_records(links, *_snapshots(spark, sf))
    return out.groupBy("candidate_id", "source").agg(F.count(F.lit(1)).alias("records"))


@query(
    "enrich_stats",
    f"""WITH {_ENRICH}
SELECT 'github' AS source, count(*) AS records, count(*) FILTER (NOT ok) AS failed FROM gh JOIN looked USING (u)
UNION ALL SELECT 'linkedin', count(*), 0 FROM customer WHERE c_custkey % 5 = 0""",
)
def enrich_stats(spark, sf):
    return E.enrichment_counters(E.enrich(_people(spark, sf), *_snapshots(spark, sf)))


@query(
    "enrich_errors",
    f"""WITH {_ENRICH}
SELECT 'GitHub /users/' || asked || ' → ' || CASE WHEN u IN (SELECT u FROM acc) THEN '500' ELSE '404' END AS error, count(*) AS records
FROM gh JOIN looked USING (u) WHERE NOT ok GROUP BY 1""",
)
def enrich_errors(spark, sf):
    return E.enrichment_errors(E.enrich(_people(spark, sf), *_snapshots(spark, sf)))
