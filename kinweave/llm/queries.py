"""Registered queries of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm import (
    chat_format, decontaminate, divergence, html_extract, license_scan, line_quality, ngram_join, packing, quality_rules, secret_scan,
    url_filter, word_table, zone_clusters,
)
from kinweave.operators.skew import cut

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


@query("op2_quality_rules")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    counts = cut(quality_rules.measure(table(spark, sf, "documents")))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return quality_rules.judge(counts).withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~failed & F.col("good")).alias("kept"), "posterior",
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file; the vocabulary itself is no part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer_path(), capacity=2048, end_id=0)


@query("op5_ngram_jaccard")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf, "documents"), n=4, threshold="0.85")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


@query("op7_line_quality")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = line_quality.fit(docs, table(spark, sf, "labels").where(~held_out()))
    return line_quality.score(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_lines", "n_bad_lines",
    )


@query("op8_secret_scan")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


@query("op9_decontaminate")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


BASE_RULES = tuple(
    url_filter.host_rule(verdict, name)
    for verdict, name in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
)
#: Words that mark hosts of unwanted pages.
WORD_RULES = tuple(url_filter.word_rule("block", w) for w in (
    "spam", "casino", "pills", "bets", "ads", "porn", "xxx", "viagra", "poker", "loans", "escort", "replica"))


@query("op6_url_filter", rf"""
WITH base(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
split AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hit AS (
  SELECT DISTINCT ON (host, path) host, path, rule, verdict
  FROM (SELECT DISTINCT host, path FROM split) s
  JOIN base ON ('.' || host) LIKE '%.' || string_split(rule, '/')[1] AND starts_with(path, substr(rule, strpos(rule, '/')))
  ORDER BY host, path, length(rule) DESC)
SELECT page_id, s.host, s.path, h.rule,
       coalesce(h.verdict, CASE WHEN regexp_matches(s.host, '(^|[^a-z0-9])({"|".join(r.name for r in WORD_RULES)})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN hit h USING (host, path)""")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf, "pages").select("page_id", "url"), BASE_RULES + WORD_RULES)
    return judged.select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.when(F.col("_rule").isin(*[r.name for r in BASE_RULES]), F.col("_rule")).alias("rule"), F.col("_verdict").alias("verdict"),
    )


def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, raw): conversations as JSON texts in the layouts that corpora come in.

    Two turns of user and assistant become a prompt or question record, system, user and
    assistant an instruction record, all others a list in one of two dialects.
    """
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    talks = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")) \
        .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles, even = F.array_join("t.role", ","), F.coalesce(F.col("conv_id") % 2 == 0, F.lit(True))
    said = lambda i: F.element_at("t.text", i)
    dialect = F.transform("t", lambda t: F.struct(
        F.when(t.role == "user", "human").when(t.role == "assistant", "gpt").otherwise(t.role).alias("from"), t.text.alias("value")))
    # In the dialect the names human and gpt stand for others and must not occur themselves.
    plain = ~F.exists("t", lambda t: t.role.isin("human", "gpt"))
    raw = (
        F.when((roles == "user,assistant") & even, F.to_json(F.struct(said(1).alias("prompt"), said(2).alias("completion"))))
        .when(roles == "user,assistant", F.to_json(F.struct(said(1).alias("question"), said(2).alias("answer"))))
        .when(roles == "system,user,assistant", F.to_json(F.struct(said(1).alias("instruction"), said(2).alias("input"), said(3).alias("output"))))
        .when(even & plain, F.to_json(F.struct(dialect.alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda t: F.struct(t.role.alias("role"), t.text.alias("content"))).alias("messages"))))
    )
    return talks.select("conv_id", raw.alias("raw"))


@query("op10_chat_format", r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (
  SELECT *, replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t') AS body,
         replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS who FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(who) + length(body) + 14)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    formatted = chat_format.canonical(raw_records(spark, sf)).select("conv_id", chat_format.render(F.col("turns")).alias("out"))
    back = formatted.select(
        "conv_id", F.col("out.text").alias("text"), chat_format.read(F.col("out.text")).alias("turns"),
        chat_format.under_mask(F.col("out.text"), F.col("out.mask")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


def repository_files(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents as files of a source tree.

    Directories are source, language and two levels of runs of ids. A document that opens
    or ends with a licence line is a LICENSE file, of its own directory or the one above.
    """
    line = F.concat_ws("\n", F.substring_index("text", "\n", 1), F.substring_index("text", "\n", -1))
    opens = F.coalesce(F.regexp_like(line, F.lit("(?i)licen[cs]ed?\\b")), F.lit(False))
    run = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    above = F.concat_ws("/", "source", "lang", run(5000))
    path = F.when(opens & (F.col("doc_id") % 2 == 0), F.concat(above, F.lit("/LICENSE-"), "doc_id")) \
        .when(opens, F.concat(above, F.lit("/"), run(1000), F.lit("/LICENSE-"), "doc_id")) \
        .otherwise(F.concat(above, F.lit("/"), run(1000), F.lit("/"), "doc_id", F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


_QUOTED = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in license_scan.TEMPLATES)
_TERMS = "regexp_extract_all(lower(text), '[a-z0-9]+(?:[.][a-z0-9]+)*')"


@query("op1_license_scan", rf"""
WITH named AS (
  SELECT doc_id, text, source || '/' || lang || '/' || doc_id // 5000 AS above,
         coalesce(regexp_matches(string_split(text, chr(10))[1] || chr(10) || string_split(text, chr(10))[-1], '(?i)licen[cs]ed?\b'), false) AS opens
  FROM documents),
files AS (
  SELECT doc_id, text, opens, above || CASE WHEN opens AND doc_id % 2 = 0 THEN '/LICENSE-' || doc_id
    WHEN opens THEN '/' || doc_id // 1000 || '/LICENSE-' || doc_id ELSE '/' || doc_id // 1000 || '/' || doc_id || '.txt' END AS path FROM named),
said AS (
  SELECT path, line, opens AS is_file, text FROM (
    SELECT path, opens, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files)
  WHERE regexp_matches(text, '(?i)({"|".join(license_scan.ANCHORS)})')
  UNION ALL SELECT path, 0, true, text FROM files WHERE opens AND text <> ''),
counted AS (SELECT path, line, is_file, term, count(*) AS tf FROM (SELECT path, line, is_file, unnest({_TERMS}) AS term FROM said) GROUP BY ALL),
n AS (SELECT count(*) AS total FROM (SELECT DISTINCT path, line FROM said)),
df AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
weighed AS (SELECT c.*, tf * (1 + ln((1 + total) / (1 + df))) AS w FROM counted c JOIN df USING (term), n),
template(license, text) AS (VALUES {_QUOTED}),
parts AS (SELECT license, text, term, count(*) AS tf FROM (SELECT license, text, unnest({_TERMS}) AS term FROM template) GROUP BY ALL),
rated AS (SELECT license, text, term, tf * (1 + ln((1 + total) / (1 + coalesce(df, 0)))) AS w FROM parts LEFT JOIN df USING (term), n),
known AS (SELECT license, text, term, w / sqrt(sum(w * w) OVER (PARTITION BY license, text)) AS v FROM rated),
dots AS (SELECT path, line, is_file, license, k.text AS t, sum(w * v) AS dot FROM weighed JOIN known k USING (term) GROUP BY ALL),
best AS (SELECT path, line, is_file, round(dot, 9) AS dot, license FROM dots
         QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY round(dot, 9) DESC, license) = 1),
scored AS (SELECT path, line, is_file, license, dot / (SELECT sqrt(sum(w * w)) FROM weighed x WHERE x.path = b.path AND x.line = b.line) AS cosine FROM best b),
own AS (SELECT path, license, round(cosine, 9) AS cosine, CASE WHEN is_file THEN 'file' ELSE 'statement' END AS origin FROM scored WHERE cosine >= 0.6
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(cosine, 9) DESC, line, license) = 1),
given AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS directory, license, cosine FROM own WHERE origin = 'file'
          QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY cosine DESC, path) = 1),
inherited AS (
  SELECT path, g.license, g.cosine, g.directory FROM files f JOIN given g ON starts_with(path, g.directory || '/')
  WHERE path NOT IN (SELECT path FROM own) QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(g.directory) DESC) = 1)
SELECT doc_id, path, coalesce(o.license, i.license) AS license, round(coalesce(o.cosine, i.cosine), 6) AS cosine,
       CASE WHEN o.path IS NOT NULL THEN o.origin WHEN i.path IS NOT NULL THEN 'inherited' END AS origin, i.directory AS found_in
FROM files LEFT JOIN own o USING (path) LEFT JOIN inherited i USING (path)""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    files = repository_files(table(spark, sf, "documents"))
    templates = spark.createDataFrame(list(license_scan.TEMPLATES), "license string, text string")
    said = cut(license_scan.statements(files))
    more = cut(license_scan.passages(files, said, templates))
    found = license_scan.scan(files, said, templates, more=more)
    return files.select("doc_id", "path").join(found, "path", "left").select(
        "doc_id", "path", "license", F.round("cosine", 6).alias("cosine"), "origin", "found_in")


@query("op3_html_extract")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract(table(spark, sf, "pages"))


@query("op11_word_table_bpe")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    decoded = word_table.decode(word_table.encode(table(spark, sf, "documents"), path), path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op12_source_divergence", r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
occ AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
vocabulary AS (SELECT lang, term, count(*) AS n FROM occ GROUP BY ALL HAVING count(DISTINCT r) >= 3),
counts AS (SELECT o.lang, source, term, count(*) AS n FROM occ o SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM vocabulary GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(s.total, 0) AS lang_total, coalesce(t.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes s USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) t USING (lang, source)),
rated AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 1) // (g.lang_total + g.v) AS q
  FROM groups g JOIN vocabulary k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(f.value, 0) AS value
  FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
             FROM rated x JOIN rated y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
listed AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM rated WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM listed QUALIFY part = 'pair' OR rank <= 200""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"), min_docs=3, top=200)


_ROUNDS = 10
_NEAREST = """near{0} AS MATERIALIZED (
  SELECT r, c, distance FROM (
    SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM parts v JOIN centre{0} c USING (i) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)"""
# Sums are shifted to be positive before the division, which cuts towards 0.
_MOVED = """centre{1} AS MATERIALIZED (
  SELECT c.c, c.i, CASE WHEN n IS NULL THEN c.x ELSE (s - (s % n + n) % n) // n END AS x FROM centre{0} c
  LEFT JOIN (SELECT c, i, sum(x) AS s, count(*) AS n FROM parts JOIN near{0} USING (r) GROUP BY ALL) m ON m.c = c.c AND m.i = c.i)"""


@query("op13_centroid_clustering", f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM kept QUALIFY c < 8),
centre0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN parts USING (r)),
{", ".join(_NEAREST.format(t) + ", " + _MOVED.format(t, t + 1) for t in range(_ROUNDS))},
{_NEAREST.format(_ROUNDS)},
named AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM centre{_ROUNDS} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN near{_ROUNDS} USING (r) JOIN named USING (c)""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    order = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = zone_clusters.cluster(table(spark, sf, "embeddings"), order, k=8, rounds=_ROUNDS, dim=64, scale=1024)
    said = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.withColumn("centroid_sha256", F.sha2(said, 256)).drop("centroid")
