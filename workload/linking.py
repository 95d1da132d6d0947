"""Linking: signals, edges, components, rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave import schema as S
from kinweave.operators import link
from kinweave.operators.components import connected_components
from kinweave.operators.skew import cut
from kinweave.plans import report
from workload.base import EDGES, STD, query, rec_records, table


@query("signals", f"WITH RECURSIVE {STD} {EDGES} SELECT candidate_id, kind, key FROM signals")
def signals(spark, sf):
    return link.strong_signals(rec_records(spark, sf))


@query(
    "signal_overlap",
    f"""WITH {STD}
SELECT x.k, x.source AS sa, y.source AS sb, coalesce(x.phone = y.phone, false) AS same_phone, coalesce(x.email = y.email, false) AS same_email
FROM std x JOIN std y ON x.k = y.k AND x.block < y.block""",
)
def signal_overlap(spark, sf):
    """Do two records of a customer (four at most) share a phone or a mail address?"""
    r = rec_records(spark, sf).select(
        F.col("record_seq.pos").alias("k"), F.col("record_seq.block").alias("o"), "source", "phones", "emails"
    )
    x, y = r.alias("x"), r.alias("y")
    return x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.o") < F.col("y.o"))).select(
        F.col("x.k").alias("k"), F.col("x.source").alias("sa"), F.col("y.source").alias("sb"),
        link.signal_overlap(F.col("x.phones"), F.col("y.phones")).alias("same_phone"),
        link.signal_overlap(F.col("x.emails"), F.col("y.emails")).alias("same_email"),
    )


@query("link_strong", f"WITH RECURSIVE {STD} {EDGES} SELECT a, b FROM strong")
def link_strong(spark, sf):
    return link.strong_edges(rec_records(spark, sf))


@query("link_weak", f"WITH RECURSIVE {STD} {EDGES} SELECT a, b FROM weak")
def link_weak(spark, sf):
    return link.weak_edges(rec_records(spark, sf))


@query(
    "resolve_hot_phones",
    """SELECT 'c' || c_custkey AS old_id, min('c' || c_custkey) OVER (PARTITION BY c_nationkey) AS new_id
FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey) > 1""",
)
def resolve_hot_phones(spark, sf):
    """All customers of a nation share one phone, so every key is far above the share that makes it heavy."""
    people = table(spark, sf, "customer").selectExpr(
        "concat('c', c_custkey) AS candidate_id", "array(concat('+14155550', lpad(c_nationkey, 3, '0'))) AS phones")
    return link.resolve(S.conform(people)).select("old_id", "new_id")


# Long names: the words of all of a customer's part, segment, nation and numbers.
_LONG = """
people AS (
  SELECT 'c' || c_custkey AS id, 'City ' || c_custkey // 6 % 40 AS city,
         'item ' || p_name || ' of ' || p_brand || ' ' || p_type || ' for ' || c_mktsegment || ' in ' || n_name ||
         ' size' || p_size % 3 || CASE WHEN c_custkey % 3 = 0 THEN ' extra' ELSE '' END ||
         CASE WHEN c_custkey % 2 = 0 THEN ' long delivery note with seal' ELSE '' END AS name
  FROM customer JOIN nation ON n_nationkey = c_custkey // 6 % 25 JOIN part ON p_partkey = c_custkey // 6 + 1),
sets AS (SELECT id, lower(city) AS city, list_distinct(string_split(lower(name), ' ')) AS tokens FROM people)"""


def _long_people(spark, sf):
    k = F.col("c_custkey")
    name = F.concat(
        F.lit("item "), "p_name", F.lit(" of "), "p_brand", F.lit(" "), "p_type", F.lit(" for "), "c_mktsegment",
        F.lit(" in "), "n_name", F.lit(" size"), (F.col("p_size") % 3).cast("string"),
        F.when(k % 3 == 0, " extra").otherwise(""),
        F.when(k % 2 == 0, " long delivery note with seal").otherwise(""),
    )
    none = F.lit(None).cast("string")
    group = F.floor(k / 6)  # six customers share a part, a nation and a city, so distinct names grow with the tables
    c, n, p = (table(spark, sf, t) for t in ("customer", "nation", "part"))
    return (
        c.join(n, F.col("n_nationkey") == group % 25)
        .join(p, F.col("p_partkey") == group + 1)
        .select(
            F.concat(F.lit("c"), k.cast("string")).alias("candidate_id"),
            name.alias("full_name"),
            F.struct(
                F.concat(F.lit("City "), (group % 40).cast("string")).alias("city"), none.alias("region"),
                none.alias("country"), none.alias("raw"),
            ).alias("location"),
        )
    )


@query(
    "link_weak_long_names",
    f"""
WITH RECURSIVE {_LONG},
sym AS (
  SELECT x.id AS a, y.id AS b FROM sets x JOIN sets y ON x.city = y.city
  WHERE len(list_intersect(x.tokens, y.tokens)) * 20 >= 17 * (len(x.tokens) + len(y.tokens) - len(list_intersect(x.tokens, y.tokens)))),
reach(x, y) AS (SELECT a, a FROM sym UNION SELECT r.x, s.b FROM reach r JOIN sym s ON s.a = r.y)
SELECT x AS id, min(y) AS root FROM reach GROUP BY x HAVING count(*) > 1
""",
)
def link_weak_long_names(spark, sf):
    """Clusters of similar long names in the same city (SQL compares all pairs)."""
    return connected_components(link.weak_edges(_long_people(spark, sf)))


# Names of 20 to 40 words: six customers share a list of words, of which each but one has some of its own;
# two neighbouring lists overlap and lie in one city.
_WORDS = "20 + c_custkey // 6 % 21"
_LONGER = f"""
people AS (
  SELECT 'c' || c_custkey AS id, 'city ' || c_custkey // 12 % 40 AS city,
         list_transform(range(0, {_WORDS}), lambda i: CASE WHEN c_custkey % 6 > 0 AND (i * 7 + c_custkey) % 19 = 0
           THEN 'own' || c_custkey || '_' || i ELSE 'w' || (c_custkey // 6 * 3 + i) % 997 END) AS tokens
  FROM customer)"""


def _longer_people(spark, sf):
    name = f"""array_join(transform(sequence(0, {_WORDS.replace('//', 'div')} - 1), i -> IF(c_custkey % 6 > 0 AND (i * 7 + c_custkey) % 19 = 0,
        concat('own', c_custkey, '_', i), concat('W', (c_custkey div 6 * 3 + i) % 997))), ' ')"""
    none = "cast(NULL AS string)"
    return table(spark, sf, "customer").selectExpr(
        "concat('c', c_custkey) AS candidate_id", f"{name} AS full_name",
        f"struct(concat('City ', c_custkey div 12 % 40) AS city, {none} AS region, {none} AS country, {none} AS raw) AS location")


@query(
    "link_weak_names_of_40",
    f"""
WITH RECURSIVE {_LONGER},
sym AS (
  SELECT x.id AS a, y.id AS b FROM people x JOIN people y ON x.city = y.city
  WHERE len(list_intersect(x.tokens, y.tokens)) * 20 >= 17 * (len(x.tokens) + len(y.tokens) - len(list_intersect(x.tokens, y.tokens)))),
reach(x, y) AS (SELECT a, a FROM sym UNION SELECT r.x, s.b FROM reach r JOIN sym s ON s.a = r.y)
SELECT x AS id, min(y) AS root FROM reach GROUP BY x HAVING count(*) > 1
""",
)
def link_weak_names_of_40(spark, sf):
    """Clusters of similar names of 20 to 40 words in the same city (SQL compares all pairs)."""
    return connected_components(link.weak_edges(_longer_people(spark, sf)))


@query(
    "name_jaccard",
    """
WITH n AS (SELECT p_partkey AS k, p_name || '  Unit ' || p_brand || ' ' || p_type || ' made in lot ' || p_size % 4 AS name FROM part),
t AS (SELECT k, name, list_distinct(string_split(regexp_replace(lower(name), '\\s+', ' ', 'g'), ' ')) AS w FROM n)
SELECT x.k, round(len(list_intersect(x.w, y.w))::DOUBLE / len(list_distinct(x.w || y.w)), 6) AS similarity,
  len(list_intersect(x.w, y.w)) * 20 >= 17 * len(list_distinct(x.w || y.w)) AS name_match
FROM t x JOIN t y ON y.k = x.k + 64
""",
)
def name_jaccard(spark, sf):
    """Pairwise predicate over given pairs: each part with the one 64 keys on."""
    n = table(spark, sf, "part").selectExpr(
        "p_partkey AS k", "concat(p_name, '  Unit ', p_brand, ' ', p_type, ' made in lot ', p_size % 4) AS name"
    )
    x, y = n.select("k", F.col("name").alias("a")), n.select((F.col("k") - 64).alias("k"), F.col("name").alias("b"))
    tokens = [link.name_tokens(F.col(c)) for c in ("a", "b")]
    return x.join(y, "k").select(
        "k", F.round(link.token_similarity(*tokens), 6).alias("similarity"),
        link.name_match(F.col("a"), F.col("b")).alias("name_match"),
    )


@query(
    "place_match",
    f"""WITH {STD}
SELECT x.k, x.source AS sa, y.source AS sb,
  coalesce(lower(x.city) = lower(y.city), false) OR coalesce(x.country = y.country, false) AS place_match
FROM std x JOIN std y ON x.k = y.k AND x.block < y.block""",
)
def place_match(spark, sf):
    r = rec_records(spark, sf).select(F.col("record_seq.pos").alias("k"), F.col("record_seq.block").alias("o"), "source", "location")
    x, y = r.alias("x"), r.alias("y")
    return x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.o") < F.col("y.o"))).select(
        F.col("x.k").alias("k"), F.col("x.source").alias("sa"), F.col("y.source").alias("sb"),
        link.place_match(F.col("x.location"), F.col("y.location")).alias("place_match"),
    )


@query(
    "resolve_components",
    f"WITH RECURSIVE {STD} {EDGES} SELECT old_id, new_id FROM rewrite",
)
def resolve_components(spark, sf):
    return link.resolve(cut(rec_records(spark, sf)))


@query(
    "merge_audit",
    f"WITH RECURSIVE {STD} {EDGES} SELECT old_id AS from_id, new_id AS into_id FROM rewrite WHERE old_id <> new_id",
)
def merge_audit(spark, sf):
    return link.merge_audit(link.resolve(cut(rec_records(spark, sf))))


@query(
    "apply_rewrite",
    f"""WITH RECURSIVE {STD} {EDGES}
SELECT s.k, s.source, s.candidate_id AS old_id, coalesce(new_id, s.candidate_id) AS candidate_id
FROM std s LEFT JOIN rewrite ON old_id = s.candidate_id WHERE s.candidate_id IS NOT NULL""",
)
def apply_rewrite(spark, sf):
    r = cut(rec_records(spark, sf))
    return link.apply_rewrite(r, link.resolve(r)).select(
        F.col("record_seq.pos").alias("k"), "source", "old_id", "candidate_id"
    )


@query("orphans", f"WITH {STD} SELECT k, source FROM std WHERE candidate_id IS NULL")
def orphans(spark, sf):
    return link.orphans(rec_records(spark, sf)).select(F.col("record_seq.pos").alias("k"), "source")


@query(
    "records_per_id",
    f"WITH {STD} SELECT candidate_id, count(*) AS records FROM std WHERE candidate_id IS NOT NULL GROUP BY candidate_id",
)
def records_per_id(spark, sf):
    r = rec_records(spark, sf)
    return r.where(F.col("candidate_id") != "").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("records"))


@query(
    "run_stats",
    f"""WITH RECURSIVE {STD} {EDGES}
SELECT (SELECT count(*) FROM std) AS total_records, (SELECT count(*) FROM std WHERE candidate_id IS NULL) AS orphan_records,
  0 AS files, (SELECT count(DISTINCT candidate_id) FROM std) AS groups_before,
  (SELECT count(DISTINCT candidate_id) FROM std) - (SELECT count(*) FROM rewrite WHERE old_id <> new_id) AS groups_after,
  (SELECT count(*) FROM rewrite WHERE old_id <> new_id) AS merges""",
)
def run_stats(spark, sf):
    r = cut(rec_records(spark, sf))
    return report.run_stats(r, link.resolve(r))
