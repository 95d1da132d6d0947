"""Fusion: votes, lists, provenance, conflicts and confidences by candidate id."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave import schema as S
from kinweave.operators import enrich, fuse
from workload.base import FUSED, STD, TRUST, canonical, fused, query, rec_records, rich_records, table


def _flat(df):
    return df.withColumn("sources", F.array_join("sources", ",")).withColumn(
        "weight", fuse.rounded(F.col("weight"))
    )


@query(
    "trust_lookup",
    f"WITH {STD} {TRUST} SELECT k, source, round(w, 6)::DOUBLE AS w FROM voter",
)
def trust_lookup(spark, sf):
    r = rec_records(spark, sf).where(F.col("candidate_id") != "")
    w = fuse.vote_weight(F.col("source"), F.col("confidence"))
    return r.select(F.col("record_seq.pos").alias("k"), "source", w.cast("double").alias("w"))


@query(
    "default_confidence",
    """SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 0.5 WHEN source = 'src0' THEN 0.95 WHEN source = 'src1' THEN 0.55 ELSE 0.5 END::DOUBLE AS confidence
FROM documents""",
)
def default_confidence(spark, sf):
    """Missing confidences: two document sources play known ones, the rest are unknown."""
    d = table(spark, sf, "documents")
    source = F.when(F.col("source") == "src0", "ats_json").when(F.col("source") == "src1", "recruiter_notes").otherwise(F.col("source"))
    given = F.when(F.col("doc_id") % 2 == 0, F.lit("0.5").cast(S.CONFIDENCE))
    return d.select("doc_id", "source", fuse.filled_confidence(source, given).cast("double").alias("confidence"))


def _vote(field):
    sql = f"""WITH {FUSED}
SELECT candidate_id, value, round(weight, 3)::DOUBLE AS weight, array_to_string(sources, ',') AS sources,
       rn = 1 AS wins FROM ranked WHERE field = '{field}'"""

    @query(f"vote_{field}", sql)
    def run(spark, sf):
        """Every value of the field with its weight; the winner is flagged."""
        f = fuse.facts(rec_records(spark, sf), (field,))
        win = fuse.field_totals(f).select("candidate_id", F.col("top.value").alias("best"))
        return _flat(f.join(win, "candidate_id")).select(
            "candidate_id", "value", "weight", "sources", (F.col("value") == F.col("best")).alias("wins")
        )

    return run


for _f in ("full_name", "headline", "location", "years_experience"):
    _vote(_f)


@query(
    "vote_confidence",
    f"""WITH {FUSED} SELECT candidate_id, field, confidence FROM conf
WHERE field IN ('full_name', 'headline', 'location', 'years_experience', 'candidate_id')""",
)
def vote_confidence(spark, sf):
    totals = fuse.field_totals(fuse.facts(rec_records(spark, sf), S.SCALAR_FIELDS))
    return fuse.field_confidence(totals)


@query(
    "vote_alternates",
    f"""WITH {FUSED} SELECT candidate_id, field, value, array_to_string(sources, ',') AS sources, round(weight, 3)::DOUBLE AS weight
FROM ranked WHERE rn > 1 AND field IN ('full_name', 'headline', 'location', 'years_experience', 'candidate_id')""",
)
def vote_alternates(spark, sf):
    c = canonical(spark, sf).select("candidate_id", F.explode("conflicts").alias("field", "c"))
    a = c.select("candidate_id", "field", F.explode("c.alternates").alias("a"))
    return a.select("candidate_id", "field", "a.value", F.array_join("a.sources", ",").alias("sources"), "a.weight")


@query(
    "conflicts",
    f"""WITH {FUSED} SELECT candidate_id, field, value AS winner, array_to_string(sources, ',') AS winning_sources, n - 1 AS n_alternates
FROM ranked WHERE rn = 1 AND n > 1 AND field IN ('full_name', 'headline', 'location', 'years_experience', 'candidate_id')""",
)
def conflicts(spark, sf):
    c = canonical(spark, sf).select("candidate_id", F.explode("conflicts").alias("field", "c"))
    return c.select(
        "candidate_id", "field", F.col("c.winner").alias("winner"),
        F.array_join("c.winning_sources", ",").alias("winning_sources"),
        F.size("c.alternates").cast("long").alias("n_alternates"),
    )


def _fuse_list(field):
    sql = f"""WITH {FUSED}
SELECT candidate_id, rn AS pos, key, value, round(weight, 3)::DOUBLE AS weight, array_to_string(sources, ',') AS sources
FROM ranked WHERE field = '{field}'"""

    @query(f"fuse_{field}", sql)
    def run(spark, sf):
        """The list of every candidate in order, one row per item."""
        g = fuse.gather(fuse.facts(rich_records(spark, sf), (field,)))
        e = g.select("candidate_id", F.posexplode("entries").alias("i", "e"))
        return e.select(
            "candidate_id", (F.col("i") + 1).cast("long").alias("pos"), "e.key", "e.value",
            fuse.rounded(-F.col("e.neg")).alias("weight"), F.array_join("e.sources", ",").alias("sources"),
        )

    return run


for _f in S.LIST_FIELDS:
    _fuse_list(_f)


@query(
    "item_provenance",
    f"""WITH {FUSED} SELECT candidate_id, field, key, array_to_string(sources, ',') AS sources FROM facts
WHERE field NOT IN ('full_name', 'headline', 'location', 'years_experience', 'candidate_id')""",
)
def item_provenance(spark, sf):
    p = canonical(spark, sf).select("candidate_id", F.explode("list_provenance").alias("field", "m"))
    return p.select("candidate_id", "field", F.explode("m").alias("key", "s")).select(
        "candidate_id", "field", "key", F.array_join("s", ",").alias("sources")
    )


@query(
    "list_confidence",
    f"""WITH {FUSED} SELECT candidate_id, field, confidence FROM conf
WHERE field NOT IN ('full_name', 'headline', 'location', 'years_experience', 'candidate_id')""",
)
def list_confidence(spark, sf):
    return fuse.field_confidence(fuse.field_totals(fuse.facts(rich_records(spark, sf), S.LIST_FIELDS)))


@query(
    "overall_confidence",
    f"""WITH {FUSED} SELECT candidate_id, round(sum(confidence::DECIMAL(10,3)) / count(*), 3)::DOUBLE AS overall_confidence
FROM conf WHERE confidence > 0 GROUP BY candidate_id""",
)
def overall_confidence(spark, sf):
    """Long form: no profile row is ever built."""
    return fuse.overall_confidence(fuse.field_confidence(fuse.field_totals(fused(spark, sf))))


@query(
    "profile_sources",
    f"""WITH {FUSED} SELECT candidate_id, string_agg(DISTINCT s, ',' ORDER BY s) AS sources
FROM (SELECT candidate_id, unnest(sources) AS s FROM facts) GROUP BY candidate_id""",
)
def profile_sources(spark, sf):
    from kinweave.plans import report

    return report.profile_sources(canonical(spark, sf)).select("candidate_id", F.array_join("sources", ",").alias("sources"))


@query(
    "latest_meta",
    """SELECT user_id::VARCHAR AS candidate_id, arg_max(event_type, event_id) AS handle, arg_max(event_id, event_id) AS followers
FROM events WHERE event_type <> 'error' GROUP BY user_id""",
)
def latest_meta(spark, sf):
    """Last event of a user that carries metadata."""
    e = table(spark, sf, "events")
    none = F.lit(None).cast("long")
    text = F.lit(None).cast("string")
    r = e.select(
        F.col("user_id").cast("string").alias("candidate_id"),
        F.struct(F.lit("events").alias("origin"), F.lit(0).cast("long").alias("block"), F.col("event_id").alias("pos")).alias("record_seq"),
        F.when(
            F.col("event_type") != "error",
            F.struct(
                F.col("event_type").alias("handle"), none.alias("public_repos"), F.col("event_id").alias("followers"),
                none.alias("following"), text.alias("avatar_url"), text.alias("html_url"),
            ),
        ).alias("github_meta"),
    )
    m = fuse.latest_meta(S.conform(r))
    return m.select("candidate_id", "github_meta.handle", "github_meta.followers")


@query(
    "top_k_per_user",
    """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 9 <> 0 GROUP BY user_id, event_type),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c)
SELECT user_id::VARCHAR AS handle, string_agg(event_type, ',' ORDER BY rn) AS languages FROM r WHERE rn <= 3 GROUP BY user_id
""",
)
def top_k_per_user(spark, sf):
    repos = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("handle"), F.col("event_type").alias("language"),
        (F.col("event_id") % 9 == 0).alias("fork"),
    )
    return enrich.top_languages(repos, k=3).select("handle", F.array_join("languages", ",").alias("languages"))


@query(
    "top_k_recent",
    """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type, event_id % 9 = 0) AS r FROM events),
c AS (SELECT user_id, event_type, count(*) AS n FROM l WHERE r <= 5 AND event_id % 9 <> 0 GROUP BY user_id, event_type),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c)
SELECT user_id::VARCHAR AS handle, string_agg(event_type, ',' ORDER BY rn) AS languages FROM r WHERE rn <= 10 GROUP BY user_id
""",
)
def top_k_recent(spark, sf):
    """The same over the five latest repositories of a handle."""
    repos = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("handle"), F.col("event_type").alias("language"),
        (F.col("event_id") % 9 == 0).alias("fork"), F.col("ts").alias("updated_at"),
    )
    return enrich.top_languages(repos, k=10, recent=5).select("handle", F.array_join("languages", ",").alias("languages"))


@query(
    "fuse_first_seen",
    """
WITH words AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
items AS (
  SELECT 'c' || p_partkey % 500 AS candidate_id, p_partkey AS pos, unnest(list_concat(list_transform(w, lambda x: upper(x)), w)) AS value,
         generate_subscripts(list_concat(w, w), 1) AS i FROM words)
SELECT candidate_id, lower(value) AS key, arg_min(value, (pos, i)) AS value FROM items GROUP BY candidate_id, lower(value)""",
)
def fuse_first_seen(spark, sf):
    """Of several spellings the one seen first stays, by record and then by place inside the record."""
    words = F.split("p_name", " ")
    parts = table(spark, sf, "part").select(
        F.struct(F.lit("part").alias("origin"), F.lit(0).cast("long").alias("block"), F.col("p_partkey").alias("pos")).alias("record_seq"),
        F.lit("ats_json").alias("source"), F.concat(F.lit("c"), (F.col("p_partkey") % 500).cast("string")).alias("candidate_id"),
        F.concat(F.transform(words, F.upper), words).alias("skills"),
    )
    return fuse.facts(S.conform(parts), ("skills",)).select("candidate_id", "key", "value")


@query(
    "fuse_first_history",
    """
WITH rows AS (
  SELECT o_custkey % 40 AS c, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS i FROM orders)
SELECT 'c' || c AS candidate_id, 'acme|' || lower(o_orderpriority) || '|' AS key, arg_min('order ' || o_orderkey, i) AS location
FROM rows GROUP BY c, lower(o_orderpriority)""",
)
def fuse_first_history(spark, sf):
    """Rows of one record that say the same about a company and title: the first keeps its place."""
    roles = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("c")).agg(
        F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("r"))
    records = roles.select(
        F.struct(F.lit("orders").alias("origin"), F.lit(0).cast("long").alias("block"), F.col("c").cast("long").alias("pos")).alias("record_seq"),
        F.lit("resume").alias("source"), F.concat(F.lit("c"), F.col("c").cast("string")).alias("candidate_id"),
        F.transform("r", lambda r: F.struct(
            F.lit("Acme").alias("company"), r.o_orderpriority.alias("title"), F.lit(None).cast("string").alias("start_date"),
            F.lit(None).cast("string").alias("end_date"), F.concat(F.lit("order "), r.o_orderkey.cast("string")).alias("location"))).alias("experience"),
    )
    out = fuse.facts(S.conform(records), ("experience",))
    return out.select("candidate_id", "key", F.get_json_object("value", "$.location").alias("location"))
