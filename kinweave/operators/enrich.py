"""Enrichment from snapshot tables of account profiles and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from kinweave import schema as S
from kinweave.functions import standardize as N, text as X
from kinweave.operators.skew import cut_counted, join_counted
from kinweave.sources.records import conf, one_or_none, seq

GITHUB, LINKEDIN = "github", "linkedin"

# Columns of the profile snapshot; absent ones count as null.
PROFILE_SNAPSHOT = {
    "provider": T.StringType(), "handle": T.StringType(), "status": T.IntegerType(),
    "name": T.StringType(), "bio": T.StringType(), "company": T.StringType(),
    "location": T.StringType(), "email": T.StringType(), "blog": T.StringType(),
    "twitter": T.StringType(), "public_repos": T.LongType(), "followers": T.LongType(),
    "following": T.LongType(), "avatar_url": T.StringType(), "html_url": T.StringType(),
    "skills": T.ArrayType(T.StringType()), "experience": T.ArrayType(S.EXPERIENCE),
    "education": T.ArrayType(S.EDUCATION),
}


def _snapshot(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in PROFILE_SNAPSHOT.items()]
    )


def handles(link_url: Column) -> Column:
    """(provider, handle) of a profile link, or null."""
    gh, li = N.github_handle(link_url), N.linkedin_handle(link_url)
    return F.when(
        gh.isNotNull(), F.struct(F.lit(GITHUB).alias("provider"), gh.alias("handle"))
    ).when(li.isNotNull(), F.struct(F.lit(LINKEDIN).alias("provider"), li.alias("handle")))


def enrichment_jobs(records: DataFrame, github: bool = True, linkedin: bool = True) -> DataFrame:
    """Distinct (candidate_id, provider, handle, asked): whose account to look up.

    One job per candidate and lower-cased handle; the spelling seen last is used.
    """
    wanted = [p for p, on in ((GITHUB, github), (LINKEDIN, linkedin)) if on]
    return (
        records.where(F.col("candidate_id") != "")
        .select("candidate_id", "record_seq", F.posexplode("links").alias("i", "l"))
        .select("candidate_id", handles(F.col("l.url")).alias("h"), F.struct("record_seq", "i").alias("at"))
        .where(F.col("h.provider").isin(*wanted))
        .groupBy("candidate_id", "h.provider", F.lower("h.handle").alias("handle"))
        .agg(F.max_by("h.handle", "at").alias("asked"))
    )


def top_languages(repos: DataFrame, k: int = 10, recent: int | None = 30) -> DataFrame:
    """(handle, languages): the k most frequent languages of non-fork repositories.

    With an ``updated_at`` column only the ``recent`` latest repositories of a
    handle count. Row-number limits are applied before the shuffle as well, so a
    handle with very many rows does not end up in one task.
    """
    if recent and "updated_at" in repos.columns:
        latest = W.partitionBy("handle").orderBy(F.desc("updated_at"), "language", "fork")
        repos = repos.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= recent)
    counts = (
        repos.where(~F.col("fork") & F.col("language").isNotNull())
        .groupBy("handle", "language")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = W.partitionBy("handle").orderBy(F.desc("n"), "language")
    return (
        counts.withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= k)
        .groupBy("handle")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "language"))).alias("_l"))
        .select("handle", F.transform("_l", lambda e: e["language"]).alias("languages"))
    )


def lookup_records(
    jobs: DataFrame, profiles: DataFrame, repos: DataFrame | None = None, origin: str = "enrichment"
) -> DataFrame:
    """One record per job. A GitHub account that is missing or failed gives a record of
    confidence 0 with the error; a LinkedIn account without payload gives its link only."""
    snap = _snapshot(profiles).withColumn("handle", F.lower("handle")).withColumnRenamed("skills", "own_skills")
    # Look every account up once, then hand it to all candidates that name it.
    jobs, total = cut_counted(jobs)
    on = ["provider", "handle"]
    accounts = jobs.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).join(snap, on, "left")
    if repos is not None:
        langs = top_languages(repos.withColumn("handle", F.lower("handle"))).withColumn("provider", F.lit(GITHUB))
        accounts = accounts.join(langs, on, "left")
    else:
        accounts = accounts.withColumn("languages", F.lit(None).cast("array<string>"))
    found = join_counted(jobs, accounts, on, total=total)
    is_gh = F.col("provider") == GITHUB
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    url = F.when(is_gh, F.concat(F.lit("https://github.com/"), "asked")).otherwise(
        F.concat(F.lit("https://linkedin.com/in/"), "asked")
    )

    def link(u: Column, kind: str) -> Column:
        return F.when(u.isNotNull(), F.struct(u.alias("url"), F.lit(kind).alias("type")))

    own = F.struct(url.alias("url"), F.col("provider").alias("type"))
    blog = N.link(F.when(F.col("blog") != "", F.col("blog")))
    twitter = link(F.when(F.col("twitter") != "", F.concat(F.lit("https://twitter.com/"), "twitter")), "twitter")
    work = F.when(
        F.col("company") != "",
        X.experience_struct(
            F.regexp_replace("company", "^@", ""), F.lit(None).cast("string"), F.lit(None).cast("string"),
            F.lit(None).cast("string"), F.col("location"),
        ),
    )
    confidence = (
        F.when(is_gh & ok, conf(S.SOURCE_TRUST[GITHUB][1]))
        .when(is_gh, conf(S.FAILED_CONFIDENCE))
        .when(ok, conf(S.SOURCE_TRUST[LINKEDIN][1]))
        .otherwise(conf(S.REFERENCE_ONLY_CONFIDENCE))
    )
    raw_skills = F.when(is_gh, F.col("languages")).otherwise(F.col("own_skills"))
    out = found.select(
        # Enrichments follow all other records, in a fixed order.
        seq(F.concat(F.lit("\U0010ffff"), F.lit(origin), F.lit("/"), "provider", F.lit("/"), "handle")).alias("record_seq"),
        F.col("provider").alias("source"),
        "candidate_id",
        confidence.alias("confidence"),
        F.when(ok, N.name(F.col("name"))).when(~is_gh, N.name(N.name_from_slug(F.col("asked")))).alias("full_name"),
        F.when(ok & is_gh, one_or_none(N.email(F.col("email")))).alias("emails"),
        F.when(ok, N.location(F.col("location"))).alias("location"),
        F.when(ok & is_gh, N.headline_from_bio(F.col("bio"), F.col("company")))
        .when(ok, N.blank_to_null(F.col("bio")))
        .alias("headline"),
        F.when(ok, N.compact(F.transform(raw_skills, lambda s: N.skill(s)))).alias("skills"),
        F.when(ok & is_gh, N.compact(F.array(own, blog, twitter))).otherwise(F.array(own)).alias("links"),
        F.when(ok & is_gh, one_or_none(work)).when(ok, F.col("experience")).alias("experience"),
        F.when(ok & ~is_gh, F.col("education")).alias("education"),
        F.when(
            is_gh & ~ok,
            F.concat(
                F.lit("GitHub /users/"), "asked", F.lit(" → "), F.coalesce(F.col("status"), F.lit(404)).cast("string")
            ),
        ).alias("error"),
        F.when(~is_gh & ~ok, F.lit("no profile payload: only handle and link kept")).alias("note"),
        F.when(
            is_gh & ok,
            F.struct(F.col("asked").alias("handle"), "public_repos", "followers", "following", "avatar_url", "html_url"),
        ).alias("github_meta"),
        F.when(
            ~is_gh & ~ok,
            F.struct(F.col("asked").alias("handle"), url.alias("url"), F.lit(False).alias("enriched")),
        ).alias("linkedin_meta"),
    )
    return S.conform(out)


def extra_link_records(
    links: DataFrame, profiles: DataFrame, repos: DataFrame | None = None,
    github: bool = True, linkedin: bool = True, url: str = "url",
) -> DataFrame:
    """Records from a table of profile links that belong to no candidate yet.

    The id comes from the account's email, else from the handle.
    """
    wanted = [p for p, on in ((GITHUB, github), (LINKEDIN, linkedin)) if on]
    jobs = (
        links.select(handles(F.col(url)).alias("h"))
        .where(F.col("h.provider").isin(*wanted))
        .select(
            F.lit(None).cast("string").alias("candidate_id"), "h.provider",
            F.lower("h.handle").alias("handle"), F.col("h.handle").alias("asked"),
        )
    )
    found = lookup_records(jobs, profiles, repos, origin="links")
    handle = F.element_at(F.split(F.col("record_seq.origin"), "/"), -1)
    mail = F.try_element_at("emails", F.lit(1))
    gh_id = F.coalesce(N.id_from_email(mail, strip=False), F.concat(F.lit("derived_gh_"), handle))
    li_id = F.concat(F.lit("derived_li_"), F.regexp_replace(handle, "[^a-z0-9]+", "_"))
    return found.withColumn("candidate_id", F.when(F.col("source") == GITHUB, gh_id).otherwise(li_id))


def enrich(
    records: DataFrame, profiles: DataFrame, repos: DataFrame | None = None,
    github: bool = True, linkedin: bool = True,
) -> DataFrame:
    """The enrichment records of all candidates; union them with the input."""
    return lookup_records(enrichment_jobs(records, github, linkedin), profiles, repos)


def enrichment_counters(records: DataFrame) -> DataFrame:
    """Per provider: records and failures."""
    return (
        records.where(F.col("source").isin(GITHUB, LINKEDIN))
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    )


def enrichment_errors(records: DataFrame) -> DataFrame:
    """Distinct error texts with their number; kept long because there is one per failed account."""
    return records.where(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("records"))
