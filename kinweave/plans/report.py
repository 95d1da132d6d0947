"""Reports over profiles: tables for people who read them, all plain projections or small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.plans import project as P

NONE = "—"


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.75, "good").when(c >= 0.5, "fair").otherwise("poor")


def confidence_bands(profiles: DataFrame) -> DataFrame:
    return (
        profiles
        .groupBy(confidence_band(F.col("overall_confidence")).alias("band"))
        .agg(F.count(F.lit(1)).alias("profiles"))
    )


def _list_size(field: str) -> Column:
    return F.coalesce(F.size(field), F.lit(0)).cast("long")


def profile_table(profiles: DataFrame) -> DataFrame:
    """One line per profile: name, id, first mail address, sizes, confidence."""
    return profiles.select(
        F.coalesce("full_name", F.lit(NONE)).alias("name"),
        F.col("candidate_id").alias("id"),
        F.coalesce(F.try_element_at("emails", F.lit(1)), F.lit(NONE)).alias("email"),
        _list_size("skills").alias("n_skills"),
        F.round("overall_confidence", 2).alias("confidence"),
        F.size("conflicts").cast("long").alias("n_conflicts"),
    )


def place_line(loc: Column) -> Column:
    parts = F.filter(F.array(loc["city"], loc["region"], loc["country"]), lambda p: p != "")
    return F.coalesce(F.when(F.size(parts) > 0, F.array_join(parts, ", ")), loc["raw"], F.lit(NONE))


def profile_summary(profiles: DataFrame, skills_shown: int = 12, meta: DataFrame | None = None) -> DataFrame:
    """The longer line: contacts, place, skills with a count of the rest, history sizes, account."""
    heads = profiles
    if meta is not None:
        heads = heads.join(meta, "candidate_id", "left")
        account = F.when(
            F.col("github_meta").isNotNull(),
            F.concat(
                F.lit("@"), F.col("github_meta.handle"), F.lit(" ("),
                F.col("github_meta.public_repos").cast("string"), F.lit(" repos, "),
                F.col("github_meta.followers").cast("string"), F.lit(" followers)"),
            ),
        )
    else:
        account = F.lit(None).cast("string")
    shown = F.array_join(F.slice("skills", 1, skills_shown), ", ")
    more = _list_size("skills") - skills_shown
    return heads.select(
        "candidate_id",
        F.coalesce("full_name", F.lit("(no name)")).alias("name"),
        "headline",
        F.array_join("emails", ", ").alias("emails"),
        F.array_join("phones", ", ").alias("phones"),
        place_line(F.col("location")).alias("place"),
        F.when(more > 0, F.concat(shown, F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(shown).alias("skills"),
        _list_size("experience").alias("roles"),
        _list_size("education").alias("schools"),
        account.alias("account"),
        F.col("overall_confidence").alias("confidence"),
    )


def conflict_report(profiles: DataFrame) -> DataFrame:
    """One row per winner or alternate of every contested field."""
    each = profiles.select("candidate_id", F.explode("conflicts").alias("field", "c"))
    win = F.struct(
        F.lit("winner").alias("role"), F.col("c.winner").alias("value"),
        F.col("c.winning_sources").alias("sources"), F.lit(None).cast("double").alias("weight"),
    )
    others = F.transform(
        "c.alternates",
        lambda a: F.struct(
            F.lit("alternate").alias("role"), a["value"].alias("value"), a["sources"].alias("sources"),
            a["weight"].alias("weight"),
        ),
    )
    return each.select("candidate_id", "field", F.explode(F.concat(F.array(win), others)).alias("r")).select(
        "candidate_id", "field", "r.role", "r.value", F.array_join("r.sources", ",").alias("sources"), "r.weight"
    )


def profile_sources(profiles: DataFrame) -> DataFrame:
    """Distinct source names anywhere in a profile."""
    scalar = F.flatten(F.map_values("scalar_provenance"))
    listed = F.flatten(F.flatten(F.transform(F.map_values("list_provenance"), F.map_values)))
    return profiles.select(
        "candidate_id", F.array_sort(F.array_distinct(F.concat(scalar, listed))).alias("sources")
    )


def profile_search(profiles: DataFrame, query: str, config: dict | None = None, outputs: bool = False) -> DataFrame:
    """Profiles whose id, canonical text or, with ``outputs``, output text holds the words, in any case.

    All texts are made from the profile's row in one projection; nothing is fused again or joined.
    """
    q = query.strip().lower()
    if not q:
        return profiles
    held = profiles.withColumn("_row", F.struct(*profiles.columns))
    if outputs:
        held = P.documents(held, config, keep=("_row",))
    said = ["candidate_id", *(["output"] if outputs else []), F.to_json("_row")]
    text = F.lower(F.concat_ws(" ", *said))
    # A filter on plain columns takes the making of the texts into its condition, where parts that occur
    # twice are made twice; on a generated column it reads the finished text.
    return held.select("_row", F.explode(F.array(text)).alias("_said")).where(F.col("_said").contains(q)).select("_row.*")


def run_stats(records: DataFrame, rewrite: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row of totals: records, orphans, files, groups before and after resolution."""
    has_id = F.col("candidate_id") != ""
    n_files = files.agg(F.count(F.lit(1))).scalar() if files is not None else F.lit(0).cast("long")
    merged = rewrite.agg(F.count_if(F.col("old_id") != F.col("new_id"))).scalar()
    ids = records.where(has_id).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
    before = ids.agg(F.count(F.lit(1))).scalar()
    return records.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(~F.coalesce(has_id, F.lit(False))).alias("orphan_records"),
    ).select(
        "total_records", "orphan_records", n_files.alias("files"),
        before.alias("groups_before"), (before - merged).alias("groups_after"), merged.alias("merges"),
    )
