"""The whole job: records in, unified profiles and statistics out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave import schema as S
from kinweave.operators import enrich as E, fuse, link
from kinweave.operators.skew import cut, cut_counted, drop_cut
from kinweave.plans import project as P, report
from kinweave.plans.config import checked, fields_needed
from kinweave.sources import files as IO


@dataclass
class Unified:
    """Result tables of a run. Records, links and facts are computed and written to the shared folder while the
    run is put together, all else is lazy. ``close`` deletes the written tables once the results are stored."""

    records: DataFrame      # every record, enrichments included
    rewrite: DataFrame      # (old_id, new_id) of linked ids
    facts: DataFrame        # long fused table, whole at any group size
    profiles: DataFrame     # nested canonical profiles
    config: dict | None
    files: DataFrame | None = None
    problems: Callable[[], DataFrame] | None = None  # looks up what could not be read, by file
    fused: Callable[[DataFrame], DataFrame] | None = None  # makes the profiles of fact rows

    @property
    def outputs(self) -> DataFrame:
        return P.project(self.profiles, self.config)

    @property
    def documents(self) -> DataFrame:
        return P.documents(self.profiles, self.config)

    @property
    def summary(self) -> DataFrame:
        """The longer line of every profile, with the account that enrichment found last."""
        return report.profile_summary(self.profiles, meta=fuse.latest_meta(link.apply_rewrite(self.records, self.rewrite)))

    @cached_property
    def stats(self) -> dict[str, DataFrame]:
        out = {
            "totals": report.run_stats(self.records, self.rewrite, self.files),
            "merges": link.merge_audit(self.rewrite),
            "enrichment": E.enrichment_counters(self.records),
            "enrichment_errors": E.enrichment_errors(self.records),
        }
        if self.files is not None:
            out["files"] = IO.ingest_report(self.files, self.records, self.problems() if self.problems else None)
        return out

    def close(self) -> None:
        for table in (self.records, self.facts):
            drop_cut(table)

    def write(self, path: str, mode: str = "errorifexists") -> None:
        if self.fused is None:
            IO.write_result(P.results(self.profiles, self.config), self.stats, path, mode)
        else:
            # The ranges are drawn from the facts, so that the profiles are made once: to sample finished rows makes them twice.
            ranged = self.fused(self.facts.repartitionByRange(fuse.ID))
            IO.write_result(P.results(ranged, self.config), self.stats, path, mode, ranged=True)


def unify(
    records: DataFrame,
    config: dict | None = None,
    profile_snapshot: DataFrame | None = None,
    repo_snapshot: DataFrame | None = None,
    extra_links: DataFrame | None = None,
    enrich: bool = True,
    enrich_github: bool = True,
    enrich_linkedin: bool = True,
    files: DataFrame | None = None,
    problems: Callable[[], DataFrame] | None = None,
    collation: str | None = None,
) -> Unified:
    """Enrich, resolve, fuse and project a table of source records."""
    checked(config)
    # Parsed records are read by linking, rewriting and statistics: keep them.
    everything, total = cut_counted(S.conform(records))
    if enrich and profile_snapshot is not None:
        parts = [everything, E.enrich(everything, profile_snapshot, repo_snapshot, enrich_github, enrich_linkedin)]
        if extra_links is not None:
            parts.append(
                E.extra_link_records(extra_links, profile_snapshot, repo_snapshot, enrich_github, enrich_linkedin)
            )
        everything, total = cut_counted(IO.union_sources(parts))
    rewrite = link.resolve(everything)
    merged = link.apply_rewrite(everything, rewrite, total)
    fields = fields_needed(config)
    fact_rows = cut(fuse.facts(merged, fields))
    fused = lambda rows: fuse.profiles(fuse.gather(rows, collation), fields)
    return Unified(everything, rewrite, fact_rows, fused(fact_rows), config, files, problems, fused)


def unify_folder(
    spark: SparkSession, path: str, config: dict | None = None, as_of_year: int | None = None,
    multi_line: bool = True, json_lines: bool = False, country: str = "US", **options,
) -> Unified:
    """The same over a folder of source files. ``multi_line=False`` and ``json_lines=True`` let large files be split."""
    # To list a folder and to read the headers takes a task per directory or a pass over the lists: once for all readers.
    listed = cut(IO.discover(spark, path))
    has_lists = not listed.where(F.col("source_kind") == IO.DELIMITED).isEmpty()
    headers = IO.read_headers(spark, path) if has_lists else None
    records = IO.read_folder(spark, path, multi_line, json_lines, as_of_year, country, listed, headers)
    # Looked for only where the report is asked for: it reads the files again.
    problems = lambda: IO.ingest_problems(spark, path, multi_line, json_lines, listed, headers)
    return unify(records, config, files=listed, problems=problems, **options)
