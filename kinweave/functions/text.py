"""Mining of text columns: contacts, links, lexicon terms, cues, sections and history rows.

Everything works inside one row with built-in array expressions, so long texts
are never exploded into shuffles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from kinweave import schema as S
from kinweave.functions import standardize as N

# Patterns whose matches must agree with other readers of the same text (fixed values).
NOTE_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NOTE_LINK = r"https?://[^\s)>,]+"
DOCUMENT_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
DOCUMENT_LINK = (
    r"(?:(?:https?|ftp)://)?(?:www\.)?[a-zA-Z0-9][a-zA-Z0-9-]*"
    r"(?:\.[a-zA-Z0-9][a-zA-Z0-9-]*)*\.[a-zA-Z]{2,}(?:/[^\s]*)?"
)
PHONE = r"\+?\d[\d\s().-]{7,}\d"
YEARS_CUE = r"(?i)(\d+(?:\.\d+)?)\s*\+?\s*(?:years|yrs)\b"
NOT_A_LINK = r"\.(?:js|e|pdf|doc|docx|txt|jpg|png|gif|css|html|xml|json|exe|dll|so|dylib|zip|tar|gz)$"
NOT_A_LABELLED_LINK = r"(?i)\.(?:js|e|pdf|doc|docx|txt|jpg|png|gif|css|html|xml|json)$"
ROLE_WORD = r"(?i)\b(?:engineer|developer|manager|scientist|analyst|designer|architect|lead|director)\b"
ROLE_CUE = r"(?i)currently\s+an?\s+([A-Za-z][A-Za-z\s/]+?)\s+(?:at|@)\s+([A-Za-z][\w.\s&]+?)[.\n]"
NAME_WORD = r"[A-Z][a-zA-Z'.-]*"
HISTORY_ROW = r"^([^|]+)\|([^|]+)\|([^|]+?)(?:\|([^|]+))?$"
HISTORY_DATE = r"[A-Za-z]+\.?\s*\d{4}|\d{4}|\d{4}-\d{2}"
HISTORY_PROSE = (
    rf"(?i)^(.+?)\s+(?:—|-|@|at)\s+(.+?)\s*\(?\s*({HISTORY_DATE})\s*[-–]\s*(present|now|current|{HISTORY_DATE})\)?$"
)
KEY_LINE = r"(?m)^[ \t]*(?=(?:SKILLS|EXPERIENCE|EDUCATION):[ \t\r]*$|(?!(?:SKILLS|EXPERIENCE|EDUCATION):)[A-Z_]+:)"
PLACE_WORD = r",\s*[A-Z]{2}\b|\b(?:USA|US|UK|India|Canada|Germany|France|Japan|Singapore|Brazil|Mexico)\b"


def matches(text: Column, pattern: str) -> Column:
    """Distinct matches in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


# ------------------------------------------------------------- contacts ----


def emails(text: Column, pattern: str = NOTE_EMAIL) -> Column:
    return N.compact(F.transform(matches(text, pattern), N.email))


def phones(text: Column, country: str = "US") -> Column:
    return N.compact(F.transform(matches(text, PHONE), lambda p: N.phone(p, country)))


def links(text: Column) -> Column:
    return N.link_list(matches(text, NOTE_LINK))


def real_link(u: Column) -> Column:
    """Predicate: not a mail host, mail address or file name."""
    bad = N.let(
        F.lower(u),
        lambda low: low.contains("@")
        | low.contains("gmail.com")
        | low.contains("yahoo.com")
        | low.contains("outlook.com")
        | low.rlike(NOT_A_LINK),
    )
    return ~bad & u.contains(".") & (F.length(u) >= 5)


def document_links(text: Column) -> Column:
    return N.link_list(F.filter(matches(text, DOCUMENT_LINK), real_link))


# ----------------------------------------------------------------- cues ----


def terms(text: Column, lexicon: tuple[str, ...]) -> Column:
    """Lexicon terms standing between non-letters, in lexicon order, any case.

    One scan of the text: at each word start the longest term is taken, and terms
    that begin another term ("SQL" in "SQL Server") are added from a static map.
    """
    by_length = sorted({t.lower() for t in lexicon}, key=lambda t: (-len(t), t))
    alternatives = "|".join(re.escape(t) for t in by_length)
    # A lookahead matches without consuming, so neighbouring terms can share a blank.
    pattern = rf"(?i)(?<![A-Za-z])(?=({alternatives})(?![A-Za-z]))"
    hits = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower))

    def also_found_by(short: str) -> list[str]:
        return [t for t in by_length if t.startswith(short) and not t[len(short):len(short) + 1].isalpha()]

    wanted = F.array(*[F.struct(F.lit(t).alias("term"), F.array(*map(F.lit, also_found_by(t.lower()))).alias("by")) for t in lexicon])
    return N.let(
        hits,
        lambda found: F.transform(F.filter(wanted, lambda t: F.arrays_overlap(found, t["by"])), lambda t: t["term"]),
    )


def years_cue(text: Column) -> Column:
    return F.regexp_extract(text, YEARS_CUE, 1).try_cast("double")


def role_cue(text: Column) -> Column:
    """``currently a <role> at <company>`` as ``<role> at <company>``."""
    role = N.trim(F.regexp_extract(text, ROLE_CUE, 1))
    return F.when(role != "", F.concat(role, F.lit(" at "), N.trim(F.regexp_extract(text, ROLE_CUE, 2))))


def split_skills(text: Column, delimiters: str = r"[,;|]", alias_first: bool = False) -> Column:
    return N.compact(F.transform(F.split(text, delimiters), lambda s: N.skill(s, alias_first)))


# ------------------------------------------------------ lines, sections ----


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def section(line_array: Column, headings: tuple[str, ...], all_headings: tuple[str, ...] | None = None) -> Column:
    """Lines between the first of ``headings`` and the next known heading."""
    known = all_headings or tuple(h for group in S.SECTION_HEADINGS.values() for h in group)

    def positions(heads: Column, words: tuple[str, ...]) -> Column:
        return F.filter(
            F.transform(heads, lambda h, i: F.when(h.isin(*words), i)), lambda i: i.isNotNull()
        )

    def cut(heads: Column, start: Column) -> Column:
        end = F.try_element_at(F.filter(positions(heads, known), lambda i: i >= start), F.lit(1))
        length = F.greatest(F.coalesce(end, F.size(line_array)) - start, F.lit(0))
        return F.when(start.isNotNull(), F.slice(line_array, start + 1, length)).otherwise(
            F.array().cast("array<string>")
        )

    heads = F.transform(
        line_array, lambda s: N.trim(F.regexp_replace(F.lower(N.trim(s)), r":.*$", ""))
    )
    return N.let(
        heads,
        lambda h: N.let(F.try_element_at(positions(h, headings), F.lit(1)) + 1, lambda start: cut(h, start)),
    )


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def first_name_line(line_array: Column) -> Column:
    cleaned = F.transform(F.slice(line_array, 1, 10), N.trim)
    return _first(F.filter(cleaned, lambda s: s.rlike(rf"^{NAME_WORD}(?:\s+{NAME_WORD}){{1,4}}$")))


def first_role_line(line_array: Column) -> Column:
    cleaned = F.transform(F.slice(line_array, 1, 15), N.trim)
    return _first(F.filter(cleaned, lambda s: s.rlike(ROLE_WORD) & (F.length(s) < 80)))


def first_place_line(line_array: Column) -> Column:
    return N.location(N.trim(_first(F.filter(F.slice(line_array, 1, 20), lambda s: s.rlike(PLACE_WORD)))))


# -------------------------------------------------------------- history ----


def _span(dates: Column, i: int) -> Column:
    return N.month(F.try_element_at(F.split(dates, "[-–]"), F.lit(i)))


def _cell(parts: Column, i: int) -> Column:
    return N.blank_to_null(F.try_element_at(parts, F.lit(i)))


def experience_struct(company, title, start, end, place) -> Column:
    return F.struct(
        company.alias("company"), title.alias("title"), start.alias("start_date"),
        end.alias("end_date"), place.alias("location"),
    )


def education_struct(institution, degree, field, date) -> Column:
    return F.struct(
        institution.alias("institution"), degree.alias("degree"),
        field.alias("field"), date.alias("graduation_date"),
    )


def _null_text() -> Column:
    return F.lit(None).cast("string")


def _bar_cells(row: Column) -> Column:
    return F.transform(F.split(row, r"\|"), N.trim)


def labelled_experience(rows: Column) -> Column:
    """``company | title | start - end | place`` rows with at least three parts."""

    def build(p: Column) -> Column:
        dates = F.try_element_at(p, F.lit(3))
        return F.when(
            F.size(p) >= 3,
            experience_struct(_cell(p, 1), _cell(p, 2), _span(dates, 1), _span(dates, 2), _cell(p, 4)),
        )

    return N.compact(F.transform(rows, lambda row: N.let(_bar_cells(row), build)))


def labelled_education(rows: Column) -> Column:
    def build(p: Column) -> Column:
        return F.when(
            F.size(p) >= 2,
            education_struct(_cell(p, 1), _cell(p, 2), _null_text(), N.month(F.try_element_at(p, F.lit(3)))),
        )

    return N.compact(F.transform(rows, lambda row: N.let(_bar_cells(row), build)))


def free_text_experience(section_lines: Column) -> Column:
    """Piped rows, else prose such as ``Title at Company (Jan 2020 - present)``."""
    def part(s: Column, pattern: str, i: int) -> Column:
        return N.trim(F.regexp_extract(s, pattern, i))

    def build(s: Column) -> Column:
        dates = F.regexp_extract(s, HISTORY_ROW, 3)
        return F.when(
            s.rlike(HISTORY_ROW),
            experience_struct(
                part(s, HISTORY_ROW, 1), part(s, HISTORY_ROW, 2), _span(dates, 1), _span(dates, 2),
                N.blank_to_null(part(s, HISTORY_ROW, 4)),
            ),
        ).when(
            s.rlike(HISTORY_PROSE),
            experience_struct(
                part(s, HISTORY_PROSE, 2), part(s, HISTORY_PROSE, 1), N.month(part(s, HISTORY_PROSE, 3)), N.month(part(s, HISTORY_PROSE, 4)),
                _null_text(),
            ),
        )

    return N.compact(F.transform(section_lines, lambda raw: N.let(N.trim(raw), build)))


def free_text_education(section_lines: Column) -> Column:
    """``institution | degree | date`` rows, commas when there is no bar."""

    def cells(s: Column) -> Column:
        bars = F.split(s, r"\|")
        return F.transform(F.when(F.size(bars) >= 2, bars).otherwise(F.split(s, r",\s*")), N.trim)

    def build(p: Column) -> Column:
        return F.when(
            F.size(p) >= 2,
            education_struct(_cell(p, 1), _cell(p, 2), _null_text(), N.month(F.try_element_at(p, F.lit(3)))),
        )

    filled = F.filter(F.transform(section_lines, lambda raw: N.trim(N.squeeze(raw))), lambda s: s != "")
    return N.compact(F.transform(filled, lambda s: N.let(cells(s), build)))


# ------------------------------------------------------- labelled blocks ----


def labelled_chunks(text: Column) -> Column:
    """Cut a ``KEY: value`` text at its key lines.

    A list heading (SKILLS, EXPERIENCE, EDUCATION) counts only when nothing
    follows its colon; with an inline value the line is ordinary text.
    """
    cut = "\u0001"
    return F.split(F.regexp_replace(text, KEY_LINE, cut), cut)


def labelled_value(chunks: Column, key: str) -> Column:
    """Value of the last line with that key; null when absent or blank."""
    hits = F.filter(chunks, lambda c: c.startswith(f"{key}:"))
    return N.blank_to_null(N.trim(F.regexp_extract(F.try_element_at(hits, F.lit(-1)), rf"^{key}:[ \t]*([^\r\n]*)", 1)))


def labelled_list(chunks: Column, key: str) -> Column:
    """Bulleted lines under that heading, over all its occurrences."""
    body = F.flatten(F.transform(F.filter(chunks, lambda c: c.startswith(f"{key}:")), lines))
    bullets = F.filter(F.transform(body, N.trim), lambda s: s.startswith("-"))
    return F.transform(bullets, lambda s: F.regexp_replace(s, r"^-\s*", ""))
