"""From raw columns to records of the shared layout, one function per source kind.

All functions are single projections (plus an explode for arrays and blocks), so
they run in the scan stage of whatever table holds the raw text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinweave import schema as S
from kinweave.functions import standardize as N, text as X


def seq(origin: Column | str, block: Column | int = 0, pos: Column | int = 0, item: Column | int = 0) -> Column:
    """Position of a record in the total input order; ``item`` counts the records of one row."""
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        col(origin).cast("string").alias("origin"),
        col(block).cast("long").alias("block"),
        col(pos).cast("long").alias("pos"),
        col(item).cast("long").alias("item"),
    )


def conf(value) -> Column:
    return F.lit(value).cast(S.CONFIDENCE)


def one_or_none(value: Column) -> Column:
    """A list holding the value, or an empty list."""
    return N.compact(F.array(value))


# ------------------------------------------------------------ delimited ----


def pick(df: DataFrame, spellings: tuple[str, ...], header: tuple[str, ...] | None = None) -> Column:
    """First non-blank cell among the columns whose name is one of ``spellings``.

    Names are compared trimmed and lower-cased; the order of ``spellings`` decides, and of
    columns with the same name the first counts. ``header`` holds the names as written
    where the columns themselves are only numbered.
    """
    by_name: dict[str, str] = {}
    for c, written in zip(df.columns, header or df.columns):
        by_name.setdefault(written.strip().lower(), c)
    cells = [N.blank_to_null(N.trim(F.col(f"`{by_name[s]}`").cast("string"))) for s in spellings if s in by_name]
    return F.coalesce(*cells) if cells else F.lit(None).cast("string")


def alias_match(df: DataFrame, aliases=S.COLUMN_ALIASES, keep: tuple[str, ...] = (), header: tuple[str, ...] | None = None) -> DataFrame:
    """Rename a people list of any column spelling to the known targets."""
    return df.select(*keep, *[pick(df, spellings, header).alias(target) for target, spellings in aliases.items()])


def delimited_records(
    df: DataFrame,
    record_seq: str = "record_seq",
    row_number: str | None = None,
    as_of_year: int | None = None,
    country: str = "US",
    header: tuple[str, ...] | None = None,
) -> DataFrame:
    """Rows of a people list. ``row_number`` names a column holding the 1-based row
    number in its file, needed only by rows without id, name and email."""
    keep = tuple(dict.fromkeys(c for c in (record_seq, row_number) if c))
    return target_records(alias_match(df, keep=keep, header=header), record_seq, row_number, as_of_year, country)


def header_places(names: Column, aliases=S.COLUMN_ALIASES) -> Column:
    """For each target the 1-based places of its columns in a header, in the order of its spellings; ``names`` is an array of texts."""
    plain = F.transform(names, lambda c: F.lower(N.trim(c)))

    def places(known: Column) -> Column:
        found = [F.filter(F.array(*[F.array_position(known, F.lit(s)).cast("int") for s in spellings]), lambda p: p > 0).alias(target)
                 for target, spellings in aliases.items()]
        return F.struct(*found)

    return N.let(plain, places)


def placed_cells(df: DataFrame, cells: Column, places: str = "places", keep: tuple[str, ...] = (), aliases=S.COLUMN_ALIASES) -> DataFrame:
    """The known targets of rows that come as arrays, each with the places of its own header: the first cell that is not blank."""
    def value(target: str) -> Column:
        held = F.transform(F.col(f"{places}.{target}"), lambda p: N.blank_to_null(N.trim(F.try_element_at(cells, p))))
        return F.get(F.filter(held, lambda x: x.isNotNull()), F.lit(0)).alias(target)

    return df.select(*keep, *[value(t) for t in aliases])


def target_records(
    d: DataFrame, record_seq: str = "record_seq", row_number: str | None = None, as_of_year: int | None = None, country: str = "US",
) -> DataFrame:
    """Records from rows that have the known targets as columns."""
    number = F.col(row_number) if row_number else F.lit(None)
    has_role = F.col("company").isNotNull() | F.col("headline").isNotNull()
    role = X.experience_struct(
        F.col("company"), F.col("headline"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("location")
    )
    return S.conform(
        d.select(
            F.col(record_seq).alias("record_seq"),
            F.lit("recruiter_csv").alias("source"),
            N.row_id(F.col("candidate_id"), F.col("email"), F.col("name"), number).alias("candidate_id"),
            conf(S.SOURCE_TRUST["recruiter_csv"][1]).alias("confidence"),
            N.name(F.col("name")).alias("full_name"),
            one_or_none(N.email(F.col("email"))).alias("emails"),
            one_or_none(N.phone(F.col("phone"), country)).alias("phones"),
            N.location(F.col("location")).alias("location"),
            F.col("headline"),
            N.years(F.col("years"), as_of_year).alias("years_experience"),
            X.split_skills(F.coalesce(F.col("skills"), F.lit(""))).alias("skills"),
            N.link_list(F.array("linkedin", "github", "portfolio")).alias("links"),
            one_or_none(F.when(has_role, role)).alias("experience"),
        )
    )


# ----------------------------------------------------------------- JSON ----


_ROLE = "struct<company:string,title:string,start_date:string,start:string,end_date:string,end:string,location:string>"
_SCHOOL = "struct<institution:string,school:string,degree:string,field:string,graduation_date:string,end_date:string>"
#: What is read of a person; values of another kind and absent ones are null.
_PERSON = (
    "struct<candidate_id:string,id:string,confidence:double,full_name:string,name:string,emails:array<string>,email:string,"
    "phones:array<string>,phone:string,location:string,headline:string,title:string,years_experience:string,"
    f"skills:array<string>,links:array<variant>,experience:array<{_ROLE}>,education:array<{_SCHOOL}>>"
)


def _text(v: Column, *names: str) -> Column:
    """First non-blank text among the fields of a struct."""
    return F.coalesce(*[F.when(v[n] != "", v[n]) for n in names])


def _texts(v: Column, many: str, one: str) -> Column:
    """A text list under ``many``, else the single text under ``one``."""
    return F.coalesce(v[many], one_or_none(_text(v, one)))


def json_records(
    df: DataFrame, value: str = "value", record_seq: str = "record_seq", country: str = "US"
) -> DataFrame:
    """Records from JSON text: an array of people or one person per row.

    Unparsable text gives no record. A row may hold a whole array, so each
    element keeps its position.
    """
    people = N.let(
        F.try_parse_json(F.col(value)),
        lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)),
    )
    # A person is cast as a whole: a path of a variant that leads nowhere costs an exception each time.
    each = df.select(F.col(record_seq).alias("_seq"), F.posexplode(people).alias("_i", "c")).where(
        F.col("c").isNotNull()
    ).select("_seq", "_i", F.try_variant_get("c", "$", _PERSON).alias("c"))
    c = F.col("c")

    def role(e: Column) -> Column:
        company, title = _text(e, "company"), _text(e, "title")
        return F.when(
            company.isNotNull() | title.isNotNull(),
            X.experience_struct(
                company, title, N.month(_text(e, "start_date", "start")),
                N.month(_text(e, "end_date", "end")), _text(e, "location"),
            ),
        )

    def school(e: Column) -> Column:
        place, degree = _text(e, "institution", "school"), _text(e, "degree")
        return F.when(
            place.isNotNull() | degree.isNotNull(),
            X.education_struct(
                place, degree, _text(e, "field"), N.month(_text(e, "graduation_date", "end_date"))
            ),
        )

    default = conf(S.SOURCE_TRUST["ats_json"][1])
    given = c["confidence"]
    trusted = given.try_cast(S.CONFIDENCE)
    return S.conform(
        each.select(
            seq(F.col("_seq.origin"), F.col("_seq.block"), F.col("_seq.pos"), F.col("_i")).alias("record_seq"),
            F.lit("ats_json").alias("source"),
            _text(c, "candidate_id", "id").alias("candidate_id"),
            F.coalesce(trusted, default).alias("confidence"),
            F.when(given.isNotNull() & trusted.isNull(), "confidence out of range").alias("error"),
            N.name(_text(c, "full_name", "name")).alias("full_name"),
            N.compact(F.transform(_texts(c, "emails", "email"), N.email)).alias("emails"),
            N.compact(F.transform(_texts(c, "phones", "phone"), lambda p: N.phone(p, country))).alias("phones"),
            N.location(_text(c, "location")).alias("location"),
            _text(c, "headline", "title").alias("headline"),
            N.number(c["years_experience"]).alias("years_experience"),
            N.compact(F.transform(c["skills"], lambda x: N.skill(x))).alias("skills"),
            N.compact(
                F.transform(
                    c["links"],
                    lambda x: N.link(
                        F.coalesce(F.try_variant_get(x, "$", "struct<url:string>")["url"], F.try_variant_get(x, "$", "string"))
                    ),
                )
            ).alias("links"),
            N.compact(F.transform(c["experience"], role)).alias("experience"),
            N.compact(F.transform(c["education"], school)).alias("education"),
        )
    )


# ---------------------------------------------------------------- notes ----


def note_blocks(df: DataFrame, value: str = "value", record_seq: str = "record_seq") -> DataFrame:
    """Blocks of a notes text that carry an id: (record_seq, candidate_id, block)."""
    blocks = df.select(
        F.col(record_seq).alias("_seq"), F.posexplode(F.split(F.col(value), r"\n\s*---\s*\n")).alias("_i", "_b")
    )
    block = N.trim(F.col("_b"))
    marker = F.regexp_extract(block, r"(?m)^CANDIDATE_ID:\s*(\S+)", 1)
    return blocks.select(
        seq(F.col("_seq.origin"), F.col("_seq.block"), F.col("_seq.pos"), F.col("_i")).alias("record_seq"),
        marker.alias("candidate_id"),
        block.alias("block"),
    ).where(F.col("candidate_id") != "")


def note_records(
    df: DataFrame,
    value: str = "value",
    record_seq: str = "record_seq",
    country: str = "US",
    lexicon: tuple[str, ...] = S.NOTE_TERMS,
) -> DataFrame:
    b = F.col("block")
    return S.conform(
        note_blocks(df, value, record_seq).select(
            "record_seq",
            F.lit("recruiter_notes").alias("source"),
            "candidate_id",
            conf(S.SOURCE_TRUST["recruiter_notes"][1]).alias("confidence"),
            X.emails(b).alias("emails"),
            X.phones(b, country).alias("phones"),
            X.role_cue(b).alias("headline"),
            X.years_cue(b).alias("years_experience"),
            X.terms(b, lexicon).alias("skills"),
            X.links(b).alias("links"),
        )
    )


# ------------------------------------------------------- labelled texts ----


def labelled_records(
    df: DataFrame, value: str = "value", record_seq: str = "record_seq", country: str = "US"
) -> DataFrame:
    """One record per ``KEY: value`` text."""
    d = df.select(F.col(record_seq).alias("record_seq"), X.labelled_chunks(F.col(value)).alias("_c"))
    c = F.col("_c")
    get = lambda key: X.labelled_value(c, key)
    mail = N.email(get("EMAIL"))
    local = N.blank_to_null(N.slug(F.substring_index(mail, "@", 1)))
    urls = F.filter(
        F.transform(F.split(F.coalesce(get("LINKS"), F.lit("")), ","), N.trim),
        lambda u: ~(u.contains("@") | u.rlike(X.NOT_A_LABELLED_LINK)),
    )
    return S.conform(
        d.select(
            "record_seq",
            F.lit("resume").alias("source"),
            F.coalesce(get("CANDIDATE_ID"), F.concat(F.lit("derived_"), local)).alias("candidate_id"),
            conf(S.SOURCE_TRUST["resume"][1]).alias("confidence"),
            N.name(get("NAME")).alias("full_name"),
            one_or_none(mail).alias("emails"),
            one_or_none(N.phone(get("PHONE"), country)).alias("phones"),
            N.location(get("LOCATION")).alias("location"),
            get("HEADLINE").alias("headline"),
            N.number(get("YEARS")).alias("years_experience"),
            N.compact(F.transform(X.labelled_list(c, "SKILLS"), lambda s: N.skill(s))).alias("skills"),
            N.link_list(urls).alias("links"),
            X.labelled_experience(X.labelled_list(c, "EXPERIENCE")).alias("experience"),
            X.labelled_education(X.labelled_list(c, "EDUCATION")).alias("education"),
        )
    )


# ------------------------------------------------------ free-text files ----


def free_text_id(text: Column, first_email: Column, file_name: Column) -> Column:
    """Explicit marker, else from the first email, else from the file name."""
    marker = N.blank_to_null(F.regexp_extract(text, r"CANDIDATE_ID:\s*(\S+)", 1))
    local = N.blank_to_null(N.slug(F.substring_index(first_email, "@", 1)))
    stem = N.blank_to_null(N.slug(F.regexp_replace(F.lower(file_name), r"\.[^.]*$", "")))
    return F.coalesce(
        marker, F.concat(F.lit("derived_"), local), F.concat(F.lit("uploaded_"), F.coalesce(stem, F.lit("file")))
    )


def free_text_records(
    df: DataFrame,
    value: str = "value",
    file_name: str = "file_name",
    record_seq: str = "record_seq",
    country: str = "US",
    lexicon: tuple[str, ...] = S.DOCUMENT_TERMS,
) -> DataFrame:
    """One record per document text, mined by patterns and section headings."""
    t = F.col(value)
    d = df.select(
        F.col(record_seq).alias("record_seq"),
        t.alias("_t"),
        F.col(file_name).alias("_f"),
        X.lines(t).alias("_l"),
        X.emails(t, X.DOCUMENT_EMAIL).alias("emails"),
    )
    text, ln = F.col("_t"), F.col("_l")
    listed = X.split_skills(F.array_join(X.section(ln, S.SECTION_HEADINGS["skills"]), "\n"), r"[,•\n;|]")
    return S.conform(
        d.select(
            "record_seq",
            F.lit("resume").alias("source"),
            free_text_id(text, F.try_element_at(F.col("emails"), F.lit(1)), F.col("_f")).alias("candidate_id"),
            conf(S.FREE_TEXT_CONFIDENCE).alias("confidence"),
            N.name(X.first_name_line(ln)).alias("full_name"),
            "emails",
            X.phones(text, country).alias("phones"),
            X.first_place_line(ln).alias("location"),
            X.first_role_line(ln).alias("headline"),
            X.years_cue(text).alias("years_experience"),
            F.when(F.size(listed) > 0, listed).otherwise(X.terms(text, lexicon)).alias("skills"),
            X.document_links(text).alias("links"),
            X.free_text_experience(X.section(ln, S.SECTION_HEADINGS["experience"])).alias("experience"),
            X.free_text_education(X.section(ln, S.SECTION_HEADINGS["education"])).alias("education"),
        )
    )
