"""Column standardisers: text in, clean value out, null when the text is unusable.

All of them are built-in expressions, so they stay inside the scan stage and
never cause a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from kinweave import schema as S

# Characters that count as blank: the ASCII ones and the Unicode spaces.
_WIDE = "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANKS = " \t\n\x0b\x0c\r" + "".join(
    chr(i)
    for lo, hi in ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
                   (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
    for i in range(lo, hi + 1)
)
WS = r"\s\x0B" + _WIDE  # for use inside a character class
_RUN = f"[{WS}]+"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once.

    Expressions inside array lambdas are not shared by the optimizer, so a value
    that is used several times is bound to a variable first.
    """
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Collapse every run of blanks to one space. Plain ASCII with single spaces passes untouched."""
    return let(c, lambda s: F.when(s.rlike("[^ -~]|  "), F.regexp_replace(s, _RUN, " ")).otherwise(s))


def blank_to_null(c: Column) -> Column:
    return let(c, lambda s: F.when(s != "", s))


def sql_text(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(table: Mapping[str, str], key: Column) -> Column:
    entries = ", ".join(sql_text(x) for kv in table.items() for x in kv)
    return F.try_element_at(F.expr(f"map({entries})"), key)


# ---------------------------------------------------------------- email ----


def email(c: Column) -> Column:
    return let(
        F.lower(trim(c)), lambda s: F.when(s.rlike(r"^[a-z0-9_][a-z0-9._%+-]*@[a-z0-9.-]+\.[a-z]{2,}$"), s)
    )


# ---------------------------------------------------------------- phone ----


def _plan_patterns(plans) -> tuple[str, str]:
    """(calling code followed by a trunk prefix, whole valid number), as two alternations."""
    with_trunk = sorted({f"{code}{trunk}" for code, trunk, _ in plans.values() if trunk and trunk != code})
    valid = sorted({f"{code}{pattern}" for code, _, pattern in plans.values()})
    strip = "|".join(f"{t[:-1]}(?={t[-1]})" for t in with_trunk)
    return strip, "^(?:" + "|".join(valid) + ")$"


def phone(c: Column, country: str = "US", plans=S.NUMBERING_PLANS) -> Column:
    """E.164 text of a valid number, else null.

    Numbers without a leading plus are national numbers of ``country``.
    Validity is decided by the numbering-plan table.
    """
    code, trunk, national = plans[country]
    strip, valid = _plan_patterns(plans)

    def home(d: Column) -> Column:
        chain = F.when(d.rlike(f"^{national}$"), F.concat(F.lit(code), d))
        if trunk:
            chain = chain.when(
                d.rlike(f"^{trunk}{national}$"), F.concat(F.lit(code), F.substring(d, len(trunk) + 1, 20))
            )
        return chain.when(d.rlike(f"^{code}{national}$"), d)

    def foreign(d: Column) -> Column:
        return let(F.regexp_replace(d, f"^({strip})0", "$1"), lambda n: F.when(n.rlike(valid), n))

    def parsed(s: Column) -> Column:
        plus = s.rlike(r"^\(?[+\uFF0B]")
        number = let(
            F.regexp_replace(s, "[^0-9]", ""), lambda d: F.when(plus, foreign(d)).otherwise(home(d))
        )
        usable = s.rlike(r"^[+\uFF0B(]*[0-9][0-9()./\-\u2010-\u2015" + WS + "]*$")
        return F.when(usable, F.concat(F.lit("+"), number))

    # From the first digit or plus on, without a trailing extension.
    start = F.regexp_extract(trim(c), r"(?s)[+\uFF0B(]*[0-9].*$", 0)
    return let(
        F.regexp_replace(start, r"(?i)\s*[;,]?\s*(?:ext\.?|extension|x|#)\s*[0-9]{1,7}$", ""), parsed
    )


# --------------------------------------------------------------- skills ----


def _title_word(w: Column) -> Column:
    return F.when(F.length(w) <= 2, F.upper(w)).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000_000)))
    )


def skill(c: Column, alias_first: bool = False, aliases: Mapping[str, str] = S.SKILL_ALIASES) -> Column:
    """Canonical spelling of one skill.

    Dotted words are refused before the alias table is asked; ``alias_first``
    asks the table first.
    """

    def clean(s: Column) -> Column:
        refused = (s == "") | s.rlike(r"(?i)^https?://|[@/]|\.[a-z]{2,}\b")
        alias = lookup(aliases, squeeze(F.lower(s)))
        other = F.when(s.rlike(r"^[A-Z0-9+#.]{2,}$"), s).otherwise(
            F.array_join(F.transform(F.split(s, _RUN), _title_word), " ")
        )
        if alias_first:
            return F.coalesce(alias, F.when(~refused, other))
        return F.when(~refused, F.coalesce(alias, other))

    return let(trim(c), clean)


def compact(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.isNotNull())


def skill_list(arr: Column, alias_first: bool = False, collation: str | None = None) -> Column:
    """Clean skills, one per case-insensitive spelling (first wins), sorted."""
    empty = F.array().cast("array<string>")
    unique = F.aggregate(
        compact(F.transform(F.coalesce(arr, empty), lambda x: skill(x, alias_first))),
        F.struct(empty.alias("seen"), empty.alias("kept")),
        lambda acc, x: F.when(F.array_contains(acc["seen"], F.lower(x)), acc).otherwise(
            F.struct(
                F.array_append(acc["seen"], F.lower(x)).alias("seen"), F.array_append(acc["kept"], x).alias("kept")
            )
        ),
        lambda acc: acc["kept"],
    )
    if collation:
        pairs = F.transform(unique, lambda x: F.struct(F.collate(x, collation).alias("k"), x.alias("v")))
        return F.transform(F.array_sort(pairs), lambda e: e["v"])
    return F.array_sort(unique)


# ---------------------------------------------------------------- dates ----


def month(c: Column) -> Column:
    """``YYYY-MM`` or ``present``. Month numbers are not range checked."""
    year_first, month_first, word_first = (
        r"^(\d{4})[-/](\d{1,2})$",
        r"^(\d{1,2})[-/](\d{4})$",
        r"^([a-z]+)\.?\s+(\d{4})$",
    )

    def read(s: Column) -> Column:
        def pair(pattern: str, year: int, mon: int) -> Column:
            return F.concat(
                F.regexp_extract(s, pattern, year), F.lit("-"), F.lpad(F.regexp_extract(s, pattern, mon), 2, "0")
            )

        number = lookup({k: f"{v:02d}" for k, v in S.MONTHS.items()}, F.regexp_extract(s, word_first, 1))
        return (
            F.when(s.isin("present", "current", "now"), F.lit("present"))
            .when(s.rlike(year_first), pair(year_first, 1, 2))
            .when(s.rlike(month_first), pair(month_first, 2, 1))
            .when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01")))
            .when(s.rlike(word_first), F.concat(F.regexp_extract(s, word_first, 2), F.lit("-"), number))
        )

    return let(F.lower(trim(c)), read)


# --------------------------------------------------------------- places ----


def country(c: Column, known_codes: tuple[str, ...] | None = None) -> Column:
    """Two-letter code. Any two letters pass unless ``known_codes`` lists those that may."""

    def read(s: Column) -> Column:
        two = F.upper(s)
        if known_codes is not None:
            known = F.when(two == "UK", F.lit("GB")).when(two.isin(*known_codes), two)
        else:
            known = two
        return F.when(s.rlike("^[a-z]{2}$"), known).otherwise(lookup(S.COUNTRY_CODES, s))

    return let(F.lower(trim(c)), read)


def location(c: Column, known_codes: tuple[str, ...] | None = None) -> Column:
    def build(s: Column, parts: Column) -> Column:
        n = F.size(parts)
        second, last = F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(-1))

        def assembled(code: Column) -> Column:
            return F.struct(
                F.try_element_at(parts, F.lit(1)).alias("city"),
                F.when((n > 2) | ((n == 2) & code.isNull()), second).alias("region"),
                code.alias("country"),
                s.alias("raw"),
            )

        return F.when(n > 0, let(F.when(n > 1, country(last, known_codes)), assembled))

    return let(
        trim(c),
        lambda s: let(
            F.filter(F.transform(F.split(s, ","), trim), lambda p: p != ""), lambda parts: build(s, parts)
        ),
    )


# ---------------------------------------------------------------- names ----


def name(c: Column) -> Column:
    return blank_to_null(F.initcap(squeeze(trim(c))))


# ----------------------------------------------------------------- URLs ----

_URL = r"(?is)^([a-z]+)://(?:[^/?#]*@)?([^/?#:@]*)(:[0-9]*)?([^?#]*)(\?[^#]*)?(?:#.*)?$"
_CUT = "\u0001"


def _percent(c: Column, characters: str) -> Column:
    for ch in characters:
        c = F.replace(c, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    return c


def url(c: Column) -> Column:
    """Origin + path without its last slash + query; null without a dotted host."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

    def rebuild(p: Column) -> Column:
        def part(i: int) -> Column:
            return F.try_element_at(p, F.lit(i))

        def checked(host: Column) -> Column:
            dotted = host.contains(".") & ~host.rlike(r"[\s<>^|%\[\]\"`{}]")
            numeric_end = host.rlike(r"(?:^|\.)[0-9]+\.?$")
            return F.when(dotted & (~numeric_end | host.rlike(rf"^{octet}(?:\.{octet}){{3}}$")), host)

        scheme = F.lower(part(1))
        default = F.when(scheme == "https", ":443").otherwise(":80")
        port = F.when(part(3).isin("", ":") | (part(3) == default), "").otherwise(part(3))
        path = _percent(F.regexp_replace(part(4), "/$", ""), ' "<>`{}')
        query = F.when(part(5) == "?", "").otherwise(_percent(part(5), ' "<>'))
        return F.concat(scheme, F.lit("://"), let(F.lower(part(2)), checked), port, path, query)

    def absolute(t: Column) -> Column:
        s = F.when(t.rlike(r"(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
        s = F.replace(F.translate(s, "\t\n\r", ""), F.lit("\\"), F.lit("/"))
        groups = F.regexp_replace(s, _URL, _CUT.join(f"${i}" for i in range(1, 6)))
        return let(F.split(groups, _CUT), rebuild)

    return let(trim(c), absolute)


def link_type(c: Column) -> Column:
    return let(
        F.lower(F.coalesce(c, F.lit(""))),
        lambda u: F.when(u.contains("linkedin.com"), "linkedin")
        .when(u.contains("github.com"), "github")
        .when(u.contains("twitter.com") | u.contains("x.com"), "twitter")
        .when(u.contains("stackoverflow.com"), "stackoverflow")
        .otherwise("other"),
    )


def link(c: Column) -> Column:
    """Clean URL with its class, or null."""
    return let(
        url(c), lambda u: F.when(u.isNotNull(), F.struct(u.alias("url"), link_type(u).alias("type")))
    )


def link_list(arr: Column) -> Column:
    return compact(F.transform(arr, link))


def github_handle(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?i)^https?://(?:www\.)?github\.com/([^/?#]+)(?:[/?#]|$)", 1)
    return let(
        found,
        lambda h: F.when(
            h.rlike(r"(?i)^[a-z0-9][a-z0-9-]{0,38}$") & ~F.lower(h).isin(*S.GITHUB_RESERVED), h
        ),
    )


def linkedin_handle(c: Column) -> Column:
    return blank_to_null(
        F.regexp_extract(c, r"(?i)^https?://(?:www\.)?linkedin\.com/in/([^/?#]+)(?:[/?#]|$)", 1)
    )


def name_from_slug(c: Column) -> Column:
    return let(
        F.filter(F.split(c, "-"), lambda p: p.rlike("^[a-zA-Z]+$")),
        lambda words: F.when(F.size(words) >= 2, F.initcap(F.array_join(F.slice(words, 1, 3), " "))),
    )


# -------------------------------------------------------------- numbers ----


def number(c: Column) -> Column:
    """Plain decimal text as a double; anything else is null."""
    plain = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
    return let(trim(c), lambda s: F.when(s.rlike(plain), s.try_cast("double")))


def years(c: Column, as_of_year: int | None = None) -> Column:
    """Years of experience: a number in [0, 80), or the span of a year range.

    An open range ends in ``as_of_year``; without that parameter it gives null,
    because results must not depend on the clock.
    """
    span = r"(?i)([0-9]{4}).*?([0-9]{4}|present|now|current)"

    def gap(s: Column) -> Column:
        start = F.regexp_extract(s, span, 1).try_cast("int")
        end = let(
            F.regexp_extract(s, span, 2),
            lambda e: F.when(e.rlike("^[0-9]{4}$"), e.try_cast("int")).when(e != "", F.lit(as_of_year).cast("int")),
        )
        return (end - start).cast("double")

    def sensible(v: Column, otherwise: Column | None = None) -> Column:
        ok = F.when((v >= 0) & (v < 80), v + F.lit(0.0))  # "-0" reads as zero, not as minus zero
        return ok if otherwise is None else ok.otherwise(otherwise)

    return let(trim(c), lambda s: let(number(s), lambda n: sensible(n, let(gap(s), sensible))))


# ------------------------------------------------------------------ ids ----


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def id_from_email(c: Column, strip: bool = True) -> Column:
    local = F.substring_index(c, "@", 1)
    body = slug(local) if strip else F.regexp_replace(F.lower(local), "[^a-z0-9]+", "_")
    return F.concat(F.lit("derived_"), body)


def id_from_name(c: Column) -> Column:
    return F.concat(F.lit("derived_"), slug(c))


def row_id(explicit: Column, email_text: Column, name_text: Column, row_number: Column) -> Column:
    """Id of a delimited row: explicit, from email, from name, else from its row number."""
    return F.coalesce(
        explicit,
        id_from_email(email_text),
        id_from_name(name_text),
        F.concat(F.lit("derived_row_"), row_number.cast("string")),
    )


def headline_from_bio(bio: Column, company: Column) -> Column:
    text = F.substring(trim(squeeze(bio)), 1, 140)
    return F.when(bio != "", text).when(company != "", F.concat(F.lit("Working at "), company))
