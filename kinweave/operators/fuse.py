"""Fusing the records of a candidate into one profile.

Everything starts from one long table of facts, (candidate_id, field, key) with
the summed weight and the sources behind it: one pre-aggregated shuffle serves
all eleven fields. Scalars are votes over their values, lists are unions over
their keys, and both are ordered by weight and then text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinweave import schema as S
from kinweave.functions import standardize as N
from kinweave.operators.skew import cut, position_within

ID = "candidate_id"
# Values of a long list that are written as one text before the texts are joined.
BLOCK_VALUES = 8192


# -------------------------------------------------------------- weights ----


def _trust(source: Column, i: int, other) -> Column:
    known = N.lookup({name: str(trust[i]) for name, trust in S.SOURCE_TRUST.items()}, source)
    return F.coalesce(known, F.lit(str(other))).cast(S.CONFIDENCE)


def source_weight(source: Column) -> Column:
    return _trust(source, 0, S.OTHER_WEIGHT)


def filled_confidence(source: Column, confidence: Column) -> Column:
    """The record's confidence, else the default of its source."""
    return F.coalesce(confidence.cast(S.CONFIDENCE), _trust(source, 1, S.OTHER_CONFIDENCE))


def vote_weight(source: Column, confidence: Column) -> Column:
    return (source_weight(source) * filled_confidence(source, confidence)).cast("decimal(8,6)")


# ---------------------------------------------------------------- facts ----

STRUCT_FIELDS = ("location", "links", "experience", "education")


def _json(c: str) -> str:
    return f"to_json({c}, map('ignoreNullFields', 'false'))"


# How a scalar is written as text. Numbers look as in JSON, without a trailing ``.0``.
_SCALAR_TEXT = {
    "full_name": "full_name",
    "headline": "headline",
    "location": _json("location"),
    "years_experience": "regexp_replace(cast(years_experience AS string), '[.]0$', '')",
    "candidate_id": "candidate_id",
}
# Key and text of a list item x.
_ITEM = {
    "emails": ("lower(x)", "x"),
    "phones": ("x", "x"),
    "links": ("lower(x.url)", _json("x")),
    "skills": ("lower(x)", "x"),
    "experience": (
        "concat(coalesce(lower(x.company), ''), '|', coalesce(lower(x.title), ''), '|', coalesce(x.start_date, ''))",
        _json("x"),
    ),
    "education": ("concat(coalesce(lower(x.institution), ''), '|', coalesce(lower(x.degree), ''))", _json("x")),
}


def _record_order(records: DataFrame) -> str:
    group = "group_seq, " if "group_seq" in records.columns else ""
    return f"struct({group}record_seq)"


def observations(records: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """(candidate_id, field, key, value, seq, source, w): one row per value of every record.

    ``seq`` orders all values: by record, then by place in the record's list, then by value.
    ``value`` is the plain text of a value, or the JSON text of a structure.
    ``fields`` keeps only what a later projection reads.
    """
    wanted = fields or (*S.SCALAR_FIELDS, *S.LIST_FIELDS)
    scalars = [f"struct('{f}' AS field, {t} AS key, {t} AS value, 0 AS item)" for f, t in _SCALAR_TEXT.items() if f in wanted]
    parts = [f"array({', '.join(scalars)})"] if scalars else []
    parts += [
        f"coalesce(transform({f}, (x, i) -> struct('{f}' AS field, {key} AS key, {text} AS value, i AS item)), array())"
        for f, (key, text) in _ITEM.items()
        if f in wanted
    ]
    return (
        records.where(F.col(ID) != "")
        .select(
            ID,
            "source",
            vote_weight(F.col("source"), F.col("confidence")).alias("w"),
            F.expr(_record_order(records)).alias("seq"),
            F.expr(f"explode(concat({', '.join(parts)}))").alias("o"),
        )
        .selectExpr(ID, "o.field", "o.key", "o.value", "struct(seq, o.item, o.value) AS seq", "source", "w")
        .where("trim(key) <> ''")
    )


def facts(records: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """(candidate_id, field, key, value, weight, sources): summed over all records.

    The spelling kept for a key is the one seen first.
    """
    return (
        observations(records, fields)
        .groupBy(ID, "field", "key")
        .agg(
            # ``seq`` ends with the value itself, so the smallest one carries it.
            F.min("seq").alias("first"),
            F.sum("w").cast(S.WEIGHT_SUM).alias("weight"),
            F.array_sort(F.collect_set("source")).alias("sources"),
        )
        .select(ID, "field", "key", F.col("first.value").alias("value"), "weight", "sources")
    )


def order_text(field: Column, value: Column) -> Column:
    """JSON text of a value: the tie-break after the weight."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    plain = F.concat(F.lit('"'), escaped, F.lit('"'))
    return F.when(field.isin(*STRUCT_FIELDS, "years_experience"), value).otherwise(plain)


def ordered_facts(fact_rows: DataFrame, collation: str | None = None) -> DataFrame:
    text = order_text(F.col("field"), F.col("value"))
    if collation:
        text = F.collate(text, collation)
    return fact_rows.select("*", (-F.col("weight")).alias("neg"), text.alias("text"))


# ------------------------------------------------- long, whole, no arrays ----


def field_totals(fact_rows: DataFrame) -> DataFrame:
    """(candidate_id, field, n, total, top): hash aggregation only, safe for any group size."""
    return (
        ordered_facts(fact_rows)
        .groupBy(ID, "field")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("weight").cast(S.WEIGHT_SUM).alias("total"),
            F.min(F.struct("neg", "text", "value", "sources")).alias("top"),
        )
    )


def items(fact_rows: DataFrame, collation: str | None = None) -> DataFrame:
    """(candidate_id, field, position, value, key, weight, sources): every value with its 0-based place in its field.

    The long form of :func:`profiles`, in the same order, for lists of any length: no group is sorted in one task.
    """
    placed = position_within(ordered_facts(fact_rows, collation), [ID, "field"], ["neg", "text", "value", "key"])
    return placed.select(ID, "field", "position", "value", "key", "weight", "sources")


def rounded(c: Column, digits: int = 3) -> Column:
    return F.round(c, digits).cast("double")


def share_of(weight: Column, total: Column) -> Column:
    return rounded(F.coalesce(F.try_divide(weight, total), F.lit(0)))


def capped_mean(total: Column, n: Column) -> Column:
    return F.least(F.lit(1.0), rounded(F.coalesce(F.try_divide(total, n), F.lit(0))))


def field_confidence(totals: DataFrame) -> DataFrame:
    """(candidate_id, field, confidence): vote share of scalars, mean item weight of lists."""
    scalar = F.col("field").isin(*S.SCALAR_FIELDS)
    return totals.select(
        ID,
        "field",
        F.when(scalar, share_of(-F.col("top.neg"), F.col("total")))
        .otherwise(capped_mean(F.col("total"), F.col("n")))
        .alias("confidence"),
    )


def overall_confidence(confidences: DataFrame) -> DataFrame:
    present = F.when(F.col("confidence") > 0, F.col("confidence").cast("decimal(10,3)"))
    return confidences.groupBy(ID).agg(
        rounded(F.coalesce(F.try_divide(F.sum(present), F.count(present)), F.lit(0))).alias("overall_confidence")
    )


# ------------------------------------------------------ profile in a row ----

_ENTRY = ["field", "neg", "text", "value", "key", "sources"]


# Entries lie in the order of their fields' names.
_IN_ORDER = tuple(sorted((*S.SCALAR_FIELDS, *S.LIST_FIELDS)))


def gather(fact_rows: DataFrame, collation: str | None = None) -> DataFrame:
    """(candidate_id, entries, counts): the facts of a candidate in one row, in order of field, weight and text.

    ``counts`` has the number of entries of each field, so that a field is a slice of the entries and none is
    searched for. A profile is one row and becomes one document, whatever the length of its lists; lists that no
    row could hold are in :func:`items`.
    """
    field = F.col("field")
    counts = [F.count_if(field == f).cast("int").alias(f"_n_{f}") for f in _IN_ORDER]
    return (
        ordered_facts(fact_rows.where(field.isin(*_IN_ORDER)), collation)
        .groupBy(ID)
        .agg(F.sort_array(F.collect_list(F.struct(*_ENTRY))).alias("entries"), *counts)
        .select(ID, "entries", F.struct(*[F.col(f"_n_{f}").alias(f) for f in _IN_ORDER]).alias("counts"))
    )


def _typed(field: str, text: str) -> str:
    """SQL that turns the text of a value back into its type."""
    if field == "years_experience":
        return f"cast({text} AS double)"
    if field in STRUCT_FIELDS:
        kind = S.CANONICAL_TYPES[field]
        kind = getattr(kind, "elementType", kind)
        columns = ", ".join(f"`{n}` STRING" for n in kind.names)
        return f"from_json({text}, '{columns}')"
    return text


def _whole_map(pairs: dict[str, str], kind: str) -> str:
    """SQL of a map of pairs whose values are never null."""
    inner = ", ".join(f"'{k}', {v}" for k, v in pairs.items())
    return f"cast(map({inner}) AS map<string,{kind}>)"


def _map_of(pairs: dict[str, str], kind: str) -> str:
    """SQL of a map holding the pairs whose value is not null."""
    each = ", ".join(f"struct('{k}' AS key, {v} AS value)" for k, v in pairs.items())
    return (
        f"map_from_entries(filter(cast(array({each}) AS array<struct<key:string,value:{kind}>>), "
        "p -> p.value IS NOT NULL))"
    )


NO_TEXTS = "cast(array() AS array<string>)"
ALTERNATE = "struct<value:string,sources:array<string>,weight:double>"
CONFLICT = f"struct<winner:string,winning_sources:array<string>,alternates:array<{ALTERNATE}>>"


def _rounded(sql: str) -> str:
    return f"cast(round(coalesce({sql}, 0), 3) AS double)"


# Mean of the field confidences above zero, in exact decimals.
_PRESENT = "transform(filter(map_values(field_confidence), c -> c > 0), c -> cast(c AS decimal(10,3)))"
_SUMMED = f"aggregate({_PRESENT}, cast(0 AS decimal(20,3)), (a, c) -> cast(a + c AS decimal(20,3)))"
_OVERALL = _rounded(f"try_divide({_SUMMED}, size({_PRESENT}))")


def profiles(gathered: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """One nested profile per row of :func:`gather`: values, provenance, confidences, conflicts.

    Pure projection. Columns come in canonical order.
    """
    wanted = fields or (*S.SCALAR_FIELDS, *S.LIST_FIELDS)
    scalars = [f for f in S.SCALAR_FIELDS if f in wanted]
    lists = [f for f in S.LIST_FIELDS if f in wanted]
    before = lambda f: " + ".join(f"counts.{g}" for g in _IN_ORDER if g < f) or "0"
    split = gathered.selectExpr(
        ID, "counts", *[f"slice(entries, 1 + {before(f)}, counts.{f}) AS _{f}" for f in (*scalars, *lists)]
    )
    total = "aggregate(_{0}, cast(0 AS decimal(38,6)), (a, e) -> cast(a - e.neg AS decimal(38,6)))"
    tops = split.selectExpr("*", *[f"get(_{f}, 0) AS _top_{f}" for f in scalars])
    confidence = {
        f: _rounded(f"try_divide(-_top_{f}.neg, {total.format(f)})") for f in scalars
    } | {
        f: f"least(1.0D, {_rounded(f'try_divide({total.format(f)}, cast(counts.{f} AS bigint))')})" for f in lists
    }
    parts = tops.selectExpr("*", *[f"{c} AS _c_{f}" for f, c in confidence.items()])
    values = [
        f if f == ID else f"{_typed(f, f'_top_{f}.value')} AS {f}" for f in scalars
    ] + [f"transform(_{f}, e -> {_typed(f, 'e.value')}) AS {f}" if f in STRUCT_FIELDS else f"_{f}.value AS {f}" for f in lists]
    # The winner is the first entry, everything else lost.
    alternate = "e -> struct(e.value AS value, e.sources AS sources, cast(round(-e.neg, 3) AS double) AS weight)"
    contested = {
        f: f"CASE WHEN counts.{f} > 1 THEN struct(_top_{f}.value AS winner, "
        f"coalesce(_top_{f}.sources, {NO_TEXTS}) AS winning_sources, "
        f"transform(slice(_{f}, 2, greatest(counts.{f}, 1)), {alternate}) AS alternates) END"
        for f in scalars
    }
    # Mean of the field confidences above zero, in exact decimals.
    summed = " + ".join(f"cast(greatest(_c_{f}, 0D) AS decimal(10,3))" for f in confidence)
    present = " + ".join(f"if(_c_{f} > 0, 1, 0)" for f in confidence)
    return parts.selectExpr(
        *values,
        f"{_whole_map({f: f'coalesce(_top_{f}.sources, {NO_TEXTS})' for f in scalars}, 'array<string>')} AS scalar_provenance",
        f"{_whole_map({f: f'map_from_arrays(_{f}.key, _{f}.sources)' for f in lists}, 'map<string,array<string>>')} AS list_provenance",
        f"{_whole_map({f: f'_c_{f}' for f in confidence}, 'double')} AS field_confidence",
        f"{_map_of(contested, CONFLICT)} AS conflicts",
        f"{_rounded(f'try_divide(cast({summed} AS decimal(20,3)), {present})')} AS overall_confidence",
    )


# ------------------------------------------------- profile with long lists ----


def list_texts(fact_rows: DataFrame, collation: str | None = None) -> DataFrame:
    """(candidate_id, field, n, total, text): a list as the members of its JSON text, in order.

    Values become text in blocks of ``BLOCK_VALUES``, so what a row holds at once is its text and never an array of
    all entries.
    """
    member = F.struct("position", "value")
    written = F.to_json(F.transform(F.sort_array(F.collect_list(member)), lambda x: x["value"]))
    structure = F.col("field").isin(*STRUCT_FIELDS)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(member)), lambda x: x["value"]), ",")
    blocks = (
        items(fact_rows, collation)
        .groupBy(ID, "field", F.floor(F.col("position") / BLOCK_VALUES).alias("block"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("weight").cast(S.WEIGHT_SUM).alias("total"),
            F.when(structure, joined).otherwise(F.substr(written, F.lit(2), F.length(written) - 2)).alias("text"),
        )
    )
    texts = F.sort_array(F.collect_list(F.struct("block", "text")))
    return blocks.groupBy(ID, "field").agg(
        F.sum("n").alias("n"), F.sum("total").cast(S.WEIGHT_SUM).alias("total"),
        F.array_join(F.transform(texts, lambda b: b["text"]), ",").alias("text"),
    )


def long_profiles(fact_rows: DataFrame, fields: tuple[str, ...] | None = None, collation: str | None = None) -> DataFrame:
    """:func:`profiles` for lists of any length a text can hold: each list is (n, text) with its JSON text, without list provenance."""
    wanted = fields or (*S.SCALAR_FIELDS, *S.LIST_FIELDS)
    scalars = tuple(f for f in S.SCALAR_FIELDS if f in wanted)
    lists = tuple(f for f in S.LIST_FIELDS if f in wanted)
    kept = cut(fact_rows.where(F.col("field").isin(*wanted)))
    heads = profiles(gather(kept.where(F.col("field").isin(*S.SCALAR_FIELDS)), collation), scalars)
    of = lambda f: F.max(F.when(F.col("field") == f, F.struct("n", "total", "text"))).alias(f)
    said = list_texts(kept.where(F.col("field").isin(*lists)), collation).groupBy(ID).agg(*[of(f) for f in lists])
    confidence = [F.struct(F.lit(f).alias("key"), capped_mean(F.col(f"{f}.total"), F.col(f"{f}.n")).alias("value")) for f in lists]
    shown = [F.struct(F.coalesce(f"{f}.n", F.lit(0)).alias("n"), F.concat(F.lit("["), F.coalesce(f"{f}.text", F.lit("")), F.lit("]")).alias("text")).alias(f) for f in lists]
    out = heads.join(said, ID, "left").select(
        *scalars, *shown, "scalar_provenance",
        F.map_concat("field_confidence", F.map_from_entries(F.array(*confidence))).alias("field_confidence"), "conflicts",
    )
    return out.selectExpr("*", f"{_OVERALL} AS overall_confidence")


def latest_meta(records: DataFrame) -> DataFrame:
    """Last enrichment metadata of every candidate, in record order."""
    order = F.expr(_record_order(records))
    gh, li = F.col("github_meta"), F.col("linkedin_meta")
    return (
        records.where((F.col(ID) != "") & (gh.isNotNull() | li.isNotNull()))
        .groupBy(ID)
        .agg(
            F.max_by(gh, F.when(gh.isNotNull(), order)).alias("github_meta"),
            F.max_by(li, F.when(li.isNotNull(), order)).alias("linkedin_meta"),
        )
    )
