"""Projecting profiles onto an output configuration.

A configuration is compiled on the driver into a list of columns; the job itself
is one projection.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from kinweave.functions import standardize as N
from kinweave.operators.skew import cut
from kinweave.plans.config import checked, declared_fields, path_parts, root_of
from kinweave import schema as S

def _step(value: Column, kind: T.DataType, part: str | int) -> tuple[Column, T.DataType] | None:
    if isinstance(part, int):
        if isinstance(kind, T.ArrayType):
            return F.try_element_at(value, F.lit(part + 1)), kind.elementType
        return None
    if isinstance(kind, T.StructType):
        return (value[part], kind[part].dataType) if part in kind.names else None
    if isinstance(kind, T.MapType):
        return F.try_element_at(value, F.lit(part)), kind.valueType
    if isinstance(kind, T.ArrayType) and part == "length":
        return F.size(value), T.IntegerType()
    return None


def path(df: DataFrame, expression: str) -> tuple[Column, T.DataType]:
    """Column for ``a.b[0].c``; a path that leads nowhere gives null."""
    nowhere = (F.lit(None).cast("string"), T.StringType())
    parts = path_parts(expression)
    if not parts:
        return nowhere
    if parts[0] == "provenance" and len(parts) > 1:
        column = "scalar_provenance" if parts[1] in S.SCALAR_FIELDS else "list_provenance"
        parts = [column, *parts[1:]]
    root = parts[0]
    allowed = {*S.CANONICAL_TYPES, "scalar_provenance", "list_provenance", "overall_confidence"}
    if root not in df.columns or root not in allowed:
        return nowhere
    value, kind = F.col(root), df.schema[root].dataType
    for part in parts[1:]:
        stepped = _step(value, kind, part)
        if stepped is None:
            return nowhere
        value, kind = stepped
    return value, kind


def normalized(value: Column, kind: T.DataType, normalizer: str | None, country: str = "US") -> Column:
    """Apply a named normaliser; phone, email and skill also take lists."""
    if normalizer is None:
        return value
    is_list = isinstance(kind, T.ArrayType)
    is_text = isinstance(kind, T.StringType)
    text = value if is_text else value.cast("string")
    if normalizer == "phone":
        return F.transform(value, lambda v: N.phone(v, country)) if is_list else N.phone(text, country)
    if normalizer == "email":
        return F.transform(value, N.email) if is_list else N.email(text)
    if normalizer == "skill":
        return N.skill_list(value) if is_list else N.skill(text)
    if normalizer in ("lowercase", "uppercase"):
        change = F.lower if normalizer == "lowercase" else F.upper
        return change(value) if is_text else value
    return {"name": N.name, "date": N.month, "country": N.country}[normalizer](text)


def _missing(value: Column, kind: T.DataType) -> Column:
    gone = value.isNull()
    return gone | (F.size(value) == 0) if isinstance(kind, T.ArrayType) else gone


def project(profiles: DataFrame, config: dict | None = None, country: str = "US", keep: tuple[str, ...] | None = None) -> DataFrame:
    """One output row per profile: declared keys, then provenance, confidences and conflicts.

    Missing values follow ``missing_policy``: ``null`` gives null, ``omit`` gives
    null here and no key in :func:`documents`, ``error`` stops the job. ``keep`` names further columns
    of the profile to carry along, and has the id carried as ``_id``.
    """
    cfg = checked(config)
    policy = cfg.get("missing_policy") or "null"
    with_prov = cfg.get("include_provenance") is not False
    with_conf = cfg.get("include_confidence") is not False
    outputs, scalar_prov, list_prov, confidences, absent = [], [], [], [], []

    def entry(key: str, value: Column, shown: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.when(shown, value).alias("value"))

    for field in declared_fields(cfg):
        key = field["key"]
        source = field.get("from") or key
        value, kind = path(profiles, source)
        value = normalized(value, kind, field.get("normalize"), country)
        kind = T.ArrayType(T.StringType()) if isinstance(kind, T.ArrayType) and field.get("normalize") else kind
        missing = _missing(value, kind)
        if policy == "error":
            stop = F.raise_error(F.lit(f"Missing required field for output: {key}"))
            out = F.when(missing, stop.cast(profiles.select(value).schema[0].dataType)).otherwise(value)
        else:
            out = F.when(~missing, value)
        outputs.append(out.alias(key))
        absent.append(F.when(missing, F.lit(key)))
        shown = ~missing if policy == "omit" else F.lit(True)
        root = root_of(source)
        if root in S.SCALAR_FIELDS:
            scalar_prov.append(entry(key, F.try_element_at("scalar_provenance", F.lit(root)), shown))
        if root in S.LIST_FIELDS:
            list_prov.append(entry(key, F.try_element_at("list_provenance", F.lit(root)), shown))
        if root in S.CANONICAL_TYPES:
            confidences.append(entry(key, F.try_element_at("field_confidence", F.lit(root)), shown))

    def as_map(entries: list[Column], kind: str) -> Column:
        # Without a cast: it would write every map and list of the entries anew.
        if not entries:
            return F.map_from_entries(F.array().cast(f"array<struct<key:string,value:{kind}>>"))
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))

    extra = []
    if with_prov:
        extra.append(
            F.struct(
                as_map(scalar_prov, "array<string>").alias("scalars"),
                as_map(list_prov, "map<string,array<string>>").alias("lists"),
            ).alias("provenance")
        )
    if with_conf:
        extra += [
            as_map(confidences, "double").alias("field_confidence"),
            F.coalesce("overall_confidence", F.lit(0.0)).alias("overall_confidence"),
            F.when(F.size("conflicts") > 0, F.col("conflicts")).alias("conflicts"),
        ]
    declared = [f["key"] for f in declared_fields(cfg)]
    id_column = [] if "candidate_id" in declared else [F.col("candidate_id")]
    carried = [] if keep is None else [F.col("candidate_id").alias("_id"), *keep]
    return profiles.select(
        *carried, *id_column, *outputs, *extra,
        N.compact(F.array(*absent)).alias("missing_keys"),
    )


def output_validation(profiles: DataFrame, config: dict | None = None) -> DataFrame:
    """(candidate_id, valid, errors): does every written document have its declared keys?"""
    return documents(profiles, config).select("candidate_id", "valid", "errors")


def _key_errors(output: Column, cfg: dict) -> Column:
    """A line per declared key that the document lacks; under ``omit`` keys may lack."""
    if (cfg.get("missing_policy") or "null") == "omit":
        return F.array().cast("array<string>")
    there = F.json_object_keys(output)
    wanted = F.array(*[F.lit(f["key"]) for f in cfg.get("fields") or []]).cast("array<string>")
    return F.transform(F.array_except(wanted, there), lambda k: F.format_string("output lacks the key %s", k))


def validated(written: DataFrame, config: dict) -> DataFrame:
    """Documents with ``valid`` and ``errors`` as another configuration than their own sees them."""
    return written.withColumn("errors", _key_errors(F.col("output"), config)).withColumn("valid", F.size("errors") == 0)


class Quarantine(NamedTuple):
    outputs: DataFrame   # rows that have all demanded values
    rejected: DataFrame  # (candidate_id, errors) of the others
    counts: dict         # {"passed": n, "rejected": n}


def quarantine(profiles: DataFrame, config: dict, country: str = "US") -> Quarantine:
    """The ``error`` policy without ending the job: rows that lack a declared value are set apart with the reasons.

    Profiles are projected once and written to the shared folder; the counts come from that pass.
    """
    cfg = dict(config, missing_policy="null")
    bad = F.size("missing_keys") > 0
    seen = Observation()
    out = project(profiles, cfg, country, keep=()).observe(
        seen, F.count_if(~bad).alias("passed"), F.count_if(bad).alias("rejected"))
    kept = cut(out)
    plain = [c for c in kept.columns if c not in ("_id", "missing_keys")]
    reasons = F.transform("missing_keys", lambda k: F.concat(F.lit("Missing required field for output: "), k))
    return Quarantine(
        kept.where(~bad).select(*plain), kept.where(bad).select(F.col("_id").alias("candidate_id"), reasons.alias("errors")), dict(seen.get))


def _document(out: DataFrame, cfg: dict, carried: tuple[str, ...], texts: dict[str, Column] | None = None) -> Column:
    """The JSON text of an output row: keys without a value are left out under ``omit``, ``conflicts`` always.

    ``texts`` gives the JSON text of keys whose value is none of the row's own.
    """
    declared = {f["key"] for f in declared_fields(cfg)}
    fields = [c for c in out.columns if c not in ("missing_keys", "_id", *carried) and (c != "candidate_id" or c in declared)]
    omit = (cfg.get("missing_policy") or "null") == "omit"

    def text_of(names: list[str]) -> Column:
        return F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})

    def member(c: str) -> Column:
        # Bound once: inside a condition the optimizer does not share what is used twice.
        pair = N.let(text_of([c]), lambda t: F.substr(t, F.lit(2), F.length(t) - 2))
        if texts and c in texts:
            pair = F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(json.dumps(c, ensure_ascii=False) + ":"), texts[c])).otherwise(pair)
        leaves = omit if c in declared else c == "conflicts"
        return F.when(F.col(f"`{c}`").isNotNull(), pair) if leaves else pair

    if omit or texts:
        return F.concat(F.lit("{"), F.array_join(F.array(*[member(c) for c in fields]), ","), F.lit("}"))
    # No key leaves but the conflicts, which come last: the row is written as one object.
    whole = [c for c in fields if c != "conflicts" or c in declared]
    if not fields:
        return F.lit("{}")
    if whole == fields:
        return text_of(fields)
    if not whole:
        return F.coalesce(F.when(F.col("conflicts").isNotNull(), text_of(fields)), F.lit("{}"))
    return N.let(
        F.array(text_of(whole), F.when(F.col("conflicts").isNotNull(), text_of(["conflicts"]))),
        lambda t: F.when(t[1].isNull(), t[0]).otherwise(F.concat(F.substr(t[0], F.lit(1), F.length(t[0]) - 1), F.lit(","), F.substr(t[1], F.lit(2)))))


def documents(profiles: DataFrame, config: dict | None = None, country: str = "US", keep: tuple[str, ...] = ()) -> DataFrame:
    """(candidate_id, output, valid, errors): each output as a JSON text, with the columns ``keep`` of the profile.

    This is where ``omit`` shows: keys without a value are left out of the text, nulls inside
    a value stay. ``conflicts`` is left out under every policy where there is none.
    """
    cfg = config or {}
    out = project(profiles, cfg, country, keep)
    done = out.select(F.col("_id").alias("candidate_id"), *keep, _document(out, cfg, keep).alias("output"))
    return done.withColumn("errors", _key_errors(F.col("output"), cfg)).select(
        "candidate_id", *keep, "output", (F.size("errors") == 0).alias("valid"), "errors")


def long_documents(profiles: DataFrame, config: dict) -> DataFrame:
    """(candidate_id, output, and the columns of the profile): documents of :func:`kinweave.operators.fuse.long_profiles`.

    Lists go in as the texts they are, so only whole lists can be asked for, and no list provenance.
    """
    cfg = checked(config)
    lists = {f["key"]: f.get("from") or f["key"] for f in declared_fields(cfg) if root_of(f.get("from") or f["key"]) in S.LIST_FIELDS}
    whole = all(root in S.LIST_FIELDS for root in lists.values()) and not any(f.get("normalize") for f in declared_fields(cfg) if f["key"] in lists)
    if not whole or cfg.get("include_provenance") is not False:
        raise ValueError("documents of long lists hold whole lists as they are, without provenance")
    # One value stands for a list that has any, which is all that a missing policy asks.
    stands = {f: F.when(F.col(f"{f}.n") > 0, F.array(F.lit(""))).alias(f) for f in S.LIST_FIELDS if f in profiles.columns}
    held = profiles.withColumn("_profile", F.struct(*profiles.columns)).select(
        *[stands.get(c, F.col(c)) for c in profiles.columns], "_profile")
    out = project(held, cfg, keep=("_profile",))
    texts = {key: F.col(f"_profile.{root}.text") for key, root in lists.items()}
    return out.select("_profile.*", _document(out, cfg, ("_profile",), texts).alias("output"))


def results(profiles: DataFrame, config: dict | None = None, country: str = "US") -> DataFrame:
    """(candidate_id, canonical, output, validation): what the result sink writes per profile, fused once."""
    whole = profiles.withColumn("_canonical", F.struct(*profiles.columns))
    return documents(whole, config, country, keep=("_canonical",)).select(
        "candidate_id", F.col("_canonical").alias("canonical"), F.parse_json("output").alias("output"),
        F.struct("valid", "errors").alias("validation"))
