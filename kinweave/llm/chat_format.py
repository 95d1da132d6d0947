"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A raw record is a JSON text in some layout. Its nested field paths, in a fixed order
and without leaf types, are hashed; the hash selects a mapping that says where turns,
roles and texts are. Canonical turns are rendered with a template whose control strings
are escaped inside texts, with a loss mask over the assistant's texts, and can be read back.

Only built-in functions are used; nothing is shuffled. Records that do not parse, or
whose fingerprint no mapping has, get null turns. Null texts and roles are empty; empty
records have no turns and an empty text; very long texts are handled whole (Spark's limit of
a value applies); repeated rows are handled one by one; other columns are carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """``paths``: the field paths of the layout. Either ``turns`` names a list with role and text fields, or ``fields``
    lists (role, field) in the order of speaking."""

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    names: dict[str, str] = field(default_factory=dict)
    fields: tuple[tuple[str, str], ...] = ()

    @property
    def schema(self) -> str:
        if self.turns:
            return f"struct<`{self.turns}`:array<struct<`{self.role}`:string,`{self.text}`:string>>>"
        return "struct<" + ",".join(f"`{f}`:string" for _, f in self.fields) + ">"


MAPPINGS = (
    Mapping("messages", ("OBJECT<messages: ARRAY<OBJECT<content, role>>>", "OBJECT<messages: ARRAY>"), "messages", "role", "content"),
    Mapping("conversations", ("OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "OBJECT<conversations: ARRAY>"),
            "conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    Mapping("prompt", ("OBJECT<completion, prompt>",), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question", ("OBJECT<answer, question>",), fields=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("OBJECT<instruction, output>",), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("OBJECT<input, instruction, output>",),
            fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
)


def field_paths(raw: Column) -> Column:
    """The nested field names of a JSON text, sorted, without leaf types; null if it does not parse."""
    schema = F.schema_of_variant(F.try_parse_json(raw))
    return F.regexp_replace(F.regexp_replace(schema, "ARRAY<[A-Z]+>", "ARRAY"), ": (?!OBJECT|ARRAY)[A-Z]+([(][0-9,]*[)])?", "")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def _turn_of(m: Mapping):
    known = F.create_map(*[F.lit(x) for pair in m.names.items() for x in pair]) if m.names else None

    def turn(t):
        role = F.coalesce(t[m.role], F.lit(""))
        if known is not None:
            role = F.coalesce(known[role], role)
        return F.struct(role.alias("role"), F.coalesce(t[m.text], F.lit("")).alias("text"))

    return turn


def canonical(records: DataFrame, raw_col: str = "raw", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` (null if unknown) and ``turns``."""
    raw = F.col(raw_col)
    out = records.withColumn("_paths", field_paths(raw)) \
        .withColumn("fingerprint", F.when(F.col("_paths").isNotNull(), fingerprint(F.col("_paths"))))
    layout = turns = F.lit(None)
    for m in mappings:
        here = F.col("fingerprint").isin(*[fingerprint(F.lit(p)) for p in m.paths])
        value = F.from_json(raw, m.schema)
        if m.turns:
            found = F.transform(F.coalesce(value[m.turns], F.array().cast(f"array<struct<`{m.role}`:string,`{m.text}`:string>>")), _turn_of(m))
        else:
            found = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(value[f], F.lit("")).alias("text")) for role, f in m.fields])
        layout, turns = F.when(here, m.name).otherwise(layout), F.when(here, found).otherwise(turns)
    return out.withColumn("layout", layout.cast("string")).withColumn("turns", turns.cast(TURNS)).drop("_paths")


# ----------------------------------------------------------- template ----

HEAD, MID, TAIL = "### ", ": ", "</turn>\n"
#: Control strings and the escapes that stand for them inside texts; the escape sign itself goes first.
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, escapes=ESCAPES) -> Column:
    """Every escape sign is followed by its letter, so the pairs can be undone one kind after the other."""
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(turns: Column) -> Column:
    """struct<text, mask>: the formatted text, and per turn the (start, end) of its part under the loss mask.

    Offsets count code points from the start of the turn; they are null for turns that are not the assistant's.
    """
    pieces = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(HEAD), escape(t.role, ROLE_ESCAPES), F.lit(MID)).alias("head"), escape(t.text).alias("body"), t.role.alias("role")))
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p.head, p.body, F.lit(TAIL))), "")
    mask = F.transform(pieces, lambda p: F.when(p.role == "assistant", F.struct(
        F.length(p.head).alias("start"), (F.length(p.head) + F.length(p.body)).alias("end"))))
    return F.struct(text.alias("text"), mask.alias("mask"))


def pieces_of(text: Column) -> Column:
    """The formatted text cut at the ends of its turns."""
    parts = F.split(text, F.lit(TAIL), -1)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def read(text: Column) -> Column:
    """Canonical turns of a formatted text."""
    def turn(piece):
        at = F.instr(piece, MID)
        role = F.substr(piece, F.lit(len(HEAD) + 1), at - 1 - len(HEAD))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substr(piece, at + len(MID))).alias("text"))

    return F.transform(pieces_of(text), turn)


def under_mask(text: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask, one after the other."""
    both = F.arrays_zip(pieces_of(text).alias("piece"), mask.alias("mask"))
    kept = F.filter(both, lambda x: x.mask.isNotNull())
    return F.array_join(F.transform(kept, lambda x: unescape(
        F.substr(x.piece, x.mask.start + 1, x.mask.end - x.mask.start))), "")
