"""Folder input: discovery, type detection, per-type readers, ingest report and the result sink."""

from __future__ import annotations

import csv
import re
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from kinweave import schema as S
from kinweave.operators.skew import cut, cut_counted, join_counted
from kinweave.sources import records as R

# Header tables of up to so many files are sent to every task; larger ones are joined through a shuffle.
SENT_FILES = 20_000
# JSON files above this are read by several tasks.
SPLIT_BYTES = 8 << 20
# Text of a large JSON array that is parsed at once, about.
ARRAY_CHUNK = 1 << 20
DELIMITED, JSON, NOTES, LABELLED, FREE_TEXT = "recruiter_csv", "ats_json", "recruiter_notes", "resume", "resume_doc"


def detect_source(name: Column, document_first: bool = False) -> Column:
    """Source kind from a file name, null when the file is to be ignored.

    ``document_first`` is the order used for content handed over in memory.
    """
    n = F.lower(name)
    document = n.rlike(r"[^/]\.(?:pdf|docx|doc)$")
    chain = F.when(document, FREE_TEXT) if document_first else F
    return (
        chain.when(n.endswith(".csv"), DELIMITED)
        .when(n.endswith(".json"), JSON)
        .when(n.contains("notes"), NOTES)
        .when(document, FREE_TEXT)
        .when(n.endswith(".txt"), LABELLED)
    )


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Every file under a folder: (file, source_kind, length). Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listing = found.select("path", "length")
    # A scan leaves empty files out; the listing on the driver, which Spark keeps anyway, has them.
    named = [re.sub("^file:/+", "file:/", unquote(name)) for name in found.inputFiles()]
    if len(named) != listing.count():
        every = spark.createDataFrame([(name,) for name in named], "path string")
        listing = listing.unionByName(every.join(listing, "path", "left_anti").withColumn("length", F.lit(0).cast("long")))
    name = F.element_at(F.split("path", "/"), -1)
    return listing.select(F.col("path").alias("file"), detect_source(name).alias("source_kind"), "length")


def _text_files(spark: SparkSession, path: str, glob: str, kind: str, at_most: int | None = None, **options) -> DataFrame:
    """Text rows of the files of one kind and of up to ``at_most`` bytes, with their position in the input order."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    for k, v in options.items():
        reader = reader.option(k, v)
    return (
        reader.format("text")
        .load(path)
        .where(detect_source(F.col("_metadata.file_name")) == kind)
        .where(F.lit(True) if at_most is None else F.col("_metadata.file_size") <= at_most)
        .select(
            "value",
            F.col("_metadata.file_name").alias("file_name"),
            R.seq(
                F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id(),
            ).alias("record_seq"),
        )
    )


def read_json(
    spark: SparkSession, path: str, lines: bool = False, country: str = "US", split_bytes: int = SPLIT_BYTES,
    listed: DataFrame | None = None,
) -> DataFrame:
    """JSON people lists. Arrays in files of more than ``split_bytes`` are cut between their elements and read
    by several tasks, with the records of the whole text. ``lines`` reads one person per line. ``listed`` is the
    listing of :func:`discover`, where it was made before."""
    glob = "*.[jJ][sS][oO][nN]"
    if lines:
        return R.json_records(_text_files(spark, path, glob, JSON, wholetext=False), country=country)
    listed = discover(spark, path) if listed is None else listed
    large = not listed.where((F.col("source_kind") == JSON) & (F.col("length") > split_bytes)).isEmpty()
    texts = _text_files(spark, path, glob, JSON, at_most=split_bytes if large else None, wholetext=True)
    if large:
        texts = texts.select("value", "record_seq").unionByName(array_texts(spark, path, glob, more_than=split_bytes))
    return R.json_records(texts, country=country)


def _array_parts(
    spark: SparkSession, path: str, glob: str, more_than: int = -1, chunk: int | None = None, any_name: bool = False,
) -> DataFrame:
    """(file, part, value, ends): large JSON files as texts of whole elements, each an array of about ``chunk`` bytes.

    Files are read as pieces that end in ``}``, by as many tasks as they have splits. A piece says by how much it
    changes the depth of brackets, for both cases that it begins inside a string or outside; sums over the
    pieces of a split and then over the splits of a file give the depth behind every piece. Behind a brace
    that brings an array's depth back to 1 an element ends. A file that is no array is one text; ``ends``
    says that the part is the last of a whole array, or no array.
    """
    here = ["file", "block"]
    text = F.regexp_replace("value", r"(?s)\\.", "")
    count = lambda c, letters: F.length(c) - F.length(F.translate(c, letters, ""))
    quotes = count(text, '"')

    def change(begins_inside: bool) -> Column:
        bare = F.regexp_replace(F.concat(F.lit('"'), text) if begins_inside else text, '"[^"]*("|$)', "")
        closes = F.when((quotes + int(begins_inside)) % 2 == 0, 1).otherwise(0)  # the brace behind the piece
        return (count(bare, "{[") - count(bare, "]") - closes).cast("long")

    pieces = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "}").format("text").load(path)
        .where((F.lit(any_name) | (detect_source(F.col("_metadata.file_name")) == JSON)) & (F.col("_metadata.file_size") > more_than))
        .select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("pos"), "value",
            (quotes % 2).alias("flip"), change(False).alias("from_out"), change(True).alias("from_in"), F.octet_length("value").cast("long").alias("size"))
    )
    inside = W.partitionBy(*here).orderBy("pos")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    to_here = inside.rowsBetween(W.unboundedPreceding, 0)
    odd = F.coalesce(F.sum("flip").over(before), F.lit(0)) % 2 == 1
    summed = cut(
        pieces.withColumn("odd", odd)
        .withColumn("if_out", F.when(F.col("odd"), F.col("from_in")).otherwise(F.col("from_out")))
        .withColumn("if_in", F.when(F.col("odd"), F.col("from_out")).otherwise(F.col("from_in")))
        .select(*here, "file_size", "pos", "value", "flip", "size",
                F.sum("if_out").over(to_here).alias("depth_out"), F.sum("if_in").over(to_here).alias("depth_in"),
                (F.sum("flip").over(to_here) % 2).alias("odd_after"), F.sum(F.col("size") + 1).over(to_here).alias("end"))
    )
    # One row for each split of a file.
    blocks = summed.groupBy(*here).agg(
        F.sum("flip").alias("flip"), F.max_by("depth_out", "pos").alias("depth_out"), F.max_by("depth_in", "pos").alias("depth_in"),
        F.max("end").alias("bytes"), F.min_by(F.regexp_extract("value", r"\S", 0), "pos").alias("opens"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        blocks.withColumn("starts_odd", F.coalesce(F.sum("flip").over(earlier), F.lit(0)) % 2)
        .withColumn("own", F.when(F.col("starts_odd") == 1, F.col("depth_in")).otherwise(F.col("depth_out")))
        .select(*here, "starts_odd", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("depth"),
                F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"),
                (F.first("opens").over(W.partitionBy("file").orderBy("block")) == "[").alias("is_array"))
    )
    deep = F.col("depth") + F.when(F.col("starts_odd") == 1, F.col("depth_in")).otherwise(F.col("depth_out"))
    outside = (F.col("odd_after") + F.col("starts_odd")) % 2 == 0
    placed = cut(
        summed.join(starts, here).select(
            *here, "file_size", "pos", "value", "size", "is_array", deep.alias("depth"),
            F.when(F.col("is_array") & outside & (deep == 1), F.col("base") + F.col("end")).alias("cut"))
        .withColumn("last_cut", F.max("cut").over(before))
    )
    # Where the last element before a split's first one ended.
    carried = placed.groupBy(*here).agg(F.max("cut").alias("cut")).select(*here, F.max("cut").over(earlier).alias("carried"))
    part = F.floor(F.coalesce("last_cut", "carried", F.lit(0)) / (chunk or ARRAY_CHUNK))
    texts = (
        placed.join(carried, here).withColumn("part", part)
        .groupBy("file", "part")
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "pos", "value"))), lambda x: x.value), "}").alias("text"),
            F.first("is_array").alias("is_array"), F.min("depth").alias("least"), F.sum("size").alias("size"),
            F.count(F.lit(1)).alias("pieces"), F.first("file_size").alias("file_size"))
    )
    # The last piece of a file has no brace behind it, so a whole array ends one below its start.
    ends = F.col("is_array") & (F.col("least") == -1)
    body = F.regexp_replace(F.when(F.col("part") == 0, F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.regexp_replace("text", r"^\s*,", "")),
                            r"\s+$", "")
    body = F.when(ends & body.endswith("]"), body.substr(F.lit(1), F.length(body) - 1)) \
        .when(ends, F.lit("no array")).otherwise(F.concat(body, F.lit("}")))
    whole = F.concat("text", F.when(F.col("file_size") - F.col("size") >= F.col("pieces"), "}").otherwise(""))
    return cut(texts.select(
        "file", "part", F.when(F.col("is_array"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(whole).alias("value"),
        (ends | ~F.col("is_array")).alias("ends")))


def array_texts(spark: SparkSession, path: str, glob: str, **how) -> DataFrame:
    """(value, record_seq): large JSON files as texts of about a megabyte, see :func:`_array_parts`.

    A file of which any part does not parse, or that goes on behind its array, gives none.
    ``any_name`` also takes files that are not named as JSON.
    """
    parts = _array_parts(spark, path, glob, **how)
    good = parts.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.try_parse_json("value").isNotNull()).alias("parses"), F.bool_or("ends").alias("ends"),
    ).where("parses AND ends").select("file", "n")
    return join_counted(parts, good, ["file"]).select("value", R.seq(F.col("file"), F.col("part")).alias("record_seq"))


def read_notes(spark: SparkSession, path: str, country: str = "US") -> DataFrame:
    """Note blocks. Files are cut at separator lines while reading, so large ones split;
    separators with blanks around them are handled inside each piece."""
    return R.note_records(
        _text_files(spark, path, "*[nN][oO][tT][eE][sS]*", NOTES, lineSep="\n---\n"), country=country
    )


def read_labelled(spark: SparkSession, path: str, country: str = "US") -> DataFrame:
    return R.labelled_records(
        _text_files(spark, path, "*.[tT][xX][tT]", LABELLED, wholetext=True), country=country
    )


def read_free_text(spark: SparkSession, path: str, country: str = "US") -> DataFrame:
    """Documents whose text was extracted beforehand, kept under their original names."""
    return R.free_text_records(
        _text_files(spark, path, "*.{[pP][dD][fF],[dD][oO][cC],[dD][oO][cC][xX]}", FREE_TEXT, wholetext=True),
        country=country,
    )


def _cell_rows(spark: SparkSession, path: str | list[str], width: int, multi_line: bool, raw_text: str | None = None) -> DataFrame:
    """Rows of people lists below their headers: ``width`` texts (``_c0``, ...) and the position.

    ``raw_text`` names a further column with the text of rows that have another number of cells.
    """
    columns = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    if raw_text:
        columns = columns.add(raw_text, T.StringType())
    raw = (
        spark.read.schema(columns).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .options(header=True, multiLine=multi_line, quote='"', escape='"', mode="PERMISSIVE")
        .options(ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **({"columnNameOfCorruptRecord": raw_text} if raw_text else {}))
        .csv(path)
    )
    return raw.select(
        "*",
        R.seq(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ).alias("record_seq"),
    )


def _with_row_number(rows: DataFrame, some: DataFrame) -> DataFrame:
    """``some`` of the rows with ``_row_number``, the 1-based place in their file below the header."""
    at = [F.col("record_seq.origin").alias("_file"), F.col("record_seq.block").alias("_block")]
    blocks = rows.groupBy(*at).agg(
        F.min("record_seq.pos").alias("_base"), F.count(F.lit(1)).alias("_rows")
    )
    before = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    return (
        some.select("*", *at)
        .join(offsets, ["_file", "_block"])
        .withColumn("_row_number", F.col("record_seq.pos") - F.col("_base") + F.col("_before") + 1)
        .drop("_file", "_block", "_base", "_rows", "_before")
    )


def _numbered(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with the row number in the file for rows without id, name and email; only these are joined."""
    named = F.coalesce("candidate_id", "email", "name")
    keyed = targets.where(named.isNotNull()).withColumn("_row_number", F.lit(None).cast("long"))
    return keyed.unionByName(_with_row_number(rows, targets.where(named.isNull())))


def _with_header(rows: DataFrame, headers: DataFrame, n: int) -> DataFrame:
    """Rows with the columns of their file's header: sent where files are few, else joined; a file's size stands for its rows."""
    placed = rows.withColumn("file", F.col("record_seq.origin"))
    if n <= SENT_FILES:
        return placed.join(F.broadcast(headers.drop("bytes")), "file")
    return join_counted(placed, headers, ["file"], count="bytes")


class Headers(NamedTuple):
    table: DataFrame  # header_table, written to the shared folder
    files: int
    width: int        # cells of the longest header


def read_headers(spark: SparkSession, path: str | list[str]) -> Headers:
    """The headers of all people lists; a listing of the folder and a pass over its lists, so made once for all their readers."""
    table, n = cut_counted(header_table(spark, path))
    return Headers(table, n, table.select(F.max("width")).first()[0] or 1)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    multi_line: bool = True,
    as_of_year: int | None = None,
    country: str = "US",
    header: str | None = None,
    headers: Headers | None = None,
) -> DataFrame:
    """People lists, each with the columns that its own header names, or all with those of ``header``.

    Whatever the number of files and headers, rows are read by one scan as arrays of cells and
    meet the places of their file's header in a table. Columns are told apart by position, so
    names may occur twice. ``multi_line=False`` splits large files; it needs files without line
    breaks inside quotes. Rows without id, name and email are named after their row number.
    ``headers`` is what :func:`read_headers` gave, where it was called before.
    """
    if header is not None:
        written = tuple(next(csv.reader([header.removeprefix("\ufeff")], skipinitialspace=True), []))
        rows = _cell_rows(spark, path, len(written), multi_line)
        targets = R.alias_match(rows, keep=("record_seq",), header=written)
    else:
        found = headers or read_headers(spark, path)
        width = found.width
        rows = _cell_rows(spark, path, width, multi_line)
        placed = _with_header(rows, found.table.select("file", "places", "bytes"), found.files)
        targets = R.placed_cells(placed, F.array(*[f"_c{i}" for i in range(width)]), keep=("record_seq",))
    return R.target_records(_numbered(rows, targets), row_number="_row_number", as_of_year=as_of_year, country=country)


def header_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, bytes, width, places): for each people list the places of the known columns in its first line that is not blank."""
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]").format("text").load(path)
        .where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), "value", F.monotonically_increasing_id().alias("pos"))
    )
    first = cut(lines.groupBy("file").agg(F.min_by("value", "pos").alias("header"), F.max("bytes").alias("bytes")))
    bare = F.regexp_replace("header", '"(?:[^"]|"")*"', "")
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    width = first.select(F.max(commas)).first()[0] or 0
    columns = ", ".join(f"_c{i} STRING" for i in range(width + 1))
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE"}
    cells = F.from_csv(F.regexp_replace("header", "^\ufeff", ""), columns, options)
    names = F.array(*[F.col(f"cells._c{i}") for i in range(width + 1)])
    return first.withColumn("cells", cells).select("file", "bytes", (commas + 1).alias("width"), R.header_places(names).alias("places"))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Bag union of record tables of the shared layout, duplicates kept."""
    out = S.conform(frames[0])
    for f in frames[1:]:
        out = out.unionByName(S.conform(f))
    return out


def read_folder(
    spark: SparkSession,
    path: str,
    multi_line: bool = True,
    json_lines: bool = False,
    as_of_year: int | None = None,
    country: str = "US",
    listed: DataFrame | None = None,
    headers: Headers | None = None,
) -> DataFrame:
    """Records of every recognised file under a folder. ``listed`` and ``headers``: as :func:`discover` and
    :func:`read_headers` gave them, where they were called before."""
    listed = discover(spark, path) if listed is None else listed
    kinds = {r["source_kind"] for r in listed.select("source_kind").distinct().collect()}
    frames = []
    if DELIMITED in kinds:
        frames.append(read_delimited(spark, path, multi_line, as_of_year, country, headers=headers))
    if JSON in kinds:
        frames.append(read_json(spark, path, json_lines, country, listed=listed))
    if NOTES in kinds:
        frames.append(read_notes(spark, path, country))
    if LABELLED in kinds:
        frames.append(read_labelled(spark, path, country))
    if FREE_TEXT in kinds:
        frames.append(read_free_text(spark, path, country))
    if not frames:
        return spark.createDataFrame([], S.RECORD)
    return union_sources(frames)


def _list_of(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def json_problems(texts: DataFrame) -> DataFrame:
    """(file, place, problem, text): texts that are no JSON, and list elements that are no objects, with their 0-based place.

    A column ``before`` may say how many elements of the file stand in earlier texts.
    """
    before = F.col("before") if "before" in texts.columns else F.lit(0)
    parsed = texts.select(F.col("record_seq.origin").alias("file"), before.cast("long").alias("before"), "value", F.try_parse_json("value").alias("v"))
    whole = parsed.where(F.col("v").isNull()).select(
        "file", F.lit(None).cast("long").alias("place"), F.when(F.col("value").rlike(r"\S"), "no JSON").otherwise("empty text").alias("problem"), F.col("value").alias("text"))
    items = parsed.where(F.col("v").isNotNull()).select("file", "before", F.posexplode(_list_of(F.col("v"))).alias("i", "x"))
    odd = items.where(~F.coalesce(F.schema_of_variant("x"), F.lit("VOID")).startswith("OBJECT"))
    return whole.unionByName(odd.select("file", (F.col("before") + F.col("i")).alias("place"), F.lit("no object").alias("problem"), F.to_json("x").alias("text")))


def _array_problems(parts: DataFrame) -> DataFrame:
    """The same for the parts of large arrays, and arrays without an end."""
    earlier = W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = parts.select("file", "part", F.coalesce(F.size(_list_of(F.try_parse_json("value"))), F.lit(0)).alias("n"))
    counted = sizes.select("file", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    texts = parts.join(counted, ["file", "part"]).select("value", "before", R.seq(F.col("file"), F.col("part")).alias("record_seq"))
    last = parts.groupBy("file").agg(F.bool_or("ends").alias("ends"), F.max_by("value", "part").alias("text")).where("NOT ends")
    return json_problems(texts).unionByName(last.select("file", F.lit(None).cast("long").alias("place"), F.lit("array without end").alias("problem"), "text"))


def delimited_problems(
    spark: SparkSession, path: str | list[str], multi_line: bool = True, headers: Headers | None = None,
) -> DataFrame:
    """(file, place, problem, text): rows with more or fewer cells than their header, with their 1-based row number."""
    found = headers or read_headers(spark, path)
    width = found.width + 1  # wider than any header, so the text of odd rows is kept
    rows = _cell_rows(spark, path, width, multi_line, raw_text="_raw")
    bare = F.regexp_replace("_raw", '"(?:[^"]|"")*"', "")
    cells = F.coalesce(F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1, F.lit(width))
    # A row of exactly this width has no text of its own; its cells are quoted anew.
    cell = lambda c: F.when(c.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    text = F.coalesce("_raw", F.array_join(F.transform(F.array(*[F.col(f"_c{i}") for i in range(width)]), cell), ",", ""))
    placed = _with_header(rows.withColumn("_cells", cells).withColumn("_text", text), found.table.select("file", "width", "bytes"), found.files)
    ragged = _with_row_number(rows, placed.where(F.col("_cells") != F.col("width")).select("file", "record_seq", "_cells", "_text", "width"))
    return ragged.select(
        "file", F.col("_row_number").alias("place"),
        F.format_string("%d cells under a header of %d", "_cells", "width").alias("problem"), F.col("_text").alias("text"))


def ingest_problems(
    spark: SparkSession, path: str, multi_line: bool = True, json_lines: bool = False,
    listed: DataFrame | None = None, headers: Headers | None = None,
) -> DataFrame:
    """(file, place, problem, text): what could not be read in a folder, file by file: empty files, texts that are no
    JSON, list elements that are no objects, ragged rows. A file may have many rows; the text is kept whole."""
    listed = discover(spark, path) if listed is None else listed
    empty = listed.where(F.col("source_kind").isNotNull() & (F.col("length") == 0)).select(
        "file", F.lit(None).cast("long").alias("place"), F.lit("empty file").alias("problem"), F.lit("").alias("text"))
    kinds = {r["source_kind"] for r in listed.where("length > 0").select("source_kind").distinct().collect()}
    found = empty
    if JSON in kinds:
        glob = "*.[jJ][sS][oO][nN]"
        large = not json_lines and not listed.where((F.col("source_kind") == JSON) & (F.col("length") > SPLIT_BYTES)).isEmpty()
        found = found.unionByName(json_problems(_text_files(spark, path, glob, JSON, SPLIT_BYTES if large else None, wholetext=not json_lines)))
        if large:
            found = found.unionByName(_array_problems(_array_parts(spark, path, glob, SPLIT_BYTES)))
    if DELIMITED in kinds:
        found = found.unionByName(delimited_problems(spark, path, multi_line, headers))
    return found


def ingest_report(files: DataFrame, records: DataFrame, problems: DataFrame | None = None, shown: int = 200) -> DataFrame:
    """Per file: number of records, source label of the first one, and a note for files without records.

    With ``problems`` also their number, and message and text (up to ``shown`` characters) of the first one.
    """
    per_file = records.groupBy(F.col("record_seq.origin").alias("file")).agg(
        F.count(F.lit(1)).alias("records"), F.min_by("source", "record_seq").alias("source")
    )
    joined = files.join(per_file, "file", "left")
    note = F.when(F.col("records").isNull(), F.when(F.col("source_kind").isNull(), "ignored").otherwise("no records"))
    more = []
    if problems is not None:
        first = F.struct(F.coalesce("place", F.lit(-1)).alias("place"), "problem", F.substring("text", 1, shown).alias("text"))
        joined = joined.join(problems.groupBy("file").agg(F.count(F.lit(1)).alias("_n"), F.min(first).alias("_first")), "file", "left")
        note = F.coalesce("_first.problem", note)
        place = F.nullif("_first.place", F.lit(-1))
        more = [F.coalesce("_n", F.lit(0)).alias("problems"), place.alias("place"), F.col("_first.text").alias("text")]
    return joined.select("file", "source_kind", F.coalesce("records", F.lit(0)).alias("records"), "source", note.alias("problem"), *more)


def write_result(
    documents: DataFrame, stats: dict[str, DataFrame], path: str, mode: str = "errorifexists", ranged: bool = False,
) -> None:
    """Result sink: ``profiles`` ordered by id as line-delimited JSON with the canonical profile, the output and its
    validation as objects, and one small table per statistic. ``ranged``: the partitions are ranges of ids already."""
    dealt = documents if ranged else documents.repartitionByRange("candidate_id")
    ordered = dealt.sortWithinPartitions("candidate_id")
    ordered.write.mode(mode).json(f"{path}/profiles", ignoreNullFields=False)
    for name, frame in stats.items():
        frame.write.mode(mode).json(f"{path}/stats/{name}")
