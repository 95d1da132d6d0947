"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

1. Statements are the lines of a file that hold one of the anchor words (every line of the
   whole text is looked at); a licence file's whole text is one more. Wrapped headers add
   passages: lines, sentences and paragraphs, each also up to any of its line ends, whatever
   words they hold, as far as their words leave room for the threshold. Texts and paragraphs without
   any of the terms that such a passage must have are passed over.
2. Statements and templates become sparse vectors: term frequency times
   1 + ln((1 + N) / (1 + df)), with document frequencies over all statements of the corpus
   (passages are weighed by them and do not count in them).
   Products meet in an equi-join on the term, so only shared terms cost anything.
3. The template with the largest cosine, if that reaches the threshold, is the licence
   of the statement; the best statement is that of the file.
4. A licence file gives its licence to its directory. A file without an own licence
   takes that of the nearest directory above it that has one, by an equi-join on path
   prefixes.

Ties go to the template, line or path that comes first. Null and empty texts have no
statement but inherit; a null path is in no directory and inherits nothing; several rows with
one path are one file; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from kinweave.llm.words import slices

#: A line without any of these says nothing about a licence.
ANCHORS = ("licen[cs]e", "licen[cs]ed", "copyright", "spdx", "copyleft", "redistribution", "warranty", "public domain")
#: File names whose whole text is one statement that counts for the directory.
LICENSE_FILE = "(?i)^(licen[cs]e|copying|notice|unlicense)([-_. ].*)?$"
#: Template tables up to this many terms are sent to every executor.
SENT = 200_000

#: Statements by which licences are commonly given, as (licence, text); several per licence are fine.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is free software under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved. No part may be reproduced without written permission."),
)


TERM = re.compile(r"[a-z0-9]+(?:[.][a-z0-9]+)*")
SENTENCE_END = re.compile(r"(?<=[.;!?])\s")


def terms(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits; dots inside stay, so versions are one term."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:[.][a-z0-9]+)*"), F.lit(0))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def statements(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line, is_file, text): lines count from 1, line 0 is the whole text of a licence file."""
    anchor = "(?i)(" + "|".join(ANCHORS) + ")"
    text = F.col(text_col).cast("string")
    whole = F.coalesce(F.regexp_like(name(F.col(path_col)), F.lit(LICENSE_FILE)), F.lit(False))
    rows = files.select(F.col(path_col).alias("path"), text.alias("text"), whole.alias("is_file")) \
        .where(F.col("is_file") & (F.col("text") != "") | F.regexp_like("text", F.lit(anchor)))
    lines = rows.select("path", "is_file", F.posexplode(F.split("text", "\n")).alias("at", "text")) \
        .where(F.regexp_like("text", F.lit(anchor))).select("path", (F.col("at") + 1).alias("line"), "is_file", "text")
    return lines.unionByName(rows.where("is_file").select("path", F.lit(0).alias("line"), "is_file", "text"))


class Room:
    """The largest cosine to any template that a passage can have, term by term.

    Terms of templates have known weights; any other weighs 1 at least for each time it occurs.
    """

    def __init__(self, idf: dict[str, float], holders: dict[str, list[tuple[int, float]]]):
        self.idf, self.holders = idf, holders
        self.clear()

    def clear(self) -> None:
        self.seen, self.dots, self.square, self.other = {}, {}, 0.0, 0

    def add(self, line: str) -> None:
        for term in TERM.findall(line.lower()):
            before = self.seen.get(term, 0)
            self.seen[term] = before + 1
            w = self.idf.get(term)
            if w is None:
                self.square += 2 * before + 1
                self.other += 2 * before + 1
                continue
            self.square += (2 * before + 1) * w * w
            for t, v in self.holders[term]:
                self.dots[t] = self.dots.get(t, 0.0) + w * v

    def most(self) -> float:
        return max(self.dots.values()) / math.sqrt(self.square) if self.dots else 0.0

    def least(self, heaviest: float) -> float:
        """The smallest that the largest cosine can be, if a term that no template has weighs ``heaviest`` at most."""
        more = self.other * (heaviest**2 - 1) if self.other else 0.0
        return max(self.dots.values()) / math.sqrt(self.square + more) if self.dots else 0.0


def markers(holders: dict[str, list[tuple[int, float]]], threshold: float) -> set[str]:
    """Terms of which every passage that reaches the threshold has at least one.

    The lightest terms of a template that together are shorter than the threshold are none: a passage
    without any others has no larger product with the template than their length.
    """
    by_template: dict[int, list[tuple[float, str]]] = {}
    for term, held in holders.items():
        for template, v in held:
            by_template.setdefault(template, []).append((v, term))
    out: set[str] = set()
    for weighed in by_template.values():
        square = 0.0
        for v, term in sorted(weighed):
            square += v * v
            if square >= (threshold - 1e-6) ** 2:
                out.add(term)
    return out


def passages_of(text: str, room: Room, threshold: float, marked: re.Pattern | None = None, heaviest: float = math.inf) -> list[tuple[int, str]]:
    """(line, text) of the passages that may reach the threshold; a line without letters and digits ends a paragraph.

    Paragraphs without a match of ``marked`` are left out. A passage that goes on from its first line is
    kept only if it can be closer to a template than all shorter ones from that line are for certain.
    """
    out: dict[tuple[int, str], None] = {}

    def tried(pieces: list[tuple[int, str]]) -> None:
        room.clear()
        sure = 0.0
        for i, (_, piece) in enumerate(pieces):
            room.add(piece)
            most = room.most()
            if most >= threshold - 1e-6 and most > sure + 1e-9:
                out[pieces[0][0], " ".join(x for _, x in pieces[:i + 1])] = None
                sure = max(sure, room.least(heaviest))

    paragraph: list[tuple[int, str]] = []
    for number, line in enumerate([*text.split("\n"), ""], 1):
        if TERM.search(line.lower()):
            paragraph.append((number, line))
            continue
        if marked and paragraph and not any(marked.search(row.lower()) for _, row in paragraph):
            paragraph = []
        sentence: list[tuple[int, str]] = []
        for at, row in paragraph:
            pieces = SENTENCE_END.split(row)
            if len(pieces) > 1 or len(paragraph) > 1:
                tried([(at, row)])
            for i, piece in enumerate(pieces):
                sentence.append((at, piece))
                if i + 1 < len(pieces) or row.rstrip().endswith((".", ";", "!", "?")):
                    if len(sentence) > 1 or len(pieces) > 1:
                        tried(sentence)
                    sentence = []
        if len(sentence) > 1:
            tried(sentence)
        if paragraph:
            tried(paragraph)
        paragraph = []
    return list(out)


def passages(files: DataFrame, said: DataFrame, templates: DataFrame, threshold: float = 0.6, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line, part, is_file, text): passages of the files that may reach the threshold, numbered from 1 within a file row.

    The terms of the templates are collected: templates are a table of sentences.
    """
    _, known = weights(said, templates)
    idf: dict[str, float] = {}
    holders: dict[str, list[tuple[int, float]]] = {}
    for r in known.collect():
        idf[r.term] = r.idf
        holders.setdefault(r.term, []).append((r.template, r.v))
    marks = sorted(markers(holders, threshold))
    marked = re.compile("|".join(map(re.escape, marks))) if marks else None
    heaviest = 1 + math.log(1 + said.select("path", "line").distinct().count())
    source = files.where(F.col(path_col).isNotNull()).select(F.col(path_col).alias("path"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = Room(idf, holders)
        for part in slices(batches, "text"):
            # Most texts hold no marked term at all; the dotted capital I is the one letter beyond ASCII that gives an ASCII one.
            if marked:
                part = part.filter(pc.fill_null(pc.match_substring_regex(part.column(1), f"(?i){marked.pattern}|\u0130"), False))
            rows = [(path, line, n, text) for path, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if whole
                    for n, (line, text) in enumerate(passages_of(whole, room, threshold, marked, heaviest), 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string())], ["path", "line", "part", "text"])

    found = source.mapInArrow(run, "path string, line int, part int, text string")
    return found.withColumn("is_file", F.coalesce(F.regexp_like(name(F.col("path")), F.lit(LICENSE_FILE)), F.lit(False))).distinct()


def weights(said: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms of the statements as (term, df), and of the templates as (template, license, term, idf, v)."""
    template_terms = templates.select(
        F.xxhash64("license", "text").alias("template"), "license", F.explode(terms(F.col("text"))).alias("term")
    ).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = said.select("path", "line", "is_file", F.explode(terms(F.col("text"))).alias("term")) \
        .distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = said.select("path", "line").distinct().agg(F.count(F.lit(1)).alias("total"))
    idf = 1 + F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0))))
    known = template_terms.join(df, "term", "left").join(F.broadcast(total)).withColumn("idf", idf).withColumn("w", F.col("tf") * F.col("idf"))
    sizes = known.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return df, known.join(sizes, "template").select("template", "license", "term", "idf", (F.col("w") / F.col("size")).alias("v"))


def score(said: DataFrame, templates: DataFrame, threshold: float = 0.6, more: DataFrame | None = None) -> DataFrame:
    """(path, is_file, line, license, cosine): the best template of each statement that reaches the threshold.

    ``said`` is read several times: pass a written table. ``templates`` has (license, text), ``more`` passages.
    """
    df, known = weights(said, templates)
    send = F.broadcast if templates.select(F.explode(terms(F.col("text")))).count() <= SENT else (lambda df: df)
    key = ["path", "line", "part", "is_file"]
    every = said.withColumn("part", F.lit(0))
    every = every if more is None else every.unionByName(more)
    counted = every.select(*key, F.explode(terms(F.col("text"))).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    # One number for the corpus, one row per term; terms that no statement has are those of passages, with df 0.
    total = said.select("path", "line").distinct().agg(F.count(F.lit(1)).alias("total"))
    idf = 1 + F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0))))
    weighed = counted.join(df, "term", "left").join(F.broadcast(total)).withColumn("w", F.col("tf") * idf)
    # A statement's length and its products with all templates in one pass over its terms.
    lengths = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = weighed.join(send(known), "term").groupBy(*key, "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    best = dots.groupBy(*key).agg(F.min(F.struct(-F.round("dot", 9), "license")).alias("top"))
    return best.join(lengths, key).select(
        "path", "is_file", "line", F.col("top.license").alias("license"), (-F.col("top.col1") / F.col("size")).alias("cosine")
    ).where(F.col("cosine") >= threshold)


def scan(files: DataFrame, said: DataFrame, templates: DataFrame, threshold: float = 0.6, path_col: str = "path", more: DataFrame | None = None) -> DataFrame:
    """(path, license, cosine, origin, found_in) per distinct path. ``more`` has the passages, from ``passages``.

    ``origin`` is file, statement, inherited or null; ``found_in`` names the directory inherited from.
    """
    found = score(said, templates, threshold, more)
    own = found.groupBy("path").agg(F.min(F.struct(-F.round("cosine", 9), "line", "license", "is_file")).alias("top")).select(
        "path", F.col("top.license").alias("license"), (-F.col("top.col1")).alias("cosine"),
        F.when(F.col("top.is_file"), "file").otherwise("statement").alias("origin"))
    # A directory's own licence: the closest match, then the first file name.
    given = own.where("origin = 'file'").groupBy(parent(F.col("path")).alias("directory")).agg(
        F.min(F.struct(-F.col("cosine"), "path", "license")).alias("top")
    ).select("directory", F.col("top.license").alias("given"), (-F.col("top.col1")).alias("given_cosine"))
    paths = files.where(F.col(path_col).isNotNull()).select(F.col(path_col).alias("path")).distinct()
    lacking = paths.join(own, "path", "left_anti")
    # Files of a directory ask alike, so ancestors are looked up per directory.
    steps = F.split("home", "/")
    above = lacking.select(parent(F.col("path")).alias("home")).distinct().select(
        "home", F.explode(F.concat(F.array(F.lit("")), F.transform(
            F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")))).alias("directory"))
    nearest = above.distinct().join(given, "directory").groupBy("home").agg(
        F.max(F.struct(F.length("directory").alias("depth"), "directory", "given", "given_cosine")).alias("top"))
    inherited = lacking.withColumn("home", parent(F.col("path"))).join(nearest, "home", "left").select(
        "path", F.col("top.given").alias("license"), F.col("top.given_cosine").alias("cosine"),
        F.when(F.col("top").isNotNull(), "inherited").alias("origin"), F.col("top.directory").alias("found_in"))
    return own.withColumn("found_in", F.lit(None).cast("string")).unionByName(inherited)
