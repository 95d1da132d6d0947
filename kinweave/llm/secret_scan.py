"""Secret scans with structural confirmation.

Plain patterns report assignments, access keys and long hex strings as they stand.
Encoded candidates are reported only after they have been decoded and their inside has
the structure of a secret:

* ``jwt``: three dotted base64url parts whose first decodes to a JSON object that names
  an ``alg`` and whose second decodes to a JSON object;
* ``pem``: a PRIVATE KEY block whose body decodes to a key structure, or to whole cipher blocks
  where its header lines name a cipher. The body may be wrapped, indented, quoted line by line or
  escaped as in a JSON string;
* ``base64_key``: a stretch of a run of base64 characters, wherever in the run it begins, that
  decodes to a key structure; the structure tells where it ends;
* ``hex_key``: a bare run that decodes to a key structure.

A key structure is a DER sequence whose nested lengths add up exactly and whose
members are those of a PKCS#1, PKCS#8, encrypted PKCS#8 or EC private key, or an
OpenSSH private key whose length-prefixed fields add up.

Null and empty texts have no spans. Spans of one kind never overlap; ties in the start are
ordered by kind. Repeated rows are scanned one by one, an empty table gives an empty
result, columns other than those named are carried or left out, never read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kinweave.llm.words import Texts, slices

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "base64_key", "hex_key")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*")
ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
#: Escapes that JSON and source strings put into a block: line ends, slashes, and the marks that some writers escape.
ESCAPE = re.compile(r"(?<!\\)\\+(?:[nrt]|(/)|u00(2[bBfF]|3[dD]))")
#: What stands before and after the base64 of a line that is indented, commented or a string of its own.
BEFORE = re.compile(r"""^[\s"'`#>*|]+""")
AFTER = re.compile(r"""["'`]\s*[+.,;]?$""")
HEADER = re.compile(r"""[\s"'`#>*|]*([A-Za-z][A-Za-z0-9-]*):(.*)""")
CIPHER = re.compile(r"\s*([A-Za-z0-9-]+),[0-9A-Fa-f]{16,}\b")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}")
#: How the base64 of a DER sequence and of an OpenSSH key begins.
KEY_HEAD = re.compile(r"M(?=[A-P])|b3BlbnNzaC1rZXktdjEA")
LONG_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{2}){32,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9A-F]{2}){32,}(?![0-9A-Za-z])")


def decode64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64 with or without padding; None if it is neither."""
    text = text.rstrip("=").translate({45: 43, 95: 47})
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def der(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end] exactly; None if their lengths do not add up."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at:at + n], "big")
            at += n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    outer = der(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = der(data, *outer[0][1:])
    if not inner:
        return False
    tags = [t for t, _, _ in inner]
    first = int.from_bytes(data[inner[0][1]:inner[0][2]], "big") if tags[0] == 0x02 and inner[0][2] - inner[0][1] <= 1 else -1
    if first in (0, 1) and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True  # PKCS#1: version and eight numbers
    if first in (0, 1) and tags[1:3] == [0x30, 0x04]:  # PKCS#8: version, algorithm, key
        return any(t == 0x06 for t, _, _ in der(data, *inner[1][1:]) or ())
    if first == 1 and tags[1:2] == [0x04] and 16 <= inner[1][2] - inner[1][1] <= 66:
        return True  # EC: version and the secret number
    if tags == [0x30, 0x04]:  # encrypted PKCS#8: algorithm and ciphertext
        return any(t == 0x06 for t, _, _ in der(data, *inner[0][1:]) or ())
    return False


def der_end(data: bytes, at: int) -> int | None:
    """Where the sequence at ``at`` ends by its own length, if that is inside ``data`` and it opens like a key."""
    if data[at:at + 1] != b"\x30" or at + 2 > len(data):
        return None
    size, at = data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        size = int.from_bytes(data[at:at + n], "big")
        at += n
        if not 1 <= n <= 4:
            return None
    return at + size if at + size <= len(data) and data[at:at + 1] in (b"\x02", b"\x30") else None


def ssh_end(data: bytes, at: int = 0) -> int | None:
    """Where the OpenSSH key at ``at`` ends by its fields; None if they do not fit."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic, at):
        return None
    at += len(magic)
    for step in ("cipher", "kdf", "options", "count", "public", "private"):
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at:at + 4], "big")
        at += 4 + (0 if step == "count" else size)
        if step == "count" and size != 1:
            return None
    return at if at <= len(data) else None


def is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_key(data) or ssh_end(data) == len(data))


def base64_keys(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the keys inside runs of base64 characters.

    A run also holds what stands before a key without a break (``n`` of an escape, ``/``, ``-``),
    so every place where a key can begin is tried. A run is decoded at most four times, once
    for each way of dividing it into groups of four.
    """
    for m in BASE64.finditer(text):
        run, decoded, done = m[0].translate({45: 43, 95: 47}), {}, 0
        for head in KEY_HEAD.finditer(run):
            at, odd = head.start(), head.start() % 4
            if at < done:
                continue
            if odd not in decoded:
                rest = len(run) - odd
                decoded[odd] = decode64(run[odd:len(run) - (rest % 4 == 1)])
            data, begin = decoded[odd], at // 4 * 3
            end = der_end(data, begin)
            if end is None or not is_der_key(data[begin:end]):
                end = ssh_end(data, begin)
            n = 0 if end is None else (4 * (end - begin) + 2) // 3
            if n >= 40:
                done = at + n
                past, pad = m.start() + done, -n % 4
                while pad and text.startswith("=", past):
                    past, pad = past + 1, pad - 1
                yield m.start() + at, past


def bare(line: str) -> str:
    return BEFORE.sub("", AFTER.sub("", line.rstrip().removesuffix("\\").rstrip()))


def is_key_block(body: str) -> bool:
    """Whether the text between the lines of a PEM block is that of a private key."""
    body = ESCAPE.sub(lambda m: m[1] or (chr(int(m[2], 16)) if m[2] else "\n"), body)
    lines = body.splitlines()
    while lines and not bare(lines[0]):
        del lines[0]
    cipher = None
    if lines and HEADER.match(lines[0]):
        # The header ends with an empty line; where that was lost, with its last field.
        blank = next((i for i, line in enumerate(lines) if not bare(line)), None)
        fields = [i for i, line in enumerate(lines) if HEADER.match(line)]
        past = fields[-1] + 1 if blank is None or blank < fields[-1] else blank
        for m in map(HEADER.match, lines[:past]):
            if m and m[1].lower() == "dek-info":
                cipher = CIPHER.match(m[2])
        lines = lines[past:]
    data = decode64("".join("".join(map(bare, lines)).split()))
    if cipher and data is not None:
        # Encrypted as a whole: nothing to read inside, but block ciphers fill their blocks.
        return len(data) >= 32 and (not cipher[1].upper().endswith(("CBC", "ECB")) or len(data) % 8 == 0)
    return is_key(data)


def is_object(text: str, must: str = "") -> bool:
    try:
        value = json.loads(decode64(text) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and (not must or isinstance(value.get(must), str))


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text in code points, by start and then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    out += [("jwt", *m.span()) for m in JWT.finditer(text) if is_object(m[1], "alg") and is_object(m[2])]
    opened = None
    for m in ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            opened = m
        elif opened and opened[2] == m[2]:
            if is_key_block(text[opened.end():m.start()]):
                out.append(("pem", opened.start(), m.end()))
            opened = None
    out += [("base64_key", *span) for span in base64_keys(text)]
    out += [("hex_key", *m.span()) for m in LONG_HEX.finditer(text) if is_key(bytes.fromhex(m[0]))]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_HEX, _BASE64 = _class(b"0123456789abcdef"), _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def worth_reading(texts: Texts) -> np.ndarray:
    """Which texts can have a span at all: a ``:`` or ``=``, a run long enough for a bare key, or the head of a token or block."""
    data = texts.data
    head = (data == ord(":")) | (data == ord("="))
    if len(data) > 2:
        for mark in (b"eyJ", b"---"):
            head[:-2] |= (data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])
    out = texts.counts(head) > 0
    for chars, least in ((_HEX, 24), (_BASE64, 20)):
        start, end, first = texts.runs(~chars[texts.data])
        out |= np.diff(np.concatenate([[0], np.cumsum(end - start >= least)])[first]) > 0
    return out


def _scan_part(column: pa.Array) -> tuple[np.ndarray, list[list[tuple[str, int, int]]]]:
    at = np.flatnonzero(worth_reading(Texts(column)))
    return at, [find(text) for text in column.take(pa.array(at)).to_pylist()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) per row; spans are (kind, start, end) in code points, end exclusive."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part in slices(batches, "text"):
            spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for i, found in zip(*_scan_part(part.column(1))):
                spans[i] = [{"kind": k, "start": s, "end": e} for k, s, e in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["id", "spans"])

    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("spans", SPANS)])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """The text with the union of the spans replaced, each connected stretch by one mask."""
    out, done = [], 0
    begin = end = None
    for _, s, e in [*spans, ("", len(text) + 1, len(text) + 1)]:
        if begin is not None and s > end:
            out += [text[done:begin], mask]
            done, begin = end, None
        begin, end = (s, e) if begin is None else (begin, max(end, e))
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with all columns; secrets in the text column become ``mask``. Null stays null."""
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, names[at]):
            column = part.column(at)
            new = {}
            for i, found in zip(*_scan_part(column)):
                if found:
                    new[i] = masked(column[int(i)].as_py(), found, mask)
            if new:
                column = pa.array([new.get(i, v) for i, v in enumerate(column.to_pylist())], column.type)
            columns = [column if i == at else c for i, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)
