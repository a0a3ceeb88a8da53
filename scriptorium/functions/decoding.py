"""Bytes to text: charsets, transfer encodings and MIME parts, as Arrow UDFs over BINARY.

Labels of the Latin family are distrusted: strict UTF-8 first, then UTF-8 sequence by
sequence with single bytes between. Other labels are trusted if the bytes fit, else
counted doubtful; wide ones that do not fit are refused. Null bytes give null.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LATIN = frozenset(
    "ansi_x3.4-1968 ascii cp-1252 cp1252 cp819 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso_8859-1 l1 latin1 "
    "unicode-1-1-utf-8 us-ascii utf-8 utf8 windows-1252 windows-1252-1 windows_1252 x-cp1252 x-unicode-1-1-utf-8".split()
) | {""}
_WIDE = frozenset("iso-10646-ucs-2 ucs-2 ucs2 unicodefeff unicodefffe utf-16 utf-16be utf-16le utf-32 utf-32be utf-32le utf16 utf16be utf16le utf32 utf32be utf32le".split())
_HIGH = dict(zip(range(0x80, 0xA0), "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"))


def cp1252(text: str) -> str:
    return text.translate(_HIGH)


def mixed(data: bytes) -> str:
    """UTF-8 sequences where they are whole, single bytes elsewhere."""
    out, at = [], 0
    for m in re.finditer(rb"[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}", data):
        out.append(data[at : m.start()].decode("latin-1"))
        try:
            out.append(m[0].decode())
        except UnicodeDecodeError:
            out.append(m[0].decode("latin-1"))
        at = m.end()
    return "".join([*out, data[at:].decode("latin-1")])


class Report:
    def __init__(self):
        self.doubtful, self.refused, self.charsets = 0, 0, set()


def charset_text(data: bytes, label: str | None, report: Report | None = None) -> str:
    label = (label or "").strip().lower().strip('"')
    if label not in _LATIN:
        try:
            return cp1252(data.decode(codecs.lookup(label).name))
        except (LookupError, UnicodeError, ValueError):
            if report:
                report.doubtful += 1
                report.charsets.add(label)
                report.refused += label in _WIDE
    try:
        return cp1252(data.decode())
    except UnicodeDecodeError:
        return cp1252(mixed(data))


def quoted_printable(data: bytes) -> bytes:
    data = re.sub(rb"=\r?\n", b"", data)
    return re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data)


def base64_bytes(data: bytes) -> bytes:
    """What of it is base 64, padded as needed."""
    data = re.sub(rb"[^A-Za-z0-9+/]", b"", data.split(b"=")[0].translate(bytes.maketrans(b"-_", b"+/")))
    try:
        return base64.b64decode(data[: len(data) - (len(data) % 4 == 1)] + b"=" * (-len(data) % 4))
    except binascii.Error:
        return b""


def encoded_words(value: str | None) -> str:
    def swap(m: re.Match) -> str:
        payload = m[3].encode("latin-1", "replace")
        data = base64_bytes(payload) if m[2] in "Bb" else quoted_printable(payload.replace(b"_", b" "))
        return charset_text(data, m[1])

    return re.sub(r"=\?([\w-]+)\?([BbQq])\?([^?]*)\?=", swap, value or "")


def headers_and_body(raw: bytes) -> tuple[dict[str, str], bytes]:
    if lead := re.match(rb"\r?\n", raw):
        return {}, raw[lead.end() :]
    cut = re.search(rb"\r?\n\r?\n", raw)
    head, body = (raw[: cut.start()], raw[cut.end() :]) if cut else (raw, b"")
    found: dict[str, str] = {}
    for line in re.split(rb"\r?\n", re.sub(rb"\r?\n[ \t]+", b" ", head)):
        if m := re.match(rb"([!-9;-~]+):[ \t]*(.*)\Z", line):
            name, value = m[1].decode("latin-1").lower(), m[2].decode("latin-1")
            found[name] = f"{found[name]}, {value}" if name in found else value
    return found, body


def type_and_parameters(value: str | None) -> tuple[str, dict[str, str]]:
    kind, *rest = (value or "text/plain").split(";")
    found = {}
    for part in rest:
        if m := re.match(r'\s*([\w-]+)\s*=\s*"?([^";]*)"?', part):
            found[m[1].lower()] = m[2].strip()
    return kind.strip().lower(), found


def split_parts(body: bytes, boundary: str) -> list[bytes]:
    """Parts between delimiter lines; a part that begins like no part is glued back."""
    mark = b"--" + boundary.encode("latin-1", "replace")
    line = re.compile(re.escape(mark) + rb"[ \t]*(--)?[ \t]*\Z")
    parts: list[list[bytes]] = []
    inside = False
    for row in re.split(rb"\r?\n", body):
        m = line.match(row)
        if m and m[1]:
            break
        if m:
            inside = True
            parts.append([])
        elif inside:
            parts[-1].append(row)
    out: list[bytes] = []
    for part in (b"\n".join(p) for p in parts):
        first = re.split(rb"\r?\n", part, maxsplit=1)[0]
        if out and first and not re.match(rb"[!-9;-~]+:", first):
            out[-1] += b"\n" + mark + b"\n" + part
        else:
            out.append(part)
    return out


def numeric_reference(code: int) -> str:
    if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF or code == 0x7F or (code < 0x20 and code not in (9, 10, 13)):
        return " "
    return cp1252(chr(code))


_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def html_text(html: str) -> str:
    """The row-wise form of ``parsing.html_to_text``, for parts inside a message."""
    for pattern, to in (
        (r"(?is)<(style|script).*?</\1>", ""),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)<li[^>]*>", "- "),
        (r"(?i)</(?:blockquote|div|h[1-6]|li|p|tr)>", "\n"),
        (r"<[^>]+>", ""),
    ):
        html = re.sub(pattern, to, html)
    html = re.sub(r"&#([0-9]+);", lambda m: numeric_reference(min(int(m[1][-12:]) if len(m[1]) <= 12 else 1 << 30, 1 << 30)), html)
    html = re.sub(r"(?i)&#x([0-9a-f]+);", lambda m: numeric_reference(min(int(m[1], 16), 1 << 30)), html)
    html = re.sub(r"&(\w+);", lambda m: _NAMED.get(m[1].lower(), m[0]), html)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", html)).strip()


def readable(raw: bytes, report: Report, depth: int = 0) -> tuple[str, str]:
    """(type, text): plain text before HTML before anything else; attachments are empty."""
    headers, body = headers_and_body(raw)
    kind, parameters = type_and_parameters(headers.get("content-type"))
    if kind.startswith("multipart/") and parameters.get("boundary") and depth < 8:
        found = [readable(p, report, depth + 1) for p in split_parts(body, parameters["boundary"])]
        found = [p for p in found if p[1].strip()]
        for wanted in ("text/plain", "text/html"):
            for part in found:
                if part[0] == wanted:
                    return part
        return found[0] if found else ("text/plain", "")
    encoding = headers.get("content-transfer-encoding", "7bit").strip().lower()
    data = base64_bytes(body) if encoding == "base64" else quoted_printable(body) if encoding == "quoted-printable" else body
    text = charset_text(data, parameters.get("charset"), report)
    if kind == "text/html":
        return kind, html_text(text)
    return kind, text if kind == "text/plain" else ""


_PART = "type string, text string, doubtful int, refused boolean, charsets string"


#: Rows that are decoded before their texts leave the worker.
PIECE = 256


def _decoded(raws: pa.Array, read) -> Iterator[pa.Array]:
    """Structs of ``_PART``, a piece at a time, so that a worker holds the bytes of a batch and
    the texts of a piece."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string())
    for at in range(0, len(raws), PIECE):
        rows = []
        for i, raw in enumerate(raws.slice(at, PIECE), at):
            report, data = Report(), raw.as_py()
            kind, text = (None, None) if data is None else read(data, report, i)
            rows.append((kind, text, report.doubtful, report.refused > 0, ",".join(sorted(report.charsets))))
        yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["type", "text", "doubtful", "refused", "charsets"])
    pa.default_memory_pool().release_unused()


def part_text(raw: Column) -> Column:
    """STRUCT<type, text, doubtful, refused, charsets> of a whole message's bytes."""

    @F.arrow_udf(_PART)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for raws in batches:
            yield from _decoded(raws, lambda r, report, i: readable(r, report))

    return run(raw)


def decode_charset(data: Column, label: Column) -> Column:
    """STRUCT<type, text, doubtful, refused, charsets> of bytes with a charset label."""

    @F.arrow_udf(_PART)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for raws, labels in batches:
            yield from _decoded(raws, lambda r, report, i: ("text/plain", charset_text(r, labels[i].as_py(), report)))  # noqa: B023 (read at once)

    return run(data, label)


def decoding_report(decoded: Column) -> list[Column]:
    """Over rows of ``decode_charset``: doubtful, refused, and the labels that were doubtful."""
    labels = F.array_sort(F.collect_set(F.nullif(decoded["charsets"], F.lit(""))))
    return [F.sum(decoded["doubtful"].cast("long")).alias("doubtful"), F.sum(decoded["refused"].cast("long")).alias("refused"), F.array_join(labels, ", ").alias("charsets")]


def decode_words(value: Column) -> Column:
    """Encoded words of a header."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else encoded_words(v))

    return run(value)


def wrapped(text: Column, number: Column) -> Column:
    """A text as the bytes of a message, by number: plain, base 64, quoted or multipart."""

    @F.pandas_udf(T.BinaryType())
    def run(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        import quopri

        out = []
        for t, n in zip(texts, numbers):
            data, how = (t or "").encode(), int(n) % 4
            plain = b'Content-Type: text/plain; charset="utf-8"\n'
            if how == 0:
                out.append(plain + b"\n" + data)
            elif how == 1:
                out.append(plain + b"Content-Transfer-Encoding: base64\n\n" + base64.encodebytes(data))
            elif how == 2:
                out.append(plain + b"Content-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring(data))
            else:
                html = b"--b7\nContent-Type: text/html\n\n<p>other</p>\n"
                out.append(b"Content-Type: multipart/alternative; boundary=b7\n\npreamble\n" + html + b"--b7\n" + plain + b"\n" + data + b"\n--b7--\nend")
        return pd.Series(out)

    return run(text, number)
