"""Documents inside archives, with limits, and the text of simple PDFs without any other library."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of an archive: members, bytes of one and of all, and how much a member may shrink.
MEMBERS, MEMBER_BYTES, TOTAL_BYTES, RATIO = 10_000, 256 << 20, 2 << 30, 200
SCHEMA = "archive string, path string, content binary, fault string"


def _fault(infos: list[zipfile.ZipInfo]) -> str | None:
    """What forbids to open an archive."""
    names = [i.filename for i in infos]
    if len(names) > MEMBERS or len(set(names)) < len(names):
        return "ARCHIVE_INVENTORY_INVALID"
    parts = [n.split("/") for n in names]
    linked = any(i.external_attr >> 16 & 0o170000 == 0o120000 for i in infos)
    if linked or any(n.startswith("/") or "\\" in n or ".." in p for n, p in zip(names, parts, strict=True)):
        return "ARCHIVE_MEMBER_UNSAFE"
    if any(i.file_size > MEMBER_BYTES or i.file_size > RATIO * max(i.compress_size, 1) for i in infos) or sum(i.file_size for i in infos) > TOTAL_BYTES:
        return "ARCHIVE_LIMIT_EXCEEDED"
    return None


def members(files: DataFrame, suffix: str = "pdf") -> DataFrame:
    """The members (archive, path, content) of zip files (path, content) with a suffix; a faulty archive gives one row with its
    ``fault`` and no member.  A member's path is archive!/name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content or b""))) as archive:
                        fault = _fault(archive.infolist())
                        wanted = [] if fault else [i for i in archive.infolist() if not i.is_dir() and i.filename.lower().endswith("." + suffix)]
                        for info in wanted:  # one at a time, so that memory holds one member
                            yield pd.DataFrame([(path, f"{path}!/{info.filename}", archive.read(info), None)], columns=["archive", "path", "content", "fault"])
                except (zipfile.BadZipFile, zlib.error):
                    fault = "ARCHIVE_INVALID"
                if fault:
                    yield pd.DataFrame([(path, None, None, fault)], columns=["archive", "path", "content", "fault"])

    out = files.select("path", "content").mapInPandas(run, SCHEMA)
    return out.withColumn("sha256", F.sha2("content", 256))


_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<(?!<)|>(?!>)|<<[^<>]*>>)*)>>\s*stream\r?\n", re.S)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|(?P<gap>-?\d+(?:\.\d+)?)(?=[\s\[\]()<])|(?P<op>T\*|T[Jjd]|TD|'|\"|ET)", re.S)
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap in a shown array, in thousandths of the font size, from which on it is a space.
GAP = 200


class NoText(ValueError):
    """A PDF whose text is not there, or not readable without its fonts' maps."""


def _plain(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def char(m: re.Match[bytes]) -> bytes:
        code = m[1]
        return bytes([int(code, 8) & 255]) if code.isdigit() else _NAMED.get(code, b"" if code in (b"\n", b"\r", b"\r\n") else code)

    return _ESCAPED.sub(char, token[1:-1])


def _shown(content: bytes) -> str:
    """The strings that a content stream shows, a line for each that moves down."""
    out: list[str] = []
    held: list[str] = []
    for m in _SHOWN.finditer(content):
        if m["op"]:
            if m["op"] in (b"Tj", b"TJ", b"'", b'"'):
                out.append(("\n" if m["op"] in (b"'", b'"') else "") + "".join(held))
            elif m["op"] in (b"T*", b"Td", b"TD", b"ET") and out and out[-1] != "\n":
                out.append("\n")
            held = []
        elif m["gap"]:
            if held and float(m["gap"]) <= -GAP:
                held.append(" ")
        else:
            raw = _plain(m[0])
            held.append(raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace"))
    return "".join(out)


def plain_pdf_text(content: bytes) -> str:
    """The text of a PDF whose fonts use standard encodings; an engine for ``files.with_engines``.

    Only streams that are plain or deflated are read, in the order of the file; fonts with maps of their own need another engine."""
    if not content.startswith(b"%PDF"):
        raise NoText("not a PDF")
    texts = []
    for m in _STREAM.finditer(content):
        body = content[m.end() : content.find(b"endstream", m.end())]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompressobj().decompress(body, MEMBER_BYTES)
            except zlib.error:
                continue
        elif b"/Filter" in m["head"]:
            continue
        if b"BT" in body and re.search(rb"T[Jj]\b", body):
            texts.append(_shown(body).strip("\n"))
    text = "\n".join(t for t in texts if t.strip())
    if not text or b"/Identity-H" in content:
        raise NoText("no text in standard encodings")
    return text
