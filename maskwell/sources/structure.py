"""What files hold beside their text: columns, rows and a sample; keys; properties; the size of an image; in one pass over each file."""

from __future__ import annotations

import csv
import io
import json
import struct
import zipfile
from xml.etree import ElementTree


def decoded(raw: bytes) -> tuple[str, str]:
    """(text, encoding): UTF-8, or else Latin-1."""
    try:
        return raw.decode("utf-8-sig"), "utf-8"
    except UnicodeDecodeError:
        return raw.decode("latin-1"), "latin1"


def csv_file(raw: bytes, sample: int = 5) -> tuple[str, dict]:
    """Rows as lines of tab-joined fields, and {columns, rows, sample, encoding}; rows are read one by one."""
    text, encoding = decoded(raw)
    lines = csv.reader(io.StringIO(text, newline=""), strict=True)
    columns = next(lines, None)
    if columns is None:
        raise ValueError("no columns")
    out, first, n = ["\t".join(columns)], [], 0
    for row in lines:
        if not row:
            continue
        if len(row) > len(columns):
            raise ValueError(f"line {lines.line_num} has {len(row)} fields of {len(columns)}")
        n += 1
        out.append("\t".join(row))
        if n <= sample:
            first.append(dict(zip(columns, [*row, *[None] * (len(columns) - len(row))], strict=True)))
    return "\n".join(out), {"columns": columns, "rows": n, "sample": first, "encoding": encoding}


def json_file(raw: bytes) -> tuple[str, dict]:
    """The value printed with an indent of two, and its structure: an object's keys, or an array's length and first keys."""
    value = json.loads(raw.decode("utf-8-sig"))
    shape: dict = {}
    if isinstance(value, dict):
        shape = {"type": "object", "keys": list(value)}
    elif isinstance(value, list):
        shape = {"type": "array", "length": len(value)}
        if value and isinstance(value[0], dict):
            shape["sample_keys"] = list(value[0])
    return json.dumps(value, indent=2), shape


# The core properties of a document, by their names in the file.
PROPERTIES = {
    "creator": "author", "category": "category", "description": "comments", "contentStatus": "content_status", "created": "created", "identifier": "identifier", "keywords": "keywords", "language": "language",
    "lastModifiedBy": "last_modified_by", "lastPrinted": "last_printed", "modified": "modified", "revision": "revision", "subject": "subject", "title": "title", "version": "version",
}


def properties(raw: bytes) -> dict[str, str]:
    """Core properties of a DOCX or XLSX file, those without a value left out."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    if "docProps/core.xml" not in z.namelist():
        return {}
    found = {PROPERTIES.get(e.tag.rpartition("}")[2]): (e.text or "").strip() for e in ElementTree.fromstring(z.read("docProps/core.xml"))}
    return {k: v for k, v in found.items() if k and v}


def image(raw: bytes) -> dict:
    """Format and size of an image from its header, nothing for an unknown one; its text needs OCR."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        kind, (width, height) = "PNG", struct.unpack(">II", raw[16:24])
    elif raw[:6] in (b"GIF87a", b"GIF89a"):
        kind, (width, height) = "GIF", struct.unpack("<HH", raw[6:10])
    elif raw[:2] == b"BM":
        kind, (width, height) = "BMP", struct.unpack("<ii", raw[18:26])
    elif raw[:2] == b"\xff\xd8":
        kind, at = "JPEG", 2
        while raw[at] == 0xFF and not (0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC)):
            at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
        height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
    else:
        return {}
    return {"format": kind, "width": width, "height": abs(height)}
