"""Blocks of documents: a row a paragraph, table cell, sheet cell or line, with its style or place.

One Arrow pass over ``binaryFile`` rows; parts of a file are parsed as events, so a large sheet is never a tree in memory,
and a file that cannot be read is one row with its error.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import validate
from . import pdf

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BLOCK = "page int, block int, text string, style string, content_type string, sheet string, cell string, error string"

Block = tuple[int, str, str | None, str | None, str | None, str | None]  # page, text, style, content type, sheet, cell


def _styles(z: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in z.namelist():
        return {}
    return {s.get(f"{W}styleId"): (s.find(f"{W}name").get(f"{W}val") if s.find(f"{W}name") is not None else s.get(f"{W}styleId")) for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style")}


def docx_blocks(raw: bytes) -> Iterator[Block]:
    """Paragraphs that are not blank with their style, then those of table cells."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    styles, cells, depth = _styles(z), [], 0
    default = styles.get("Normal", "Normal")
    for event, e in ElementTree.iterparse(z.open("word/document.xml"), ("start", "end")):
        if e.tag == f"{W}tbl":
            depth += 1 if event == "start" else -1
        elif e.tag == f"{W}p" and event == "end":
            text = "".join((x.text or "") if x.tag == f"{W}t" else "\t" if x.tag == f"{W}tab" else "\n" for x in e.iter() if x.tag in (f"{W}t", f"{W}tab", f"{W}br"))
            style = e.find(f"{W}pPr/{W}pStyle")
            e.clear()
            if not text.strip():
                continue
            if depth:
                cells.append((1, text, None, "table_cell", None, None))
            else:
                own = style.get(f"{W}val") if style is not None else None
                yield 1, text, styles.get(own, own) if own else default, None, None, None
    yield from cells


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet, by the workbook's relations."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in z.namelist() else {}
    out = []
    for i, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{M}sheet"), 1):
        target = rels.get(s.get(f"{R}id"), f"worksheets/sheet{i}.xml")
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")))
    return out


def sheet_names(raw: bytes) -> list[str]:
    return [name for name, _ in sheets(zipfile.ZipFile(io.BytesIO(raw)))]


def letters(n: int) -> str:
    """Column ``n`` (from 1) as in A1."""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def column(address: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", address)[0]:
        n = 26 * n + ord(c) - 64
    return n


def rows(z: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """(row, [(column, text)]) of a sheet; cells without a value are left out, places are those of the file."""
    row = 0
    for _, e in ElementTree.iterparse(z.open(part), ("end",)):
        if e.tag != f"{M}row":
            continue
        row, at, own = int(e.get("r") or row + 1), 0, []
        for c in e.iter(f"{M}c"):
            at = column(c.get("r")) if c.get("r") else at + 1
            v, kind = c.find(f"{M}v"), c.get("t")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{M}t"))
            elif v is None or v.text is None:
                continue
            else:
                text = shared[int(v.text)] if kind == "s" else {"1": "True", "0": "False"}.get(v.text, v.text) if kind == "b" else v.text
            own.append((at, text))
        e.clear()
        yield row, own


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml"), ("end",)):
        if e.tag == f"{M}si":
            out.append("".join(t.text or "" for t in e.iter(f"{M}t")))
            e.clear()
    return out


def xlsx_blocks(raw: bytes) -> Iterator[Block]:
    """Cells that have a value, with sheet and address; a sheet is a page."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = shared_strings(z)
    for page, (name, part) in enumerate(sheets(z), 1):
        for row, cells in rows(z, part, shared):
            for at, text in cells:
                yield page, text, None, None, name, f"{letters(at)}{row}"


def xlsx_text(raw: bytes) -> str:
    """Each sheet: its name, then its rows, cells joined by tabs, those left out kept empty."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared, out = shared_strings(z), []
    for name, part in sheets(z):
        out.append(f"Sheet: {name}")
        for _, cells in rows(z, part, shared):
            held = dict(cells)
            out.append("\t".join(held.get(i, "") for i in range(1, max(held, default=0) + 1)))
    return "\n".join(out)


def pdf_blocks(raw: bytes) -> Iterator[Block]:
    """Lines that are not blank, by page."""
    for page, text in enumerate(pdf.pages(raw), 1):
        for line in text.split("\n"):
            if line.strip():
                yield page, line, None, None, None, None


READERS = {"docx": docx_blocks, "excel": xlsx_blocks, "pdf": pdf_blocks}
AT_ONCE = 4096  # blocks of a batch


def blocks(files: DataFrame, kind: str | None = None, readers: dict | None = None) -> DataFrame:
    """path, page, block, text, type, style, content_type, sheet, cell, error of (path, content) rows.  ``type`` is ``mrz`` for
    a machine-readable zone, else ``text``; ``kind`` overrides what the path's ending says; ``readers`` adds kinds."""
    from .readers import kind as kind_of

    use = {**READERS, **(readers or {})}
    own = files.select(F.col("path").cast("string").alias("path"), "content", (F.lit(kind) if kind else kind_of(F.col("path"))).alias("kind"))
    names = ["path", "page", "block", "text", "style", "content_type", "sheet", "cell", "error"]

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("block", pa.int32()), *[(n, pa.string()) for n in names[3:]]])
        held: list[tuple] = []
        for batch in batches:
            for path, content, k in zip(*(batch.column(i) for i in range(3)), strict=True):
                done = 0
                try:
                    for done, (page, *rest) in enumerate(use[k.as_py()](content.as_py()), 1):  # noqa: B007
                        held.append((path.as_py(), page, done, *rest, None))
                        if len(held) >= AT_ONCE:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held = []
                except Exception as e:  # a damaged file is one row's error, after what could be read
                    said = f"no reader for {k.as_py()}" if isinstance(e, KeyError) and k.as_py() not in use else f"{type(e).__name__}: {e}"[:200]
                    held.append((path.as_py(), None, None, None, None, None, None, None, said))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    found = own.mapInArrow(run, f"path string, {BLOCK}")
    mrz = F.when(F.col("text").isNotNull(), F.when(validate.mrz_kind(F.col("text")).isNotNull(), "mrz").otherwise("text"))
    return found.select("path", "page", "block", "text", mrz.alias("type"), "style", "content_type", "sheet", "cell", "error")


def totals(found: DataFrame) -> DataFrame:
    """Per document: pages and blocks that have text, machine-readable zones, and whether something could not be read."""
    has = F.col("text").isNotNull()
    return found.groupBy("path").agg(F.count_distinct(F.when(has, F.col("page"))).alias("pages"), F.count_if(has).alias("blocks"), F.count_if(F.col("type") == "mrz").alias("zones"), F.bool_or(F.col("error").isNotNull()).alias("failed"))
