"""Sources: files of many formats, tables, text and pages become rows (path, text, meta, error).

Text, CSV, JSON and HTML stay in built-in expressions.  DOCX, XLSX and PDF are opened with the
standard library in Arrow batches of ``binaryFile`` rows.  OCR and model-backed readers are hooks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import html_text
from . import blocks, pdf, structure

# Suffixes by kind, upload types, and the upload bound.
SUFFIXES = {
    "pdf": ("pdf",),
    "image": ("png", "jpg", "jpeg", "tiff", "bmp", "gif"),
    "docx": ("docx",),
    "excel": ("xlsx", "xls"),
    "csv": ("csv",),
    "json": ("json",),
    "text": ("txt", "md", "py", "js", "html", "xml"),
}
UPLOAD_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "tiff": "image/tiff",
}
MAX_UPLOAD = 50 * 1024 * 1024


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind(path: Column) -> Column:
    s = suffix(path)
    out = F.lit("text")
    for name, suffixes in SUFFIXES.items():
        out = F.when(s.isin(*suffixes), name).otherwise(out)
    return out


def upload_error(path: Column, size: Column, mime: Column) -> Column:
    """Null for an acceptable upload, else the reason."""
    types = F.create_map(*[F.lit(x) for kv in UPLOAD_TYPES.items() for x in kv])
    own = F.try_element_at(types, suffix(path))
    return F.when(own.isNull() | ~mime.isin(*UPLOAD_TYPES.values()), "type").when(own != mime, "mismatch").when(size > MAX_UPLOAD, "size").when(size == 0, "empty")


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def decoded(content: Column) -> Column:
    """UTF-8, or else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def line_count(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("\n")) + 1).cast("long")


def text_files(files: DataFrame) -> DataFrame:
    text = decoded(F.col("content"))
    return files.select("path", text.alias("text")).withColumn("meta", F.create_map(F.lit("lines"), line_count(F.col("text")).cast("string"))).withColumn("error", F.lit(None).cast("string"))


def docx_text(raw: bytes) -> str:
    """Paragraphs that are not blank, by line; then table rows, cells joined by a bar."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{w}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    lines = [t for p in body.findall(f"{w}p") if (t := said(p)).strip()]
    for row in body.iter(f"{w}tr"):
        cells = [t for c in row.findall(f"{w}tc") if (t := said(c).strip())]
        if cells:
            lines.append(" | ".join(cells))
    return "\n".join(lines)


def pdf_text(raw: bytes) -> str:
    """Pages joined by a blank line."""
    return "\n\n".join(pdf.pages(raw))


def _pdf_file(raw: bytes) -> tuple[str, dict]:
    own = pdf.pages(raw)
    return "\n\n".join(own), {"pages": len(own)}


#: Readers by kind: the text, and what else the file holds.
OPENERS: dict[str, Callable[[bytes], tuple[str | None, dict]]] = {
    "csv": structure.csv_file, "json": structure.json_file, "pdf": _pdf_file, "docx": lambda raw: (docx_text(raw), {"document_properties": structure.properties(raw)}),
    "excel": lambda raw: (blocks.xlsx_text(raw), {"sheets": blocks.sheet_names(raw), "document_properties": structure.properties(raw)}), "image": lambda raw: (None, structure.image(raw)),
}


def ingest(files: DataFrame, openers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, text, meta, error of ``binaryFile`` rows, by kind.  ``openers`` replaces a kind's reader of text (OCR for ``image``,
    say).  ``meta`` has the ``structure`` as JSON: columns, keys, properties, pages, an image's size; a file that cannot be read is
    a row with its error, and so is an image without a reader."""
    own = dict(openers or {})

    @F.pandas_udf("text string, structure string, error string")
    def opened(kinds, contents):
        import json

        import pandas as pd

        rows = []
        for k, raw in zip(kinds, contents, strict=True):
            try:
                text, shape = (own[k](bytes(raw)), {}) if k in own else OPENERS[k](bytes(raw)) if k in OPENERS else (None, {})
                rows.append((text, json.dumps(shape), None if text is not None else f"no reader for {k}"))
            except Exception as e:  # a damaged file is one row's error
                rows.append((None, None, f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(rows, columns=["text", "structure", "error"])

    df = files.select("path", "content", kind(F.col("path")).alias("kind"), F.length("content").cast("string").alias("size"))
    none = F.lit(None).cast("string")
    native = df.filter(F.col("kind") == "text").select("path", "kind", "size", decoded(F.col("content")).alias("text"), none.alias("structure"), none.alias("error"))
    native = native.withColumn("text", F.when(suffix(F.col("path")) == "html", html_text(F.col("text"))).otherwise(F.col("text")))
    other = df.filter(F.col("kind") != "text").withColumn("r", opened("kind", "content")).select("path", "kind", "size", "r.text", "r.structure", "r.error")
    meta = F.map_filter(F.create_map(F.lit("kind"), F.col("kind"), F.lit("size"), F.col("size"), F.lit("structure"), F.col("structure")), lambda k, v: v.isNotNull())
    return native.unionByName(other).select("path", "text", meta.alias("meta"), "error")


def from_table(df: DataFrame, fields: list[str], condition: str | None = None, limit: int = 100, order: str | None = None) -> DataFrame:
    """Rows of any source as text: the present fields joined by a blank line, and their names."""
    if condition:
        df = df.filter(condition)
    if order:
        df = df.orderBy(order)
    df = df.limit(limit)
    own = [f for f in fields if f in df.columns]
    names = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in own]))
    return df.withColumn("text", F.concat_ws("\n\n", *[F.col(f).cast("string") for f in own])).withColumn("fields", names)


def json_shape(text: Column) -> Column:
    """object keys, or array length."""
    keys = F.json_object_keys(text)
    return F.struct(F.when(keys.isNotNull(), "object").when(F.json_array_length(text).isNotNull(), "array").alias("kind"), keys.alias("keys"), F.json_array_length(text).alias("length"))


def box(left: Column, top: Column, width: Column, height: Column) -> Column:
    """(left, top, width, height) as corners."""
    return F.array(left.cast("double"), top.cast("double"), (left + width).cast("double"), (top + height).cast("double"))
