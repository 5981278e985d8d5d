"""Sinks: redacted documents as JSON, CSV, text, API rows, DOCX and PDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import redact as R
from ..functions import score
from ..operators.report import audit_entry
from ..operators.spans import SPANS, explode

FORMS = ("pdf", "docx", "json", "csv", "text", "api_response")
# Columns of the entity file and the wording of headers.
ENTITY_COLUMNS = ("pii_type", "original_text", "redacted_text", "confidence", "risk_level", "start_position", "end_position")
TITLE, STATISTICS, STATISTICS_HEAD = "Redacted Document", "Redaction Statistics", ("PII Type", "Count")


def json_rows(redacted: DataFrame, key: str = "doc_id") -> DataFrame:
    """One JSON object a document."""
    body = F.to_json(F.struct(F.col(key), "redacted_text", "redaction_count", F.size("spans").alias("entity_count")))
    return redacted.select(key, body.alias("value"))


#: Columns of span rows that the entity table is made of.
ENTITY_FROM = ("type", "entity", "space", "confidence", "start_char", "end_char")


def entity_columns(rows: DataFrame, redact_of, key: str = "doc_id") -> DataFrame:
    """Span rows as the entity table has them: seven columns beside the key."""
    return rows.select(key, F.col("type").alias("pii_type"), F.col("entity").alias("original_text"), redact_of(F.col("type"), F.col("entity")).alias("redacted_text"), "confidence", score.risk(F.col("type"), F.col("space"), F.col("confidence")).alias("risk_level"), F.col("start_char").alias("start_position"), F.col("end_char").alias("end_position"))


def entity_rows(found: DataFrame, redact_of, key: str = "doc_id") -> DataFrame:
    """The entity table of documents with their spans."""
    return entity_columns(explode(found, key), redact_of, key)


def text_rows(redacted: DataFrame, key: str = "doc_id") -> DataFrame:
    head = F.concat(F.lit("REDACTED DOCUMENT\nDocument: "), F.col(key).cast("string"), F.lit("\nEntities: "), total(F.col("redaction_count")).cast("string"), F.lit("\n\n"))
    return redacted.select(key, F.concat(head, "redacted_text").alias("value"))


def total(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x)


def api_rows(redacted: DataFrame, key: str = "doc_id") -> DataFrame:
    return redacted.select(key, F.struct("redacted_text", F.struct(total(F.col("redaction_count")).alias("total_redactions"), F.col("redaction_count").alias("by_type")).alias("statistics")).alias("response"))


def wrap(text: str, width: int) -> list[str]:
    """Greedy lines of at most ``width`` characters; longer words stand alone."""
    out = []
    for line in text.split("\n"):
        held = ""
        for word in line.split(" "):
            if held and len(held) + 1 + len(word) > width:
                out.append(held)
                held = word
            else:
                held = f"{held} {word}" if held else word
        out.append(held)
    return out


def pdf(text: str, width: int = 78, lines: int = 50, facts: tuple[str, ...] = (), counts: dict[str, int] | None = None) -> bytes:
    """A plain PDF: as many pages as the text needs.  ``facts`` go before the text, the ``counts`` of types after it."""
    rows = wrap(text, width)
    if facts:
        rows = [*facts, "", *rows]
    if counts is not None:
        rows = [*rows, "", STATISTICS, *[f"{k}: {n}" for k, n in counts.items()]]
    pages = [rows[i : i + lines] for i in range(0, len(rows), lines)] or [[]]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))), len(pages)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"]
    for i, page in enumerate(pages):
        safe = [r.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for r in page]
        body = b"BT /F1 10 Tf 72 740 Td 13 TL\n" + b"\n".join(b"(%s) Tj T*" % r for r in safe) + b"\nET"
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (5 + 2 * i))
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    table = b"".join(b"%010d 00000 n \n" % a for a in at)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, table, len(at) + 1, len(out))


def docx(text: str, facts: tuple[str, ...] = (), counts: dict[str, int] | None = None) -> bytes:
    """A plain DOCX: a paragraph a line; equal input gives equal bytes.  ``facts`` are a heading and paragraphs before the text,
    ``counts`` a heading and a table after it."""
    import io
    import re
    import zipfile
    from xml.sax.saxutils import escape

    def run(line):
        line = re.sub("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", line)  # without what XML cannot hold
        return f'<w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r>'

    def heading(line, level):
        return f'<w:p><w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>{run(line)}</w:p>'

    def paragraph(line):
        return f"<w:p>{run(line)}</w:p>"

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    parts = [heading(facts[0], 1), *map(paragraph, facts[1:]), paragraph("_" * 50)] if facts else []
    parts += map(paragraph, text.split("\n"))
    if counts is not None:
        rows = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(str(c))}</w:tc>" for c in row) + "</w:tr>" for row in (STATISTICS_HEAD, *counts.items()))
        parts += [heading(STATISTICS, 2), f'<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/></w:tblPr>{rows}</w:tbl>']
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/></w:style>' for i in (1, 2)) + '<w:style w:type="table" w:styleId="TableGrid"><w:name w:val="Table Grid"/></w:style>'
    rels = "http://schemas.openxmlformats.org/package/2006/relationships"
    files = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{kind}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{rels}"><Relationship Id="r1" Type="{office}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{rels}"><Relationship Id="r1" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "word/styles.xml": f'<w:styles xmlns:w="{w}">{styles}</w:styles>',
        "word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{"".join(parts)}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0"?>' + body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def rendered(redacted: DataFrame, form: str, key: str = "doc_id") -> DataFrame:
    """key, content: each document as a PDF or DOCX file's bytes."""
    make = {"pdf": pdf, "docx": docx}[form]

    @F.pandas_udf("binary")
    def render(texts):
        return texts.map(lambda t: make(t or ""))

    return redacted.select(key, render("redacted_text").alias("content"))


def write(redacted: DataFrame, form: str, path: str, key: str = "doc_id") -> None:
    """Write all documents in one form: json, text, csv (entities), api, pdf or docx (as rows of bytes)."""
    if form == "json":
        json_rows(redacted, key).select("value").write.text(path)
    elif form == "text":
        text_rows(redacted, key).select("value").write.option("lineSep", "\n\f\n").text(path)
    elif form == "csv":
        entity_rows(redacted, lambda t, c: R.replacement(t, c), key).write.option("header", True).csv(path)
    elif form == "api":
        api_rows(redacted, key).write.json(path)
    elif form in ("pdf", "docx"):
        rendered(redacted, form, key).write.parquet(path)
    else:
        raise ValueError(f"unknown output form: {form}")


# ---------------------------------------------------------------- whole results


def detected(spans: Column, **options) -> Column:
    """The spans as an output names them: what they are, what became of them, their risk and their place."""

    def entity(s):
        values = (s["type"], s["text"], R.replacement(s["type"], s["text"], **options), s["confidence"], score.risk(s["type"], s["space"], s["confidence"]), s["start"], s["end"])
        return F.struct(*[v.alias(name) for v, name in zip(values, ENTITY_COLUMNS, strict=True)])

    return F.transform(spans, entity)


def _files(df: DataFrame, forms: list[str], key: str) -> DataFrame:
    """Documents as files, with the error of one that cannot be made: key, redaction_count, format, content, error, row_count;
    one pass for all kinds, a file at a time."""
    make = {"pdf": pdf, "docx": docx}
    given = df.select(key, "redacted_text", "__facts", F.map_keys("redaction_count").alias("__types"), F.map_values("redaction_count").alias("__numbers"))
    kept = f"{key} {df.schema[key].dataType.simpleString()}, __types array<string>, __numbers array<bigint>"

    def render(batches):
        import pandas as pd

        for batch in batches:
            for form in forms:
                made = []
                for t, f, k, n in zip(batch["redacted_text"], batch["__facts"], batch["__types"], batch["__numbers"], strict=True):
                    try:
                        made.append((None, None) if t is None else (make[form](t, facts=tuple(f), counts=dict(zip(k, n, strict=True))), None))
                    except Exception as e:  # noqa: BLE001  the row's error
                        made.append((None, f"{type(e).__name__}: {e}"))
                yield batch[[key, "__types", "__numbers"]].assign(format=form, content=pd.Series([m[0] for m in made], index=batch.index, dtype=object), error=pd.Series([m[1] for m in made], index=batch.index, dtype=object))

    done = given.mapInPandas(render, f"{kept}, format string, content binary, error string")
    error = F.coalesce("error", F.when(F.col("content").isNull(), "No text to redact"))
    return done.select(key, F.map_from_arrays("__types", "__numbers").alias("redaction_count"), "format", "content", error.alias("error"), F.lit(None).cast("long").alias("row_count"))


def formatted(redacted: DataFrame, *forms: str, key: str = "doc_id", at: Column | None = None, user: str | None = None, frameworks: tuple[str, ...] = (), metadata: dict[str, str] | None = None, path: str | None = None, **options) -> DataFrame:
    """Documents of :func:`maskwell.plans.engine.redact` (with the same ``options``) in each of ``forms``, a row a document and form.

    Columns: the key, format, success, error, content (the file's bytes), size_bytes, row_count (entities of ``csv``) and
    ``audit``.  One pass for the forms of text, one for files; no shuffle.  A null text, a form that is not known and a file that cannot be made give rows without
    success, and stop nothing.  ``at`` is the time stated (now); ``metadata`` are stated in JSON and API rows.
    """
    at = F.current_timestamp() if at is None else at
    text, id_ = F.col("redacted_text"), F.col(key).cast("string")
    if "spans" not in redacted.columns and {"json", "csv"} & {f.lower() for f in forms}:
        raise ValueError("JSON and CSV state the spans, which these documents were redacted without")
    spans = F.coalesce("spans", F.array()) if "spans" in redacted.columns else F.array().cast(SPANS)
    counts = F.coalesce("redaction_count", F.create_map().cast("map<string,bigint>"))
    stamp, iso = F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    stated = F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv]).cast("map<string,string>")
    df = redacted.select(key, text, spans.alias("spans"), counts.alias("redaction_count"), stamp.alias("__stamp"), iso.alias("__iso"), stated.alias("__meta"), detected(spans, **options).alias("__entities"))
    df = df.withColumn("__facts", F.array(F.lit(TITLE), F.concat(F.lit("Processed: "), "__stamp"), F.concat(F.lit("Document ID: "), F.coalesce(id_, F.lit("")))))
    counts, entities = F.col("redaction_count"), F.col("__entities")

    def whole(content: Column, rows: Column | None = None) -> tuple[Column, Column, Column]:
        none = F.lit(None).cast("string")
        return F.when(text.isNotNull(), content.cast("binary")), none, (F.lit(None) if rows is None else rows).cast("long")

    def made(form: str) -> tuple[Column, Column, Column]:
        if form == "json":
            return whole(F.to_json(F.struct(id_.alias("document_id"), text, counts, entities.alias("detected_entities"), F.col("__iso").alias("processed_at"), F.col("__meta").alias("metadata"))))
        if form == "csv":
            line = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
            return whole(F.array_join(F.concat(F.array(F.lit(",".join(ENTITY_COLUMNS))), F.transform(entities, lambda e: F.to_csv(e, line)), F.array(F.lit(""))), "\n"), F.size(entities))
        if form == "text":
            return whole(F.concat(F.lit("===== REDACTED DOCUMENT =====\n"), F.element_at("__facts", 2), F.lit("\n"), F.element_at("__facts", 3), F.lit("\n" + "=" * 30 + "\n\n"), text))
        if form == "api_response":
            statistics = F.struct(total(counts).alias("total_redactions"), counts.alias("by_type"))
            return whole(F.to_json(F.struct(F.lit(True).alias("success"), text, F.col("__meta").alias("metadata"), F.col("__iso").alias("timestamp"), statistics.alias("redaction_statistics"))))
        return F.lit(None).cast("binary"), F.lit(f"Unsupported format type: {form}"), F.lit(None).cast("long")

    forms, each = tuple(dict.fromkeys(f.lower() for f in forms)), []
    files = [form for form in forms if form in ("pdf", "docx")]
    parts = [_files(df, files, key)] if files else []
    for form in forms:
        if form not in ("pdf", "docx"):
            content, error, rows = made(form)
            each.append(F.struct(F.lit(form).alias("format"), content.alias("content"), F.coalesce(error, F.when(text.isNull(), "No text to redact")).alias("error"), rows.alias("row_count")))
    if each:
        parts.append(df.select(key, counts, F.explode(F.array(*each)).alias("f")).select(key, "redaction_count", "f.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.withColumn("success", F.col("error").isNull())
    audit = audit_entry(F.col("format"), F.col(key), F.col("redaction_count"), F.col("success"), at, user, frameworks, path)
    return out.select(key, "format", "success", "error", "content", F.octet_length("content").cast("long").alias("size_bytes"), F.when(F.col("success"), F.col("row_count")).alias("row_count"), audit.alias("audit"))


def save(redacted: DataFrame, path: str, *forms: str, **options) -> DataFrame:
    """Write :func:`formatted` rows as Parquet under ``path``, a folder a form, and give what was written, without the contents."""
    formatted(redacted, *forms, path=path, **options).write.partitionBy("format").mode("overwrite").parquet(path)
    return redacted.sparkSession.read.parquet(path).drop("content")
