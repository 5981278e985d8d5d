"""PDF text by page and blocks of documents, on files built here."""

import io
import zipfile
import zlib

import pytest

from maskwell import queries as Q
from maskwell.sources import blocks, pdf, readers, writers


def built(objects: list[bytes], table: str = "xref", trailer: bytes = b"") -> bytes:
    """A file of numbered objects, with its table, with a stream of entries for one, or with a damaged table."""
    out, at = b"%PDF-1.5\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    n = len(objects) + 1
    if table == "stream":
        rows = b"\x00\x00\x00\x00" + b"".join(b"\x01" + a.to_bytes(3, "big") for a in [*at, len(out)])
        up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(rows[i : i + 4], rows[i - 4 : i] if i else bytes(4), strict=True)) for i in range(0, len(rows), 4))
        data = zlib.compress(up)
        start = len(out)
        return out + b"%d 0 obj\n<< /Type /XRef /W [1 3 0] /Size %d /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (n, n + 1, len(data), data, start)
    start = len(out) if table == "xref" else 3
    rows = b"".join(b"%010d 00000 n \n" % a for a in at)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (n, rows, n, trailer, start)


def stream(data: bytes, more: bytes = b"", packed: bool = True) -> bytes:
    body = zlib.compress(data) if packed else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if packed else b"", more, body)


MAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0010> <00660069> endbfchar 1 beginbfrange <0041> <0043> <0061> <0050> <0051> [<03B1> <D83DDE00>] endbfrange"
FIRST = b"BT /F1 12 Tf 72 700 Td [(Hel) 20 (lo) -300 (w\\157rld \\(x\\))] TJ 0 -14 Td (next\\\nline) Tj 30 0 Td (same) Tj T* (third) ' ET % (not this) Tj\n"
SECOND = b"BT /F2 9 Tf 1 0 0 1 72 700 Tm <00410042000300100050 0051> Tj ET"


def sample(table="xref", trailer=b""):
    return built(
        [
            b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 8 0 R] /Count 2 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>",
            stream(FIRST), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>", stream(MAP), b"<< /Type /Pages /Kids [9 0 R] /Parent 2 0 R >>",
            b"<< /Type /Page /Parent 8 0 R /Contents 10 0 R >>", stream(SECOND, packed=False),
        ],
        table, trailer,
    )


@pytest.mark.parametrize("table", ["xref", "stream", "damaged"])
def test_pages(table):
    assert pdf.pages(sample(table)) == ["Hello world (x)\nnextline same\nthird", "ab fiα\U0001f600"]


def test_objects_in_streams():
    inner = [b"<< /Type /Catalog /Pages 5 0 R >>", b"<< /Type /Pages /Kids [6 0 R] >>", b"<< /Type /Page /Contents 2 0 R >>"]
    places, body = [], b""
    for n, o in zip((4, 5, 6), inner, strict=True):
        places.append(b"%d %d" % (n, len(body)))
        body += o + b" "
    head = b" ".join(places) + b" "
    raw = b"%PDF-1.5\n1 0 obj\n" + stream(head + body, b"/Type /ObjStm /N 3 /First %d" % len(head)) + b"\nendobj\n2 0 obj\n" + stream(b"BT (packed) Tj ET") + b"\nendobj\n3 0 obj\n<< /Type /XRef /Root 4 0 R >>\nendobj\n"
    assert pdf.pages(raw) == ["packed"]


@pytest.mark.parametrize(
    "raw, says",
    [
        (b"", "no PDF"), (b"%PDF-1.4\n", "no pages"), (sample(trailer=b"/Encrypt << /V 1 >>"), "encrypted"),
        (built([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Contents 4 0 R >>", stream(b"q 1 0 0 1 0 0 cm /Im1 Do Q")]), "no text layer"),
        (sample().replace(b"/ToUnicode 7 0 R", b""), "without a map"),
    ],
)
def test_unreadable(raw, says):
    with pytest.raises(ValueError, match=says):
        pdf.pages(raw)


def test_many_pages_come_back():
    text = "\n".join(f"line {i} (é) \\ {'word ' * (i % 30)}".rstrip() for i in range(230))
    assert "\n".join(pdf.pages(writers.pdf(text))) == "\n".join(writers.wrap(text, 78))


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
BOOK = packed(
    {
        "xl/workbook.xml": f'<workbook {M}><sheets><sheet name="Late" r:id="r2"/><sheet name="Early" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/other.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {M}><si><t>he</t><r><t>y</t></r></si></sst>",
        "xl/other.xml": f'<worksheet {M}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AB2"><v>7</v></c></row><row r="9"><c r="A9" t="b"><v>1</v></c><c r="B9"/></row></sheetData></worksheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {M}><sheetData><row><c t="inlineStr"><is><t>in</t></is></c><c><v>1.5</v></c></row></sheetData></worksheet>',
    }
)


def test_sheets_keep_their_places():
    assert list(blocks.xlsx_blocks(BOOK)) == [(1, "hey", None, None, "Late", "B2"), (1, "7", None, None, "Late", "AB2"), (1, "True", None, None, "Late", "A9"), (2, "in", None, None, "Early", "A1"), (2, "1.5", None, None, "Early", "B1")]
    assert blocks.xlsx_text(BOOK) == "Sheet: Late\n\they" + "\t" * 26 + "7\nTrue\nSheet: Early\nin\t1.5"
    assert [blocks.letters(n) for n in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"] and blocks.column("AAA7") == 703


WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
LETTER = packed(
    {
        "word/styles.xml": f'<w:styles {WORD}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/document.xml": f'<w:document {WORD}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t> </w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>body</w:t><w:tab/><w:t>x</w:t></w:r></w:p></w:body></w:document>',
    }
)


def test_blocks(spark):
    zone = "P<UTOERIKSSON<<ANNA<MARIA" + "<" * 19 + "\n" + "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    rows = [("a.docx", LETTER), ("b.xlsx", BOOK), ("c.pdf", sample()), ("d.docx", b"broken"), ("e.png", b"x"), ("f.docx", writers.docx(""))]
    found = blocks.blocks(spark.createDataFrame(rows, "path string, content binary"))
    got = sorted((r.path, r.block or 0, r.page, r.text, r.type, r.style, r.content_type, r.sheet, r.cell) for r in found.filter("error is null").collect())
    assert got[:3] == [("a.docx", 1, 1, "Title", "text", "heading 1", None, None, None), ("a.docx", 2, 1, "body\tx", "text", "Normal", None, None, None), ("a.docx", 3, 1, "cell", "text", None, "table_cell", None, None)]
    assert [r[3] for r in got if r[0] == "c.pdf"] == ["Hello world (x)", "nextline same", "third", "ab fiα\U0001f600"]
    assert {r.path: r.error for r in found.filter("error is not null").collect()}.keys() == {"d.docx", "e.png"}
    totals = {r.path: (r.pages, r.blocks, r.failed) for r in blocks.totals(found).collect()}
    assert totals == {"a.docx": (1, 3, False), "b.xlsx": (2, 5, False), "c.pdf": (2, 4, False), "d.docx": (0, 0, True), "e.png": (0, 0, True)}
    mrz = blocks.blocks(spark.createDataFrame([("z", zone)], "path string, content string"), "own", {"own": lambda t: [(1, t, None, None, None, None)]})
    assert mrz.first().type == "mrz"


def test_unreadable_pdf_is_an_error_row(spark):
    rows = [("a.pdf", sample()), ("b.pdf", b"%PDF-1.4 nothing")]
    got = {r.path: (r.text, r.error) for r in readers.ingest(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.pdf"][0].startswith("Hello world (x)") and "\n\nab fi" in got["a.pdf"][0] and got["a.pdf"][1] is None
    assert got["b.pdf"] == (None, "ValueError: no pages")


def test_pdf_query(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        lines = [x.encode("latin-1", "replace").decode("cp1252", "replace") for x in writers.wrap(r.text or "", 78)]
        for page in range(0, len(lines), 50):
            own = [x for x in lines[page : page + 50] if x.strip()]
            if own:
                want[r.doc_id, page // 50 + 1] = (len(own), sum(map(len, own)))
    assert {(r.doc_id, r.page): (r.lines, r.characters) for r in Q.QUERIES["pdf_lines"](spark, sf).collect()} == want
