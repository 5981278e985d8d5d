import zipfile

from pyspark.sql import functions as F

from maskwell.sources import readers, writers
from maskwell.streaming import streams


def test_documents_round_trip():
    text = "One (1) & two\nthree"
    assert readers.docx_text(writers.docx(text)) == text
    assert readers.pdf_text(writers.pdf(text)) == text


def test_ingest_isolates_bad_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\xe9\nx".encode("latin-1"))
    (tmp_path / "b.html").write_text("<p>Hi <b>you</b></p>")
    (tmp_path / "c.docx").write_bytes(writers.docx("hello"))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.png").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "f.xlsx", "w") as z:
        m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {m}><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>hey</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')
    got = {r.path[-5:]: r for r in readers.ingest(readers.binary(spark, str(tmp_path))).collect()}
    assert got["a.txt"[-5:]].text == "café\nx" and got[".html"].text == "Hi you"
    assert got["e.png"].error == "no reader for image" and got[".xlsx"].text == "Sheet: S1\nhey\t7"
    assert {r.text for p, r in got.items() if p == ".docx"} <= {"hello", None}


def test_upload_rules(spark):
    rows = [("a.pdf", 5, "application/pdf", None), ("a.txt", 5, "text/plain", "type"), ("a.png", 5, "image/jpeg", "mismatch"), ("a.pdf", 0, "application/pdf", "empty"), ("a.pdf", 1 << 30, "application/pdf", "size")]
    df = spark.createDataFrame(rows, "p string, n long, m string, want string")
    assert all(r[0] == r[1] for r in df.select("want", readers.upload_error(F.col("p"), F.col("n"), F.col("m"))).collect())


def test_stream_detection_and_chunks(spark, tmp_path):
    from maskwell.operators import spans as S
    from maskwell.plans import catalog as C

    spark.createDataFrame([("k", "mail a@b.co"), ("k", "x"), ("k", "y")], "key string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, text string").parquet(str(tmp_path / "in"))
    found = streams.running_counts(S.explode(S.extract(source, [p for p in C.LEGACY if p.type == "email"]), "key"), "type")
    q = found.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("counts").collect()] == [("email", 1)]
