"""Files in and out, and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import batches, files
from tessera.streaming import windows as win


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n{bad\n[1]\n', encoding="utf-8")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    good, bad = files.read_jsonl_tolerant(spark, str(p), schema)
    assert sorted((r.a, r.b) for r in good.collect()) == [(1, "x"), (2, None)]
    assert sorted(r.reason for r in bad.collect()) == ["bad_json", "not_an_object"]
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(p), schema).collect()


def test_csv_with_byte_order_mark(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('code,v\n000001,"a\nb"\n'.encode("utf-8-sig"))
    assert [tuple(r) for r in files.read_csv(spark, str(p)).select("code", "v").collect()] == [("000001", "a\nb")]


def test_dictionary_lookup_keeps_order(spark, tmp_path):
    p = tmp_path / "d.txt"
    p.write_text("0101010101 甲\n0202020202   乙 丙\nnothing\n", encoding="utf-8")
    rows = spark.createDataFrame([(1, "0202020202|9999999999|0101010101"), (2, None)], "id long, codes string")
    got = files.lookup_codes(rows, F.col("codes"), files.read_code_dictionary(spark, str(p)), "id").orderBy("id").collect()
    assert [r.names for r in got] == [["乙 丙", "甲"], []]


def _xlsx(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>qty</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>000001</t></is></c><c r="C2"><v>5</v></c></row><row r="3"><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>code</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    path.write_bytes(buf.getvalue())


def test_xlsx_and_types(spark, tmp_path):
    _xlsx(tmp_path / "a.xlsx")
    df = files.read_xlsx(spark, str(tmp_path / "a.xlsx"), ["code", "qty", "absent"])
    assert [tuple(r) for r in df.collect()] == [("000001", "5", None), (None, "true", None)]
    t = files.typed(spark.createDataFrame([("000001", "5", "20240131"), ("", "NaN", None)], "code string, qty string, ann_dt string"))
    assert [tuple(r) for r in t.collect()] == [("000001", 5.0, "2024-01-31"), (None, None, None)]


def test_first_sheet_is_the_one_the_workbook_lists_first():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="b" r:id="rId2"/><sheet name="a" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        for n in (1, 2):
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{main}"><sheetData><row><c><v>{n}</v></c><c r="AB1" t="str"><v>x</v></c></row></sheetData></worksheet>')
    assert list(files.sheet_rows(buf.getvalue())) == [["2", *[None] * 26, "x"]]


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>第一</w:t><w:tab/><w:t>段</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>格</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in files.read_docx(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "第一 段\n格", "bad.docx": None}


def test_folder_scan_is_incremental(spark, tmp_path):
    (tmp_path / "600000.SH").mkdir()
    (tmp_path / "600000.SH" / "600000.SH_2024-01-31_report.txt").write_text("x")
    (tmp_path / "600000.SH" / "notes.txt").write_text("y")
    f = files.scan_folder(spark, str(tmp_path))
    got = sorted((r.company_id, str(r.published_date), r.document_type) for r in f.collect())
    assert got == [("600000.SH", "1970-01-01", "unknown"), ("600000.SH", "2024-01-31", "report")]
    assert files.unseen_files(f, f.where("document_type = 'report'")).count() == 1


def test_detect_format(spark):
    rows = [(b"%PDF-1.4", "text/html", "a.txt"), (b"abc", "text/html; x", "a.pdf"), (b"abc", None, "http://x/a.DOCX?q"), (b"", None, None)]
    got = spark.createDataFrame(rows, "b binary, t string, u string").select(files.detect_format(F.col("b"), F.col("t"), F.col("u")).alias("f")).collect()
    assert [r.f for r in got] == ["pdf", "html", "docx", "unknown"]


def test_sinks_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "a long, b double")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert sorted((r.a, r.b) for r in files.read_jsonl(spark, str(tmp_path / "j"), "a long, b double").collect() if r.b) == [(2, 0.5)]
    files.write_table(df, str(tmp_path / "t"))
    seen = spark.createDataFrame(files.manifest(spark, str(tmp_path / "t")).collect())
    assert not files.is_stale(spark, seen, str(tmp_path / "t"))
    files.write_table(df.limit(1), str(tmp_path / "t"))
    assert files.is_stale(spark, seen, str(tmp_path / "t"))
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c")).count() == 2
    with pytest.raises(Exception, match="positive"):
        files.require_all(df, F.col("a") > 1, "a must be positive").collect()


def test_answers_are_put_back_in_order(spark):
    inputs = spark.createDataFrame([(f"c{i:02d}", f"t{i}") for i in range(25)], "chunk_id string, input string")
    req = batches.make_requests(inputs, per_request=4, buckets=2)
    assert req.groupBy("custom_id").count().agg(F.max("count")).first()[0] == 4
    answers = req.orderBy(F.rand(1)).select("custom_id", "idx", F.array(F.expr("cast(substring(id, 2) as double)")).alias("embedding"))
    good, bad = batches.collect_answers(req, answers)
    assert bad.count() == 0 and all(int(r.id[1:]) == r.embedding[0] for r in good.collect()) and good.count() == 25
    broken = answers.where("idx > 0").unionByName(answers.where("idx = 1").limit(1)).unionByName(spark.createDataFrame([("zz", 0, [1.0]), ], "custom_id string, idx int, embedding array<double>"))
    _, bad = batches.collect_answers(req, broken)
    assert {r.reason for r in bad.collect()} == {"missing", "repeated", "unknown"}
    assert {r.state for r in batches.shard_status(req, answers.where("false")).collect()} == {"pending"}


@pytest.fixture
def events(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:10:00", 7, "a", 1.0), (2, "2024-01-01 00:50:00", 7, None, 2.0), (2, "2024-01-01 00:50:00", 7, "b", 2.0), (3, "2024-01-01 02:10:00", 8, "a", 4.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))


def _run(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.sql(f"SELECT * FROM {name}")


def test_stream_windows_equal_batch(spark, events):
    batch, stream = events
    for i, fn in enumerate((lambda e: win.tumbling(e, "1 hour", ["event_type"], watermark="10 minutes"), lambda e: win.sliding(e, "2 hours", "1 hour", ["event_type"], watermark="10 minutes"))):
        got = sorted(map(str, _run(fn(stream), "update", f"w{i}").collect()))
        assert got == sorted(map(str, fn(batch).collect()))
    assert win.sessions(batch, "1 hour", "user_id").count() == 2


def test_stream_distinct_and_state(spark, events):
    _, stream = events
    assert _run(win.distinct_events(stream, "event_id"), "append", "d").count() == 3
