"""Readers, sinks and streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.errors import MissingSource
from millrace.profiles import CATALOGUE
from millrace.sources import readers, sinks
from millrace.streaming import checks


def test_csv_encodings(spark, tmp_path):
    for e in ("utf-8", "utf-8-sig", "gbk", "latin-1"):
        p = tmp_path / f"{e}.csv"
        p.write_text("名,n\n甲,1\n" if e != "latin-1" else "nämé,n\nñ\xff,1\n", encoding=e)
        df = readers.read(spark, f"file:{p}")
        assert df.columns[0] == ("名" if e != "latin-1" else "nämé") and df.first()["n"] == 1


def test_json_and_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 3}')
    (tmp_path / "c.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "d.md").write_text("line\nline")
    assert [readers.read(spark, f"file:{tmp_path}/{n}").count() for n in ("a.json", "b.json", "c.jsonl")] == [2, 1, 2]
    assert readers.read(spark, f"file:{tmp_path}/d.md").first()["text"] == "line\nline"
    with pytest.raises(MissingSource):
        readers.read(spark, f"file:{tmp_path}/none.csv")


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>age</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>41</v></c></row><row><c r="B3"><v>7</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in readers.read(spark, f"file:{tmp_path}/t.xlsx").collect()] == [("Ann", 41), (None, 7)]


def test_snapshot(spark, tmp_path):
    got = sinks.snapshot(str(tmp_path), spark.range(3), schema=[{"column": "id"}], summary="# s")
    assert spark.read.parquet(got["data"]).count() == 3 and spark.read.csv(got["csv"], header=True).count() == 3
    assert sinks.finalize(str(tmp_path))["status"] == "COMPLETED" and (tmp_path / "final" / "summary.md").exists()
    assert sinks.reopen(str(tmp_path))["status"] == "RUNNING" and not (tmp_path / "final").exists()


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/customer.parquet").write.parquet(f"file:{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"file:{tmp_path}/in").schema).parquet(f"file:{tmp_path}/in").withColumn("row_id", F.col("c_custkey"))
    q = checks.issues(stream, CATALOGUE.get("customer"), "row_id").writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").where("rule = 'min'").count() > 0
