"""Files to DataFrames, by suffix."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from millrace.errors import MissingSource, UnreadableSource

ENCODINGS = ("utf-8", "gbk", "iso-8859-1")
SNIFFED = 1 << 16
FORMATS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "xlsx": "xlsx", "orc": "orc"}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) is not None and len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)) > 0


def first_bytes(spark: SparkSession, path: str) -> bytes:
    """Up to SNIFFED bytes of the first file under a path, by name; nothing else of it is read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    todo, files = list(fs.globStatus(p) or []), []
    while todo:
        at = todo.pop()
        if at.getPath().getName()[0] in "._":
            continue
        if at.isDirectory():
            todo += list(fs.listStatus(at.getPath()))
        else:
            files.append(at.getPath())
    if not files:
        return b""
    stream = fs.open(min(files, key=lambda f: f.toString()))
    try:
        return bytes(stream.readNBytes(SNIFFED))
    finally:
        stream.close()


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding that reads the first bytes of the first file; the last one reads anything."""
    head = first_bytes(spark, path)
    for e in ENCODINGS:
        for cut in range(4):  # the sample may end inside a character
            try:
                head[: len(head) - cut].decode(e)
                return e
            except UnicodeDecodeError:
                if len(head) < SNIFFED:
                    break
    return ENCODINGS[-1]


def read(spark: SparkSession, path: str, fmt: str | None = None, *, encoding: str | None = None, schema: str | None = None, multiline: bool = True) -> DataFrame:
    """multiline=False: no quoted field of a csv holds a line feed, so that large files are split.

    A table from csv, tsv, json (array or object), jsonl, parquet, orc or xlsx; anything else as (path, text), a row a file."""
    if not _exists(spark, path):
        raise MissingSource(path)
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    fmt = fmt or FORMATS.get(suffix, "text")
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        match fmt:
            case "csv":
                encoding = encoding or sniff_encoding(spark, path)
                if encoding == "gbk":
                    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
                return reader.csv(path, header=True, inferSchema=schema is None, encoding=encoding, sep="\t" if suffix == "tsv" else ",", multiLine=multiline, escape='"')
            case "json":
                df = reader.json(path, multiLine=True)
            case "jsonl":
                df = reader.json(path)
            case "parquet" | "orc":
                return getattr(reader, fmt)(path)
            case "xlsx":
                spark.dataSource.register(XlsxSource)
                return spark.read.format("xlsx").load(path)
            case _:
                return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    except UnreadableSource:
        raise
    if "_corrupt_record" in df.columns:
        raise UnreadableSource(f"{path} is neither an array nor an object")
    return df


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(path: str) -> list[list]:
    """The first sheet of an xlsx file: text, numbers, booleans and None; no formulas are computed."""
    with zipfile.ZipFile(path.removeprefix("file:")) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        rows = []
        for row in ElementTree.fromstring(z.read(sheets[0])).iter(f"{_MAIN}row"):
            cells: list = []
            for c in row.iter(f"{_MAIN}c"):
                letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                cells += [None] * (at - 1 - len(cells))
                v, kind = c.find(f"{_MAIN}v"), c.get("t", "n")
                if kind == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{_MAIN}t")))
                elif v is None or v.text is None:
                    cells.append(None)
                elif kind == "s":
                    cells.append(shared[int(v.text)])
                elif kind == "b":
                    cells.append(v.text == "1")
                elif kind in ("str", "e"):
                    cells.append(v.text)
                else:
                    cells.append(float(v.text))
            rows.append(cells)
    return rows


class XlsxSource(DataSource):
    """spark.read.format("xlsx"): the first sheet, header first; columns of whole numbers are bigint."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _table(self) -> tuple[list[str], list[str], list[list]]:
        rows = sheet_rows(self.options["path"])
        names = [str(n) for n in rows[0]]
        body = [(r + [None] * len(names))[: len(names)] for r in rows[1:]]
        kinds = []
        for i in range(len(names)):
            own = [r[i] for r in body if r[i] is not None]
            if own and all(isinstance(v, bool) for v in own):
                kinds.append("boolean")
            elif own and all(isinstance(v, float) for v in own):
                kinds.append("bigint" if all(v.is_integer() for v in own) else "double")
            else:
                kinds.append("string")
        return names, kinds, body

    def schema(self) -> str:
        names, kinds, _ = self._table()
        return ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))

    def reader(self, schema):
        return _XlsxReader(*self._table())


class _XlsxReader(DataSourceReader):
    def __init__(self, names, kinds, body):
        self.kinds, self.body = kinds, body

    def read(self, partition):
        cast = {"bigint": int, "double": float, "boolean": bool, "string": lambda v: f"{v:g}" if isinstance(v, float) else str(v)}
        for r in self.body:
            yield tuple(None if v is None else cast[k](v) for v, k in zip(r, self.kinds))
