"""Coercion, expressions and formulas against plain Python."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.errors import ExpressionError
from millrace.functions import coerce, domain
from millrace.functions.expressions import compile_expression, derive


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")


def results(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


DATES = ["2023-01-05", " 2023/1/5 ", "2023年12月31日", "05/06/2023", "13/06/2023", "06/13/2023", "20230105", "23-1-1", "2023115", "2023-02-30", "soon", "2023-01-05 10:00", "", None]


def test_dates(spark):
    def plain(v):
        if v is None:
            return None
        v = v.strip()
        for style in ("%Y-%m-%d", "%Y/%m/%d", "%Y年%m月%d日", "%d/%m/%Y", "%m/%d/%Y", "%Y%m%d"):
            try:
                if len(v) == 7 and v.isdigit():
                    break  # Python splits 2023115 its own way; it stays text here
                return datetime.strptime(v, style).strftime("%Y-%m-%d")
            except ValueError:
                pass
        return v

    assert results(column(spark, DATES), coerce.iso_date(F.col("v"))) == [plain(v) for v in DATES]
    assert results(column(spark, [20230105, 7], "long"), coerce.iso_date(F.col("v"), "bigint")) == ["2023-01-05", "7"]


NUMBERS = ["12", "-3.5", "1,234.5", "￥500万", "-500万", "85%", "1e5", "1.2.3", "-", "", "abc", "3亿", "9" * 30, None]


def test_numbers(spark):
    def plain(v):
        if v is None:
            return None
        try:
            return float(re.sub(r"[^0-9.\-]", "", v)) * (1e4 if "万" in v else 1)
        except ValueError:
            return None

    assert results(column(spark, NUMBERS), coerce.number(F.col("v"))) == [plain(v) for v in NUMBERS]
    assert results(column(spark, ["3.9", "-3.9", "9" * 30]), coerce.number(F.col("v"), integer=True)) == [3, -3, None]


def test_booleans(spark):
    said = ["true", " YES ", "是", "1", "y", "no", "", "2", None]
    assert results(column(spark, said), coerce.boolean(F.col("v"))) == [True] * 5 + [False] * 3 + [None]
    assert results(column(spark, [0, 3, None], "int"), coerce.boolean(F.col("v"), "int")) == [False, True, None]


def test_masks_are_idempotent(spark):
    m = coerce.masked_text(F.col("v"))
    df = column(spark, ["secret", "", None, "一二三"])
    once = results(df, m)
    assert once == ["[RESTRICTED-6 chars]", "", None, "[RESTRICTED-3 chars]"]
    assert results(df.withColumn("v", m), m) == once


def test_imo(spark):
    said = ["9074729", "9074728", "123", "12345678", "abc", "", None]
    digits = [9, 0, 7, 4, 7, 2]
    assert sum(d * w for d, w in zip(digits, range(7, 1, -1))) % 10 == 9
    assert results(column(spark, said), domain.imo_state(F.col("v"))) == [None, "warning", "warning", "error", "error", "error", None]


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, 0, "a", "2020-01-01"), (6.0, 3, "", "2021-01-01"), (None, 2, None, None)], "x double, n int, s string, d string").withColumn("d", F.to_date("d"))
    run = lambda e: [r[0] for r in df.select(compile_expression(e, df, "2020-01-11")).collect()]
    assert run("x / n if n else null") == [None, 2.0, None]
    assert run("x / n") == [None, 2.0, None]
    assert run("-x + 2 * (n - 1)") == [-3.0, -2.0, None]
    assert run("1 if s else 0") == [1, 0, 0]
    assert run("1 if all([x, n]) else 0") == [0, 1, 0]
    assert run("1 if 0 < n <= 3 and not s == 'a' else 0") == [0, 1, 1]
    assert run("today() - d") == [10, -356, None]
    for bad in ("__import__('os')", "x.real", "[1]", "lambda: 1", "x if", "y + 1", "x ** 2", "open('f')"):
        with pytest.raises(ExpressionError):
            compile_expression(bad, df)
    _, added, skipped = derive(df, {"a": "x + 1", "b": "a * 2", "c": "nope"})
    assert added == ["a", "b"] and list(skipped) == ["c"]
