"""Rules of a profile, checked in one pass, as a table of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType, StringType

from millrace.functions import coerce
from millrace.functions.domain import VALIDATORS
from millrace.profiles import Profile

ISSUE = "row_id, field, rule, severity, description, suggestion"
UNCAPPED = ("required", "missing_column")


def _issue(field: str, rule: str, severity: Column | str, description: Column, suggestion: str) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), severity.alias("severity"), description.alias("description"), F.lit(suggestion).alias("suggestion"))


def rules(df: DataFrame, profile: Profile, named: bool = False) -> list:
    """One expression a rule: null, or the issue a row has. named: (field, true where the rule is broken, else null) instead."""
    found = []
    for f in profile.fields.values():
        if f.name not in df.columns:
            continue
        c, kind = F.col(f"`{f.name}`"), df.schema[f.name].dataType
        number, text, said = isinstance(kind, NumericType), isinstance(kind, StringType), c.cast("string")

        def add(bad: Column, rule: str, severity, what: Column, how: str, name=f.name):
            found.append((name, F.when(bad, True)) if named else F.when(bad, _issue(name, rule, severity, what, how)))

        if f.required:
            add(c.isNull(), "required", "error", F.lit("value is missing"), "fill it in")
        if f.type in ("float", "integer") and text:
            add(~coerce.looks_numeric(c), "type", "warning", F.concat(F.lit("not a number: "), said), "give digits")
        if f.min is not None and number:
            add(c < f.min, "min", "error", F.concat(F.lit("below "), F.lit(f"{f.min:g}")), "check the value")
        if f.max is not None and number:
            add(c > f.max, "max", "error", F.concat(F.lit("above "), F.lit(f"{f.max:g}")), "check the value")
        if f.pattern and text:
            add(~c.rlike(f"^(?:{f.pattern})"), "pattern", "warning", F.concat(F.lit("unlike the pattern: "), said), "check the form")
        if f.enum:
            add(~said.isin(*f.enum), "enum", "error", F.concat(F.lit("not allowed: "), said), "use one of: " + ", ".join(f.enum))
        if f.validator in VALIDATORS:
            state = VALIDATORS[f.validator](c)
            add(state.isNotNull(), f.validator, state, F.concat(F.lit("fails the check: "), said), "check the value")
    return found


def issues(df: DataFrame, profile: Profile, row_id: str = "row_id", limit: int | None = 10) -> DataFrame:
    """(row_id, field, rule, severity, description, suggestion). limit: rows listed of each field and rule, the
    first by row_id; missing values are all listed. A required column that is absent is one issue at row -1
    (not in a stream, whose rows can't be joined by a fixed one)."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[row_id]
    absent = [(f.name,) for f in profile.fields.values() if f.required and f.name not in df.columns]
    found = rules(df, profile)
    schema = f"row_id {kind}, field string, rule string, severity string, description string, suggestion string"
    if found:
        listed = df.select(F.col(row_id).alias("row_id"), F.explode(F.array(*found)).alias("i")).where("i IS NOT NULL").select("row_id", "i.*")
        if limit is not None:
            w = Window.partitionBy("field", "rule").orderBy("row_id")
            first = listed.where(~F.col("rule").isin(*UNCAPPED)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
            listed = listed.where(F.col("rule").isin(*UNCAPPED)).unionByName(first)
    else:
        listed = spark.createDataFrame([], schema)
    if absent and not df.isStreaming:
        lacking = spark.createDataFrame(absent, "field string").select(F.lit(-1).cast(kind).alias("row_id"), "field", F.lit("missing_column").alias("rule"), F.lit("error").alias("severity"), F.lit("column is missing").alias("description"), F.lit("add the column").alias("suggestion"))
        listed = listed.unionByName(lacking)
    return listed


def issues_by_field(df: DataFrame, profile: Profile) -> DataFrame:
    """(field, issues): how many issues a field with rules has, in one aggregate that lists none of them. An absent required column is one issue."""
    per: dict[str, Column] = {}
    for name, rule in rules(df, profile, named=True):
        per[name] = per[name] + F.count(rule) if name in per else F.count(rule)
    absent = {f.name: F.lit(1).cast("long") for f in profile.fields.values() if f.required and f.name not in df.columns}
    if not per and not absent:
        return df.sparkSession.createDataFrame([], "field string, issues long")
    one = df.agg(F.array(*[F.struct(F.lit(n).alias("field"), k.alias("issues")) for n, k in (per | absent).items()]).alias("f"))
    return one.select(F.explode("f").alias("f")).select("f.*")


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("field", "rule", "severity").agg(F.count("*").alias("issues"))
