"""Renaming, typing, ordering, cleaning and repairing of a table's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from millrace.errors import DuplicateColumn
from millrace.functions import coerce
from millrace.profiles import Profile


def rename_aliases(df: DataFrame, profile: Profile) -> DataFrame:
    """Headers that are a field's alias get the field's name; unknown ones stay. Exact, case-sensitive."""
    owner = {a: f.name for f in profile.fields.values() for a in f.aliases}
    owner |= {n: n for n in profile.fields if n in df.columns}
    names = [owner.get(c, c) for c in df.columns]
    if twice := {n for n in names if names.count(n) > 1}:
        raise DuplicateColumn(f"several columns would be named {sorted(twice)}")
    return df.withColumnsRenamed({c: n for c, n in zip(df.columns, names) if c != n})


def coerce_types(df: DataFrame, profile: Profile, typed: bool = False) -> DataFrame:
    """Profile fields to their types. Dates become ISO text, or dates when typed; unreadable numbers null."""
    kinds, new = dict(df.dtypes), {}
    for f in profile.fields.values():
        if f.name not in kinds:
            continue
        c, kind = F.col(f"`{f.name}`"), kinds[f.name]
        if f.type == "date":
            new[f.name] = coerce.typed_date(c) if typed and kind == "string" else c.cast("date") if typed else coerce.iso_date(c, kind)
        elif f.type == "boolean":
            new[f.name] = coerce.boolean(c, kind)
        elif f.type == "float" and kind not in ("double", "float"):
            new[f.name] = coerce.number(c, kind)
        elif f.type == "integer" and kind == "string":
            new[f.name] = coerce.number(c, kind, integer=True)
        elif f.type == "float":
            new[f.name] = coerce.nan_to_null(c)
        if f.default is not None:
            new[f.name] = F.coalesce(new.get(f.name, c), F.lit(f.default))
    return df.withColumns(new) if new else df


def reorder(df: DataFrame, first: tuple[str, ...]) -> DataFrame:
    here = [c for c in first if c in df.columns]
    return df.select(*here, *[c for c in df.columns if c not in here])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def drop_empty_rows(df: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    return df.dropna("all", subset=[c for c in df.columns if c not in but])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without columns that are null throughout: one aggregate over the table."""
    n = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if not n[i]])


def drop_repeated_rows(df: DataFrame, keys: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """One row for each combination of keys (all columns); the first by order, when given."""
    if order is None:
        return df.dropDuplicates(list(keys) or None)
    if not keys:  # whole rows: an aggregate, combined before the shuffle
        return df.groupBy(*[F.col(f"`{c}`") for c in df.columns if c != order]).agg(F.min(order).alias(order)).select([F.col(f"`{c}`") for c in df.columns])
    by = list(keys)
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def repair(df: DataFrame, profile: Profile) -> DataFrame:
    """The repairs that the fields' hints name: units in text, negative amounts."""
    kinds, new = dict(df.dtypes), {}
    for f in profile.fields.values():
        if f.name not in kinds:
            continue
        c, kind, wanted = F.col(f"`{f.name}`"), kinds[f.name], f.repairs()
        if "unit" in wanted and kind == "string":
            c, kind = coerce.number(c), "double"
        if "negative" in wanted and kind in ("double", "float", "bigint", "int"):
            c = F.abs(c)
        new[f.name] = c
    return df.withColumns(new) if new else df


def cleaning_report(df: DataFrame, profile: Profile | None = None) -> DataFrame:
    """(column, null_count, null_rate, warn, swapped_count): one pass; warn above a null rate of 0.9."""
    swapped = {f.name for f in profile.fields.values() if "swapped" in f.repairs()} if profile else set()
    facts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(f"`{c}`").isNull()).alias("null_count"), (F.count_if(F.col(f"`{c}`") > 1.2) if c in swapped else F.lit(0)).cast("long").alias("swapped_count")) for c in df.columns]
    one = df.agg(F.count("*").alias("n"), F.array(*facts).alias("facts"))
    rate = F.round(F.try_divide(F.col("f.null_count"), F.col("n")), 4)
    return one.select("n", F.explode("facts").alias("f")).select("f.column", "f.null_count", rate.alias("null_rate"), (rate > 0.9).alias("warn"), "f.swapped_count")


def entries_to_table(entries: DataFrame, profile: Profile) -> DataFrame:
    """entries (fields map, confidence, needs_review) -> one column a profile field, _confidence, _needs_review."""
    fields: list[Column] = [F.try_element_at("fields", F.lit(n)).alias(n) for n in profile.fields]
    return entries.select(*fields, F.coalesce("confidence", F.lit(1.0)).alias("_confidence"), F.coalesce("needs_review", F.lit(False)).alias("_needs_review"))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A dense number from 0 in the table's order: counts of partitions first, then offsets. No global sort."""
    marked = df.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = {r[0]: r[1] for r in marked.groupBy("_p").count().collect()}
    offsets, at = {}, 0
    for p in sorted(sizes):
        offsets[p], at = at, at + sizes[p]
    offset = F.try_element_at(F.create_map(*[x for p, o in offsets.items() for x in (F.lit(p), F.lit(o))]), F.col("_p")) if offsets else F.lit(0)
    return marked.withColumn(name, (F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33) + offset).cast("long")).drop("_p", "_m")
