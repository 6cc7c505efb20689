"""Column statistics: each function reads the table a few times, whatever the number of columns."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DateType, FractionalType, IntegralType, TimestampNTZType, TimestampType

from millrace.operators.shape import numeric_columns

QUARTILES = (0.25, 0.5, 0.75)
BINS = 16_384


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def type_name(kind) -> str:
    if isinstance(kind, BooleanType):
        return "boolean"
    if isinstance(kind, IntegralType):
        return "integer"
    if isinstance(kind, FractionalType):
        return "float"
    return "date" if isinstance(kind, (DateType, TimestampType, TimestampNTZType)) else "string"


def long_form(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(column, value): the values of columns, cast to kind."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast(kind).alias("value")) for c in columns])).alias("x")).select("x.*")


def frequencies(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(column, value, n), nulls left out; counted before the shuffle."""
    return long_form(df, columns, kind).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def _reach(v: Column) -> Column:
    """What quantiles needs to know of the doubles v first: how many there are and how far the finite ones reach."""
    finite = F.when(F.abs(v) < math.inf, v)
    return F.struct(F.count(v).alias("n"), F.count_if(v == -math.inf).alias("below"), F.count(finite).alias("finite"), F.count_if(v == math.inf).alias("above"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))


def quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...], reach: dict | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, as percentile interpolates them; no task sorts or holds a column's values.

    Counts of equal-width bins tell which bin holds a wanted rank; that one's own least and largest value bound the
    bins of the next pass, until the rank's value stands alone or at an end. Two passes do for most columns, values
    spread over many powers of 2^14 take one each; a pass shuffles counts of bins only.
    """
    values = {c: q(c).cast("double") for c in columns}
    if reach is None:
        reach = dict(zip(columns, df.agg(*[_reach(v).alias(str(i)) for i, v in enumerate(values.values())]).first())) if columns else {}
    known: dict[tuple[str, int], float] = {}
    work = []  # (column, least value, largest value, ranks before, values in it, wanted ranks)
    for c in columns:
        r = reach[c]
        ranks = {k for p in at if r["n"] for k in (math.floor((r["n"] - 1) * p), math.ceil((r["n"] - 1) * p))}
        ends = r["below"], r["below"] + r["finite"], r["below"] + r["finite"] + r["above"]
        known |= {(c, k): -math.inf if k < ends[0] else math.inf if k < ends[2] else math.nan for k in ranks if not ends[0] <= k < ends[1]}
        work.append((c, r["lo"], r["hi"], ends[0], r["finite"], {k for k in ranks if ends[0] <= k < ends[1]}))
    while True:
        left = []
        for c, lo, hi, before, n, ranks in work:
            known |= {(c, k): lo if k == before else hi for k in ranks if lo == hi or k in (before, before + n - 1)}
            if ranks := {k for k in ranks if (c, k) not in known}:
                left.append((c, lo, hi, before, ranks))
        if not left:
            break
        work = [(left[r["job"]][0], r["lo"], r["hi"], r["before"], r["n"], {k for k in left[r["job"]][4] if r["before"] <= k < r["before"] + r["n"]}) for r in _bins(df, values, left).collect()]
        if sum(len(w[5]) for w in work) < sum(len(w[4]) for w in left):
            raise RuntimeError("the table changed while it was read")

    def between(c: str, n: int, p: float) -> float | None:
        if not n:
            return None
        place = (n - 1) * p
        low, high = math.floor(place), math.ceil(place)
        a, b = known[c, low], known[c, high]
        return a if low == high or a == b else (high - place) * a + (place - low) * b

    return {c: [between(c, reach[c]["n"], p) for p in at] for c in columns}


def _bins(df: DataFrame, values: dict[str, Column], jobs: list[tuple]) -> DataFrame:
    """(job, n, lo, hi, before): of each job (column, lo, hi, before, ranks) the bins that hold its ranks. Jobs of one column don't overlap."""
    cells, inside = {}, []
    for j, (c, lo, hi, _, _) in enumerate(jobs):
        v = values[c]
        part = (v - lo) / F.lit(hi - lo) if hi - lo < math.inf else (v / 2 - lo / 2) / F.lit(hi / 2 - lo / 2)
        inside.append((v >= lo) & (v <= hi))
        cells[c] = (cells[c] if c in cells else F).when(inside[-1], F.least(F.floor(part * BINS), F.lit(BINS - 1)) + j * BINS)
    found = df.where(reduce(lambda a, b: a | b, inside)).select(F.explode(F.array(*[F.struct(cell.alias("cell"), values[c].alias("v")) for c, cell in cells.items()])).alias("x")).where("x.cell IS NOT NULL").select("x.*")
    counted = found.groupBy("cell").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("job", F.floor(F.col("cell") / BINS))
    start = F.get(F.array(*[F.lit(before).cast("long") for _, _, _, before, _ in jobs]), F.col("job").cast("int"))
    placed = counted.withColumn("before", start + F.sum("n").over(Window.partitionBy("job").orderBy("cell")) - F.col("n"))
    wanted = F.get(F.array(*[F.array(*[F.lit(k).cast("long") for k in sorted(ranks)]) for *_, ranks in jobs]), F.col("job").cast("int"))
    return placed.where(F.exists(wanted, lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))).select("job", "n", "lo", "hi", "before")


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True, distinct: bool = True) -> DataFrame:
    """(column, type, count, null_count, unique_count, mean, std, min, max, q25, q50, q75), numbers only for numeric columns.

    One fused aggregate gives the moments, passes over bins the exact quartiles; value frequencies give distinct
    counts, unless distinct=False leaves them null. With exact=False sketches in the same aggregate estimate both,
    and no value is shuffled: for tables whose columns hold billions of distinct values.
    """
    columns = columns or df.columns
    numbers = set(numeric_columns(df))
    if not exact:
        return _sketched(df, columns, numbers)
    own, rest = [c for c in columns if c in numbers], [c for c in columns if c not in numbers]
    moments = [F.struct(F.count(q(c)).alias("count"), *([f(q(c)).cast("double").alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))] if c in numbers else [])).alias(f"m{i}") for i, c in enumerate(columns)]
    one = df.agg(F.count("*").alias("rows"), *moments, *[_reach(q(c).cast("double")).alias(f"r{i}") for i, c in enumerate(own)]).first()
    quartiles = quantiles(df, own, QUARTILES, {c: one[f"r{i}"] for i, c in enumerate(own)})
    facts = [(c, type_name(df.schema[c].dataType), m["count"], one["rows"] - m["count"], *(list(m[1:]) if c in numbers else [None] * 4), *quartiles.get(c, [None] * 3)) for i, c in enumerate(columns) for m in [one[f"m{i}"]]]
    base = df.sparkSession.createDataFrame(facts, "column string, type string, count long, null_count long, mean double, std double, min double, max double, q25 double, q50 double, q75 double")
    if distinct:
        parts = [frequencies(df, some, kind).groupBy("column").agg(F.count("*").alias("unique_count")) for some, kind in ((own, "double"), (rest, "string")) if some]
        base = base.join(F.broadcast(reduce(DataFrame.unionByName, parts)), "column", "left")
    unique = F.coalesce("unique_count", F.lit(0)) if distinct else F.lit(None).cast("long")
    return base.select("column", "type", "count", "null_count", unique.alias("unique_count"), "mean", "std", "min", "max", "q25", "q50", "q75")


def _sketched(df: DataFrame, columns: list[str], numbers: set[str]) -> DataFrame:
    facts = []
    for c in columns:
        num = c in numbers
        nothing = F.lit(None).cast("double")
        quartile = F.percentile_approx(q(c).cast("double"), list(QUARTILES), 10_000) if num else F.lit(None).cast("array<double>")
        facts.append(F.struct(
            F.lit(c).alias("column"), F.lit(type_name(df.schema[c].dataType)).alias("type"), F.count(q(c)).alias("count"), F.count_if(q(c).isNull()).alias("null_count"), F.approx_count_distinct(q(c)).alias("unique_count"),
            *[(f(q(c)).cast("double") if num else nothing).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))],
            *[(F.get(quartile, F.lit(i)) if num else nothing).alias(n) for i, n in enumerate(("q25", "q50", "q75"))],
        ))
    return df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """(column, value, n, place): the k most frequent values as text, ties by value."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return frequencies(df, columns, "string").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def date_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    facts = [F.struct(F.lit(c).alias("column"), F.date_format(F.min(q(c)), "yyyy-MM-dd").alias("first"), F.date_format(F.max(q(c)), "yyyy-MM-dd").alias("last")) for c in columns]
    return df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def anomalies(profiled: DataFrame) -> DataFrame:
    """(column, anomaly): more than half missing; no variance."""
    rate = F.try_divide(F.col("null_count"), F.col("count") + F.col("null_count"))
    found = F.array_compact(F.array(F.when(rate > 0.5, "high_null_rate"), F.when(F.col("std") == 0, "zero_variance")))
    return profiled.select("column", F.explode(found).alias("anomaly"))


def scale(df: DataFrame, zscore: tuple[str, ...] = (), minmax: tuple[str, ...] = ()) -> DataFrame:
    """Adds {c}_zscore and {c}_minmax; 0.0 for columns without spread; null stays. One row of statistics is broadcast."""
    one = df.agg(*[f(q(c)).alias(f"_{n}{i}") for i, c in enumerate(zscore) for n, f in (("avg", F.avg), ("sd", F.stddev_samp))], *[f(q(c)).alias(f"_{n}{i}") for i, c in enumerate(minmax) for n, f in (("min", F.min), ("max", F.max))])
    new = {}
    for i, c in enumerate(zscore):
        flat = F.coalesce(F.col(f"_sd{i}"), F.lit(0.0)) == 0
        new[f"{c}_zscore"] = F.when(q(c).isNotNull(), F.when(flat, 0.0).otherwise(F.try_divide(q(c) - F.col(f"_avg{i}"), F.col(f"_sd{i}"))))
    for i, c in enumerate(minmax):
        flat = F.col(f"_max{i}") <= F.col(f"_min{i}")
        new[f"{c}_minmax"] = F.when(q(c).isNotNull(), F.when(flat, 0.0).otherwise(F.try_divide(q(c) - F.col(f"_min{i}"), (F.col(f"_max{i}") - F.col(f"_min{i}")).cast("double"))))
    return df.crossJoin(F.broadcast(one)).withColumns(new).select(*df.columns, *new)


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, mean, median, std, skew, kurtosis, missing_rate), bias-corrected, of columns with two values or more."""
    columns = columns or numeric_columns(df)
    facts = [F.struct(F.lit(c).alias("column"), F.count(q(c)).alias("n"), F.count("*").alias("rows"), F.avg(q(c)).alias("mean"), F.stddev_samp(q(c)).alias("std"), F.skewness(q(c)).alias("g1"), F.kurtosis(q(c)).alias("g2")) for c in columns]
    base = df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*").where("n >= 2")
    median = df.sparkSession.createDataFrame([(c, m) for c, (m,) in quantiles(df, columns, (0.5,)).items()], "column string, median double")
    n, g1, g2 = (F.col(x).cast("double") for x in ("n", "g1", "g2"))
    skew = F.when(F.col("n") < 3, None).when(F.col("std") == 0, 0.0).otherwise(F.try_divide(F.sqrt(n * (n - 1)), n - 2) * g1)
    kurt = F.when(F.col("n") < 4, None).when(F.col("std") == 0, 0.0).otherwise(F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    missing = F.round((F.col("rows") - F.col("n")) / F.col("rows"), 4)
    return base.join(F.broadcast(median), "column").select("column", "mean", "median", "std", skew.alias("skew"), kurt.alias("kurtosis"), missing.alias("missing_rate"))


def outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, outliers, rate, low, high, least, most) of columns with values beyond 1.5 interquartile ranges.

    Bounds are found first, in the passes of quantiles; one more counts what lies beyond them.
    """
    columns = columns or numeric_columns(df)
    facts = []
    for c, (a, b) in quantiles(df, columns, (0.25, 0.75)).items():
        if a is None:
            continue
        v, low, high = q(c).cast("double"), a - 1.5 * (b - a), b + 1.5 * (b - a)
        beyond = F.when((v < low) | (v > high), v)
        facts.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("total"), F.count(beyond).alias("outliers"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.min(beyond).alias("least"), F.max(beyond).alias("most")))
    if not facts:
        return df.sparkSession.createDataFrame([], "column string, outliers long, rate double, low double, high double, least double, most double")
    found = df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*").where("total >= 4 AND outliers > 0")
    return found.select("column", "outliers", F.round(F.col("outliers") / F.col("total"), 4).alias("rate"), "low", "high", "least", "most")


def strong_correlations(df: DataFrame, columns: list[str] | None = None, least: float = 0.7) -> DataFrame:
    """(a, b, r): Pearson over rows where both are present, of pairs with |r| >= least. One aggregate."""
    pairs = list(combinations(columns or numeric_columns(df), 2))
    facts = []
    for a, b in pairs:
        x, y = (F.when(q(a).isNotNull() & q(b).isNotNull(), q(c).cast("double")) for c in (a, b))
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        facts.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
    if not facts:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    return df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.a", "f.b", F.round("f.r", 4).alias("r")).where(F.abs("r") >= least)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, n) of equal-width bins; the largest value falls in the last one."""
    one = df.agg(F.min(q(column)).alias("_a"), F.max(q(column)).alias("_b"))
    place = F.least(F.floor(F.try_divide((q(column) - F.col("_a")) * bins, F.col("_b") - F.col("_a"))), F.lit(bins - 1))
    return df.where(q(column).isNotNull()).crossJoin(F.broadcast(one)).groupBy(F.coalesce(place, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def features(df: DataFrame) -> DataFrame:
    """One row: rows, null_rate, text_ratio (share of columns whose mean text length is above 100), largest text, tags."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    n = len(df.columns)
    nulls = sum((F.count_if(q(c).isNull()) for c in df.columns), F.lit(0))
    long = sum(((F.coalesce(F.avg(F.length(q(c))), F.lit(0.0)) > 100).cast("int") for c in texts), F.lit(0))
    most = F.greatest(*[F.coalesce(F.max(F.length(q(c))), F.lit(0)) for c in texts], F.lit(0), F.lit(0))
    one = df.agg(F.count("*").alias("rows"), F.round(F.try_divide(nulls, F.count("*") * n), 4).alias("null_rate"), F.round(long / n, 4).alias("text_ratio"), most.cast("long").alias("longest_text"))
    tags = F.array_compact(F.array(F.when(F.col("null_rate") > 0.3, "needs_null_analysis"), F.when(F.col("text_ratio") > 0.3, "needs_extraction"), F.when(F.col("rows") > 100_000, "large_dataset"), F.when(n > 2 * F.col("rows"), "wide_table"), F.when(F.col("longest_text") > 100_000, "large_text")))
    return one.withColumn("tags", F.array_join(tags, ","))
