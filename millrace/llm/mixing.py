"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Document i of a source has words w_i. Among the copy rates whose words sum to the source's target, those are
sought that stay closest in entropy to one copy each: rate_i = exp(lambda * x_i), at most MOST, where x_i is
w_i over the source's mean size. The convex dual in lambda is one equation for each source. Newton steps with
a bracket solve all of them at once, until every source has converged: each step is one aggregate over a table
of (source, size, documents), which is all the steps read, so the texts are read once and a hot source is
counted before any shuffle. The bracket is known beforehand: at log(2) / the least x all rates are MOST, and at
-log(size / target) / the least x the words are no more than the target. Every third step halves it, unless
the gap has fallen to a thousandth since the third step before, which it can do a few times only; so STEPS, at
which the search is given up with an error, is out of reach.
Rates become copies by systematic rounding: running sums of rates, largest documents first, are rounded, so a
source's copies never drift, and what is left of the target goes to the size that fits it best; inside a size
the copies left over go to the documents first in hash order, found by counts of hash buckets rather than by a
sort of the whole group. `copies_of` joins the plan to the rows and repeats each as often as it says.

Edge cases: a null text has size 0; null sources are one source, sorted last; documents without words take 0;
without any words all targets are 0; repeated rows are documents of their own, ties between fully equal rows
are even. Sums that decide copies are decimals, so that reruns agree. Columns of documents may have any name: the
plan has none but its own and the key, and copies_of leaves out those of its columns that documents have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import discard, store

MOST = 2.0
STEPS = 200
BUCKET = 20_000  # documents of one size to a hash bucket


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = MOST) -> DataFrame:
    """sizes (source, source_size), one row a source -> with target double.

    Sources by code point, null last, weigh weights in turn and share share * all sizes. A target stops at
    most * its size; the excess is shared by weight among the rest, until none is above. In closed form: a
    source is full when size / weight is small, so full sources are a prefix in that order.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    rest = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    before = rest.rowsBetween(Window.unboundedPreceding, -1)
    after = rest.rowsBetween(0, Window.unboundedFollowing)
    level = (share * total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = weighed.withColumn("level", level).withColumn("full", level * F.col("weight") > most * F.col("source_size"))
    # past the first source that isn't full, all get its level
    first = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())
    return leveled.withColumn("at", first["level"]).select("source", "source_size", F.least(most * F.col("source_size"), F.coalesce(F.col("at"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _rate(lam: Column, x: Column) -> Column:
    return F.exp(F.least(lam * x, F.lit(0.6931471805599453)))


def solved(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, mean, lam, done): the dual's solution for each source.

    cells: (source, size, n); sizes: (source, source_size, target). Where nothing is to be taken, or twice
    everything, lam is never asked for.
    """
    own = cells.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    least, ln2 = F.col("least") / F.col("mean"), 0.6931471805599453
    low = F.least(F.lit(0.0), -F.log(F.try_divide(F.col("source_size"), F.col("target"))) / least) - 1e-9
    at_bound = (F.col("target") <= 0) | (F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12))
    state = sizes.join(own.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    state = store(state.select("source", "source_size", "target", "mean", F.lit(0.0).alias("lam"), low.alias("low"), (ln2 / least + 1e-9).alias("high"), F.lit(float("inf")).alias("mark"), (at_bound | F.col("mean").isNull()).alias("done")), "state")
    tilted = cells.where("size > 0").join(state.select(F.col("source").alias("s"), "mean"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", (F.col("size") / F.col("mean")).alias("x"))
    tilted = store(tilted, "tilted")
    for step in range(STEPS):
        if not state.where("NOT done").limit(1).count():
            return state
        at = state.where("NOT done").select(F.col("source").alias("s"), "lam")
        joined = tilted.join(at, F.col("source").eqNullSafe(F.col("s")))
        rate = _rate(F.col("lam"), F.col("x"))
        words_ = (F.col("n") * F.col("size")).cast("double")
        free = F.col("lam") * F.col("x") < ln2
        exact = "decimal(38,6)"
        sums = joined.groupBy("source").agg(F.sum((words_ * rate).cast(exact)).cast("double").alias("f"), F.sum(F.when(free, words_ * rate * F.col("x")).otherwise(0.0).cast(exact)).cast("double").alias("slope"))
        moved = state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        gap = F.col("f") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - F.try_divide(gap, F.col("slope"))
        third = step % 3 == 2
        inside = (newton > low) & (newton < high) & ((F.abs(gap) <= F.col("mark") / 1000) if third else F.lit(True))
        onward = F.when(inside, newton).otherwise((low + high) / 2)
        settled = (F.abs(gap) <= 1e-9 * F.col("target") + 1e-9) | (high - low <= 1e-11 * F.greatest(F.lit(1.0), F.abs("lam")))
        over = F.col("done") | settled
        new = moved.select("source", "source_size", "target", "mean", F.when(over, F.col("lam")).otherwise(F.round(onward, 12)).alias("lam"), F.coalesce(low, "low").alias("low"), F.coalesce(high, "high").alias("high"), (F.least("mark", F.abs(gap)) if third else F.col("mark")).alias("mark"), over.alias("done"))
        before, state = state, store(new, "state")
        discard(before)
    raise RuntimeError(f"the dual of the mix hasn't converged in {STEPS} steps")


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs -> key, source, size, source_size, target, rate, copies, taken."""
    return _plan(store(docs.select(F.lit(None).cast("long").alias("row"), *_narrow(text, source, key)), "sizes")).select(F.col("k").alias(key), "source", "size", "source_size", "target", "rate", "copies", "taken")


def copies_of(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mix itself: all columns of docs, each row as often as it was given copies, with copy (from 1), copies,
    size, source_size, target and rate, but for those that docs have as columns of their own."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"))
    rows = store(rows.select("row", "doc", *_narrow(f"doc.`{text}`", f"doc.`{source}`", f"doc.`{key}`")), "rows")
    plan = _plan(rows.drop("doc")).where("copies > 0")
    made = rows.select("row", "doc").join(plan.withColumnRenamed("row", "at"), F.col("row") == F.col("at")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    added = [c for c in ("copy", "copies", "size", "source_size", "target", "rate") if c not in docs.columns]
    return made.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns], *added)


def _narrow(text: str, source: str, key: str) -> list[Column]:
    """k, source, size and a hash of key and text that orders a size's documents."""
    return [F.col(key).alias("k"), F.col(source).alias("source"), words(F.col(text)).alias("size"), F.xxhash64(F.col(key), F.col(text), F.lit(5)).alias("h")]


def _plan(counted: DataFrame) -> DataFrame:
    """row, k, source, size, source_size, target, rate, copies, taken of each row of counted, a stored table."""
    cells = store(counted.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    sizes = store(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")
    state = solved(cells, sizes)
    final = state.select(F.col("source").alias("s"), "source_size", "target", "mean", "lam")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("target") <= 0, 0.0).when(F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12), MOST).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean")))
    rated = cells.join(final, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "source_size", "target", F.round(rate, 9).cast("decimal(18,9)").alias("rate"))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    upto = F.sum((F.col("rate") * F.col("n")).cast("decimal(38,9)")).over(down)
    rated = rated.withColumn("cell_copies", (F.round(upto) - F.round(upto - F.col("rate") * F.col("n"))).cast("long"))
    # what rounding left of the target is made up by copies of the one size that fits it best
    own = Window.partitionBy("source")
    gap = F.col("target") - F.sum(F.col("cell_copies") * F.col("size")).over(own)
    rated = rated.withColumn("gap", gap).withColumn("room", F.when(F.col("gap") > 0, 2 * F.col("n") - F.col("cell_copies")).otherwise(F.col("cell_copies")))
    rated = rated.withColumn("more", F.when(F.col("size") > 0, F.least("room", F.greatest(F.lit(1), F.round(F.abs("gap") / F.col("size")).cast("long")))).otherwise(0))
    rated = rated.withColumn("miss", F.abs(F.abs("gap") - F.col("more") * F.col("size")))
    best = F.min(F.struct("miss", "size")).over(own)
    rated = rated.withColumn("best", best).withColumn("more", F.when((F.col("size") == F.col("best.size")) & (F.col("miss") < F.abs("gap")), F.col("more") * F.signum("gap")).otherwise(0).cast("long"))
    rated = rated.withColumn("cell_copies", F.col("cell_copies") + F.col("more")).drop("gap", "room", "more", "miss", "best")
    rated = rated.withColumn("each", F.floor(F.col("cell_copies") / F.col("n")).cast("long")).withColumn("left", F.col("cell_copies") - F.col("each") * F.col("n")).withColumn("buckets", F.ceil(F.col("n") / BUCKET).cast("long"))
    rated = store(rated, "rates")
    r = rated.select(F.col("source").alias("rs"), F.col("size").alias("rz"), "source_size", "target", "rate", "each", "left", "buckets")
    placed = counted.join(r, F.col("source").eqNullSafe(F.col("rs")) & (F.col("size") == F.col("rz"))).drop("rs", "rz").withColumn("bucket", F.pmod(F.shiftright("h", 20), F.col("buckets")))
    per = placed.where("left > 0").groupBy("source", "size", "bucket").agg(F.count("*").alias("m"))
    per = per.withColumn("before", F.sum("m").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("m"))
    per = store(per, "buckets").select(F.col("source").alias("ps"), F.col("size").alias("pz"), F.col("bucket").alias("pb"), "before")
    w = Window.partitionBy("source", "size", "bucket").orderBy("h", "row")
    some = placed.where("left > 0").join(per, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz")) & (F.col("bucket") == F.col("pb"))).withColumn("place", F.col("before") + F.row_number().over(w))
    columns = ["row", "k", "source", "size", "source_size", "target", "rate", "copies"]
    whole = placed.where("left <= 0").withColumn("copies", F.col("each")).select(columns)
    part = some.withColumn("copies", F.col("each") + (F.col("place") <= F.col("left")).cast("long")).select(columns)
    copies = F.least("copies", F.lit(2))
    return whole.unionByName(part).select("row", "k", "source", "size", "source_size", F.col("target").cast("double").alias("target"), F.col("rate").cast("double").alias("rate"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))
