"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import discard, store


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, l): each vertex of edges (a, b) with the least vertex of its component.

    Labels move along links and then to their label's label, so rounds grow with the logarithm of the
    diameter; each round is written to the shared folder and the one before deleted. Nulls and loops are ignored; repeated links do no
    harm; no links give an empty table.
    """
    one = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = store(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = known = store(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("l")), "labels")
    while True:
        least = both.join(labels.select(F.col("v").alias("b"), "l"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        moved = labels.join(least, "v").select("v", "l", F.least("l", "m").alias("n"))
        jumped = moved.join(labels.select(F.col("v").alias("n"), F.col("l").alias("j")), "n").select("v", F.col("l").alias("old"), F.least("n", "j").alias("l"))
        new = store(jumped, "labels")
        discard(known)
        known, labels = new, new.select("v", "l")
        if not new.where("old != l").limit(1).count():
            discard(both)
            return labels
