"""A training corpus from documents: toxic texts out, near-duplicates out, repeated passages out, benchmark
leaks out, then each document as often as its source's weight asks for. Every stage is written as Parquet and
read again by the next; documents may have further columns, of any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm import decontam, mixing, neardup, substrings, toxicity
from millrace.llm.common import held_out, store, table

#: Classifiers and iterative optimisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def _aside(docs: DataFrame, *but: str) -> dict[str, Column]:
    """The columns of docs under names that none of an operator's own can have."""
    return {f"own{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns) if c not in but}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model, _aside(docs)).where("score < 0.5")
    return scored.select([F.col(f"own{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return neardup.deduplicated(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words that lie in a repeated window; n_chars follows the text."""
    left = substrings.remove(docs, keep=_aside(docs, "text"), digest=False)
    renewed = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"own{docs.columns.index('n_chars')}"))
    return left.select(*[F.col("kept").alias(c) if c == "text" else renewed.alias(c) if c == "n_chars" else F.col(f"own{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    mark = {"own_mark": F.xxhash64("text")}
    leaks = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=mark).select("own_mark").distinct()
    rows = docs.select(F.struct("*").alias("doc"))
    return rows.join(leaks, F.xxhash64("doc.text") == leaks["own_mark"], "left_anti").select([F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: each document, text and all, as often as the source weights give it copies."""
    return mixing.copies_of(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_passages", drop_repeated_passages), ("decontamination", drop_leaks), ("mixing", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
