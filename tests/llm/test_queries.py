"""The registered queries on the smallest tables: SQL where there is some, contracts elsewhere; and the pipeline."""

import collections
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries
from tests.llm.test_operators import brute_passages, brute_targets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toArrow(), con.sql(queries.oracle_sql()[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    assert sorted(zip(*(got[c].to_pylist() for c in columns))) == sorted(zip(*(want[c].to_pylist() for c in columns)))


CONTRACTS = {
    "op1_near_duplicates": ["doc_id", "class_id"], "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"], "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_mixing": ["doc_id", "size", "source_size", "target", "taken"], "op7_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op10_quality": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract(spark, name):
    got = queries.queries()[name](spark, SF)
    assert got.columns[: len(CONTRACTS[name])] == CONTRACTS[name]
    ids = sorted(r.doc_id for r in got.select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).persist()
        assert docs.columns == names and not docs.join(before, "doc_id", "left_anti").count()
        counts.append(docs.count())
        if name == "repeated_passages":
            old = sorted((r.doc_id, r.text) for r in before.collect())
            new = {r.doc_id: r for r in docs.collect()}
            for (i, t), (n, gone, digest) in zip(old, brute_passages([t for _, t in old], 35)):
                assert len(new[i].text.split()) == n - gone and new[i].n_chars == (len(new[i].text) if gone else len(t))
    assert counts[0] >= counts[1] >= counts[2] == counts[3] >= counts[4] > 0.5 * counts[0]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).persist()
    assert mixed.columns[: len(names)] == names and {"copy", "copies"} <= set(mixed.columns)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = mixed.collect()
    assert all(r.text == texts[r.doc_id] and 1 <= r.copy <= r.copies <= 2 for r in rows)
    assert all(n == c for (_, c), n in collections.Counter((r.doc_id, r.copies) for r in rows).items())
    sizes, longest, taken = (collections.Counter() for _ in range(3))
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    for r in rows:
        taken[r.source] += r["size"]
    want = brute_targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= max(2, longest[s] / 2) for s in sizes)


def test_pipeline_carries_columns_of_any_name(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    clashing = ["n", "mean", "worst", "score", "label", "kept", "n_words", "n_removed", "_rid", "_key", "_stays", "_spans", "spans", "mark", "doc", "row", "copies", "size", "rid", "own_text", "a.b c"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(c) for c in clashing}).withColumn("nested", F.struct(F.lit(1.5).cast("decimal(10,2)").alias("x"), F.array(F.lit("y")).alias("y")))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns[: len(names)] == names if name == "mixing" else docs.columns == names
        rows = docs.select([F.col(f"`{c}`") for c in (*clashing, "nested")]).distinct().collect()
        assert len(rows) == 1 and list(rows[0])[:-1] == clashing and rows[0].nested.y == ["y"]
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_pipeline_scores_with_every_bigram(spark, monkeypatch):
    """The pipeline's first stage looks words up in a model that holds the rare ones and bigrams."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    models, train = [], corpus_pipeline.toxicity.train
    monkeypatch.setattr(corpus_pipeline.toxicity, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.01").count()
    assert len(models[0].of_words) > 10_000 and len(models[0].of_pairs) > 10_000 and 0.8 * docs.count() < left < docs.count()
