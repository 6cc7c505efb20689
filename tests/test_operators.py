"""Text folds, linkage, shape, statistics and security on small frames."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.errors import BadChunking, DuplicateColumn, PermissionDenied
from millrace.operators import linkage, quality, security, shape, stats, text
from millrace.plans.flow import Goal, plan, run
from millrace.profiles import CATALOGUE, Catalogue, Profile


def paragraphs_plain(s, size, overlap):
    out, cur = [], []
    for p in (x.strip() for x in s.split("\n\n")):
        if not p:
            continue
        if cur and sum(map(len, cur)) + len(p) > size:
            out.append("\n\n".join(cur))
            cur = [cur[-1][-overlap:]] if overlap > 0 else []
        cur.append(p)
    return out + (["\n\n".join(cur)] if cur else [])


def size_plain(s, size, overlap):
    out, at = [], 0
    while s:
        out.append(s[at : at + size])
        if at + size >= len(s):
            break
        at += size - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(20, 0), (20, 5), (50, 30)])
def test_chunks(spark, size, overlap):
    rng = random.Random(size + overlap)
    texts = ["".join(rng.choice(["ab ", "\n\n", "你好", "x", "😀", " \t"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", "\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for make, plain in ((text.paragraph_chunks, paragraphs_plain), (text.size_chunks, size_plain)):
        got = {r.i: r.c for r in df.select("i", make(F.col("t"), size, overlap).alias("c")).collect()}
        assert [got[i] for i in range(len(texts))] == [plain(t, size, overlap) for t in texts]


def test_chunk_refuses(spark):
    with pytest.raises(BadChunking):
        text.size_chunks(F.col("t"), 10, 10)


def test_parse_and_extract(spark):
    class Flaky:
        def answer(self, prompt):
            self.n = getattr(self, "n", 0) + 1
            return "oops" if self.n % 2 else '```json\n{"fields": {"a": "1"}, "confidence": 0.5}\n```'

    df = spark.createDataFrame([(1, "x"), (2, "y")], "i int, chunk string").coalesce(1)
    got = text.extract(df, F.col("chunk"), Flaky()).collect()
    assert [(r.i, r.fields["a"], r.confidence) for r in got] == [(1, "1", 0.5), (2, "1", 0.5)]


def test_fuzzy_equals_greedy(spark):
    rng = random.Random(3)
    for threshold in (0.5, 0.67, 0.0):
        records = [{"position": i, "fields": {k: rng.choice("xyz") for k in rng.sample("abcd", 3)}, "confidence": rng.choice([None, 0.2, 0.9])} for i in range(40)]
        df = spark.createDataFrame([(r["position"], r["fields"], r["confidence"]) for r in records], "position long, fields map<string,string>, confidence double")
        got = sorted((r.position, r.merged_from, tuple(sorted(r.fields.items()))) for r in linkage.fuzzy(df, threshold).collect())
        want = sorted((r["position"], r["merged_from"], tuple(sorted(r["fields"].items()))) for r in linkage.greedy(records, threshold))
        assert got == want


def test_shape(spark):
    p = Profile.of({"profile_id": "x", "fields": {"a": {"type": "float", "aliases": ["A", "AA"]}, "b": {"type": "date", "default": "none"}}})
    df = spark.createDataFrame([("1万", "2020-1-2", 1), (None, None, 2)], "A string, b string, z int")
    got = shape.coerce_types(shape.rename_aliases(df, p), p).collect()
    assert [tuple(r) for r in got] == [(10000.0, "2020-01-02", 1), (None, "none", 2)]
    with pytest.raises(DuplicateColumn):
        shape.rename_aliases(df.withColumn("AA", F.lit(1)), p)
    ids = [r.row_id for r in shape.with_row_id(spark.range(100).repartition(7)).collect()]
    assert sorted(ids) == list(range(100))


def test_statistics_match_pandas(spark):
    rng = random.Random(1)
    pdf = pd.DataFrame({"a": [rng.gauss(0, 1) for _ in range(50)], "b": [rng.random() if i % 3 else None for i in range(50)], "c": [5.0] * 50, "d": [1.0, 2.0] + [None] * 48})
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)], "a double, b double, c double, d double")
    got = {r.column: r for r in stats.describe(df).collect()}
    for c in "abc":
        assert math.isclose(got[c]["skew"], pdf[c].skew(), abs_tol=1e-9) and math.isclose(got[c]["kurtosis"], pdf[c].kurt(), abs_tol=1e-9)
        assert math.isclose(got[c]["median"], pdf[c].median())
    assert got["d"]["skew"] is None and got["d"]["kurtosis"] is None
    scaled = stats.scale(df, ("a", "b"), ("c",)).toPandas()
    assert ((scaled["b_zscore"] - (pdf["b"] - pdf["b"].mean()) / pdf["b"].std()).abs().dropna() < 1e-9).all()
    assert scaled["b_zscore"].isna().sum() == pdf["b"].isna().sum() and (scaled["c_minmax"] == 0).all()
    close, exact = ({r.column: r for r in stats.profile(df, exact=e).collect()} for e in (False, True))
    assert all(abs(close[c].unique_count - exact[c].unique_count) <= 4 and abs(close[c].q50 - exact[c].q50) < 1.1 and math.isclose(close[c]["mean"], exact[c]["mean"], abs_tol=1e-9) for c in "abcd")
    empty = df.limit(0)
    assert stats.outliers(empty).count() == 0 and stats.describe(empty).count() == 0 and stats.profile(empty).count() == 4


def test_issue_caps(spark):
    df = spark.range(30).select(F.col("id").alias("row_id"), F.lit(-1.0).alias("v"), F.lit(None).cast("string").alias("w"))
    p = Profile.of({"profile_id": "x", "fields": {"v": {"type": "float", "min": 0}, "w": {"required": True}, "u": {"required": True}}})
    n = {(r.field, r.rule): r.issues for r in quality.issue_counts(quality.issues(df, p)).collect()}
    assert n == {("v", "min"): 10, ("w", "required"): 30, ("u", "missing_column"): 1}


def test_profiles_inherit():
    p = CATALOGUE.get("real_estate_mortgage")
    assert {"property_address", "mortgage_amount"} <= set(p.fields) and p.fields["property_address"].required
    deep = Catalogue([{"profile_id": str(i), "inherits_from": str(i + 1)} for i in range(6)], {"a": "0"})
    with pytest.raises(Exception, match="levels"):
        deep.get("a")


def test_roles(spark):
    with pytest.raises(PermissionDenied):
        security.check(security.ROLES["intern"], "extract")
    df = spark.range(2000).withColumnRenamed("id", "row_id")
    assert security.limit_rows(df, security.ROLES["intern"], "row_id").count() == 1000


def test_flow(spark, tmp_path):
    src = tmp_path / "houses.csv"
    src.write_text("房产地址,建筑面积,抵押金额,评估价值,登记日期\n甲路1号,100.5,50万,-800000,2023/1/5\n乙路2号,80,300000,600000,2023年2月3日\n,90,40万,500000,20230301\n", encoding="gbk")
    goal = Goal("real_estate_mortgage", "clean_and_validate", f"file:{src}", role="intern", params={"task_dir": str(tmp_path / "task")})
    r = run(spark, goal)
    assert r.success, r.errors
    rows = {x.row_id: x for x in r.flow.data.collect()}
    assert rows[0].mortgage_amount == 500000.0 and rows[0].valuation_amount == 800000.0 and rows[0].registration_date == "2023-01-05" and abs(rows[0].loan_to_value - 0.625) < 1e-9
    assert r.flow.metrics["validation_errors"] == 2
    stored = spark.read.parquet(r.flow.artifacts["data"]).orderBy("row_id").collect()
    assert stored[0].property_address == "[RESTRICTED-4 chars]" and stored[0].valuation_amount == "***.**"
    assert r.flow.meta["task"]["status"] == "COMPLETED" and r.flow.meta["task"]["lifecycle"]["policy"] == "supervised"
    again = run(spark, goal, start=r.flow, resume_from="schema")
    assert again.executed == ["schema", "summary", "snapshot", "finalize"]
    assert not run(spark, goal, start=r.flow, resume_from="nowhere").success
    failed = run(spark, goal, steps={"clean": lambda f: 1 / 0}, stop_on_error=False, retries=1)
    assert failed.failed_at == "clean" and "finalize" in failed.executed and not failed.success
    with pytest.raises(ValueError):
        plan(Goal("equipment", "dance"))


def test_text_flow(spark, tmp_path):
    src = tmp_path / "notes.txt"
    src.write_text("one two three\n\nfour five", encoding="utf-8")
    r = run(spark, Goal("equipment", "extract_entries", f"file:{src}", params={"backend": text.StubBackend("equipment_name")}))
    assert r.success, r.errors
    assert [x.equipment_name for x in r.flow.data.collect()] == ["5"]


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_are_exact_without_sorting(spark, seed):
    rng = random.Random(seed)
    odd = [0.0, 5e-324, 1e308, -1e308, 1e-9, 1e9, 1e9 + 1e-6, 3.0, 3.0, 3.0]
    rows = [(rng.choice(odd), rng.lognormvariate(0, 9), rng.choice([None, 7, 2**40]), rng.choice([math.inf, -math.inf, math.nan, 1.0, None]), None) for _ in range(rng.randint(1, 400))]
    df = spark.createDataFrame(rows, "a double, b double, c long, d double, e double")
    at = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)
    want = df.agg(*[F.percentile(F.col(c).cast("double"), list(at)).alias(c) for c in df.columns]).first()
    got = stats.quantiles(df, df.columns, at)
    for c in df.columns:
        assert [repr(x) for x in got[c]] == [repr(x) for x in want[c] or [None] * len(at)]
    plan = stats.profile(df, distinct=False)._jdf.queryExecution().toString()
    assert "percentile" not in plan and "Exchange" not in plan


def test_issues_by_field_counts_what_issues_lists(spark):
    df = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 7 - 3.0).alias("v"), F.when(F.col("id") % 4 > 0, F.lit("x")).alias("w"))
    p = Profile.of({"profile_id": "x", "fields": {"v": {"type": "float", "min": 0, "max": 2}, "w": {"required": True, "enum": ["y"]}, "u": {"required": True}, "z": {}, "row_id": {"min": 0}}})
    listed = {r.field: r["count"] for r in quality.issues(df, p, limit=None).groupBy("field").count().collect()}
    assert {r.field: r.issues for r in quality.issues_by_field(df, p).collect()} == listed | {"row_id": 0}


def plain_pairs(records, threshold):
    like = lambda a, b: sum((a[k] or "").strip().lower() == (b[k] or "").strip().lower() != "" for k in a if k in b) / len(set(a) & set(b)) if set(a) & set(b) else 0.0
    return sorted((x["position"], y["position"], like(x["fields"], y["fields"])) for i, x in enumerate(records) for y in records[i + 1 :] if like(x["fields"], y["fields"]) >= threshold)


@pytest.mark.parametrize("kinds", ["abcd", "abc"])
def test_pairs_and_merging_of_classes_match_plain_ones(spark, kinds, monkeypatch):
    """Equal records, blank and missing values, one kind of records or several, classes in several chunks."""
    monkeypatch.setattr(linkage, "CHUNK", 4)
    rng = random.Random(len(kinds))
    for threshold in (0.6, 1.5) if kinds == "abc" else (0.6,):
        records = [{"position": i * 3, "fields": {k: rng.choice(["x", "X ", "y", None, ""]) for k in rng.sample(kinds, 3)}, "confidence": rng.choice([None, 0.0, -0.5, 0.2, 0.9])} for i in range(60)]
        records += [r | {"position": r["position"] + 500, "confidence": rng.choice([None, 0.95])} for r in records[:20]]
        records += [{"position": 2000 + i, "fields": {k: "z" for k in kinds[:3]}, "confidence": 0.1 * (i % 7)} for i in range(30)]
        df = spark.createDataFrame([(r["position"], r["fields"], r["confidence"]) for r in records], "position long, fields map<string,string>, confidence double").repartition(3)
        assert sorted(map(tuple, linkage.similar_pairs(df, threshold).collect())) == plain_pairs(records, threshold)
        seen = lambda p, f, c, n: (p, n, repr(c), repr(sorted(f.items())))
        got = sorted(seen(r.position, r.fields, r.confidence, r.merged_from) for r in linkage.fuzzy(df, threshold).collect())
        assert got == sorted(seen(r["position"], r["fields"], r["confidence"], r["merged_from"]) for r in linkage.greedy(sorted(records, key=lambda r: r["position"]), threshold))


def test_copies_are_not_linked_in_pairs(spark, tmp_path, monkeypatch):
    stored = []
    monkeypatch.setattr(linkage, "checkpointed", lambda df, keep=linkage.checkpointed: stored.append(kept := keep(df)) or kept)
    df = spark.range(600).select(F.col("id").alias("position"), F.create_map(F.lit("a"), (F.col("id") % 3).cast("string"), F.lit("b"), F.lit("x")).alias("fields"), F.lit(0.5).alias("confidence"))
    assert sorted((r.position, r.merged_from) for r in linkage.fuzzy(df).collect()) == [(0, 200), (1, 200), (2, 200)]
    assert sorted((r.position, r.merged_from) for r in linkage.fuzzy(df, 0.5).collect()) == [(0, 600)]
    assert max(s.count() for s in stored) <= 6


def test_pairs_are_spelled_out_last(spark):
    """Pairs of records are made from lists of positions where they are returned: neither shuffled nor joined nor compared."""
    df = spark.range(90).select(F.col("id").alias("position"), F.create_map(F.lit("a"), (F.col("id") % 3).cast("string"), F.lit("b"), F.lit("x"), F.lit("c"), F.lit("")).alias("fields"))
    pairs = linkage.similar_pairs(df, 0.5, places=2)
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert not {w for w in ("Join", "Exchange", "Aggregate") if w in plan[: plan.index("Generate")]}
    assert sorted(map(tuple, pairs.collect())) == sorted((a, b, 0.67) for a in range(90) for b in range(a + 1, 90) if a % 3 == b % 3)
