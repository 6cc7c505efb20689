"""Goals to plans: which steps run, in which order, on whose behalf; resumable by step name."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.errors import MillraceError, StepFailed, UnknownOperation
from millrace.functions.expressions import derive
from millrace.operators import linkage, quality, security, shape, stats, text
from millrace.plans import lifecycle, report
from millrace.profiles import CATALOGUE, Catalogue, Profile
from millrace.sources import readers, sinks


@dataclass(frozen=True)
class Goal:
    asset_type: str
    operation: str
    input_source: str = ""
    role: str = "admin"
    params: dict[str, Any] = field(default_factory=dict)
    policy_override: str | None = None


@dataclass(frozen=True)
class Flow:
    """What is known between steps; never changed in place."""

    spark: SparkSession
    goal: Goal
    profile: Profile
    task_id: str = "task"
    data: DataFrame | None = None
    texts: DataFrame | None = None
    chunks: DataFrame | None = None
    entries: DataFrame | None = None
    issues: DataFrame | None = None
    profiled: list[dict] | None = None
    summary: str | None = None
    artifacts: dict[str, str] = field(default_factory=dict)
    metrics: dict[str, Any] = field(default_factory=dict)
    meta: dict[str, Any] = field(default_factory=dict)

    def noting(self, **metrics) -> Flow:
        return replace(self, metrics=self.metrics | metrics)


@dataclass(frozen=True)
class RunResult:
    success: bool
    flow: Flow
    executed: list[str]
    failed_at: str | None = None
    errors: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)


Step = Callable[[Flow], Flow]


def read(f: Flow) -> Flow:
    df = readers.read(f.spark, f.goal.input_source)
    if set(df.columns) == {"path", "text"}:
        return replace(f, texts=df)
    df = shape.with_row_id(df)
    return replace(f, data=security.limit_rows(df, security.ROLES[f.goal.role], "row_id"))


def chunk(f: Flow) -> Flow:
    p = f.goal.params
    return replace(f, chunks=text.chunk(f.texts, "text", p.get("strategy", "paragraph"), p.get("chunk_size", 2000), p.get("overlap", 200)))


def extract(f: Flow) -> Flow:
    asked = text.prompts(text.load_template(f.goal.params.get("templates"), f.goal.params.get("template", "generic")), f.goal.asset_type, f.profile, F.col("chunk"))
    found = text.extract(f.chunks, asked, f.goal.params.get("backend", text.StubBackend()))
    return replace(f, entries=found.withColumn("position", F.monotonically_increasing_id()))


def deduplicate(f: Flow) -> Flow:
    kept = linkage.exact(linkage.flag_review(f.entries), tuple(list(f.profile.fields)[:5]))
    merged = linkage.checkpointed(linkage.fuzzy(kept).withColumn("needs_review", F.coalesce("confidence", F.lit(1.0)) < linkage.REVIEW_BELOW))
    return replace(f, entries=merged).noting(dedup_removed=f.entries.count() - merged.count())


def normalize(f: Flow) -> Flow:
    df = f.data if f.data is not None else shape.with_row_id(shape.entries_to_table(f.entries, f.profile))
    return replace(f, data=shape.coerce_types(shape.rename_aliases(df, f.profile), f.profile))


def normalize_numeric(f: Flow) -> Flow:
    numbers = set(shape.numeric_columns(f.data))
    z, m = (tuple(n for n, d in f.profile.fields.items() if n in numbers and k in d.normalization) for k in ("zscore", "minmax"))
    return replace(f, data=stats.scale(f.data, z, m)).noting(normalized_columns=len(z) + len(m))


def validate(f: Flow) -> Flow:
    found = quality.issues(f.data, f.profile)
    counts = {r["severity"]: r["issues"] for r in found.groupBy("severity").agg(F.count("*").alias("issues")).collect()}
    return replace(f, issues=found).noting(validation_errors=counts.get("error", 0), validation_warnings=counts.get("warning", 0))


def clean(f: Flow) -> Flow:
    """The cleaned table is written once; all later steps read it from there."""
    df = shape.drop_empty_rows(f.data, but=("row_id",))
    df = shape.drop_empty_columns(df)
    repaired = shape.repair(df, f.profile)
    cleaned = linkage.checkpointed(shape.drop_repeated_rows(repaired, order="row_id"))
    rows, before = cleaned.count(), repaired.count()
    fixes = sum(bool(d.repairs()) for n, d in f.profile.fields.items() if n in df.columns)
    return replace(f, data=cleaned).noting(cleaned_rows=rows, dupes_removed=before - rows, fixes_applied=fixes)


def transform(f: Flow) -> Flow:
    df, added, skipped = derive(f.data, f.profile.computed, f.goal.params.get("today"))
    return replace(f, data=shape.reorder(df, f.profile.columns), meta=f.meta | {"skipped": skipped}).noting(computed_columns=added)


def schema(f: Flow) -> Flow:
    """Quartiles and distinct counts by sketches, in one pass, unless the goal asks for exact ones."""
    table = stats.profile(f.data, [c for c in f.data.columns if c != "row_id"], exact=bool(f.goal.params.get("exact", False)))
    rows = [r.asDict() | {"unit": f.profile.fields[r["column"]].unit if r["column"] in f.profile.fields else ""} for r in table.collect()]
    odd = [{"column": r["column"], "anomaly": a} for r in rows for a in (["high_null_rate"] if r["null_count"] > r["count"] else []) + (["zero_variance"] if r["std"] == 0 else [])]
    return replace(f, profiled=rows, meta=f.meta | {"anomalies": odd}).noting(schema_columns=len(rows), anomaly_count=len(odd), row_count=max((r["count"] + r["null_count"] for r in rows), default=0))


def summarize(f: Flow) -> Flow:
    return replace(f, summary=report.summary(f.goal.asset_type, f.metrics.get("row_count", 0), f.profiled or [], f.meta.get("anomalies", [])))


def analyze(f: Flow) -> Flow:
    df = f.data.drop("row_id")
    found = {"outliers": [r.asDict() for r in stats.outliers(df).collect()], "pairs": [r.asDict() for r in stats.strong_correlations(df).collect()]} if shape.numeric_columns(df) else {"outliers": [], "pairs": []}
    return replace(f, meta=f.meta | found)


def adapt(f: Flow) -> Flow:
    columns = [c for c in f.data.columns if c != "row_id"]
    units = {n: d.unit for n, d in f.profile.fields.items()}
    shown = security.mask(f.data, f.profile, security.ROLES[f.goal.role])
    docs = shown.select(F.concat(F.lit("doc_"), F.col("row_id").cast("string")).alias("id"), text.document_text(shown, columns, units).alias("text"), F.col("row_id").alias("row_index"), F.lit(f.goal.asset_type).alias("asset_type"))
    return replace(f, meta=f.meta | {"documents": docs})


def snapshot(f: Flow) -> Flow:
    shown = security.mask(f.data, f.profile, security.ROLES[f.goal.role])
    got = sinks.snapshot(f.goal.params["task_dir"], shown, schema=f.profiled, summary=f.summary, entries=f.entries, documents=f.meta.get("documents"))
    return replace(f, artifacts=f.artifacts | got)


def finalize(f: Flow) -> Flow:
    name, days = lifecycle.resolve(security.ROLES[f.goal.role], f.goal.policy_override, f.profile.lifecycle.get("default_ttl_days"))
    meta = sinks.finalize(f.goal.params["task_dir"], task_id=f.task_id, asset_type=f.goal.asset_type, operation=f.goal.operation, role=f.goal.role, lifecycle={"policy": name, "days": days})
    return replace(f, meta=f.meta | {"task": meta})


STEPS: dict[str, Step] = {
    "read": read, "chunk": chunk, "extract": extract, "deduplicate": deduplicate, "normalize": normalize, "normalize_numeric": normalize_numeric, "validate": validate,
    "clean": clean, "transform": transform, "schema": schema, "summary": summarize, "analyze": analyze, "adapt": adapt, "snapshot": snapshot, "finalize": finalize,
}
#: operation -> steps, each with the condition under which it runs
_TEXT, _WANTS_NUMBERS, _STORES = (lambda f: f.texts is not None), (lambda f: f.goal.params.get("normalize", True)), (lambda f: "task_dir" in f.goal.params)
_TAIL = [("schema", None), ("summary", None), ("snapshot", _STORES), ("finalize", _STORES)]
ROUTES: dict[str, list[tuple[str, Callable[[Flow], bool] | None]]] = {
    "clean_and_validate": [("read", None), ("normalize", None), ("normalize_numeric", _WANTS_NUMBERS), ("validate", None), ("clean", None), ("transform", None), *_TAIL],
    "extract_entries": [("read", lambda f: f.texts is None), ("chunk", None), ("extract", None), ("deduplicate", None), ("normalize", None), ("validate", None), *_TAIL],
    "full_pipeline": [("read", None), ("chunk", _TEXT), ("extract", _TEXT), ("deduplicate", _TEXT), ("normalize", None), ("normalize_numeric", _WANTS_NUMBERS), ("validate", None), ("clean", None), ("transform", None), ("schema", None), ("summary", None), ("analyze", None), ("adapt", None), ("snapshot", _STORES), ("finalize", _STORES)],
    "analyze": [("read", None), ("normalize", None), ("schema", None), ("summary", None), ("analyze", None)],
    "normalize_only": [("read", None), ("normalize", None), ("normalize_numeric", _WANTS_NUMBERS)],
    "transform": [("read", None), ("normalize", None), ("transform", None)],
    "generate_report": [("read", None), ("normalize", None), ("schema", None), ("summary", None)],
}


def plan(goal: Goal) -> list[tuple[str, Callable[[Flow], bool] | None]]:
    if goal.operation not in ROUTES:
        raise UnknownOperation(goal.operation)
    return [(n, c) for n, c in ROUTES[goal.operation] if n in STEPS]


def run(spark: SparkSession, goal: Goal, *, catalogue: Catalogue = CATALOGUE, start: Flow | None = None, resume_from: str | None = None, stop_on_error: bool = True, retries: int = 0, steps: dict[str, Step] | None = None) -> RunResult:
    """Runs a goal's plan. resume_from: the first step to run, on the flow of an earlier result. Steps see unmasked
    data; masks are put on what is written."""
    f = start or Flow(spark, goal, catalogue.get(goal.asset_type))
    todo, known = plan(goal), STEPS | (steps or {})
    executed, errors, seconds, failed = [], [], {}, None
    if resume_from is not None:
        names = [n for n, _ in todo]
        if resume_from not in names:
            return RunResult(False, f, [], resume_from, [f"{StepFailed.code}: no step {resume_from}"])
        todo = todo[names.index(resume_from) :]
    role = security.ROLES[goal.role]
    for name, condition in todo:
        if condition is not None and not condition(f):
            continue
        began = time.monotonic()
        for attempt in range(retries + 1):
            try:
                security.check(role, name)
                f = known[name](f)
                executed.append(name)
                break
            except Exception as e:
                if attempt == retries or isinstance(e, MillraceError):
                    errors.append(f"{getattr(e, 'code', StepFailed.code)}: {name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
                    failed = failed or name
                    break
        seconds[name] = time.monotonic() - began
        if failed and stop_on_error:
            break
    return RunResult(not errors, f, executed, failed, errors, seconds)
