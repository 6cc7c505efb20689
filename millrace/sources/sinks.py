"""A task's folder: normalized/ holds the snapshot, final/ what was finalized, meta.json its state."""

from __future__ import annotations

import json
import shutil
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame

STATES = ("PENDING", "RUNNING", "AWAITING_APPROVAL", "COMPLETED", "FAILED")


def _json(path: Path, what) -> None:
    path.write_text(json.dumps(what, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def snapshot(folder: str, df: DataFrame, *, schema: list[dict] | None = None, summary: str | None = None, entries: DataFrame | None = None, documents: DataFrame | None = None, csv: bool = True) -> dict[str, str]:
    """Writes data (Parquet, and CSV in as many files as it has partitions), schema.json, summary.md, entries and documents (JSON); gives their paths."""
    base = Path(folder) / "normalized"
    base.mkdir(parents=True, exist_ok=True)
    out = {"data": str(base / "data.parquet")}
    df.write.mode("overwrite").parquet(out["data"])
    if csv:
        out["csv"] = str(base / "data.csv")
        df.write.mode("overwrite").csv(out["csv"], header=True, encoding="utf-8")
    if schema is not None:
        _json(base / "schema.json", schema)
        out["schema"] = str(base / "schema.json")
    if summary is not None:
        (base / "summary.md").write_text(summary, encoding="utf-8")
        out["summary"] = str(base / "summary.md")
    for name, frame in (("entries", entries), ("documents", documents)):
        if frame is not None:
            out[name] = str(base / f"{name}.jsonl")
            frame.write.mode("overwrite").json(out[name])
    return out


def write_meta(folder: str, **fields) -> dict:
    path = Path(folder) / "meta.json"
    meta = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {"created_at": datetime.now(timezone.utc).isoformat()}
    meta |= fields
    path.parent.mkdir(parents=True, exist_ok=True)
    _json(path, meta)
    return meta


def finalize(folder: str, **fields) -> dict:
    """Replaces final/ by a copy of normalized/ and completes the task."""
    base = Path(folder)
    shutil.rmtree(base / "final", ignore_errors=True)
    shutil.copytree(base / "normalized", base / "final")
    return write_meta(folder, status="COMPLETED", completed_at=datetime.now(timezone.utc).isoformat(), artifacts=sorted(p.name for p in (base / "final").iterdir()), **fields)


def reopen(folder: str) -> dict:
    """Takes a finalization back."""
    shutil.rmtree(Path(folder) / "final", ignore_errors=True)
    return write_meta(folder, status="RUNNING", completed_at=None)
