"""Markdown out of collected profiles: as many rows as a table has columns."""

from __future__ import annotations


def _n(v) -> str:
    return "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)


def summary(title: str, rows: int, profiled: list[dict], anomalies: list[dict] = ()) -> str:
    out = [f"# {title}", "", f"{rows} rows, {len(profiled)} columns.", ""]
    if anomalies:
        out += [f"> {len(anomalies)} anomalies: " + ", ".join(f"{a['column']} ({a['anomaly']})" for a in anomalies), ""]
    out += ["| column | type | present | missing | distinct | mean | min | max |", "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    out += ["| " + " | ".join(_n(p[k]) for k in ("column", "type", "count", "null_count", "unique_count", "mean", "min", "max")) + " |" for p in profiled]
    cells = sum(p["count"] + p["null_count"] for p in profiled)
    rate = sum(p["null_count"] for p in profiled) / cells if cells else 0.0
    out += ["", "Many values are missing: check the source." if rate > 0.1 else "Some values are missing." if rate > 0 else "No value is missing."]
    if rows > 10_000:
        out.append("Large table: sample before looking at rows.")
    return "\n".join(out) + "\n"


def full_report(title: str, rows: int, partitions: int, profiled: list[dict], outliers: list[dict], pairs: list[dict]) -> str:
    out = [summary(title, rows, profiled), f"Partitions: {partitions}.", "", "## Outliers", ""]
    out += [f"- {o['column']}: {o['outliers']} ({o['rate']:.2%}) outside {_n(o['low'])} to {_n(o['high'])}" for o in outliers] or ["None."]
    out += ["", "## Strong correlations", ""]
    out += [f"- {p['a']} and {p['b']}: {p['r']:.4f}" for p in pairs] or ["None."]
    return "\n".join(out) + "\n"
