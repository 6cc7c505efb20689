"""How long results are kept."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millrace.operators.security import Role

#: name -> (days in all, days by stage)
POLICIES = {
    "ephemeral": (1, {"raw": 1, "normalized": 1, "final": 1}),
    "supervised": (15, {"raw": 7, "normalized": 15, "final": 15}),
    "short_term": (30, {"raw": 7, "normalized": 30, "final": 30}),
    "long_term": (365, {"raw": 30, "normalized": 180, "final": 365}),
    "permanent": (36500, {"raw": 365, "normalized": 3650, "final": 36500}),
}


def resolve(role: Role, override: str | None = None, profile_days: int | None = None) -> tuple[str, int]:
    """(policy, days): interns are supervised; else the override, if known; else the profile's days; else short term."""
    if role.name == "intern":
        return "supervised", POLICIES["supervised"][0]
    if override is not None:
        name = override if override in POLICIES else "short_term"
        return name, POLICIES[name][0]
    if profile_days is not None:
        return "profile", profile_days
    return "short_term", POLICIES["short_term"][0]


def expiry(created: Column, days: Column | int) -> Column:
    return F.date_add(created, F.lit(days) if isinstance(days, int) else days)
