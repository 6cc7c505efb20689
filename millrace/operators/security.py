"""What a role may do and see."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from millrace.errors import PermissionDenied
from millrace.functions import coerce
from millrace.profiles import Profile

STEPS = ("read", "chunk", "extract", "deduplicate", "normalize", "normalize_numeric", "validate", "clean", "transform", "schema", "summary", "analyze", "adapt", "snapshot", "finalize")


@dataclass(frozen=True)
class Role:
    name: str
    steps: frozenset[str]
    sees: frozenset[str]  # access levels shown unmasked
    row_limit: int | None = None
    can_override_policy: bool = True

    def may(self, step: str) -> bool:
        return "*" in self.steps or step in self.steps


ROLES = {
    "admin": Role("admin", frozenset({"*"}), frozenset({"public", "internal", "restricted"})),
    "analyst": Role("analyst", frozenset(STEPS), frozenset({"public", "internal"})),
    "intern": Role("intern", frozenset(STEPS) - {"extract"}, frozenset({"public"}), 1000, False),
}


def check(role: Role, step: str) -> None:
    if not role.may(step):
        raise PermissionDenied(f"{role.name} may not run {step}")


def limit_rows(df: DataFrame, role: Role, order: str) -> DataFrame:
    """The first rows by order, where the role has a limit (the limit is the feature)."""
    return df if role.row_limit is None else df.orderBy(order).limit(role.row_limit)


def mask(df: DataFrame, profile: Profile, role: Role) -> DataFrame:
    """Columns above the role's access as masks; applying it twice changes nothing more."""
    new = {}
    for f in profile.fields.values():
        if f.name in df.columns and f.access_level not in role.sees:
            c = F.col(f"`{f.name}`")
            new[f.name] = coerce.masked_number(c) if isinstance(df.schema[f.name].dataType, NumericType) else F.when(c == "***.**", c).otherwise(coerce.masked_text(c.cast("string")))
    return df.withColumns(new) if new else df


def needs_approval(step: str, rows: int, changed: int, row_threshold: int = 1000, rate: float = 0.05) -> bool:
    """Writes of many rows, and repairs of more than rate of the rows, ask for approval."""
    return step == "finalize" and rows > row_threshold or step == "clean" and changed > rate * rows
