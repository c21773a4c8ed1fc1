"""Count conditions and time frames."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column

from tracewell.plans.errors import RuleError

_COUNT = re.compile(r"\s*count\s*\(\s*(\w*)\s*\)\s*(?:by\s+([\w\s,]+?))?\s*(==|>=|<=|>|<)\s*(\d+)\s*")
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
_COMPARE = {"==": "__eq__", ">=": "__ge__", "<=": "__le__", ">": "__gt__", "<": "__lt__"}


@dataclass(frozen=True)
class AggSpec:
    """count of rows, or of distinct values of `field`, per group within `frame` seconds (None: no frame)."""

    field: str | None
    by: tuple[str, ...]
    op: str
    number: int
    frame: int | None = None

    def holds(self, count: Column) -> Column:
        return getattr(count, _COMPARE[self.op])(self.number)


def parse_frame(text) -> int | None:
    """Seconds of `15s`, `5m`, `1h`, `2d`; a bare integer counts as seconds, anything else is no frame."""
    if text is None:
        return None
    m = re.fullmatch(r"(\d+)([smhd]?)", str(text).strip())
    return int(m[1]) * UNITS.get(m[2], 1) if m else None


def parse_count(text: str, frame=None) -> AggSpec:
    m = _COUNT.fullmatch(text)
    if not m:
        raise RuleError(f"no count condition: {text}")
    by = tuple(x.strip() for x in m[2].split(",")) if m[2] else ()
    if any(not re.fullmatch(r"\w+", x) for x in by):
        raise RuleError(f"bad field in by: {m[2]}")
    return AggSpec(m[1] or None, by, m[3], int(m[4]), parse_frame(frame))
