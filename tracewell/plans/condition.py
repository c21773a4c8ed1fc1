"""Conditions over named selections: parentheses, then not, then and, then or."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column

from tracewell.plans.errors import RuleError

#: Words and brackets of a condition, and its `of` expression (fixed forms of the rule language).
_TOKEN = re.compile(r"\s*([()]|\w+)")
_OF = re.compile(r"(all|1) of ([^*]+)\*")


def expand_of(condition: str, names: list[str]) -> str:
    """`all of X*` and `1 of X*` by the selections that X begins; `them` is no prefix and so no match."""
    def spelled(m: re.Match) -> str:
        chosen = [n for n in names if n.startswith(m[2].strip())]
        if not chosen:
            raise RuleError(f"no selection begins with {m[2]}")
        return f"({(' and ' if m[1] == 'all' else ' or ').join(chosen)})"

    return _OF.sub(spelled, condition)


def tokens(condition: str) -> list[str]:
    out, at = [], 0
    condition = condition.rstrip()
    while at < len(condition):
        m = _TOKEN.match(condition, at)
        if not m:
            raise RuleError(f"unexpected character in condition: {condition[at:]}")
        out.append(m[1])
        at = m.end()
    return out


def compile_condition(condition: str, selections: Mapping[str, Column]) -> Column:
    """The condition as a Column; selections are two-valued already."""
    left = tokens(expand_of(condition, list(selections)))

    def peek() -> str | None:
        return left[0] if left else None

    def term(negated: bool = False) -> Column:
        t = left.pop(0) if left else None
        if t == "not":
            if negated:
                raise RuleError("not not")
            return ~term(True)
        if t == "(":
            inside = either()
            if not left or left.pop(0) != ")":
                raise RuleError("missing )")
            return inside
        if t is None or t in (")", "and", "or"):
            raise RuleError(f"misplaced {t or 'end'} in condition: {condition}")
        if t not in selections:
            raise RuleError(f"{t} is no selection")
        return selections[t]

    def both() -> Column:
        out = term()
        while peek() == "and":
            left.pop(0)
            out = out & term()
        return out

    def either() -> Column:
        out = both()
        while peek() == "or":
            left.pop(0)
            out = out | both()
        return out

    out = either()
    if left:
        raise RuleError(f"unexpected {left[0]} in condition: {condition}")
    return out
