"""Correlation rules: resolution of references, merged predicates, temporal expansion."""

from __future__ import annotations

from dataclasses import replace

from tracewell.plans.aggregation import AggSpec, parse_frame
from tracewell.plans.errors import RuleError
from tracewell.plans.rules import Rule

_COMPARE = {"eq": "==", "lte": "<=", "gte": ">=", "lt": "<", "gt": ">"}
COUNTS, TEMPORAL = ("event_count", "value_count"), ("temporal", "temporal_ordered")


def find(rules: list[Rule], reference: str) -> list[Rule]:
    """Every rule that has the reference as id, title or name."""
    found = [r for r in rules if reference in (r.rule_id, r.title, r.name)]
    if not found:
        raise RuleError(f"{reference} refers to no rule")
    return found


def _group_by(spec: dict, needed: bool) -> tuple[str, ...]:
    by = spec.get("group-by")
    if by is None and not needed:
        return ()
    if not isinstance(by, list):
        raise RuleError("group-by must be a list")
    return tuple(map(str, by))


def _frame(spec: dict) -> int:
    text = str(spec.get("timespan", ""))
    seconds = parse_frame(text)
    if seconds is None or text[-1] not in "smhd":
        raise RuleError(f"timespan {text or 'is missing'}")
    return seconds


def merged(rule: Rule, rules: list[Rule]) -> Rule:
    """An event_count or value_count rule over the union of what it refers to."""
    spec = rule.correlation
    condition = spec.get("condition") or {}
    op = next((k for k in _COMPARE if k in condition), None)
    if op is None:
        raise RuleError(f"{rule.title}: no comparison in its condition")
    name = condition.get("field") if spec["type"] == "value_count" else None
    if spec["type"] == "value_count" and not name:
        raise RuleError(f"{rule.title}: value_count needs a field")
    refs = [r for x in spec.get("rules") or [] for r in find(rules, str(x))]
    if not refs:
        raise RuleError(f"{rule.title}: refers to nothing")
    return replace(rule, refs=refs, agg=AggSpec(name, _group_by(spec, True), _COMPARE[op], int(condition[op]), _frame(spec)))


def resolve(rules: list[Rule]) -> tuple[list[Rule], list[tuple[Rule, list[Rule], int, bool]], list[str]]:
    """Rules to evaluate, temporal rules as (rule, blocks in order, seconds, ordered), and errors.

    Counts are merged first, so that temporal rules may refer to them. A rule that fails stays and never
    matches. Rules that are referred to and not generated themselves leave the output: they are marked so.
    """
    base = [r for r in rules if r.correlation is None]
    done, errors, silent = list(base), [], set()
    for r in (x for x in rules if x.correlation and x.correlation.get("type") in COUNTS):
        try:
            m = merged(r, base)
        except RuleError as e:
            errors.append(str(e))
            continue
        done.append(m)
        if not (r.correlation.get("generate") or False):
            silent |= {x.rule_id for x in m.refs}
    temporal = []
    for r in (x for x in rules if x.correlation and x.correlation.get("type") in TEMPORAL):
        try:
            frame, by = _frame(r.correlation), _group_by(r.correlation, False)
            refs = [x for name in r.correlation.get("rules") or [] for x in find(done, str(name))]
        except RuleError as e:
            errors.append(f"{r.title}: {e}")
            continue
        blocks = [x if x.correlation else replace(x, rule_id=f"{r.rule_id}/{i}", agg=AggSpec(None, by, ">=", 1, frame)) for i, x in enumerate(refs)]
        temporal.append((r, blocks, frame, r.correlation["type"] == "temporal_ordered"))
        if not (r.correlation.get("generate") or False):
            silent |= {x.rule_id for x in refs}
    for r in done:
        if r.rule_id in silent:
            r.generate = False
    return done, temporal, errors
