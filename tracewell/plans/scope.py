"""Which channels a rule can match at all, read from its selections.

A scope is sound: outside it the rule's predicate is false. It is found by running the condition over scopes in
place of Columns: `and` keeps the narrower side, `or` joins both, `not` knows nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from tracewell.plans.condition import compile_condition
from tracewell.plans.errors import RuleError
from tracewell.plans.leaves import shape_of, text_of
from tracewell.plans.rules import RESERVED, Rule


@dataclass(frozen=True)
class Scope:
    """Patterns of Channel, one of which matches wherever the predicate holds; None: any channel."""

    channels: frozenset[str] | None = None

    def __and__(self, other: Scope) -> Scope:
        known = [s for s in (self, other) if s.channels is not None]
        return min(known, key=lambda s: len(s.channels)) if known else Scope()

    def __or__(self, other: Scope) -> Scope:
        return Scope() if self.channels is None or other.channels is None else Scope(self.channels | other.channels)

    def __invert__(self) -> Scope:
        return Scope()


def _selected(node) -> Scope:
    if isinstance(node, dict):
        value = node.get("Channel")
        values = value if isinstance(value, list) else [value]
        if not values or any(v is None or isinstance(v, dict | list) for v in values):
            return Scope()
        return Scope(frozenset(map(text_of, values)))
    if isinstance(node, list) and node and all(isinstance(x, dict) for x in node):
        out = _selected(node[0])
        for x in node[1:]:
            out = out | _selected(x)
        return out
    return Scope()


@dataclass(frozen=True)
class Homes:
    """Pairs of channel and event id (folded; None: any), one of which a record has wherever the predicate holds."""

    pairs: frozenset = frozenset({(None, None)})

    def __and__(self, other: Homes) -> Homes:
        if len(self.pairs) * len(other.pairs) > 64:
            return min((x for x in (self, other)), key=lambda x: ((None, None) in x.pairs, len(x.pairs)))
        return Homes(frozenset((a if a is not None else c, b if b is not None else d) for a, b in self.pairs for c, d in other.pairs))

    def __or__(self, other: Homes) -> Homes:
        return Homes(self.pairs | other.pairs)

    def __invert__(self) -> Homes:
        return Homes()


class _HomesOf:
    """Leaves as Homes."""

    def nested(self, key: str, spec: dict) -> Homes:
        return Homes()

    def value(self, key: str, value) -> Homes:
        return self.values(key, [value])

    def values(self, key: str, values: list) -> Homes:
        shapes = [shape_of(key, v) for v in values]
        if key not in ("Channel", "EventID") or any(s is None or s[0] != "equals" for s in shapes):
            return Homes()
        return Homes(frozenset((s[2], None) if key == "Channel" else (None, s[2]) for s in shapes))


def homes_of(rule: Rule) -> set[tuple[str | None, str | None]]:
    """Where a rule can match, by channel and event id."""
    return set(rule.build(_HomesOf()).pairs)


def scope_of(rule: Rule) -> Scope:
    """The rule's scope; of a merged rule that of all it refers to. A rule that doesn't compile has none, so that
    compiling it reports the error."""
    if rule.refs:
        out = scope_of(rule.refs[0])
        for r in rule.refs[1:]:
            out = out | scope_of(r)
        return out
    detection = rule.raw.get("detection") or {}
    named = {k: _selected(v) for k, v in detection.items() if k not in RESERVED}
    condition = detection.get("condition")
    if condition is None:
        return next(iter(named.values())) if len(named) == 1 else Scope()
    try:
        return compile_condition(str(condition).split("|")[0], named)
    except RuleError:
        return Scope()
