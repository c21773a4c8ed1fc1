"""An index over the leaves of many rules, so that thousands of them run in one pass and a plan of constant size.

Each distinct leaf of all rules has a number and is evaluated once a record: equal values by a hash lookup, substrings and
ends by the list of texts that rules of the record's channel and event id ask of a field, all others by an expression.
A rule is a set of alternatives: leaves that must be true and leaves that must be false. Every alternative is
filed under the rarest of the leaves it needs, so a record only looks at alternatives one of whose leaves it has.
All tables are literals of the plan, as large as the rules.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import ascii_lower
from tracewell.plans.leaves import Columns, Lists, Resolve, shape_of
from tracewell.plans.rules import Rule
from tracewell.plans.scope import homes_of

#: Alternatives of a rule beyond which its whole predicate counts as one leaf.
MOST_ALTERNATIVES = 256
_NONE = "\0"


@dataclass(frozen=True)
class Node:
    """A Boolean expression over numbered leaves."""

    op: str
    parts: tuple = ()

    def __and__(self, other: Node) -> Node:
        return Node("and", (self, other))

    def __or__(self, other: Node) -> Node:
        return Node("or", (self, other))

    def __invert__(self) -> Node:
        return Node("not", (self,))


Alternative = tuple[frozenset, frozenset]


def alternatives(node: Node, negated: bool = False) -> list[Alternative] | None:
    """The expression as (leaves that are true, leaves that are false), one of which must hold; None: too many."""
    if node.op == "leaf":
        leaf = frozenset(node.parts)
        return [(frozenset(), leaf) if negated else (leaf, frozenset())]
    if node.op == "not":
        return alternatives(node.parts[0], not negated)
    left, right = (alternatives(p, negated) for p in node.parts)
    if left is None or right is None:
        return None
    if (node.op == "or") != negated:
        out = [*left, *right]
    else:
        out = [(a | c, b | d) for a, b in left for c, d in right] if len(left) * len(right) <= MOST_ALTERNATIVES else None
    if out is None:
        return None
    out = list(dict.fromkeys(x for x in out if not x[0] & x[1]))
    return out if len(out) <= MOST_ALTERNATIVES else None


@dataclass
class _Leaf:
    """How a leaf is evaluated: texts of a shape on one field, else an expression; and where its rules apply."""

    shapes: list[tuple[str, str, str]] | None
    column: Callable[[Columns], Column]
    homes: set = field(default_factory=set)


class Numbered:
    """Makes Nodes of leaves, equal ones with the same number."""

    def __init__(self) -> None:
        self.leaves: list[_Leaf] = []
        self._known: dict[str, int] = {}
        self.used: set[int] = set()

    def number(self, name: str, make: Callable[[], _Leaf]) -> int:
        if name not in self._known:
            leaf = make()
            self._known[name] = len(self.leaves)
            self.leaves.append(leaf)
        self.used.add(self._known[name])
        return self._known[name]

    def _leaf(self, name: list, make: Callable[[], _Leaf]) -> Node:
        return Node("leaf", (self.number(json.dumps(name), make),))

    def nested(self, key: str, spec: dict) -> Node:
        return self._leaf(["nested", key, spec], lambda: _Leaf(None, lambda c: c.nested(key, spec)))

    def value(self, key: str, value) -> Node:
        plain = "|".join(m for m in key.split("|") if m != "neq")
        node = self.values(plain, [value]) or self._leaf(["value", plain, value], lambda: _Leaf(None, lambda c: c.value(plain, value)))
        return node if plain == key else ~node

    def values(self, key: str, values: list) -> Node | None:
        """One leaf for any of the values, if all have a shape; negated with neq."""
        plain = "|".join(m for m in key.split("|") if m != "neq")
        if key.split("|")[0] in ("Data", "EventData"):
            return None
        shapes = [shape_of(key, v) for v in values]
        if any(x is None for x in shapes):
            return None
        node = self._leaf(["shapes", sorted(set(shapes))], lambda: _Leaf(shapes, lambda c: c.value(plain, values)))
        return node if plain == key else ~node


def _literal(rows: list, kind: str) -> Column:
    """A nested value as a literal: Spark folds the parsing away."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), kind)


def _bucket(key: str, n: int) -> int:
    return zlib.crc32(key.encode()) % n


def _found(c: Column, asked: Column, how: str) -> Column:
    """Numbers of the texts that the value has; the value is computed once for all of them."""
    texts = lambda v: F.transform(F.filter(asked, lambda p: getattr(v, how)(p["t"])), lambda p: p["n"])
    return F.element_at(F.transform(F.array(c), texts), 1)


class _Table:
    """A hash table as a literal: arrays of numbers or structs by a text."""

    def __init__(self, entries: dict[str, list], kind: str):
        self.n = 1
        while self.n < 2 * len(entries):
            self.n *= 2
        rows: list[list] = [[] for _ in range(self.n)]
        for key, held in entries.items():
            rows[_bucket(key, self.n)].append({"k": key, "v": held})
        self.rows, self.none = _literal(rows, f"array<array<struct<k: string, v: array<{kind}>>>>"), F.array().cast(f"array<{kind}>")

    def get(self, key: Column) -> Column:
        """The array of a key; an empty one if it is missing or null."""
        at = (F.crc32(key.cast("binary")) % self.n).cast("int") + 1
        found = F.filter(F.element_at(self.rows, at), lambda e: e["k"] == key)
        return F.coalesce(F.try_element_at(found, F.lit(1))["v"], self.none)


def once(c: Column) -> Column:
    """c, evaluated once a row: the optimizer copies no expression that depends on chance into filters and projections."""
    return F.when(F.rand(0) + 1 > 0, c)  # a bare rand() would be folded away


class Index:
    """Rules numbered by their place. `match` adds the array of those that match a record, in steps: the fields that
    rules ask for, their folded values, the true leaves, the rules; each is computed once a record."""

    def __init__(self, rules: list[Rule], resolve: Resolve, lists: Lists | None = None):
        self._plain: dict[str, Column] = {}
        self._folded: dict[str, Column] = {}
        self.resolve = lambda name: self._column(self._plain, "field", name, lambda: resolve(name))
        self.columns = Columns(self.resolve, lists or Lists())
        made = Numbered()
        found: list[tuple[int, Alternative]] = []
        for i, rule in enumerate(rules):
            made.used = set()
            ways = alternatives(rule.build(made))
            if ways is None:
                made.used = {made.number(f"rule {i}", lambda r=rule: _Leaf(None, lambda c: r.build(c)))}
                ways = [(frozenset(made.used), frozenset())]
            found += [(i, w) for w in ways]
            homes = homes_of(rule)
            for n in made.used:
                made.leaves[n].homes |= homes
        self.leaves = made.leaves
        often = Counter(n for _, (yes, _) in found for n in yes)
        self.always: list[dict] = []
        self.filed: list[list[dict]] = [[] for _ in self.leaves]
        for rule_no, (yes, no) in found:
            first = min(yes, key=lambda n: (often[n], n)) if yes else None
            entry = {"r": rule_no, "y": sorted(yes - {first}), "n": sorted(no)}
            (self.always if first is None else self.filed[first]).append(entry)

    @staticmethod
    def _column(known: dict[str, Column], kind: str, name: str, make: Callable[[], Column]) -> Column:
        """The column that will hold a value; it is added to the record by match."""
        if name not in known:
            known[name] = once(make()).alias(f"index_{kind}_{len(known)}")
        return F.col(f"index_{kind}_{list(known).index(name)}")

    def _lower(self, name: str, fold: Callable[[Column], Column] = ascii_lower) -> Column:
        return self._column(self._folded, "folded", f"{fold.__name__} {name}", lambda: fold(self.resolve(name)))

    def match(self, records: DataFrame, out: str) -> DataFrame:
        """records with the numbers of the rules that match, an array, in the column `out`."""
        leaves = self.true_leaves()
        for step in (self._plain, self._folded, {"": once(leaves).alias("index_leaves")}, {"": once(self.matching(F.col("index_leaves"))).alias(out)}):
            records = records.select("*", *step.values())
        return records.drop(*[c for c in records.columns if c.startswith("index_")])

    def _homes(self) -> dict[str, Column]:
        """Texts that name where a record lies: its channel, its event id, both."""
        channel, event = self._lower("Channel"), self._lower("EventID")
        both = self._column(self._folded, "folded", "both", lambda: F.concat(F.lit("b"), ascii_lower(self.resolve("Channel")), F.lit(_NONE), ascii_lower(self.resolve("EventID"))))
        return {"c": F.concat(F.lit("c"), channel), "e": F.concat(F.lit("e"), event), "b": both}

    @staticmethod
    def _home(pair: tuple[str | None, str | None]) -> str:
        channel, event = pair
        if channel is None:
            return "" if event is None else f"e{event}"
        return f"c{channel}" if event is None else f"b{channel}{_NONE}{event}"

    def true_leaves(self) -> Column:
        """Numbers of the leaves that are true of a record, as an array."""
        equal: dict[str, set[int]] = defaultdict(set)
        texts: dict[tuple[str, str], dict[str, list]] = defaultdict(lambda: defaultdict(list))
        others: list[int] = []
        for n, leaf in enumerate(self.leaves):
            if leaf.shapes is None:
                others.append(n)
                continue
            homes = {(None, None)} if (None, None) in leaf.homes else leaf.homes
            for kind, name, text in leaf.shapes:
                if kind == "equals":
                    equal[f"{name}{_NONE}{text}"].add(n)
                else:
                    for h in homes:
                        texts[kind, name][self._home(h)].append({"n": n, "t": text})
        parts: list[Column] = []
        if equal:
            table = _Table({k: sorted(v) for k, v in equal.items()}, "int")
            for name in sorted({k.split(_NONE)[0] for k in equal}):
                parts.append(table.get(F.concat(F.lit(name + _NONE), self._lower(name))))
        at = self._homes()
        for (kind, name), by_home in sorted(texts.items()):
            whole, c = by_home.pop("", []), self.resolve(name)
            asked = [_literal(whole, "array<struct<n: int, t: string>>")] if whole else []
            if by_home:
                table = _Table(by_home, "struct<n: int, t: string>")
                asked += [table.get(at[k]) for k in sorted({h[0] for h in by_home})]
            folded = c if kind.endswith("_cased") else self._lower(name, F.lower if kind == "contains" else ascii_lower)
            how = {"contains": "contains", "prefix": "startswith", "suffix": "endswith"}[kind.removesuffix("_cased")]
            parts.append(F.when(c.isNotNull(), _found(folded, F.concat(*asked), how)).otherwise(F.array().cast("array<int>")))
        if others:
            parts.append(F.array_compact(F.array(*[F.when(self._near(self.leaves[n].homes) & self.leaves[n].column(self.columns), F.lit(n)) for n in others])))
        return F.concat(*parts) if parts else F.array().cast("array<int>")

    def _near(self, homes: set) -> Column:
        """Whether a record lies where an expression is asked for."""
        if (None, None) in homes:
            return F.lit(True)
        at, out = self._homes(), F.lit(False)
        for k in ("c", "e", "b"):
            named = sorted(h for h in map(self._home, homes) if h[0] == k)
            if named:
                out = out | F.coalesce(at[k].isin(named), F.lit(False))
        return out

    def matching(self, leaves: Column) -> Column:
        """Numbers of the rules that match, from the record's true leaves."""
        kind = "struct<r: int, y: array<int>, n: array<int>>"
        filed = _literal(self.filed, f"array<array<{kind}>>")
        asked = F.flatten(F.transform(F.array_distinct(leaves), lambda n: F.element_at(filed, n + 1)))
        if self.always:
            asked = F.concat(asked, _literal(self.always, f"array<{kind}>"))
        holds = lambda a: F.forall(a["y"], lambda n: F.array_contains(leaves, n)) & ~F.exists(a["n"], lambda n: F.array_contains(leaves, n))
        return F.array_distinct(F.transform(F.filter(asked, holds), lambda a: a["r"]))
