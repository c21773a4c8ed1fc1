"""Rule files: loading, validation, filters and compilation to Columns."""

from __future__ import annotations

import copy
import itertools
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import Column

from tracewell.plans.aggregation import AggSpec, parse_count
from tracewell.plans.condition import compile_condition
from tracewell.plans.errors import RuleError
from tracewell.plans.leaves import Columns, Lists, Resolve, combine

#: The rule language's levels, statuses, required and reserved keys (fixed values).
LEVELS = ("undefined", "informational", "low", "medium", "high", "critical", "emergency")
STATUSES = ("stable", "test", "experimental", "deprecated", "unsupported")
REQUIRED = ("author", "title", "level", "status", "date", "id")
RESERVED = ("condition", "timeframe")


class _Loader(yaml.SafeLoader):
    """Only null, true/false, decimal integers and decimal fractions are resolved; dates and yes/no stay text."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (("null", r"~|null|Null|NULL|", "~nN\0"), ("bool", "true|True|TRUE|false|False|FALSE", "tTfF"), ("int", "[-+]?[0-9]+", "-+0123456789"), ("float", r"[-+]?[0-9]+\.[0-9]+(?:[eE][-+]?[0-9]+)?", "-+0123456789")):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(rf"^(?:{_pattern})$"), [*_first.replace("\0", ""), *([""] if _tag == "null" else [])])


@dataclass
class Rule:
    path: str
    raw: dict
    rule_id: str
    title: str
    level: str = "undefined"
    status: str = ""
    name: str = ""
    tags: tuple[str, ...] = ()
    author: str = ""
    details: str | None = None
    category: str = ""
    #: Set for correlation rules; see tracewell.plans.correlation.
    correlation: dict | None = None
    generate: bool = True
    agg: AggSpec | None = None
    refs: list[Rule] = field(default_factory=list)

    @property
    def rank(self) -> int:
        return LEVELS.index(self.level) if self.level in LEVELS else 0

    def predicate(self, resolve: Resolve, lists: Lists | None = None) -> Column:
        """Whether a record matches; of a merged rule, whether it matches one of those it refers to."""
        return self.build(Columns(resolve, lists or Lists()))

    def build(self, leaves):
        """The rule's condition over its selections, made of whatever `leaves` makes of theirs."""
        if self.refs:
            out = self.refs[0].build(leaves)
            for r in self.refs[1:]:
                out = out | r.build(leaves)
            return out
        detection = self.raw["detection"]
        named = {k: combine(v, leaves) for k, v in detection.items() if k not in RESERVED}
        condition = detection.get("condition")
        if condition is None:
            if len(named) != 1:
                raise RuleError(f"{self.title}: several selections and no condition")
            return next(iter(named.values()))
        return compile_condition(str(condition).split("|")[0], named)

    def channels(self) -> set[str]:
        """Literal values of Channel that its selections name."""
        found: set[str] = set()

        def walk(node, key: str = "") -> None:
            if isinstance(node, dict):
                for k, v in node.items():
                    walk(v, str(k))
            elif isinstance(node, list):
                for v in node:
                    walk(v, key)
            elif key.split("|")[0] == "Channel":
                found.add(str(node))

        walk(self.raw.get("detection", {}))
        for r in self.refs:
            found |= r.channels()
        return found


def rule_of(path: str, raw: dict) -> Rule:
    problems = validate(raw)
    if problems:
        raise RuleError(f"{path}: {'; '.join(problems)}")
    correlation = raw.get("correlation")
    detection = raw.get("detection") or {}
    condition = str(detection.get("condition") or "")
    agg = parse_count(condition.split("|", 1)[1], detection.get("timeframe")) if "|" in condition else None
    return Rule(path, raw, str(raw["id"]), str(raw["title"]), str(raw["level"]).lower(), str(raw["status"]), str(raw.get("name", "")), tuple(raw.get("tags") or ()), str(raw["author"]), raw.get("details"), str((raw.get("logsource") or {}).get("category", "")), correlation, bool((correlation or {}).get("generate", True)), agg)


def validate(raw: dict) -> list[str]:
    """What is wrong with a rule's form."""
    need = REQUIRED if "correlation" in raw else (*REQUIRED, "logsource", "detection")
    out = [f"{k} is missing" for k in need if k not in raw]
    if "level" in raw and str(raw["level"]).lower() not in LEVELS:
        out.append(f"level {raw['level']} is unknown")
    if "status" in raw and raw["status"] not in STATUSES:
        out.append(f"status {raw['status']} is unknown")
    if "date" in raw and not re.fullmatch(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", str(raw["date"])):
        out.append(f"date {raw['date']} is no date")
    return out


def parse_rules(text: str, path: str = "", expand: dict[str, list[str]] | None = None) -> list[Rule]:
    """All documents of a text, in order. A document whose placeholders have no values is left out."""
    docs = [d for d in yaml.load_all(text, _Loader) if isinstance(d, dict)]
    out = []
    for d in docs:
        made = expanded(d, expand or {})
        if made is not None:
            out.append(rule_of(path, made))
    return out


def load_rules(folder: str, expand: dict[str, list[str]] | None = None) -> tuple[list[Rule], list[str]]:
    """Rules of all .yml files below a folder (but .git), and what could not be loaded."""
    rules, errors = [], []
    for p in sorted(Path(folder).rglob("*.yml")):
        if ".git" in p.parts:
            continue
        try:
            rules += parse_rules(p.read_text(encoding="utf-8"), str(p), expand)
        except (RuleError, yaml.YAMLError, UnicodeDecodeError) as e:
            errors.append(f"{p}: {e}")
    return rules, errors


def expanded(raw: dict, values: dict[str, list[str]]) -> dict | None:
    """A rule with %placeholders% of `|expand` fields replaced; None if one has no values."""
    missing = False

    def fill(v):
        nonlocal missing
        if not isinstance(v, str):
            return [v]
        names = list(dict.fromkeys(re.findall(r"%(\w+)%", v)))
        if not names:
            return [v]
        if any(not values.get(n) for n in names):
            missing = True
            return []
        out = []
        for chosen in itertools.product(*(values[n] for n in names)):
            text = v
            for n, x in zip(names, chosen, strict=True):
                text = text.replace(f"%{n}%", x)
            out.append(text)
        return out

    def walk(node):
        if isinstance(node, dict):
            done = {}
            for k, v in node.items():
                if "expand" in str(k).split("|")[1:]:
                    made = [x for item in (v if isinstance(v, list) else [v]) for x in fill(item)]
                    done["|".join(p for p in str(k).split("|") if p != "expand")] = made if len(made) != 1 else made[0]
                else:
                    done[k] = walk(v)
            return done
        return [walk(x) for x in node] if isinstance(node, list) else node

    if "detection" not in raw:
        return raw
    out = copy.copy(raw)
    out["detection"] = walk(raw["detection"])
    return None if missing else out


def placeholders(rules: Iterable[dict]) -> list[str]:
    """Placeholders that `|expand` fields refer to."""
    found: set[str] = set()

    def walk(node, on: bool) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, on or "expand" in str(k).split("|")[1:])
        elif isinstance(node, list):
            for v in node:
                walk(v, on)
        elif on and isinstance(node, str):
            found.update(re.findall(r"%(\w+)%", node))

    for r in rules:
        walk(r.get("detection", {}), False)
    return sorted(found)


def filter_rules(rules: list[Rule], *, min_level: str = "informational", exact_level: str | None = None, include_status: set[str] | None = None, exclude_status: set[str] | None = None, deprecated: bool = False, unsupported: bool = False, include_category: set[str] | None = None, exclude_category: set[str] | None = None, include_tag: set[str] | None = None, exclude_tag: set[str] | None = None, exclude_ids: set[str] | None = None, only_ids: set[str] | None = None) -> list[Rule]:
    """Rules that a run uses: by level, status, category, tag and lists of ids."""
    def wanted(r: Rule) -> bool:
        if r.rank < LEVELS.index(min_level) or (exact_level and r.level != exact_level):
            return False
        if (r.status == "deprecated" and not deprecated) or (r.status == "unsupported" and not unsupported):
            return False
        if (include_status and r.status not in include_status) or (exclude_status and r.status in exclude_status):
            return False
        if (include_category and r.category not in include_category) or (exclude_category and r.category in exclude_category):
            return False
        tags = set(r.tags)
        if (include_tag and not tags & include_tag) or (exclude_tag and tags & exclude_tag):
            return False
        return not (exclude_ids and r.rule_id in exclude_ids) and not (only_ids and r.rule_id not in only_ids)

    return [r for r in rules if wanted(r)]


#: A rule's id in list files (fixed form).
_ID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")


def read_ids(*paths: str) -> set[str]:
    """Rule ids of list files, one a line: what follows # is a remark, lines that hold no id are skipped, files that don't
    exist have none."""
    found = set()
    for path in paths:
        if Path(path).is_file():
            lines = Path(path).read_text(encoding="utf-8", errors="replace").splitlines()
            found |= {x for x in (line.split("#")[0].strip() for line in lines) if _ID.fullmatch(x)}
    return found


def listed_rules(rules: list[Rule], config: str, *, noisy: bool = False, proven: bool = False) -> list[Rule]:
    """Rules less those that the lists exclude_rules.txt and (unless noisy) noisy_rules.txt of a folder name; with proven
    only those that proven_rules.txt names, if it names any."""
    at = lambda name: f"{config.rstrip('/')}/{name}_rules.txt"
    out = read_ids(at("exclude"), *([] if noisy else [at("noisy")]))
    return filter_rules(rules, exclude_ids=out, only_ids=read_ids(at("proven")) if proven else None)


def for_channels(rules: list[Rule], channels: set[str]) -> list[Rule]:
    """Rules that may match one of the channels: those that name it (with * as part of it), and correlation rules."""
    low = {c.lower() for c in channels}

    def fits(r: Rule) -> bool:
        named = r.channels()
        return r.correlation is not None or not named or any((n.strip("*").lower() in c) if "*" in n else n.lower() == c for n in named for c in low)

    return [r for r in rules if fits(r)]


def tuned(rules: list[Rule], levels: dict[str, str]) -> list[Rule]:
    """Levels overridden by id; rule files stay as they are."""
    for r in rules:
        if r.rule_id in levels:
            if levels[r.rule_id] not in LEVELS:
                raise RuleError(f"level {levels[r.rule_id]} is unknown")
            r.level = levels[r.rule_id]
    return rules


def load_counts(rules: list[Rule]) -> dict[str, Counter]:
    return {"status": Counter(r.status for r in rules), "level": Counter(r.level for r in rules), "tag": Counter(t for r in rules for t in r.tags)}
