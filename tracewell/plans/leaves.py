"""Leaf predicates: a field, its modifiers and a value become one two-valued Column.

An absent field makes a leaf false before any negation, so every leaf ends in coalesce(..., false).
"""

from __future__ import annotations

import base64
import ipaddress
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import ascii_lower
from tracewell.plans.errors import RuleError

Resolve = Callable[[str], Column]
DASHES = "-–—―"
MODIFIERS = {"contains", "startswith", "endswith", "all", "windash", "cased", "re", "i", "m", "s", "base64", "base64offset", "utf16", "utf16le", "utf16be", "wide", "cidr", "gt", "gte", "lt", "lte", "exists", "fieldref", "equalsfield", "endswithfield", "neq", "expand"}
_FIRST_ONLY = {"cidr", "gt", "gte", "lt", "lte", "exists", "fieldref", "equalsfield", "endswithfield"}
_NUMBERS = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


@dataclass
class Lists:
    """Files of regular expressions by name, for `regexes` and `allowlist`."""

    files: dict[str, list[str]] = field(default_factory=dict)


def sure(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def text_of(value) -> str:
    return "true" if value is True else "false" if value is False else str(value)


def _pieces(pattern: str) -> list[str]:
    """Literals and the wildcards * and ?; a backslash before a wildcard makes it a literal, two of them make one
    backslash and leave the wildcard."""
    out, literal, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and pattern[i : i + 3] in ("\\\\*", "\\\\?"):
            literal, i = literal + "\\", i + 2
        elif c == "\\" and pattern[i + 1 : i + 2] in ("*", "?"):
            literal, i = literal + pattern[i + 1], i + 2
        elif c in "*?":
            out += [("lit", literal)] * bool(literal) + [(c, "")]
            literal, i = "", i + 1
        else:
            literal, i = literal + c, i + 1
    return out + [("lit", literal)] * bool(literal)


def wildcard_regex(pattern: str) -> str:
    """Java expression of a wildcard pattern, without anchors: * spans lines, ? doesn't."""
    return "".join(java_quote(v) if k == "lit" else r"[\s\S]*" if k == "*" else r"[^\n]" for k, v in _pieces(pattern))


def java_quote(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|/\-&#~@<>=!:,])", r"\\\1", text)


def _plain(pattern: str) -> str:
    return pattern.replace("\\\\", "\\")


def _literal(pieces) -> str | None:
    return _plain("".join(v for _, v in pieces)) if all(k == "lit" for k, _ in pieces) else None


def wildcard_shape(pattern: str) -> tuple[str, str] | None:
    """(kind, text) of a pattern that needs no regular expression; the whole value is compared, case ignored."""
    pieces = _pieces(pattern)
    lead, tail = pieces[:1] == [("*", "")], len(pieces) > 1 and pieces[-1] == ("*", "")
    literal = _literal(pieces[1 if lead else 0 : -1 if tail else None])
    if literal is None or ((lead or tail) and not (literal and pattern.isascii())):
        return None
    if not lead and not tail:
        return "equals", ascii_fold(literal)
    return ("contains", literal.lower()) if lead and tail else ("prefix" if tail else "suffix", ascii_fold(literal))


#: How each kind of shape tests a column against its text.
SHAPES: dict[str, Callable[[Column, Column], Column]] = {
    "equals": lambda c, x: ascii_lower(c) == x,
    "contains": lambda c, x: F.lower(c).contains(x),
    "prefix": lambda c, x: ascii_lower(c).startswith(x),
    "suffix": lambda c, x: ascii_lower(c).endswith(x),
    "contains_cased": lambda c, x: c.contains(x),
    "prefix_cased": lambda c, x: c.startswith(x),
    "suffix_cased": lambda c, x: c.endswith(x),
}


def wildcard(c: Column, pattern: str) -> Column:
    """Whole-value match, case ignored; simple shapes avoid the regular expression."""
    shape = wildcard_shape(pattern)
    return SHAPES[shape[0]](c, F.lit(shape[1])) if shape else c.rlike(rf"(?iu)\A(?:{wildcard_regex(pattern)})\z")


def ascii_fold(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def java_regex(pattern: str, flags: str = "") -> str:
    """A linear-time dialect's pattern for Java: Unicode classes, only \\n ends a line; look-around and back
    references don't exist there, so a rule that has them doesn't load."""
    bare = re.sub(r"(?s)\\\\", "", pattern)  # an escaped backslash escapes nothing
    if re.search(r"\\[1-9]", bare) or re.search(r"\(\?(?:[=!]|<[=!])", re.sub(r"(?s)\\.", "", bare)):
        raise RuleError(f"unsupported expression: {pattern}")
    return f"(?{flags}uUd){pattern}"


def _needles(value: str, mods: list[str]) -> list[str]:
    raws = [value.encode()]
    wide = next((m for m in mods if m in ("utf16", "utf16le", "utf16be", "wide")), None)
    if wide in ("utf16le", "wide"):
        raws = [value.encode("utf-16-le")]
    elif wide == "utf16be":
        raws = [value.encode("utf-16-be")]
    elif wide == "utf16":
        raws = [b"\xff\xfe" + value.encode("utf-16-le")] if "base64" in mods else [value.encode("utf-16-le"), value.encode("utf-16-be")]
    if "base64" in mods:
        return [base64.b64encode(r).decode().rstrip("=") for r in raws]
    # three alignments; characters that neighbours influence are cut: 2 or 3 in front, and the last of a broken group
    out = []
    for raw in raws:
        for offset, head in ((0, 0), (1, 2), (2, 3)):
            coded = base64.b64encode(b"\0" * offset + raw).decode()
            tail = {0: 0, 1: 3, 2: 2}[(len(raw) + offset) % 3]
            out.append(coded[head : len(coded) - tail])
    return out


def cidr(c: Column, block: str) -> Column:
    """Containment of an address; IPv4 by integer arithmetic, IPv6 by its expanded groups."""
    try:
        net = ipaddress.ip_network(block, strict=False)
    except ValueError:
        return F.lit(False)
    if net.version == 4:
        octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        parts = [F.regexp_extract(c, rf"\A{octet}\.{octet}\.{octet}\.{octet}\z", i).try_cast("long") for i in (1, 2, 3, 4)]
        value = parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]
        return value.between(int(net.network_address), int(net.broadcast_address))
    v6 = F.when(c.rlike(r"(?i)\A[0-9a-f:]+\z") & c.contains(":"), F.lower(c))
    head, tail = F.substring_index(v6, "::", 1), F.when(v6.contains("::"), F.substring_index(v6, "::", -1))
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    left, right = groups(head), F.coalesce(groups(tail), F.array().cast("array<string>"))
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)
    bits = F.array_join(F.transform(filled, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    want = format(int(net.network_address), "0128b")[: net.prefixlen]
    return (F.length(bits) == 128) & bits.startswith(want)


def _modifiers(key: str) -> tuple[str, list[str], bool]:
    """Field, modifiers and whether the leaf is negated."""
    name, *mods = key.split("|")
    for m in mods:
        if m not in MODIFIERS:
            raise RuleError(f"unknown modifier {m} in {key}")
    if "neq" in mods and not name:
        raise RuleError(f"neq needs a field: {key}")
    return name, [m for m in mods if m not in ("neq", "expand")], "neq" in mods


def shape_of(key: str, value) -> tuple[str, str, str] | None:
    """(kind, field, text) of a leaf (its negation left aside) that compares one field with one text natively."""
    name, mods, _ = _modifiers(key)
    text = text_of(value)
    if not name or value is None or isinstance(value, dict | list) or "re" in mods or (mods and mods[0] in _FIRST_ONLY):
        return None
    if name == "EventID" and not mods and isinstance(value, int) and not isinstance(value, bool):
        return "equals", name, text
    cased = "_cased" if "cased" in mods else ""
    literal = _literal(_pieces(text))
    if "contains" in mods:
        if literal is None or {"base64", "base64offset", "windash"} & set(mods):
            return None
        return f"contains{cased}", name, literal if cased else literal.lower()
    for how, kind in (("startswith", "prefix"), ("endswith", "suffix")):
        if how in mods:
            if literal is not None and cased:
                return f"{kind}_cased", name, literal
            if literal is not None and text.isascii():
                return kind, name, ascii_fold(literal)
            text = text + "*" if how == "startswith" else "*" + text
            break
    shape = wildcard_shape(text)  # cased alone, and encodings without contains, change nothing
    return (shape[0], name, shape[1]) if shape else None


def value_leaf(key: str, value, resolve: Resolve) -> Column:
    """One field and one scalar value."""
    name, mods, negate = _modifiers(key)
    if value is None:
        absent = resolve(key).isNull() if name else F.lit(False)
        return ~sure(absent) if negate else sure(absent)
    shape = shape_of(key, value)
    p = sure(SHAPES[shape[0]](resolve(name), F.lit(shape[2])) if shape else _positive(name, mods, value, resolve))
    return ~p if negate else p


def _positive(name: str, mods: list[str], value, resolve: Resolve) -> Column:
    text = text_of(value)
    if not name:
        body = F.col("data_string")
        if "re" in mods:
            return body.rlike(java_regex(text, "".join(f for f in "ims" if f in mods)))
        if "all" in mods:
            return F.lower(body).contains(_plain(text).lower())
        return body.rlike(f"(?iu){wildcard_regex(text)}")
    c = resolve(name)
    first = mods[0] if mods else ""
    if first in ("fieldref", "equalsfield", "endswithfield"):
        other = resolve(text)
        how = "endswith" if first == "endswithfield" else next((m for m in mods if m in ("startswith", "endswith", "contains")), None)
        return (c == other) if how is None else getattr(F.lower(c), how)(F.lower(other))
    if first == "exists":
        return c.isNotNull() == (text.lower() == "true")
    if first == "cidr":
        return cidr(c, text)
    if first in _NUMBERS:
        if not re.fullmatch(r"\+?[0-9]+", text):
            raise RuleError(f"{first} needs an unsigned integer, not {text}")
        number = F.when(c.rlike(r"\A\+?[0-9]{1,20}\z"), c.try_cast("decimal(20,0)"))
        return getattr(number, _NUMBERS[first])(F.lit(int(text)).cast("decimal(20,0)"))
    if "re" in mods:
        return c.rlike(java_regex(text, "".join(f for f in "ims" if f in mods)))
    if "contains" in mods:
        if "base64offset" in mods:
            return _any([c.contains(n) for n in _needles(text, mods)])
        if "base64" in mods:
            return _any([F.lower(c).contains(n.lower()) for n in _needles(text, mods)])
        if "windash" in mods:
            seen = F.lower(F.regexp_replace(c, rf"(?s)\A([^{DASHES}]*)[{DASHES}]", "$1/"))
            slashed = re.sub(f"[{DASHES}]", "/", text, count=1)
            return F.lower(c).contains(text.lower()) | seen.contains(text.lower()) | seen.contains(slashed.lower())
        return c.rlike(rf"{'' if 'cased' in mods else '(?iu)'}{wildcard_regex(text)}")
    ends = next((m for m in mods if m in ("startswith", "endswith")), None)
    return wildcard(c, text + "*" if ends == "startswith" else "*" + text if ends else text)


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def nested_leaf(key: str, spec: dict, resolve: Resolve, lists: Lists) -> Column:
    """{min_length | regexes | allowlist | value: ...} under a field."""
    c = resolve(key.split("|")[0])
    parts = []
    for kind, arg in spec.items():
        if kind == "min_length":
            parts.append(sure(F.octet_length(c) >= int(arg)))
        elif kind in ("regexes", "allowlist"):
            found = [c.rlike(java_regex(p)) for p in lists.files.get(str(arg), [])]
            hit = sure(_any(found)) if found else F.lit(False)
            parts.append(~hit if kind == "allowlist" else hit)
        elif kind == "value":
            parts.append(value_leaf(key, arg, resolve))
        else:
            raise RuleError(f"unknown key {kind} under {key}")
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


class Columns:
    """Leaves as Columns."""

    def __init__(self, resolve: Resolve, lists: Lists):
        self.resolve, self.lists = resolve, lists

    def nested(self, key: str, spec: dict) -> Column:
        return nested_leaf(key, spec, self.resolve, self.lists)

    def value(self, key: str, value) -> Column:
        name, *mods = key.split("|")
        if name in ("Data", "EventData") and value is not None:
            plain = "|".join([m for m in mods if m != "neq"])
            of = lambda n: f"{n}|{plain}" if plain else n
            hit = sure(F.exists(F.col("data_array"), lambda x: value_leaf(of("Data"), value, lambda _: x))) | value_leaf(of(name), value, self.resolve)
            return ~hit if "neq" in mods else hit
        return value_leaf(key, value, self.resolve)

    def values(self, key: str, values: list) -> Column | None:
        """All values of a list at once, if that differs from one by one."""
        return None


def selection(node, resolve: Resolve, lists: Lists, key: str = "") -> Column:
    return combine(node, Columns(resolve, lists), key)


def combine(node, leaves, key: str = ""):
    """A selection from its leaves: maps are AND, lists OR; `|all` makes a list AND, and neq turns both around."""
    if isinstance(node, dict):
        if key:
            return leaves.nested(key, node)
        parts = [combine(v, leaves, str(k)) for k, v in node.items()]
        if not parts:
            raise RuleError("empty selection")
        both = True
    elif isinstance(node, list):
        if not node:
            raise RuleError(f"empty list {key}")
        negated = "neq" in key.split("|")
        both = ("|all" in key) != negated
        if both == negated:  # any of them, or none of them
            whole = leaves.values(key, node)
            if whole is not None:
                return whole
        parts = [combine(v, leaves, key) for v in node]
    else:
        return leaves.value(key, node)
    out = parts[0]
    for p in parts[1:]:
        out = out & p if both else out | p
    return out
