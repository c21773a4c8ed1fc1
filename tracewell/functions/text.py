"""Scalar functions over columns: case folding, cleaning, formatting, lookups."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Time formats, by name (fixed values).
TIME_FORMATS = {
    "default": "yyyy-MM-dd HH:mm:ss.SSS xxx",
    "iso-8601": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    "rfc-2822": "EEE, d MMM yyyy HH:mm:ss xx",
    "rfc-3339": "yyyy-MM-dd HH:mm:ss.SSSSSSxxx",
    "us-time": "MM-dd-yyyy hh:mm:ss.SSS a xxx",
    "us-military-time": "MM-dd-yyyy HH:mm:ss.SSS xxx",
    "european-time": "dd-MM-yyyy HH:mm:ss.SSS xxx",
}


def micros(ts: Column) -> Column:
    """Microseconds since 1970; times without a zone are read in the session's."""
    return F.unix_micros(ts.cast("timestamp"))


def ascii_lower(c: Column) -> Column:
    """A-Z folded; of ASCII texts by lower(), which is many times faster."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def strip(c: Column) -> Column:
    """Trim all Unicode white space. Values that begin and end with a visible ASCII character are left as they are."""
    seen = lambda x: F.ascii(x).between(33, 126)
    return F.when(seen(c) & seen(F.substring(c, -1, 1)), c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def clean(c: Column) -> Column:
    """Drop control characters but line ends and tabs, make double spaces single, trim spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""), " {2,}", " "))


def one_line(c: Column) -> Column:
    """Runs of white space become one space."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def format_time(ts: Column, kind: str = "default") -> Column:
    return F.date_format(ts, TIME_FORMATS[kind])


def titlecase(c: Column) -> Column:
    """Upper-case the first character if it is ASCII."""
    head = F.substring(c, 1, 1)
    return F.concat(F.when(head.rlike("[a-z]"), F.upper(head)).otherwise(head), F.substring(c, F.lit(2), F.length(c)))


def hex_to_decimal(c: Column) -> Column:
    """0x.. of 64 bits at most becomes decimal; anything else passes."""
    digits = F.substring(c, F.lit(3), F.length(c))
    return F.when(c.rlike(r"\A0[xX]0*[0-9a-fA-F]{1,16}\z"), F.conv(digits, 16, 10)).otherwise(c)


def uptime(seconds: Column, *, years: bool = True) -> Column:
    """Years of 365 days, months of 30 days, days, hours, minutes, seconds; without years the months go on."""
    parts, left = [] if years else [F.when(seconds.isNotNull(), "0Y")], seconds.cast("long")
    for size, unit in ((31536000, "Y"), (2592000, "M"), (86400, "d"), (3600, "h"), (60, "m"), (1, "s"))[0 if years else 1 :]:
        parts.append(F.concat(F.floor(left / size).cast("long").cast("string"), F.lit(unit)))
        left = left % size
    return F.concat_ws(" ", *parts)


def lookup(c: Column, table: dict[str, str], *, lower: bool = False, default: Column | None = None) -> Column:
    """Literal map lookup of a bounded table; misses give the default, or the value itself."""
    if not table:
        return c if default is None else default
    pairs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k.lower() if lower else k, v)])
    return F.coalesce(F.try_element_at(pairs, F.lower(c) if lower else c), c if default is None else default)


def authors(c: Column) -> Column:
    """Array of authors: split at , / ; without remarks in brackets."""
    parts = F.transform(F.split(F.regexp_replace(c, r"\([^)]*\)", ""), "[,/;]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def rendered(c: Column) -> Column:
    """A rendered message on one line: lines trimmed, tabs and line ends written out; n/a if absent."""
    lines = F.transform(F.split(c, r"\r?\n"), lambda x: F.replace(F.trim(x), F.lit("\t"), F.lit("\\t")))
    return F.coalesce(F.array_join(lines, "\\r\\n"), F.lit("n/a"))


def json_scalar(c: Column) -> Column:
    """JSON text of a scalar: 64-bit integers and booleans stay bare, all else is quoted."""
    number = c.rlike(r"\A[+-]?[0-9]{1,19}\z") & c.try_cast("long").isNotNull()
    quoted = F.to_json(F.struct(c.alias("x")))
    return F.when(number, c.try_cast("long").cast("string")).when(c.isin("true", "false"), c).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))


def json_bare(c: Column) -> Column:
    """A text as JSON spells it, without its double quotes."""
    spelled = F.to_json(F.struct(c.alias("x")))  # {"x":"..."}
    return F.when(c.rlike(r'[\\"\x00-\x1F]'), F.replace(F.substring(spelled, F.lit(6), F.length(spelled) - 6), F.lit('"'), F.lit(""))).otherwise(c)


def template(text: str, resolve) -> Column:
    """A details template: %Field% by its value on one line (n/a if absent), %Data[n]% by the n-th data value."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"%([a-zA-Z0-9_\-\[\]]+)%", text):
        parts.append(F.lit(text[at : m.start()]))
        nth = re.fullmatch(r"Data\[(\d+)\]", m[1])
        value = F.get(F.col("data_array"), F.lit(int(nth[1]) - 1)) if nth and int(nth[1]) > 0 else resolve(m[1])
        parts.append(F.coalesce(one_line(value), F.lit("n/a")))
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def template_of(text: Column, fields: Column, data: Column) -> Column:
    """A template that is data itself, filled as `template` fills it: names are keys of `fields`; null stays null."""
    field = r"%([a-zA-Z0-9_\-\[\]]+)%"

    def value(name: Column) -> Column:
        nth = F.regexp_extract(name, r"\AData\[(\d+)\]\z", 1).try_cast("int")
        return F.coalesce(one_line(F.coalesce(F.get(data, nth - 1), F.try_element_at(fields, name))), F.lit("n/a"))

    rest, names = F.split(text, field, -1), F.regexp_extract_all(text, F.lit(field), F.lit(1))
    return F.array_join(F.zip_with(rest, names, lambda r, n: F.concat(r, F.when(n.isNull(), "").otherwise(value(n)))), "")


#: Levels of nested values that become fields of their own; what lies deeper stays JSON text in one.
DEPTH = 8


def leaves(v: Column, depth: int = DEPTH) -> Column:
    """Array of (name, value) of a variant's scalars, at any level: a scalar has its own key's name, one of an array
    also its place from 1 (`Name[2]`); nulls, `xmlns` and the system part of an event are left out."""
    kind = lambda x: F.substring(F.schema_of_variant(x), 1, 1)  # noqa: E731 - of an object O, an array A, null V
    one = lambda n, x: F.struct(n.alias("name"), x.alias("value"), kind(x).alias("kind"))  # noqa: E731 - found once a value

    def members(m: Column) -> Column:
        name, x = m["name"], m["value"]
        fields = F.filter(F.map_entries(F.try_variant_get(x, "$", "map<string,variant>")), lambda e: (e["key"] != "xmlns") & ~((e["key"] == "System") & (name == "Event")))
        place = lambda y, i: F.when(kind(y).isin("O", "A"), name).otherwise(F.concat(name, F.lit("["), (i + 1).cast("string"), F.lit("]")))
        return (
            F.when(m["kind"] == "O", F.transform(fields, lambda e: one(e["key"], e["value"])))
            .when(m["kind"] == "A", F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda y, i: one(place(y, i), y)))
            .otherwise(F.array(m))
        )

    found = F.filter(F.array(one(F.lit(""), v)), lambda m: m["kind"] == "O")
    for _ in range(depth):
        found = F.flatten(F.transform(found, members))
    found = F.filter(found, lambda m: m["value"].isNotNull() & (m["kind"] != "V"))
    return F.array_distinct(F.transform(found, lambda m: F.struct(m["name"].alias("name"), F.coalesce(F.try_variant_get(m["value"], "$", "string"), F.to_json(m["value"])).alias("value"))))


def split_details(c: Column) -> Column:
    """Map of a rendered details text: pairs at " ¦ ", names at the first ": "."""
    pairs = F.filter(F.split(c, " ¦ "), lambda x: F.locate(": ", x) > 0)
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.substring(x, F.locate(": ", x) + 2, F.length(x)).alias("v"))))


def all_fields(fields: Column) -> Column:
    """Sorted "name: value" pairs of a map of fields, without repeats."""
    pairs = F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), clean(e["value"])))
    return F.array_join(F.array_sort(F.array_distinct(pairs)), " ¦ ")


def extra_fields(fields: Column, details: Column) -> Column:
    """all_fields less the values that the details show already."""
    shown = F.transform(F.split(details, " ¦ "), lambda x: F.regexp_replace(F.substring(x, F.locate(": ", x) + 2, F.length(x)), ",$", ""))
    return all_fields(F.map_filter(fields, lambda k, v: ~F.array_contains(shown, F.regexp_replace(clean(v), ",$", ""))))


def powershell_fields(channel: Column, event_id: Column, data: Column) -> Column:
    """Map of the k=v lines of classic shell events; null for all others."""
    nth = F.when(event_id == "800", 1).when(event_id.isin("400", "403", "600"), 2)
    text = F.when(channel == "Windows PowerShell", F.try_element_at(data, nth))
    return F.str_to_map(F.regexp_replace(text, r"\r?\n\t", "\n"), F.lit("\n"), F.lit("="))
