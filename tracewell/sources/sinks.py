"""Sinks: CSV, JSON and JSON lines, per-category text files, an HTML summary."""

from __future__ import annotations

import html
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import json_scalar, one_line
from tracewell.operators.reports import logon_outputs


#: What the quoting takes for numbers: decimal texts, and names of values that aren't finite.
_NUMBER = r"\A(?:[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan)))\z"


def csv_text(found: DataFrame, *, multiline: bool = False) -> DataFrame:
    """One CSV line per row: values that aren't numbers are quoted, null and empty ones too, quotes are doubled; white space
    inside values collapses unless multiline."""
    text = {c for c, t in found.dtypes if t == "string"}

    def field(c: str) -> Column:
        value = F.coalesce(F.col(c).cast("string"), F.lit(""))
        value = one_line(value) if c in text and not multiline else value
        return F.when(value.rlike(_NUMBER), value).otherwise(F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"')))

    return found.select(F.concat_ws(",", *[field(c) for c in found.columns]).alias("value"))


def write_csv(found: DataFrame, path: str, *, clobber: bool = False, multiline: bool = False) -> None:
    """A folder of CSV files, each with a header, quoted as csv_text says. Existing output is only replaced with clobber."""
    header = ",".join('"' + c.replace('"', '""') + '"' for c in found.columns)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([header])], schema=batch.schema)
                first = False
            yield batch

    csv_text(found, multiline=multiline).mapInArrow(headed, "value string").write.mode("overwrite" if clobber else "error").text(path)


def write_logons(found: DataFrame, path: str, *, clobber: bool = False) -> None:
    """The outputs of reports.logons: folders `<path>-successful` and `<path>-failed` of CSV files."""
    for name, rows in logon_outputs(found).items():
        write_csv(rows, f"{path}-{name}", clobber=clobber)


def pairs_of(c: Column) -> Column:
    """Ordered (k, v) of a rendered details text: parts at ` ¦ `, names before the first colon; both trimmed. A part
    without a colon has two empty texts."""
    at = lambda x: F.locate(":", x)
    cut_ = lambda x: F.struct(F.when(at(x) > 0, F.trim(F.substring(x, F.lit(1), at(x) - 1))).otherwise("").alias("k"), F.when(at(x) > 0, F.trim(F.substring(x, at(x) + 1, F.length(x)))).otherwise("").alias("v"))
    return F.transform(F.split(c, " ¦ "), cut_)


def _closed(c: Column) -> Column:
    """A text that begins with a quote and doesn't end with one gets one."""
    return F.when(c.startswith('"') & ~c.endswith('"'), F.concat(c, F.lit('"'))).otherwise(c)


def _quoted(c: Column) -> Column:
    whole = F.to_json(F.array(c))  # ["..."]
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def object_text(pairs: Column, *, indent: str | None = None) -> Column:
    """JSON text of ordered pairs: keys in the order of their first places; a repeated key has an array of texts."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    line = lambda n: F.lit("" if indent is None else "\n" + indent * n)

    def member(k: Column) -> Column:
        values = F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: _closed(p["v"]))
        many = F.concat(F.lit("["), line(3), F.array_join(F.transform(values, _quoted), "," + ("" if indent is None else "\n" + indent * 3)), line(2), F.lit("]"))
        return F.concat(line(2), _quoted(k), F.lit(":" if indent is None else ": "), F.when(F.size(values) == 1, json_scalar(F.element_at(values, 1))).otherwise(many))

    text = F.concat(F.lit("{"), F.array_join(F.transform(keys, member), ","), line(1), F.lit("}"))
    return F.when(F.size(keys) == 0, F.lit("{}")).otherwise(text)


#: Columns that hold details, and those that hold tags.
DETAILS, TAGS = ("Details", "AllFieldInfo", "ExtraFieldInfo"), ("MitreTactics", "MitreTags", "OtherTags")


def json_timeline(found: DataFrame, *, lines: bool = True) -> DataFrame:
    """One JSON object per row of a projected timeline, keys in column order. Columns of DETAILS become objects in the order
    of their fields, repeated ones arrays; those of TAGS become arrays; other values are scalars by their looks. Null and
    empty values are left out, but for extra and all fields, which are empty objects; details of `-` are one too, and
    details without a colon a text. With lines=False objects are spread over lines and indented."""
    indent = None if lines else "    "
    parts = []
    for c in found.columns:
        v = F.col(c).cast("string")
        value = json_scalar(_closed(v))
        if c in DETAILS:
            plain = ~v.contains(": ") & ~v.contains(" ¦ ")
            empty = v.isin("-", "") if c == "Details" else plain
            value = F.when(empty, F.lit("{}")).when(plain, json_scalar(_closed(v))).otherwise(object_text(pairs_of(v), indent=indent))
        elif c in TAGS:
            texts = F.transform(F.split(v, "¦"), lambda x: _quoted(F.trim(x)))
            value = F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
        shown = v.isNotNull() & (F.lit(True) if c in DETAILS[1:] else v != "")
        parts.append(F.when(shown, F.concat(F.lit("" if lines else "\n    "), F.lit('"' + c + ('":' if lines else '": ')), value)))
    return found.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}" if lines else "\n}")).alias("value"))


def json_text(found: DataFrame) -> DataFrame:
    """One JSON object per row, keys in column order, scalars by their looks; null columns are left out."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{c}": '), json_scalar(F.col(c).cast("string")))) for c in found.columns]
    return found.select(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("value"))


def write_json_lines(found: DataFrame, path: str, *, clobber: bool = False) -> None:
    json_timeline(found).write.mode("overwrite" if clobber else "error").text(path)


def write_categories(keywords: DataFrame, path: str, *, clobber: bool = False) -> None:
    """(category, value) as one folder of text files per category."""
    keywords.select("category", "value").repartition("category").write.partitionBy("category").mode("overwrite" if clobber else "error").text(path)


def html_report(sections: dict[str, DataFrame], path: str, *, clobber: bool = False, rows: int | None = None) -> None:
    """Summary tables (each already an aggregate) as one HTML page: all rows, a partition at a time on the driver; with
    `rows`, the first of them and how many are left out."""
    if Path(path).exists() and not clobber:
        raise FileExistsError(path)
    with open(path, "w", encoding="utf-8") as out:
        out.write("<!DOCTYPE html><meta charset=utf-8><title>Results</title>\n")
        for title, df in sections.items():
            out.write(f"<h2>{html.escape(title)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>\n")
            for r in (df if rows is None else df.limit(rows)).toLocalIterator():
                out.write("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>\n")
            out.write("</table>\n")
            if rows is not None and (more := df.count() - rows) > 0:
                out.write(f"<p>{more} more rows are left out.</p>\n")


def show(found: DataFrame, n: int = 50) -> str:
    """The first n rows as display text."""
    line = F.concat_ws(" · ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in found.columns])
    return "\n".join(r[0] for r in found.limit(n).select(line).collect())
