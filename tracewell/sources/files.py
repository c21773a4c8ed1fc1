"""Log files as records: JSON lines, JSON arrays, concatenated objects and search-product exports.

Records are parsed as variants once; system fields come out as columns, event data as a map of strings: nested
values too, by their own names, the n-th of an array as `Name[n]`.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.text import leaves, strip
from tracewell.operators.windows import running
from tracewell.sources.prune import Channels, channel_files, of_files
from tracewell.storage import cut, drop_cut

JSON_EXTENSIONS = ("json", "jsonl")


def _paths(path: str, extensions: tuple[str, ...]) -> dict:
    return {"recursiveFileLookup": "true", "pathGlobFilter": "[!.]*.{" + ",".join(extensions) + "}"}


def read_text(spark: SparkSession, path: str | list[str], *, whole: bool = False, line_end: str | None = None, extensions: tuple[str, ...] = JSON_EXTENSIONS) -> DataFrame:
    """Lines (or whole files) below a folder as file, block (where the split begins) and raw; dot-files are skipped.
    `path` may be one file or a list."""
    paths = [path] if isinstance(path, str) else path
    options = _paths(path, extensions) if all("." not in p.rsplit("/", 1)[-1] for p in paths) else {}
    if line_end is not None:
        options["lineSep"] = line_end
    return spark.read.options(**options).text(paths, wholetext=whole).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"))


def json_lines(spark: SparkSession, path: str | list[str], *, channels: Channels | None = None, **options) -> DataFrame:
    """One record per line; blank and malformed lines are skipped. channels: only files whose first record's channel is
    one of them are read (see tracewell.sources.prune)."""
    rows = read_text(spark, path, **options)
    if channels is not None:
        rows = of_files(rows, channel_files(first_lines(rows), channels))
    return records(rows.where(F.trim("raw") != "").withColumn("v", F.try_parse_json("raw")).where("v is not null").select("file", "v"))


def json_files(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Files that hold an array of objects, or objects one behind the other; whatever lies between objects is skipped, and
    objects that can't be parsed are. Files are split at every closing brace and so over tasks, whatever their size; which
    braces lie in a string, and which end an object, follows from running sums over pieces, ranges and file. Behind a
    closing brace too many a file's objects are lost. The texts are written to the shared folder by jobs that run at
    once."""
    source = read_text(spark, path, line_end="}", **options)
    text = F.regexp_replace("raw", r"(?s)\\.", "")  # escapes stand in strings only; a piece ends before none
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("long")
    quotes = count(F.col("bare"), '"')

    def opened(inside: bool) -> Column:
        """Braces that open outside strings, if the piece begins inside one or not."""
        odd = (quotes + int(inside)) % 2 == 1
        whole = F.concat(F.lit('"' if inside else ""), "bare", F.when(odd, '"').otherwise(""))
        return count(F.regexp_replace(whole, r'"[^"]*+"', ""), "{")

    pieces = source.withColumn("bare", text).select("file", F.col("block").alias("p"), F.monotonically_increasing_id().alias("pos"), "raw", quotes.alias("quotes"), opened(False).alias("opens_out"), opened(True).alias("opens_in"))
    pieces = cut(pieces.mapInArrow(_in_ranges, "file string, p long, pos long, raw string, r long, q long, d_0 long, d_1 long"), "json-pieces")
    ends = pieces.groupBy("file", "p", "r").agg(F.max_by(F.struct("q", "d_0", "d_1"), "pos").alias("x")).select("file", "p", "r", "x.*")
    before = Window.partitionBy("file").orderBy("p", "r").rowsBetween(Window.unboundedPreceding, -1)  # a row is a range
    ends = ends.withColumn("inside", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    deeper = F.when(F.col("inside") == 1, F.col("d_1")).otherwise(F.col("d_0"))
    ends = cut(ends.select("file", "p", "r", "inside", F.coalesce(F.sum(deeper).over(before), F.lit(0)).alias("depth")), "json-ranges")
    last = (F.col("depth") + deeper == 0) & ((F.col("q") + F.col("inside")) % 2 == 0)
    fresh = (F.col("pos") == F.col("r")) & (F.col("depth") == 0) & (F.col("inside") == 0)  # a range that begins between objects
    texts = pieces.join(ends, ["file", "p", "r"]).select("file", "p", "pos", "raw", last.alias("last"), fresh.alias("fresh"))
    texts = cut(texts.mapInArrow(_in_objects, "file string, p long, pos long, raw string, begins boolean, ends boolean"), "json-objects")
    drop_cut(pieces, ends)
    parts = running(texts.where("not (begins and ends)"), ["file"], ["pos"], {"nth": F.col("ends").cast("long")}, {}).withColumn("nth", F.col("nth") - F.col("ends").cast("long"))
    parts = parts.groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("p", "pos", "raw"))).alias("parts"))  # one object's texts
    whole = texts.where("begins and ends").select("file", "raw").unionByName(parts.select("file", F.array_join(F.transform("parts", lambda x: x["raw"]), "}").alias("raw")))
    rows = whole.select("file", F.regexp_replace(F.concat("raw", F.lit("}")), r"(?s)\A[^{]*+", "").alias("raw")).where(F.col("raw") != "")
    return records(rows.withColumn("v", F.try_parse_json("raw")).where("v is not null").select("file", "v"))


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """Which rows of file, p and pos don't follow the row before in their file."""
    new = np.ones(batch.num_rows, dtype=bool)
    file, p, pos = np.asarray(batch.column(0).dictionary_encode().indices), np.asarray(batch.column(1)), np.asarray(batch.column(2))
    new[1:] = (np.diff(file) != 0) | (np.diff(p) != 0) | (np.diff(pos) != 1)
    return new


def _in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with running sums over the rows of a batch that follow each other, a range r: quotes, and depth if the range
    begins outside a string (d_0) or inside (d_1)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _runs(batch)
        quotes, out, inside = (np.asarray(batch.column(c)).astype(np.int64) for c in (4, 5, 6))
        first, g = np.flatnonzero(new), np.cumsum(new) - 1

        def sums(x: np.ndarray, first: np.ndarray = first, g: np.ndarray = g) -> np.ndarray:
            s = np.cumsum(x)
            return s - (s - x)[first][g]

        q = sums(quotes)
        depth = [sums(np.where((q - quotes + h) % 2 == 1, inside, out) - (q + h + 1) % 2) for h in (0, 1)]
        r = np.asarray(batch.column(2))[first][g]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, (r, q, *depth))], names=["file", "p", "pos", "raw", "r", "q", "d_0", "d_1"])


def _in_objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of an object that follow each other in a batch as one text; begins and ends tell whether it is known to
    hold the object's first and last piece."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new, last, fresh = _runs(batch), *(np.asarray(batch.column(c).cast(pa.int8())) == 1 for c in (4, 5))
        start = np.flatnonzero(new | np.append(True, last[:-1]))
        end = np.append(start[1:], batch.num_rows)
        raw = batch.column(3)
        lists = (pa.LargeListArray if pa.types.is_large_string(raw.type) else pa.ListArray).from_arrays(np.append(start, batch.num_rows), raw)
        made = [pc.binary_join(lists, "}"), pa.array(~new[start] | fresh[start]), pa.array(last[end - 1])]
        yield pa.RecordBatch.from_arrays([*batch.select(["file", "p", "pos"]).take(pa.array(start)).columns, *made], names=["file", "p", "pos", "raw", "begins", "ends"])


def export_rows(spark: SparkSession, path: str, **options) -> DataFrame:
    """Exports with `fields` and `rows`: one record per row."""
    rows = read_text(spark, path, whole=True, **options)
    v = F.try_parse_json("raw")
    rows = rows.select("file", F.try_variant_get(v, "$.fields", "array<string>").alias("names"), F.explode(F.try_variant_get(v, "$.rows", "array<array<string>>")).alias("values"))
    rows = rows.withColumn("m", F.map_from_arrays("names", F.slice("values", 1, F.size("names"))))
    return records(rows.select("file", F.to_variant_object("m").alias("v")))


def first_lines(rows: DataFrame) -> DataFrame:
    """(file, channel) of the first record of each file of read_text: of a file's first split, which one task reads, the
    first line that isn't blank."""
    first = rows.where((F.col("block") == 0) & (F.trim("raw") != "")).groupBy("file").agg(F.first("raw").alias("raw"))
    return first.select("file", F.coalesce(*[F.get_json_object("raw", f"$.{p}Channel") for p in ("", "result.", "Event.System.")]).alias("channel"))


def records(rows: DataFrame) -> DataFrame:
    """(file, v) to records. An object under `result` is unwrapped; known names become system fields."""
    inner = F.coalesce(F.try_variant_get("v", "$.result", "variant"), F.col("v"))
    rows = rows.withColumn("v", inner)
    got = lambda *names: F.coalesce(*[F.try_variant_get("v", f"$['{n}']", "string") for n in names])
    values = F.try_variant_get("v", "$", "map<string,variant>")
    scalars = F.map_filter(F.transform_values(values, lambda k, x: scalar(x)), lambda k, x: x.isNotNull())
    # an object without objects and arrays inside becomes a map at once
    shape = F.schema_of_variant("v")
    flat = F.length(shape) - F.length(F.replace(shape, F.lit("<"), F.lit(""))) <= 1
    plain = F.map_filter(F.transform_values(F.try_variant_get("v", "$", "map<string,string>"), lambda k, x: strip(x)), lambda k, x: x.isNotNull())
    none = F.create_map().cast("map<string,string>")
    rows = rows.withColumn("flat", flat)
    rows = rows.withColumn("top", F.coalesce(F.when(F.col("flat"), plain).otherwise(scalars), none))
    rows = rows.withColumn("nested", F.when(~F.col("flat"), F.filter(leaves(F.col("v")), lambda p: p["value"].isNotNull())))
    # names of nested values that no scalar of the record itself has; of equal names the first counts
    rows = rows.withColumn("nested", F.filter("nested", lambda p: ~F.map_contains_key("top", p["name"])))
    names = F.transform("nested", lambda p: p["name"])
    first = F.filter("nested", lambda p, i: F.array_position(names, p["name"]) == i + 1)
    named = F.map_concat("top", F.map_from_entries(F.transform(first, lambda p: F.struct(p["name"], strip(p["value"])))))
    fields = F.when(F.col("flat"), F.col("top")).otherwise(named)
    raw_time = got("@timestamp", "_time", "SystemTime")
    return rows.select(
        "file", F.try_to_timestamp(raw_time).alias("ts"), got("Channel").alias("channel"), got("EventID").alias("event_id"), got("Computer", "Hostname").alias("computer"),
        got("SourceName", "Name").alias("provider"), got("EventRecordID", "RecordNumber").alias("record_id"), fields.alias("event_data"),
        F.coalesce(F.try_variant_get("v", "$.Data", "array<string>"), F.array().cast("array<string>")).alias("data_array"), F.to_json("v").alias("data_string"), F.lit(False).alias("recovered"),
    )


def scalar(x: Column) -> Column:
    """Text of a JSON scalar, trimmed; null for null, arrays and objects."""
    return F.when(~F.schema_of_variant(x).rlike(r"\A(OBJECT|ARRAY|VOID)"), strip(F.try_variant_get(x, "$", "string")))


def read_exports(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """Exported timelines (CSV with a header) as one table of texts, and the files left out because their header differs
    from the first one's. Headers are compared as lines; a file without any is left out too."""
    firsts = {p: spark.read.text(p).limit(1).collect() for p in paths}  # a line a file
    header = next((rows[0][0] for rows in firsts.values() if rows), None)
    same = [p for p, rows in firsts.items() if rows and rows[0][0] == header]
    if not same:
        return spark.createDataFrame([], "value string"), list(paths)
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(same), [p for p in paths if p not in same]


def read_table(path: str, header: bool = True) -> list[list[str]]:
    """Rows of a small configuration file in CSV."""
    with open(path, encoding="utf-8", newline="") as f:
        rows = [r for r in csv.reader(f) if r]
    return rows[1:] if header else rows


def read_lines(path: str) -> list[str]:
    return [x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip()]
