"""The timeline: order, duplicates, severities, tags, output profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import format_time
from tracewell.storage import cut

ORDER = ("ts", "level_rank", "event_id", "rule_path", "computer", "record_id")
RAISED = {"low": "medium", "medium": "high", "high": "critical", "critical": "emergency"}
#: Columns of each profile (fixed values): output name, then the detection column.
_MIN = {"Timestamp": "ts", "Computer": "computer", "Channel": "channel", "EventID": "event_id", "Level": "level"}
PROFILES = {
    "minimal": _MIN | {"RecordID": "record_id", "RuleTitle": "rule_title", "Details": "details"},
    "standard": _MIN | {"RecordID": "record_id", "RuleTitle": "rule_title", "Details": "details", "ExtraFieldInfo": "extra_fields"},
    "verbose": _MIN | {"MitreTactics": "tactics", "MitreTags": "techniques", "OtherTags": "other_tags", "RecordID": "record_id", "RuleTitle": "rule_title", "Details": "details", "ExtraFieldInfo": "extra_fields", "RuleFile": "rule_path", "EvtxFile": "file"},
    "all-field-info": _MIN | {"RecordID": "record_id", "RuleTitle": "rule_title", "AllFieldInfo": "all_fields", "RuleFile": "rule_path", "EvtxFile": "file"},
    "all-field-info-verbose": _MIN | {"MitreTactics": "tactics", "MitreTags": "techniques", "OtherTags": "other_tags", "RecordID": "record_id", "RuleTitle": "rule_title", "AllFieldInfo": "all_fields", "RuleFile": "rule_path", "EvtxFile": "file"},
    "super-verbose": _MIN | {"RuleTitle": "rule_title", "RuleAuthor": "author", "RuleID": "rule_id", "MitreTactics": "tactics", "MitreTags": "techniques", "OtherTags": "other_tags", "Provider": "provider", "RecordID": "record_id", "Details": "details", "ExtraFieldInfo": "extra_fields", "RuleFile": "rule_path", "EvtxFile": "file"},
}

PROFILES["timesketch-minimal"] = {"datetime": "ts", "timestamp_desc": "rule log", "message": "rule_title", "Level": "level", "Computer": "computer", "Channel": "channel", "EventID": "event_id", "RecordID": "record_id", "Details": "details", "RuleFile": "rule_path", "EvtxFile": "file"}
PROFILES["timesketch-verbose"] = PROFILES["timesketch-minimal"] | {"MitreTactics": "tactics", "MitreTags": "techniques", "OtherTags": "other_tags", "ExtraFieldInfo": "extra_fields"}


def project(found: DataFrame, profile: dict[str, str] | str = "standard", *, time_format: str = "default") -> DataFrame:
    """The profile's columns; what isn't a column of the detections is a literal."""
    chosen = PROFILES[profile] if isinstance(profile, str) else profile
    columns = []
    for name, source in chosen.items():
        c = format_time(F.col("ts"), time_format) if source == "ts" else F.col(source) if source in found.columns else F.lit(source)
        columns.append(c.alias(name))
    return found.select(*columns)


def in_order(found: DataFrame, *more: str) -> DataFrame:
    return found.orderBy(*[c for c in (*ORDER, *more) if c in found.columns])


def without_duplicates(found: DataFrame, file: str = "file") -> DataFrame:
    """Of rows equal in all but the file the one with the smallest file."""
    rest = [c for c in found.columns if c != file]
    return found.groupBy(*rest).agg(F.min(file).alias(file)).select(*found.columns)


#: Rows of a range of a timeline that one task goes through.
RANGE_ROWS = 1 << 17


def mark_repeats(found: DataFrame, columns: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """`DUP` in place of a value equal to that of the row before (and neither `-` nor empty). by: parts of the timeline
    emitted separately.

    Rows are dealt by ranges of their order, values are compared inside a range, and a range's first row with the last one
    of the nearest range before it, so that no task holds a timeline or a part of it. The ranges are written to the
    shared folder by a job that runs at once; rows equal in `by` and `order` keep that job's order."""
    by = by or []
    ranges = max(1, -(-found.count() // RANGE_ROWS))
    rows = found.repartitionByRange(ranges, *by, *order) if ranges > 1 else found.coalesce(1)
    kept = {c: f"dup_{i}" for i, c in enumerate(columns)}
    rows = cut(rows.withColumn("dup_range", F.spark_partition_id()).withColumn("dup_row", F.monotonically_increasing_id()), "timeline-ranges")
    here = Window.partitionBy("dup_range", *by).orderBy(*order, "dup_row")
    rows = rows.select("*", F.row_number().over(here).alias("dup_place"), *[F.lag(c).over(here).alias(k) for c, k in kept.items()])
    # one row a range and part: its last values, with those of the range before
    last = rows.groupBy("dup_range", *by).agg(*[F.max_by(F.struct(c), F.struct("dup_place"))[c].alias(k) for c, k in kept.items()])
    over = Window.partitionBy(*[F.col(c) for c in by]).orderBy("dup_range") if by else None
    carried = last.select("dup_range", *by, *[F.lag(k).over(over).alias(f"{k}_before") for k in kept.values()]) if by else _before(last, list(kept.values()))
    same = [F.col("dup_range") == F.col("c_range"), *[F.col(c).eqNullSafe(F.col(f"c_{i}")) for i, c in enumerate(by)]]
    carried = carried.select(F.col("dup_range").alias("c_range"), *[F.col(c).alias(f"c_{i}") for i, c in enumerate(by)], *[f"{k}_before" for k in kept.values()])
    rows = rows.join(carried, same, "left")
    for c, k in kept.items():
        before = F.when(F.col("dup_place") == 1, F.col(f"{k}_before")).otherwise(F.col(k))
        rows = rows.withColumn(c, F.when((F.col(c) == before) & ~F.col(c).isin("-", ""), "DUP").otherwise(F.col(c)))
    return rows.select(*found.columns)


def _before(last: DataFrame, columns: list[str]) -> DataFrame:
    """With the last values of a timeline's ranges those of the range before each. The numbers of the ranges that have rows,
    no more than the job before had tasks, go through the driver."""
    held = sorted(r[0] for r in last.select("dup_range").collect())
    pairs = last.sparkSession.createDataFrame(list(zip(held[1:], held, strict=False)), "dup_range int, dup_before int")
    values = last.select(F.col("dup_range").alias("dup_before"), *[F.col(k).alias(f"{k}_before") for k in columns])
    return pairs.join(values, "dup_before").drop("dup_before")


def raise_levels(found: DataFrame, critical: list[str]) -> DataFrame:
    """One step up for detections on critical computers; informational and undefined stay."""
    up = F.col("level")
    for low, high in RAISED.items():
        up = F.when(F.col("level") == low, high).otherwise(up)
    return found.withColumn("level", F.when(F.col("computer").isin(critical), up).otherwise(F.col("level")))


def tag_columns(found: DataFrame, tactics: dict[str, str]) -> DataFrame:
    """Comma-joined tags as tactics (of the table), techniques (attack.t, .g, .s and a number) and others."""
    all_ = F.filter(F.split("tags", ","), lambda t: t != "")
    technique = lambda t: t.rlike(r"\Aattack\.[tgs][0-9]")
    named = F.create_map(*[F.lit(x) for kv in tactics.items() for x in kv]) if tactics else None
    parts: dict[str, Column] = {
        "tactics": F.transform(F.filter(all_, lambda t: t.isin(list(tactics))), lambda t: named[t]) if tactics else F.array().cast("array<string>"),
        "techniques": F.transform(F.filter(all_, technique), lambda t: F.initcap(F.substring(t, F.lit(8), F.length(t)))),
        "other_tags": F.filter(all_, lambda t: ~technique(t) & ~t.isin(list(tactics))),
    }
    return found.withColumns({k: F.array_join(F.array_sort(v), " ¦ ") for k, v in parts.items()})


def sort_export(rows: DataFrame, column: str = "Timestamp", file: str = "EvtxFile") -> DataFrame:
    """Order an exported timeline by its time text: by instant if every row parses, else as text; drop rows equal
    in all but the file."""
    forms = ("yyyy-MM-dd HH:mm:ss.SSS xxx", "yyyy-MM-dd HH:mm:ss xxx", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX", "MM-dd-yyyy hh:mm:ss.SSS a xxx", "MM-dd-yyyy HH:mm:ss.SSS xxx", "dd-MM-yyyy HH:mm:ss.SSS xxx", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM-dd-yyyy")
    instant = F.coalesce(*[F.try_to_timestamp(F.col(column), F.lit(f)) for f in forms])
    rows = without_duplicates(rows, file) if file in rows.columns else rows.distinct()
    bad = rows.agg(F.count_if(instant.isNull()).alias("bad"))  # one row
    rows = rows.withColumn("at", instant).crossJoin(F.broadcast(bad))
    rest = [c for c in rows.columns if c not in ("at", "bad")]
    return rows.orderBy(F.when(F.col("bad") == 0, F.col("at")), column, *rest).drop("at", "bad")
