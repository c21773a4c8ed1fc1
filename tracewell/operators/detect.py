"""Running rules over records: one scan for all plain rules, windows for counts, joins of blocks for temporal ones."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import all_fields, json_bare, micros, template_of
from tracewell.operators.windows import group_key_of, rule_windows, temporal
from tracewell.plans.correlation import resolve as resolve_rules
from tracewell.plans.index import Index
from tracewell.plans.leaves import Lists, selection
from tracewell.plans.rules import Rule, for_channels
from tracewell.plans.scope import Scope, scope_of
from tracewell.storage import cut

#: Columns of records that rules may name directly; other names are looked up in event_data.
SYSTEM = {"Channel": "channel", "EventID": "event_id", "Computer": "computer", "Provider_Name": "provider", "EventRecordID": "record_id"}
#: Columns that a rule adds to its detections.
RULE = ("rule_id", "rule_title", "level", "level_rank", "rule_path", "author", "tags")


def fields_of(records: DataFrame) -> Column:
    """Map of a record's fields: its event data, else its hot columns `f_<name>` that aren't null."""
    if "event_data" in records.columns:
        return F.coalesce("event_data", F.create_map().cast("map<string,string>"))
    hot = [c for c in records.columns if c.startswith("f_")]
    if not hot:
        return F.create_map().cast("map<string,string>")
    whole = F.create_map(*[x for c in hot for x in (F.lit(c[2:]), F.col(c).cast("string"))])
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def resolver(records: DataFrame, aliases: dict[str, str] | None = None) -> Callable[[str], Column]:
    """Field names to columns: alias, system column, hot column `f_<name>`, then the map of event data."""
    columns = set(records.columns)
    aliases = aliases or {}

    def resolve(name: str) -> Column:
        name = aliases.get(name, name).rpartition(".")[2] if aliases.get(name, name).startswith("Event.") else aliases.get(name, name)
        if name in SYSTEM and SYSTEM[name] in columns:
            return F.col(SYSTEM[name])
        if f"f_{name}" in columns:
            return F.col(f"f_{name}")
        return F.try_element_at(F.col("event_data"), F.lit(name)) if "event_data" in columns else F.lit(None).cast("string")

    return resolve


def _in_scope(scope: Scope, resolve: Callable[[str], Column], lists: Lists | None) -> Column:
    return selection(sorted(scope.channels), resolve, lists or Lists(), "Channel")


def matches(records: DataFrame, rules: list[Rule], resolve: Callable[[str], Column], lists: Lists | None = None) -> DataFrame:
    """records with rule_no (the rule's place) for every plain rule that matches; one pass over the records, in which
    each distinct leaf of all rules is evaluated once (tracewell.plans.index). Records of channels that no rule can match
    leave before."""
    if not rules:
        return records.withColumn("rule_no", F.lit(0)).limit(0)
    scopes = {scope_of(r) for r in rules}
    if all(s.channels is not None for s in scopes):
        records = records.where(_in_scope(reduce(Scope.__or__, scopes), resolve, lists))
    found = Index(rules, resolve, lists).match(records, "hits")
    return found.withColumn("rule_no", F.explode("hits")).drop("hits")


def for_present_channels(records: DataFrame, rules: list[Rule], resolve: Callable[[str], Column], lists: Lists | None = None, *, most: int = 10_000) -> tuple[DataFrame, list[Rule]]:
    """Records and rules of a run, less those that cannot meet: rules that name no channel of the records, and
    (where every rule left has a scope) channels and so files that no rule can match, by a filter that reaches the scan.

    One pass over the channel column finds the channels, at most `most` of them; with more, nothing is left out."""
    kinds = records.select("channel").distinct()
    present = [r[0] for r in kinds.limit(most + 1).collect()]
    if len(present) > most:
        return records, rules
    kept = for_channels(rules, {c for c in present if c is not None})
    scopes = [scope_of(r) for r in kept]
    if not kept or any(s.channels is None for s in scopes):  # correlation rules have none either
        return records, kept
    inside = reduce(Column.__or__, [_in_scope(s, resolve, lists) for s in sorted(set(scopes), key=lambda s: sorted(s.channels))])
    hit = [r[0] for r in kinds.where(inside).collect()]
    return records.where(F.col("channel").isin(hit)), kept


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.rule_id, r.title, r.level, r.rank, r.path, r.author, ",".join(r.tags), r.details) for i, r in enumerate(rules)]
    names = "rule_id string, rule_title string, level string, level_rank int, rule_path string, author string, tags string"
    return spark.createDataFrame(rows, f"rule_no int, {names}, rule_details string")


def detections(records: DataFrame, rules: list[Rule], resolve: Callable[[str], Column], lists: Lists | None = None) -> DataFrame:
    """One row per record and plain rule: ts, channel, event_id, computer, record_id, file and the rule's metadata."""
    plain = [r for r in rules if r.agg is None and r.generate and not r.correlation]
    found = matches(records, plain, resolve, lists)
    return found.join(F.broadcast(rule_table(records.sparkSession, plain)), "rule_no").drop("rule_no")  # one row a rule


#: Time of counted records that have none.
NO_TIME = 220_924_800_000_000


#: Columns of counted records that timeline rows join.
JOINED = ("computer", "channel", "event_id")
#: Copies of the windows of rules without a frame, so that a frequent key's records meet them in many tasks.
_SALTS = 64


def _by_rule(values: list, kind: str) -> Column:
    """What each rule has of something, by rule_no."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("rule_no") + 1)


def counted(records: DataFrame, rules: list[Rule], resolve: Callable[[str], Column], lists: Lists | None = None) -> DataFrame:
    """Records that count rules match, one row a rule: rule_no, agg_key, t (microseconds), counted (the value of the rule's
    field, if it has one), file, record_id and JOINED. One pass over the records serves all rules."""
    hit = matches(records, rules, resolve, lists)
    keys = list(dict.fromkeys(r.agg.by for r in rules))
    fields = list(dict.fromkeys(r.agg.field for r in rules if r.agg.field))
    of = _by_rule([keys.index(r.agg.by) for r in rules], "int")
    key = F.coalesce(*[F.when(of == i, group_key_of([resolve(c) for c in by])) for i, by in enumerate(keys)])
    asked = _by_rule([fields.index(r.agg.field) if r.agg.field else None for r in rules], "int")
    value = F.coalesce(*[F.when(asked == i, json_bare(resolve(f).cast("string"))) for i, f in enumerate(fields)]) if fields else F.lit(None).cast("string")
    return hit.select("rule_no", key.alias("agg_key"), F.coalesce(micros(F.col("ts")), F.lit(NO_TIME)).alias("t"), value.alias("counted"), "file", "record_id", *JOINED)


def count_windows(records: DataFrame, rules: list[Rule], resolve: Callable[[str], Column], lists: Lists | None = None) -> tuple[DataFrame, DataFrame]:
    """Windows of all count rules (rule_no, agg_key, win_start and win_end in microseconds, n_rows, win_count) and the
    counted records. The records are read once, by a job that runs while the plan is being built; the results read tables
    in the shared folder."""
    rows = cut(counted(records, rules, resolve, lists).withColumn("u", F.monotonically_increasing_id()), "counted")
    made = rule_windows(rows, ["agg_key"], "t", [r.agg for r in rules], value="counted", ties=["file", "record_id"], number="u")
    return made, rows


def count_detections(records: DataFrame, rule: Rule, resolve: Callable[[str], Column], lists: Lists | None = None) -> DataFrame:
    """Windows of one count rule: agg_key, win_start and win_end (microseconds), n_rows, win_count."""
    return count_windows(records, [rule], resolve, lists)[0].drop("rule_no")


def window_rows(rows: DataFrame, windows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Timeline rows of windows, with rule_no, at their first record's time: computer, channel, event_id and file hold the
    distinct values of the window's records, sorted and joined; record_id is empty, provider a dash.

    Windows of a key start more than a frame apart, so in a bucket of the frame's width a record meets two at
    most, and a frequent key is split by its buckets. Without a frame a key has two windows at most, whose copies
    the records meet by a hash."""
    width = _by_rule([None if r.agg.frame is None else max(1, r.agg.frame * 1_000_000) for r in rules], "long")
    bucket = lambda c: F.floor(F.col(c) / width)
    salt = F.pmod(F.xxhash64("file", "record_id"), F.lit(_SALTS))
    rows = rows.withColumn("b", F.coalesce(bucket("t"), salt))
    buckets = F.coalesce(F.array_distinct(F.array(bucket("win_start"), bucket("win_end"))), F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))
    met = windows.withColumn("b", F.explode(F.when(width.isNotNull(), buckets).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))))
    held = rows.join(met, ["rule_no", "agg_key", "b"]).where("t between win_start and win_end")
    late = [i for i, r in enumerate(rules) if r.agg.op in ("==", "<", "<=")]
    if late:  # a window may begin behind rows of the same time that were passed over
        last = Window.partitionBy("rule_no", "agg_key", "win_start").orderBy(F.col("t").desc(), F.col("file").desc(), F.col("record_id").desc())
        some = held.where(F.col("rule_no").isin(late)).withColumn("nth", F.row_number().over(last)).where("nth <= n_rows").drop("nth")
        held = some.unionByName(held.where(~F.col("rule_no").isin(late)))
    joined = [F.array_join(F.array_sort(F.collect_set(c)), " ¦ ").alias(c) for c in (*JOINED, "file")]
    has_field = _by_rule([r.agg.field is not None for r in rules], "boolean")
    values = F.collect_set(F.when(has_field, F.coalesce("counted", F.lit("")))).alias("counted")
    made = held.groupBy("rule_no", "agg_key", "win_start", "win_count").agg(*joined, values)
    text = F.concat_ws(
        " ¦ ", F.concat(F.lit("Count:"), F.col("win_count").cast("string")),
        F.concat(_by_rule([r.agg.field and f"{r.agg.field}:" for r in rules], "string"), F.array_join(F.array_sort("counted"), "/")),
        F.when(_by_rule([bool(r.agg.by) for r in rules], "boolean") & (F.col("agg_key") != "_"), F.concat(F.lit("by:"), F.col("agg_key"))),
    )
    return made.select("rule_no", F.timestamp_micros("win_start").alias("ts"), *JOINED, "file", F.lit("").alias("record_id"), F.lit("-").alias("provider"), text.alias("details"))


def count_rows(records: DataFrame, rule: Rule, windows: DataFrame, resolve: Callable[[str], Column], lists: Lists | None = None) -> DataFrame:
    """Timeline rows of one count rule's windows (see window_rows); reads the records."""
    return window_rows(counted(records, [rule], resolve, lists), windows.withColumn("rule_no", F.lit(0)), [rule]).drop("rule_no")


#: Columns of a timeline row, ahead of its rule's.
ROW = ("ts", "computer", "channel", "event_id", "file", "record_id", "provider", "details")


def timeline_rows(records: DataFrame, rules: list[Rule], resolve: Callable[[str], Column], lists: Lists | None = None, templates: dict[str, str] | None = None, aliases: dict[str, str] | None = None) -> tuple[DataFrame, list[str]]:
    """Every row of a timeline: plain detections with their details, windows of count rules, first blocks of temporal
    rules; and errors of rules that can't run. Plain rows without a time are set to 1970-01-01."""
    spark = records.sparkSession
    done, timed, errors = resolve_rules(rules)
    found = with_details(detections(records, done, resolve, lists), templates, aliases)
    found = found.withColumn("ts", F.coalesce(F.col("ts").cast("timestamp"), F.timestamp_micros(F.lit(0))))
    parts = [found.select(*ROW, *RULE)]
    made = _all_windows(records, done, timed, resolve, lists)
    if made:
        windows, rows, counts, owners = made
        texts = window_rows(rows, windows, counts)
        parts.append(texts.join(F.broadcast(rule_table(spark, owners)).drop("rule_details"), "rule_no").select(*ROW, *RULE))  # one row a rule
    return reduce(DataFrame.unionByName, parts), errors


def _all_windows(records: DataFrame, done: list[Rule], timed: list, resolve: Callable[[str], Column], lists: Lists | None) -> tuple[DataFrame, DataFrame, list[Rule], list[Rule]] | None:
    """Windows that are reported, of count rules and of the first blocks of temporal rules; the counted records; the
    rules by rule_no, and the rules by whose names each is reported. All come from one pass over the records."""
    plain = [r for r in done if r.agg and r.generate]
    chosen = [(r, blocks, frame, ordered) for r, blocks, frame, ordered in timed if len(blocks) > 1]  # a single rule never fires
    counts, owners = list(plain), list(plain)
    for rule, blocks, _, _ in chosen:
        counts += blocks
        owners += [rule] * len(blocks)
    if not counts:
        return None
    windows, rows = count_windows(records, counts, resolve, lists)
    if not chosen:
        return windows, rows, counts, owners
    windows, at = cut(windows, "windows"), len(plain)
    parts = [windows.where(F.col("rule_no") < at)] if plain else []
    for _, blocks, frame, ordered in chosen:
        parts.append(temporal([windows.where(F.col("rule_no") == at + i) for i in range(len(blocks))], "agg_key", frame, ordered=ordered))
        at += len(blocks)
    return reduce(DataFrame.unionByName, parts), rows, counts, owners


def with_details(found: DataFrame, templates: dict[str, str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """details of detections: the rule's template, else the one of `<provider>_<event id>`, else all fields. aliases: names
    that templates may use and the paths they stand for, of which the last part names the field."""
    fields = fields_of(found)
    known = F.map_concat(F.map_from_arrays(F.array(*map(F.lit, SYSTEM)), F.array(*[F.col(c) for c in SYSTEM.values()])), F.map_filter(fields, lambda k, _: ~k.isin(*SYSTEM)))
    if aliases:
        of = F.map_from_arrays(F.array(*map(F.lit, aliases)), F.array(*[F.try_element_at(known, F.lit(path.rpartition(".")[2])) for path in aliases.values()]))
        known = F.map_concat(F.map_filter(known, lambda k, _: ~k.isin(list(aliases))), of)
    text = F.col("rule_details")
    if templates:
        table = found.sparkSession.createDataFrame(list(templates.items()), "template_of string, template string")
        found = found.join(F.broadcast(table), F.concat_ws("_", "provider", "event_id") == F.col("template_of"), "left")  # a file's rows
        text = F.coalesce(text, "template")
    data = F.col("data_array") if "data_array" in found.columns else F.array().cast("array<string>")
    return found.withColumn("details", F.coalesce(template_of(text, known, data), all_fields(fields))).drop("template_of", "template")


def correlate(records: DataFrame, rules: list[Rule], resolve: Callable[[str], Column], lists: Lists | None = None) -> tuple[DataFrame | None, list[str]]:
    """Windows of all count and temporal rules, with rule_id; and errors of rules that can't run."""
    done, timed, errors = resolve_rules(rules)
    made = _all_windows(records, done, timed, resolve, lists)
    if not made:
        return None, errors
    windows, _, _, owners = made
    return windows.withColumn("rule_id", _by_rule([r.rule_id for r in owners], "string")).drop("rule_no"), errors


def count_text(count: Column, key: Column, field: str | None = None, values: Column | None = None, by: bool = True) -> Column:
    """Count:N ¦ field:a/b ¦ by:key"""
    parts = [F.concat(F.lit("Count:"), count.cast("string"))]
    if field and values is not None:
        parts.append(F.concat(F.lit(f"{field}:"), F.array_join(F.array_sort(values), "/")))
    if by:
        parts.append(F.when(key != "_", F.concat(F.lit("by:"), key)))
    return F.concat_ws(" ¦ ", *parts)
