"""Record filters ahead of the rules; all are native predicates that reach the scan."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import micros
from tracewell.plans.errors import RuleError

#: Channels that fixed reports read; give them to a source's `channels` (fixed values).
LOGON_CHANNELS = (
    "Security",
    "Microsoft-Windows-TerminalServices-Gateway/Operational",
    "Microsoft-Windows-TerminalServices-LocalSessionManager/Operational",
    "Microsoft-Windows-TerminalServices-RemoteConnectionManager/Operational",
)
CRITICAL_CHANNELS = ("Security",)


def by_computer(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    name = F.coalesce(F.replace(F.col("computer"), F.lit('"'), F.lit("")), F.lit(""))
    if include:
        df = df.where(name.isin(include))
    return df.where(~name.isin(exclude)) if exclude else df


def by_event_id(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """allowed: an allow-list; an empty one lets everything pass."""
    eid = F.coalesce("event_id", F.lit(""))
    for chosen in (include, allowed):
        if chosen:
            df = df.where(eid.isin([str(x) for x in chosen]))
    return df.where(~eid.isin([str(x) for x in exclude])) if exclude else df


def valid_channel(df: DataFrame) -> DataFrame:
    return df.where(F.col("channel").isNotNull() & (F.col("channel") != "null"))


def by_channel(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    if include:
        df = df.where(F.col("channel").isin(list(include)))
    return df.where(~F.coalesce(F.col("channel").isin(list(exclude)), F.lit(False))) if exclude else df


def by_file(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """File names by globs, case ignored."""
    from tracewell.plans.leaves import wildcard_regex

    name = F.substring_index("file", "/", -1)
    test = lambda globs: name.rlike("(?iu)\\A(?:" + "|".join(wildcard_regex(g) for g in globs) + ")\\z")
    if include:
        df = df.where(test(include))
    return df.where(~F.coalesce(test(exclude), F.lit(False))) if exclude else df


def parse_time(text: str) -> datetime:
    for form in ("%Y-%m-%d %H:%M:%S %z", "%Y/%m/%d %H:%M:%S %z"):
        try:
            return datetime.strptime(text, form)
        except ValueError:
            continue
    raise RuleError(f"no time: {text}")


def by_time(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both ends included; records without a time stay."""
    test: Column = F.lit(True)
    for edge, how in ((start, "__ge__"), (end, "__le__")):
        if edge:
            test = test & getattr(micros(F.col("ts")), how)(int(parse_time(edge).timestamp() * 1_000_000))
    return df.where(F.coalesce(test, F.lit(True)))


def since(df: DataFrame, offset: str, now: Column | None = None) -> DataFrame:
    """Records not older than an offset such as 1y2M3d4h5m6s before now."""
    parts = re.findall(r"(\d+)([yMdhms])", offset)
    if not parts or "".join(a + b for a, b in parts) != offset:
        raise RuleError(f"no offset: {offset}")
    n = {u: int(v) for v, u in parts}
    gap = F.make_interval(*[F.lit(n.get(u, 0)) for u in ("y", "M")], F.lit(0), *[F.lit(n.get(u, 0)) for u in ("d", "h", "m", "s")])
    return df.where(F.coalesce(F.col("ts") >= (now if now is not None else F.current_timestamp()) - gap, F.lit(True)))


def unique_records(df: DataFrame) -> DataFrame:
    """One record per record number and time."""
    return df.dropDuplicates(["record_id", "ts"])


def with_fields(df: DataFrame, patterns: list[str], resolve, raw=None) -> DataFrame:
    """`Field:value` filters with wildcards; all must hold. raw: where a field is looked up that resolve gives no value of,
    such as a resolver without aliases."""
    from tracewell.plans.leaves import sure, wildcard

    for p in patterns:
        name, _, value = p.partition(":")
        name = name.strip()
        held = resolve(name) if raw is None else F.coalesce(resolve(name), raw(name))
        df = df.where(sure(wildcard(held, value.strip())))
    return df
