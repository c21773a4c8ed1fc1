"""Fixed reports. Each is one aggregation, with lookups as literal maps and top lists by ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import authors, lookup, micros, uptime

#: Event ids and channels of logon events (fixed values): id, channel, successful.
LOGONS = (
    ("4624", "Security", True), ("4625", "Security", False), ("4648", "Security", True),
    ("21", "Microsoft-Windows-TerminalServices-LocalSessionManager/Operational", True),
    ("22", "Microsoft-Windows-TerminalServices-LocalSessionManager/Operational", True),
    ("25", "Microsoft-Windows-TerminalServices-LocalSessionManager/Operational", True),
    ("302", "Microsoft-Windows-TerminalServices-Gateway/Operational", True),
    ("303", "Microsoft-Windows-TerminalServices-Gateway/Operational", True),
)
#: Where logon events keep what the summary shows (fixed values): channel, event ids, name, then the fields of user,
#: domain, source computer and source address. One field for user and domain holds both, parted by the last backslash.
_REMOTE = "Microsoft-Windows-TerminalServices-{}/Operational"
ROUTES = (
    ("Security", ("4624", "4625"), "Sec {}", "TargetUserName", "TargetDomainName", "WorkstationName", "IpAddress"),
    ("Security", ("4778", "4779"), "Sec {}", "AccountName", "AccountDomain", "ClientName", "ClientAddress"),
    (_REMOTE.format("LocalSessionManager"), ("21", "25"), "RDS-LSM {}", "UserDataUser", "UserDataUser", "WorkstationName", "UserDataAddress"),
    (_REMOTE.format("RemoteConnectionManager"), ("1149",), "RDS-RCM {}", "UserDataParam1", "UserDataParam2", "WorkstationName", "UserDataParam3"),
    (_REMOTE.format("Gateway"), ("302",), "RDS-GTW {}", "RdsGtwUsername", "RdsGtwUsername", "WorkstationName", "RdsGtwIpAddress"),
)
#: The event that counts as a failed logon, and names of logon types (fixed values).
FAILED = "4625"
LOGON_TYPES = {
    "0": "System", "2": "Interactive", "3": "Network", "4": "Batch", "5": "Service", "7": "Unlock", "8": "NetworkCleartext", "9": "NewInteractive",
    "10": "RemoteInteractive", "11": "CachedInteractive", "12": "CachedRemoteInteractive", "13": "CachedUnlock",
}
LOGON_KEY = ("event", "user", "domain", "computer", "logon_type", "source_user", "source_domain", "source_computer", "source_ip")
#: Values that say nothing in a keyword list (fixed values).
NO_KEYWORD = ("-", "127.0.0.1", "::1")


def event_metrics(records: DataFrame, titles: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """event_id, channel (lower case), n, percent (one decimal) and title, the most frequent first."""
    found = records.where("event_id is not null").groupBy(F.lower("channel").alias("channel"), F.lower("event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("n"))
    total = found.agg(F.sum("n").alias("total"))  # one row
    found = found.crossJoin(F.broadcast(total)).withColumn("percent", F.round(F.col("n") * 100 / F.col("total"), 1)).drop("total")
    names = {f"{e}\x00{c}".lower(): t for (e, c), t in (titles or {}).items()}
    title = lookup(F.concat_ws("\x00", "event_id", "channel"), names, default=F.lit("Unknown"))
    return found.withColumn("title", title).orderBy(F.desc("n"), "channel", "event_id")


def logon_summary(records: DataFrame, key: dict[str, Column], logons: tuple[tuple[str, str, bool], ...] = LOGONS) -> DataFrame:
    """The key's columns, event_id, successes, failures, first and last time, by number then key.

    key: column names and what they are (target and source of a logon)."""
    which = F.lit(None).cast("boolean")
    for eid, channel, ok in logons:
        which = F.when((F.col("event_id") == eid) & (F.col("channel") == channel), F.lit(ok)).otherwise(which)
    rows = records.withColumn("ok", which).where("ok is not null").select(*[F.coalesce(c, F.lit("-")).alias(k) for k, c in key.items()], "event_id", "ok", "ts")
    out = rows.groupBy(*key, "event_id").agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.orderBy(F.desc(F.col("successes") + F.col("failures")), *key, "event_id")


def logons(records: DataFrame, resolve: Callable[[str], Column]) -> DataFrame:
    """Logons by the nine columns of LOGON_KEY: successes and failures with their first and last times, in one pass. What a
    record lacks is a dash; quotes are taken out of values. Records without a time count, but give none."""
    text = lambda name: F.coalesce(F.regexp_replace(resolve(name).cast("string"), "[\"']", ""), F.lit("-"))
    routed = F.lit(None)
    for channel, ids, label, user, domain, computer, address in ROUTES:
        whole = text(user)
        both = (F.element_at(F.split(whole, r"\\"), -1), F.when(whole.contains("\\"), F.regexp_extract(whole, r"(?s)\A(.*)\\", 1)).otherwise("-")) if user == domain else (whole, text(domain))
        made = F.struct(F.format_string(label.format("%s"), "event_id").alias("event"), both[0].alias("user"), both[1].alias("domain"), text(computer).alias("source_computer"), text(address).alias("source_ip"))
        routed = F.when((F.col("channel") == channel) & F.col("event_id").isin(list(ids)), made).otherwise(routed)
    rows = records.withColumn("logon", routed).where("logon is not null")
    kind = lookup(text("LogonType"), {k: f"{k} - {v}" for k, v in LOGON_TYPES.items()})
    key = {"event": F.col("logon.event"), "user": F.col("logon.user"), "domain": F.col("logon.domain"), "computer": text("Computer"), "logon_type": kind, "source_user": text("SubjectUserName"), "source_domain": text("SubjectDomainName"), "source_computer": F.col("logon.source_computer"), "source_ip": F.col("logon.source_ip")}
    failed = F.col("event_id") == FAILED
    rows = rows.select(*[c.alias(k) for k, c in key.items()], failed.alias("failed"), "ts")
    of = lambda f, when: f(F.when(when, F.col("ts")))
    bad = F.col("failed")
    return rows.groupBy(*LOGON_KEY).agg(
        F.count_if(~bad).alias("successes"), F.count_if(bad).alias("failures"), of(F.min, ~bad).alias("first_success"), of(F.max, ~bad).alias("last_success"), of(F.min, bad).alias("first_failure"), of(F.max, bad).alias("last_failure"),
    )


def logon_outputs(found: DataFrame) -> dict[str, DataFrame]:
    """The two outputs of logons(): successful and failed ones, the most frequent first, then by key."""
    out = {}
    for name, n, first, last in (("successful", "successes", "first_success", "last_success"), ("failed", "failures", "first_failure", "last_failure")):
        rows = found.where(F.col(n) > 0).select(F.col(n).alias("n"), *LOGON_KEY, F.col(first).alias("first_ts"), F.col(last).alias("last_ts"))
        out[name] = rows.orderBy(F.desc("n"), *LOGON_KEY)
    return out


def computer_metrics(records: DataFrame, os_names: dict[str, str] | None = None) -> DataFrame:
    """Per computer: events, operating system, time zone, last boot, uptime and the last event's time."""
    boot = F.when((F.col("channel") == "System") & F.col("event_id").isin("12", "6005", "6009"), F.col("ts"))
    version = F.when(F.col("event_id") == "6009", F.try_element_at("data_array", F.lit(1)))
    zone = F.when(F.col("event_id") == "6013", F.try_element_at("data_array", F.lit(7)))
    out = records.where("computer is not null").groupBy("computer").agg(F.count(F.lit(1)).alias("n"), F.max_by(version, F.when(version.isNotNull(), F.col("ts"))).alias("os"), F.max_by(zone, F.when(zone.isNotNull(), F.col("ts"))).alias("time_zone"), F.max(boot).alias("last_boot"), F.max("ts").alias("last_ts"))
    out = out.withColumn("os", lookup(F.col("os"), os_names or {})).withColumn("uptime", uptime((micros(F.col("last_ts")) - micros(F.col("last_boot"))) / 1000000))
    return out.orderBy(F.desc("n"), "computer")


def file_metrics(records: DataFrame) -> DataFrame:
    """Per file: events, first and last time, and the sorted distinct computers, channels and providers as text; where the
    records have a column file_size, that too. Distinct values are found first, so lists are gathered from these only."""
    size = [F.max("file_size").alias("file_size")] if "file_size" in records.columns else []
    kinds = ("computer", "channel", "provider")
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds])
    held = records.select("file", F.explode(pairs).alias("p")).select("file", "p.*").where("value is not null").distinct()
    joined = lambda k: F.coalesce(F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("value")))), " ¦ "), F.lit("")).alias(f"{k}s")
    lists = held.groupBy("file").agg(*map(joined, kinds))
    made = records.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *size)
    met = made.join(lists.withColumnRenamed("file", "of"), F.col("file").eqNullSafe(F.col("of")), "left").drop("of")
    return met.select(*made.columns, *[F.coalesce(f"{k}s", F.lit("")).alias(f"{k}s") for k in kinds])


def search(records: DataFrame, keywords: list[str] | None = None, pattern: str | None = None, *, every: bool = False, ignore_case: bool = False) -> DataFrame:
    """Records whose text holds one keyword (or every one), or a part that matches the pattern; eight columns."""
    from tracewell.plans.leaves import java_regex

    text = F.col("data_string")
    if pattern is not None:
        test = text.rlike(java_regex(pattern, "i" if ignore_case else ""))
    else:
        parts = [F.lower(text).contains(k.lower()) if ignore_case else text.contains(k) for k in keywords or []]
        test = parts[0]
        for p in parts[1:]:
            test = test & p if every else test | p
    return records.where(test).select("ts", "computer", "channel", "event_id", "record_id", "data_string", "file")


def sorted_search(found: DataFrame) -> DataFrame:
    return found.distinct().orderBy("ts", "record_id", "file")


def critical_systems(records: DataFrame, share_name: Column, *, channel: str = "Security", ticket: str = "4768", share: str = "5145", skipped: str = r"\\*\IPC$") -> DataFrame:
    """Computers that are domain controllers (ticket requests) or file servers (shares other than the skipped one)."""
    own = F.col("channel") == channel
    kind = F.when(own & (F.col("event_id") == ticket), "domain controller").when(own & (F.col("event_id") == share) & (share_name != skipped), "file server")
    return records.select(kind.alias("kind"), "computer").where("kind is not null").distinct()


def pivot_keywords(found: DataFrame, fields: dict[str, list[Column]], level: Column | None = None) -> DataFrame:
    """Distinct (category, value) of the fields of each category over detections, without empty ones. level: the records'
    own level; those without one, and of the lowest ones, are left out then."""
    if level is not None:
        found = found.where(level.isNotNull() & ~level.cast("string").isin("informational", "undefined", "-"))
    pairs = F.array(*[F.struct(F.lit(k).alias("category"), c.cast("string").alias("value")) for k, cs in fields.items() for c in cs])
    return found.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull() & ~F.col("value").isin(list(NO_KEYWORD)) & (F.col("value") != "")).distinct().orderBy("category", "value")


def time_span(records: DataFrame) -> DataFrame:
    """Number of events, first (not before 2007-01-30) and last time."""
    return records.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("ts") >= F.to_timestamp(F.lit("2007-01-30 00:00:00")), F.col("ts"))).alias("first_ts"), F.max("ts").alias("last_ts"))


def level_summary(found: DataFrame) -> DataFrame:
    """Per level: detections and distinct rules."""
    return found.groupBy("level").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("rule_id").alias("unique_rules"))


def data_reduction(records: DataFrame, found: DataFrame) -> DataFrame:
    """Events, events with hits (distinct time and record) and the share that need not be looked at, in percent."""
    hits = found.agg(F.countDistinct("ts", "record_id").alias("with_hits"))  # one row
    all_ = records.agg(F.count(F.lit(1)).alias("events"))
    return all_.crossJoin(F.broadcast(hits)).withColumn("reduction", F.round((F.col("events") - F.col("with_hits")) * 100 / F.col("events"), 2))


def busiest_dates(found: DataFrame) -> DataFrame:
    """Per level the date with most detections, the smallest of equals."""
    n = found.groupBy("level", F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("level").agg(F.min(F.struct(-F.col("n"), "date")).alias("b")).select("level", F.col("b.date").alias("date"), (-F.col("b.col1")).alias("n"))


def _top(counts: DataFrame, name: str, k: int) -> DataFrame:
    w = Window.partitionBy("level").orderBy(F.desc("n"), name)
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_computers(found: DataFrame, k: int = 5) -> DataFrame:
    """Per level the computers with most distinct rules."""
    return _top(found.where("computer <> '-'").groupBy("level", "computer").agg(F.countDistinct("rule_id").alias("n")), "computer", k)


def top_rules(found: DataFrame, k: int = 5) -> DataFrame:
    return _top(found.groupBy("level", "rule_title").agg(F.count(F.lit(1)).alias("n")), "rule_title", k)


def rule_authors(found: DataFrame) -> DataFrame:
    """Rule files per author, each file counted once."""
    files = found.select("rule_path", "rule_id", "author").distinct()
    return files.withColumn("name", F.explode(authors(F.col("author")))).groupBy("name").agg(F.countDistinct("rule_path", "rule_id").alias("n")).orderBy(F.desc("n"), "name")


def histogram(found: DataFrame, bins: int = 20) -> DataFrame:
    """Detections per equal part of the time they span; none for fewer than five."""
    t = micros(F.col("ts"))
    span = found.agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.count("ts").alias("all"))  # one row
    place = F.least(F.floor((t - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.lit(bins - 1))
    return found.where("ts is not null").crossJoin(F.broadcast(span)).where("all >= 5").groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin")


def tactics_by_computer(found: DataFrame, tactics: dict[str, str]) -> DataFrame:
    """Per computer and tactic: distinct rules and detections. tags: comma-joined tags of the rule."""
    tag = F.explode(F.split("tags", ","))
    rows = found.withColumn("tag", tag).where(F.col("tag").isin(list(tactics)))
    return rows.groupBy("computer", lookup(F.col("tag"), tactics).alias("tactic")).agg(F.countDistinct("rule_id").alias("unique_rules"), F.count(F.lit(1)).alias("total"))


def short_names(details: dict[str, str]) -> dict[str, str]:
    """Full to short field names by ascending length; details: short names and the fields they stand for."""
    return dict(sorted(((full, short) for short, full in details.items()), key=lambda x: (len(x[0]), x[0])))
