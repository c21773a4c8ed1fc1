"""Queries of the outputs and of the logon report: event records under the names that these read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import reports
from tracewell.operators.detect import resolver
from tracewell.sources import sinks
from tracewell.sources.records import from_events

#: Channels and event ids that records take in turn: all routes of the report, one event that is none, one wrong channel.
_KINDS = [(channel, i) for channel, ids, *_ in reports.ROUTES for i in ids] + [("Security", "4634"), ("Other", "4624")]


def logon_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = from_events(spark, sf_dir)
    n = F.col("record_id").cast("long")
    of = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in _KINDS]), (n % len(_KINDS) + 1).cast("int"))
    user = F.col("f_user_id").cast("long")
    told = {
        "TargetUserName": F.concat(F.lit('"T"'), "f_user_id"), "AccountName": F.concat(F.lit("A"), "f_user_id"), "UserDataUser": F.concat(F.lit("D\\E\\u"), "f_user_id"), "UserDataParam1": F.concat(F.lit("P"), "f_user_id"),
        "RdsGtwUsername": F.concat(F.lit("g"), "f_user_id"), "TargetDomainName": F.lit("TD"), "AccountDomain": F.lit("AD"), "UserDataParam2": F.lit("PD"), "WorkstationName": F.when(user % 2 == 0, "WS"), "ClientName": F.lit("CN"),
        "IpAddress": F.col("f_ip"), "ClientAddress": F.lit("1.1.1.1"), "UserDataAddress": F.lit("2.2.2.2"), "UserDataParam3": F.lit("3.3.3.3"), "RdsGtwIpAddress": F.lit("4.4.4.4"), "LogonType": (user % 15).cast("string"), "SubjectUserName": F.col("f_owner"),
    }
    r = r.withColumns({f"f_{k}": v for k, v in told.items()}).withColumn("channel", of(0)).withColumn("event_id", of(1))
    return reports.logons(r, resolver(r))


def logon_routes_sql(events: str) -> str:
    kinds = ", ".join(f"{{'c': '{c}', 'e': '{e}'}}" for c, e in _KINDS)
    types = " ".join(f"WHEN '{k}' THEN '{k} - {v}'" for k, v in reports.LOGON_TYPES.items())
    return f"""WITH {events}, k AS (SELECT *, [{kinds}][record_id::BIGINT % {len(_KINDS)} + 1] AS kind, f_user_id AS u FROM rec),
l AS (SELECT *, CASE WHEN kind.c = 'Security' AND kind.e IN ('4624', '4625') THEN 'a' WHEN kind.c = 'Security' AND kind.e IN ('4778', '4779') THEN 'b' WHEN kind.e IN ('21', '25') THEN 'c'
  WHEN kind.e = '1149' THEN 'd' WHEN kind.e = '302' THEN 'e' END AS r FROM k),
m AS (SELECT CASE r WHEN 'c' THEN 'RDS-LSM ' WHEN 'd' THEN 'RDS-RCM ' WHEN 'e' THEN 'RDS-GTW ' ELSE 'Sec ' END || kind.e AS event,
  CASE r WHEN 'a' THEN 'T' WHEN 'b' THEN 'A' WHEN 'c' THEN 'u' WHEN 'd' THEN 'P' ELSE 'g' END || u AS user,
  CASE r WHEN 'a' THEN 'TD' WHEN 'b' THEN 'AD' WHEN 'c' THEN 'D\\E' WHEN 'd' THEN 'PD' ELSE '-' END AS domain, computer,
  CASE (u::BIGINT % 15)::VARCHAR {types} ELSE (u::BIGINT % 15)::VARCHAR END AS logon_type, coalesce(f_owner, '-') AS source_user, '-' AS source_domain,
  CASE WHEN r = 'b' THEN 'CN' WHEN u::BIGINT % 2 = 0 THEN 'WS' ELSE '-' END AS source_computer,
  CASE r WHEN 'a' THEN f_ip WHEN 'b' THEN '1.1.1.1' WHEN 'c' THEN '2.2.2.2' WHEN 'd' THEN '3.3.3.3' ELSE '4.4.4.4' END AS source_ip, kind.e = '4625' AS bad, ts FROM l WHERE r IS NOT NULL)
SELECT event, user, domain, computer, logon_type, source_user, source_domain, source_computer, source_ip, count(*) FILTER (NOT bad) AS successes, count(*) FILTER (bad) AS failures,
  min(ts) FILTER (NOT bad) AS first_success, max(ts) FILTER (NOT bad) AS last_success, min(ts) FILTER (bad) AS first_failure, max(ts) FILTER (bad) AS last_failure FROM m GROUP BY ALL"""


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = from_events(spark, sf_dir)
    return sinks.csv_text(r.select("record_id", "computer", "f_owner", "f_value", F.concat(F.lit('a  "b",\n'), "f_k").alias("told"), F.concat("f_k", F.lit("e3")).alias("n")))


def csv_lines_sql(events: str) -> str:
    return f"""WITH {events} SELECT record_id || ',"' || computer || '","' || coalesce(f_owner, '') || '",' || v.f_value || ',"a ""b"", ' || f_k || '",' || f_k || 'e3' AS value
FROM rec JOIN (SELECT event_id::VARCHAR AS id, value::VARCHAR AS f_value FROM events) v ON v.id = record_id"""


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = from_events(spark, sf_dir)
    details = F.concat(F.lit("User: "), "f_user_id", F.lit(" ¦ K: "), "f_k", F.lit(" ¦ User: "), "f_login", F.lit(" ¦ Path: C:\\a: b ¦ Own: "), F.coalesce("f_owner", F.lit("true")))
    tags = F.when(F.col("event_id") == "1", "T1 ¦ T2").when(F.col("event_id") == "2", "T3").otherwise("")
    made = F.when(F.col("event_id") == "3", "-").when(F.col("event_id") == "4", F.concat(F.lit("seen "), "f_k")).otherwise(details)
    rows = r.select(F.col("record_id").alias("RecordID"), F.col("computer").alias("Computer"), tags.alias("MitreTags"), made.alias("Details"), F.when(F.col("event_id") == "5", "").otherwise(F.concat(F.lit("k: "), "f_k")).alias("ExtraFieldInfo"))
    return sinks.json_timeline(rows)


def json_rows_sql(events: str) -> str:
    return f"""WITH {events} SELECT '{{"RecordID":' || record_id || ',"Computer":"' || computer || '"'
  || CASE event_id WHEN '1' THEN ',"MitreTags":["T1","T2"]' WHEN '2' THEN ',"MitreTags":["T3"]' ELSE '' END
  || ',"Details":' || CASE event_id WHEN '3' THEN '{{}}' WHEN '4' THEN '"seen ' || f_k || '"'
     ELSE '{{"User":["' || f_user_id || '","' || f_login || '"],"K":' || f_k || ',"Path":"C:\\\\a: b","Own":' || coalesce('"' || f_owner || '"', 'true') || '}}' END
  || ',"ExtraFieldInfo":' || CASE event_id WHEN '5' THEN '{{}}' ELSE '{{"k":' || f_k || '}}' END || '}}' AS value FROM rec"""


_SYSTEM = ("12", "6009", "6013", "6005", "7")
_VERSIONS = {"10.0": "Ten", "11.0": "Eleven"}


def computer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operating system, time zone, boot and uptime per computer, from the system events that tell them."""
    r = from_events(spark, sf_dir)
    n = F.col("record_id").cast("long")
    kind = F.element_at(F.array(*map(F.lit, _SYSTEM)), (n % len(_SYSTEM) + 1).cast("int"))
    version = F.when(F.col("f_user_id").cast("long") % 3 == 0, "10.0").when(F.col("f_user_id").cast("long") % 3 == 1, "11.0").otherwise("9.9")
    data = F.when(kind == "6009", F.array(version)).when(kind == "6013", F.array(*[F.lit("")] * 6, F.concat(F.lit("zone "), n % 4))).otherwise(F.array(F.lit("x")))
    r = r.withColumn("channel", F.when(n % 7 == 0, "Other").otherwise("System")).withColumn("event_id", kind).withColumn("data_array", data)
    made = reports.computer_metrics(r, _VERSIONS)
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_boot", "last_ts")})


def computer_columns_sql(events: str) -> str:
    left, parts = "s", []
    for size, unit in ((31536000, "Y"), (2592000, "M"), (86400, "d"), (3600, "h"), (60, "m"), (1, "s")):
        parts.append(f"({left}) // {size} || '{unit}'")
        left = f"({left}) % {size}"
    return f"""WITH {events}, k AS (SELECT *, {list(_SYSTEM)}[record_id::BIGINT % 5 + 1] AS e, record_id::BIGINT AS n, f_user_id::BIGINT % 3 AS v FROM rec),
c AS (SELECT computer, count(*) AS n, arg_max(CASE v WHEN 0 THEN 'Ten' WHEN 1 THEN 'Eleven' ELSE '9.9' END, ts) FILTER (e = '6009') AS os, arg_max('zone ' || n % 4, ts) FILTER (e = '6013') AS time_zone,
  max(ts) FILTER (e IN ('12', '6005', '6009') AND n % 7 <> 0) AS last_boot, max(ts) AS last_ts FROM k GROUP BY computer)
SELECT computer, n, os, time_zone, last_boot, last_ts, CASE WHEN s IS NOT NULL THEN {" || ' ' || ".join(parts)} END AS uptime FROM (SELECT *, (epoch_us(last_ts) - epoch_us(last_boot)) // 1000000 AS s FROM c)"""
