"""Enrichment: field value tables, geographic ranges, operating systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import ascii_lower
from tracewell.operators.windows import running
from tracewell.plans.leaves import ascii_fold, cidr, java_quote
from tracewell.storage import cut

#: Networks without a place (fixed values).
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "fc00::/7", "fe80::/10")
LOOPBACK = ("127.0.0.0/8", "::1/128")


def _replaced(c: Column, pairs: dict[str, str], keys: list[str], flags: str = "") -> Column:
    """The leftmost matches of the keys (of those that begin at one place the first in order) by their values, in one
    pass: what a value brings in isn't looked at again."""
    if not keys:
        return c
    any_key = flags + "|".join(java_quote(k) for k in keys)
    found = F.regexp_extract_all(c, F.lit(f"{flags}({any_key.removeprefix(flags)})"), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    name = ascii_lower if flags else lambda x: x
    value = lambda h: F.coalesce(F.try_element_at(table, name(h)), F.lit(""))
    return F.array_join(F.zip_with(F.split(c, any_key, -1), found, lambda r, h: F.concat(r, value(h))), "")


def abbreviate(c: Column, pairs: dict[str, str]) -> Column:
    """Keys by their values, A-Z folded; of keys that begin at one place the longest wins."""
    folded: dict[str, str] = {}
    for k, v in pairs.items():
        folded.setdefault(ascii_fold(k), v)
    return _replaced(c, folded, sorted((k for k in folded if k), key=len, reverse=True), "(?i)")


def rewrite(c: Column, pairs: dict[str, str]) -> Column:
    """Keys by their values as they end: the match that ends first wins, of those that end at one place the longest.

    A key in which another one ends before its own end is therefore never found. Without these, keys that begin earlier
    never end later, so the leftmost match is the one that ends first."""
    keys = [k for k in pairs if k and not any(o and o in k[:-1] for o in pairs)]
    return _replaced(c, pairs, keys)


def rewrite_fields(field: str, c: Column, tables: list[tuple]) -> Column:
    """Values of one field by (channel, event id, field, pairs) and, where a fifth item is given, only of its providers;
    case of channel and field ignored."""
    out = c
    for channel, event_id, name, pairs, *providers in tables:
        if name.lower() == field.lower():
            here = (F.lower("channel") == channel.lower()) & (F.col("event_id") == event_id)
            if providers and providers[0]:
                here = here & F.coalesce(F.col("provider").isin(list(providers[0])), F.lit(False))
            out = F.when(here, rewrite(c, pairs)).otherwise(out)
    return out


def _number(ip: Column) -> Column:
    parts = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("long"))
    return F.when(ip.rlike(r"\A\d{1,3}(\.\d{1,3}){3}\z"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def address_digits(ip: Column) -> Column:
    """An address as 32 hexadecimal digits, IPv4 as ::ffff:a.b.c.d; null for other texts."""
    plain = F.regexp_replace(F.lower(ip), r"\A::ffff:(?=[0-9]+\.)", "")
    four = F.when(_number(plain) < (1 << 32), F.concat(F.lit("0" * 20 + "ffff"), F.lpad(F.lower(F.hex(_number(plain))), 8, "0")))
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    short = plain.contains("::")
    head, tail = groups(F.substring_index(plain, "::", 1)), F.when(short, groups(F.substring_index(plain, "::", -1))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail))), tail)
    six = F.when((F.size(whole) == 8) & plain.rlike(r"\A[0-9a-f:]*:[0-9a-f:]*\z") & ~plain.rlike(r":::|::.*::|[0-9a-f]{5}"), F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))
    return F.coalesce(four, six)


def locate(df: DataFrame, ip: str, tables: dict[str, DataFrame], ranges: int | None = None) -> DataFrame:
    """df with a column for each table: the value of the range that holds the address in `ip`, null where none does or the
    address is none. tables: lo and hi (addresses as text, both included, disjoint within a table) and value.

    Range starts and the distinct addresses of all tables are sorted together, in parts dealt by value, and every address
    takes the nearest start at or before it: a range makes one row, however wide, and each address is looked up once."""
    known = df.select(address_digits(F.col(ip)).alias("at")).where("at is not null").distinct()
    line = known.select(F.explode(F.array(*[F.lit(name) for name in tables])).alias("kind"), "at", F.lit(None).cast("struct<lo: string, hi: string, value: string>").alias("start"))
    for name, table in tables.items():
        lo, hi = address_digits(F.col("lo")), address_digits(F.col("hi"))
        line = line.unionByName(table.select(F.lit(name).alias("kind"), lo.alias("at"), F.struct(lo.alias("lo"), hi.alias("hi"), F.col("value").cast("string").alias("value")).alias("start")).where("at is not null"))
    spread = line.repartitionByRange(ranges, "kind", "at") if ranges else line.repartitionByRange("kind", "at")
    spread = cut(spread.withColumn("p", F.spark_partition_id()), "address-ranges")
    near = running(spread.withColumn("last", F.col("start").isNull().cast("int")), ["kind"], ["at", "last"], {}, {"near": F.col("start")})
    held = F.when(F.col("near.hi") >= F.col("at"), F.col("near.value"))
    found = near.where("start is null").groupBy("at").agg(*[F.max(F.when(F.col("kind") == name, held)).alias(name) for name in tables])
    return df.withColumn("at_", address_digits(F.col(ip))).join(found.withColumnRenamed("at", "at_"), "at_", "left").drop("at_")


def geolocate(df: DataFrame, ip: str, ranges: DataFrame, out: str = "place") -> DataFrame:
    """df with the place of an address: Local, Private, that of its range, or `-`. ranges: lo and hi (IPv4 as numbers,
    disjoint) and place."""
    text = lambda c: F.concat_ws(".", *[F.expr(f"({c} div {1 << s}) % 256").cast("string") for s in (24, 16, 8, 0)])
    return places(df, ip, {out: ranges.select(text("lo").alias("lo"), text("hi").alias("hi"), F.col("place").alias("value"))})


def places(df: DataFrame, ip: str, tables: dict[str, DataFrame]) -> DataFrame:
    """locate() with words for what has no place: Local for this computer, Private for networks of no one, else `-`."""
    plain = F.regexp_replace(F.col(ip), r"(?i)\A::ffff:", "")
    is_in = lambda nets: F.coalesce(F.greatest(*[F.coalesce(cidr(plain, n), F.lit(False)) for n in nets]), F.lit(False))
    local = F.when(is_in(LOOPBACK) | (F.upper(plain) == "LOCAL"), "Local").when(is_in(PRIVATE), "Private")
    found = locate(df, ip, tables)
    return found.withColumns({name: F.coalesce(local, F.col(name), F.lit("-")) for name in tables})
