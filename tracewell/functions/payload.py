"""Base64 payloads in log text, natively: tokens, decoding, classification by the bytes' hexadecimal digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First bytes of file kinds, in hexadecimal, and their media types (fixed values).
MAGIC = (
    ("4D5A", "application/vnd.microsoft.portable-executable"), ("7F454C46", "application/x-executable"), ("504B0304", "application/zip"), ("504B0506", "application/zip"), ("504B0708", "application/zip"),
    ("1F8B08", "application/gzip"), ("25504446", "application/pdf"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("526172211A07", "application/vnd.rar"), ("377ABCAF271C", "application/x-7z-compressed"),
)
_SHELL = ("Microsoft-Windows-PowerShell/Operational", "PowerShellCore/Operational")
#: Fields that carry payloads (fixed values): channels, event id, fields or places in the data array, the kind's name.
EVENTS = (
    (("Security",), "4688", ("CommandLine",), "Sec 4688"), (("Microsoft-Windows-Sysmon/Operational",), "1", ("CommandLine", "ParentCommandLine"), "Sysmon 1"), (("System",), "7045", ("ImagePath",), "Sys 7045"),
    (_SHELL, "4104", ("ScriptBlockText",), "PwSh 4104"), (_SHELL, "4103", ("Payload",), "PwSh 4103"), (_SHELL, "4102", ("ContextInfo", "Payload"), "PwSh 4102"), (_SHELL, "4100", ("ContextInfo", "Payload"), "PwSh 4100"),
    (("Windows PowerShell",), "400", (2,), "PwShClassic 400"), (("Windows PowerShell",), "403", (2,), "PwShClassic 403"), (("Windows PowerShell",), "600", (2,), "PwShClassic 600"),
)
#: Fewest decoded bytes of a text, fewest characters of a token.
LEAST, SHORT = 5, 10
_HELD = "<Base64String>"


def tokens(text: Column) -> Column:
    """Candidates in order: runs of word characters, + and / that decode as base64 without padding (bits left over are
    zero), of SHORT characters and more, not of letters alone."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)([\w+/]+)"), F.lit(1))
    bits = lambda x: F.when(F.length(x) % 4 == 0, True).when(F.length(x) % 4 == 2, x.rlike("[AQgw]$")).when(F.length(x) % 4 == 3, x.rlike("[AEIMQUYcgkosw048]$")).otherwise(False)
    return F.filter(found, lambda x: (F.length(x) >= SHORT) & x.rlike(r"\A[A-Za-z0-9+/]++\z") & x.rlike("[0-9+/]") & bits(x))


def digits(token: Column) -> Column:
    """A token's decoded bytes as hexadecimal digits."""
    return F.hex(F.unbase64(token))


def classify(raw: Column) -> Column:
    """What the bytes, as hexadecimal digits, hold: UTF-16 LE, UTF-16 BE or UTF-8 for ASCII text in that encoding, Binary
    for the files of MAGIC, else Unknown."""
    text = lambda unit: (F.length(raw) >= 2 * LEAST) & raw.rlike(rf"\A(?:{unit})++\z")
    known = F.lit(False)
    for first, _ in MAGIC:
        known = known | raw.startswith(first)
    kind = F.when(text("[0-7][0-9A-F]00"), "UTF-16 LE").when(text("00[0-7][0-9A-F]"), "UTF-16 BE").when(text("[0-7][0-9A-F]"), "UTF-8")
    return kind.when(known, "Binary").otherwise("Unknown")


def decoded(raw: Column, kind: Column) -> Column:
    """The text of the bytes, null for files."""
    plain = F.when(kind == "UTF-16 LE", F.regexp_replace(raw, "(..)00", "$1")).when(kind == "UTF-16 BE", F.regexp_replace(raw, "00(..)", "$1")).when(kind == "UTF-8", raw)
    return F.unhex(plain).cast("string")


def visible(text: Column) -> Column:
    """An ASCII text without its control characters."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")


def media_type(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for first, name in reversed(MAGIC):
        out = F.when(raw.startswith(first), name).otherwise(out)
    return out


def fields(resolve: Callable[[str], Column]) -> Column:
    """Array of (kind, value) of the fields that carry payloads; empty for records of other kinds."""
    out = F.array().cast("array<struct<event: string, value: string>>")
    for channels, event_id, names, kind in EVENTS:
        values = [F.get("data_array", F.lit(n)) if isinstance(n, int) else resolve(n) for n in names]
        held = F.filter(F.array(*[F.struct(F.lit(kind).alias("event"), v.cast("string").alias("value")) for v in values]), lambda x: x["value"].isNotNull())
        out = F.when(F.col("channel").isin(list(channels)) & (F.col("event_id") == event_id), held).otherwise(out)
    return out


def extract(records: DataFrame, resolve: Callable[[str], Column]) -> DataFrame:
    """A row for each decodable token in the fields that carry payloads: ts, computer, token, decoded (without control
    characters; `(Binary Data)` for files), original (the field, its token replaced), length (of the decoded text or the
    file, in bytes), binary (Y or N), double (whether the text holds a decodable token itself), encoding, file_type,
    event, record_id, file. Tokens that decode to neither text nor a known file are left out, and so are those
    behind a hyphen, which are parts of names."""
    rows = records.select("*", F.explode(fields(resolve)).alias("of"))
    rows = rows.withColumn("token", F.explode(tokens(F.col("of.value"))))
    rows = rows.withColumn("raw", digits(F.col("token")))
    rows = rows.withColumn("kind", classify(F.col("raw"))).where("kind <> 'Unknown'")
    original = F.regexp_replace(F.replace(F.col("of.value"), F.col("token"), F.lit(_HELD)), f"{_HELD}=*", _HELD)
    rows = rows.withColumn("original", original).where(~F.col("original").contains(f"-{_HELD}"))
    rows = rows.withColumn("text", decoded(F.col("raw"), F.col("kind"))).withColumn("seen", visible(F.col("text")))
    again = F.exists(tokens(F.col("seen")), lambda t: classify(digits(t)) != "Unknown")
    is_file = F.col("kind") == "Binary"
    return rows.select(
        "ts", "computer", "token", F.when(is_file, "(Binary Data)").otherwise(F.col("seen")).alias("decoded"), "original",
        F.when(is_file, F.length("raw") / 2).otherwise(F.octet_length("text")).cast("long").alias("length"), F.when(is_file, "Y").otherwise("N").alias("binary"),
        F.when(F.coalesce(again, F.lit(False)), "Y").otherwise("N").alias("double"), F.col("kind").alias("encoding"), F.coalesce(F.when(is_file, media_type(F.col("raw"))), F.lit("text")).alias("file_type"),
        F.col("of.event").alias("event"), "record_id", "file",
    )
