"""Base64 payloads: classification against Python's own decoder, and the ten kinds of events."""

import base64
import random

from pyspark.sql import functions as F

from tracewell.functions import payload
from tracewell.operators.detect import resolver


def kind_of(raw: bytes) -> str:
    if len(raw) >= 5:
        for name, codec in (("UTF-16 LE", "utf-16-le"), ("UTF-16 BE", "utf-16-be"), ("UTF-8", "utf-8")):
            try:
                if raw.decode(codec).isascii():
                    return name
            except UnicodeDecodeError:
                continue
    return "Binary" if any(raw.startswith(bytes.fromhex(m)) for m, _ in payload.MAGIC) else "Unknown"


def test_classification(spark):
    rng = random.Random(3)
    raws = [b"", b"abcd", b"abcde", "héllo wörld".encode(), "text\n\x7f".encode("utf-16-le"), "text!".encode("utf-16-be"), b"\xff\xfea\0b\0c\0", b"a\0b\0c", b"PK\x03\x04\xff" + bytes(9), b"MZ\x90\0\x03", b"\0" * 12]
    raws += [bytes(rng.choices(range(256), k=rng.randint(0, 12))) for _ in range(40)] + ["".join(rng.choices("ab \n", k=9)).encode(rng.choice(["utf-8", "utf-16-le", "utf-16-be"])) for _ in range(20)] + [b"x" * 100_000, ("y" * 100_000).encode("utf-16-le")]
    df = spark.createDataFrame([(base64.b64encode(r).decode().rstrip("="),) for r in raws], "token string")
    got = [r.k for r in df.select(payload.classify(payload.digits(F.col("token"))).alias("k")).collect()]
    assert got == [kind_of(r) for r in raws]


def test_tokens(spark):
    text = "short1 abcdefghijklm abc1def2gh== é1abcdefghijk YWJjZGVmZw YWJjZGVmZx a_b1c2d3e4f5 (YWJj+/12YWJj)"
    got = spark.range(1).select(payload.tokens(F.lit(text)).alias("t")).first().t
    # left out: too short, letters alone, bits left over, a letter that isn't base64, an underscore
    assert got == ["YWJj+/12YWJj"]


def test_kinds_of_events(spark):
    b = lambda s: base64.b64encode(s.encode()).decode()
    own = b("hello world 1")
    rows = [(c, e, {n: f"a {own}" for n in names if isinstance(n, str)}, ["x", "y", f"a {own}"]) for channels, e, names, _ in payload.EVENTS for c in channels]
    rows += [("Security", "4689", {"CommandLine": own}, []), ("System", "7045", {"ImagePath": f"guid-{own}"}, []), ("System", "7045", {"ImagePath": f"{own} and {b('second one 22')}"}, []), ("Security", "4688", {}, [])]
    df = spark.createDataFrame([(None, "pc", c, e, str(i), "f", m, d) for i, (c, e, m, d) in enumerate(rows)], "ts timestamp, computer string, channel string, event_id string, record_id string, file string, event_data map<string,string>, data_array array<string>")
    got = payload.extract(df, resolver(df)).collect()
    fields = sum(len(names) * len(channels) for channels, _, names, _ in payload.EVENTS)
    assert len(got) == fields + 2 and {r.event for r in got} == {x[3] for x in payload.EVENTS} and len(got[0]) == 13
    assert {(r.decoded, r.length, r.encoding, r.file_type, r.double, r.original) for r in got if int(r.record_id) == 0} == {("hello world 1", 13, "UTF-8", "text", "N", "a <Base64String>")}
    assert "Python" not in payload.extract(df, resolver(df))._jdf.queryExecution().executedPlan().toString()
