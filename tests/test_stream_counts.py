"""Windows over a stream, fed out of order within the watermark, against the batch form."""

import datetime
import json
import os
import random

import pytest

from tracewell.operators.detect import count_windows, resolver
from tracewell.plans.errors import RuleError
from tracewell.plans.rules import rule_of
from tracewell.streaming.counts import count_stream

KIND = "ts timestamp, channel string, event_id string, computer string, provider string, record_id string, file string, f_user string, f_k string"


def made(i, condition, frame):
    return rule_of("inline", {"author": "a", "level": "low", "status": "test", "date": "2024-01-01", "logsource": {}, "title": f"t{i}", "id": f"i{i}", "detection": {"s": {"Channel": "c"}, "condition": f"s | {condition}"} | ({"timeframe": frame} if frame else {})})


RULES = [("count() by user >= 3", "60s"), ("count(k) by user > 1", "90s"), ("count() == 2", "30s"), ("count() by user < 2", "45s")]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows = [{"ts": (start + datetime.timedelta(seconds=3 * i + rng.random() * 100)).isoformat(), "channel": rng.choice("ccd"), "event_id": "1", "computer": "pc", "provider": "p", "record_id": f"{i:04}", "file": "f", "f_user": rng.choice("ab"), "f_k": rng.choice(["x", "y", None])} for i in range(240)]
    rules = [made(i, *r) for i, r in enumerate(RULES)]
    (tmp_path / "in").mkdir()
    for n in range(6):
        part = rows[n * 40 : (n + 1) * 40]
        rng.shuffle(part)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
    late = dict(rows[0], ts=(start + datetime.timedelta(days=1)).isoformat(), record_id="end", channel="c", f_user="z")
    (tmp_path / "in" / "9.json").write_text(json.dumps(late))  # moves the watermark behind all others
    for n, path in enumerate(sorted((tmp_path / "in").iterdir())):
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken by their times
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = count_stream(stream, rules, resolver(stream), delay="3 minutes").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        got = sorted(tuple(r) for r in spark.table("windows").collect() if r.agg_key != "z")
    finally:
        query.stop()
    batch = spark.read.schema(KIND).json(str(tmp_path / "in")).where("record_id <> 'end'")
    want = sorted(tuple(r) for r in count_windows(batch, rules, resolver(batch))[0].collect())
    assert got == want and len({r[0] for r in want}) == len(RULES) and len(want) > 30


def test_frames_are_needed(spark):
    df = spark.createDataFrame([], KIND)
    with pytest.raises(RuleError):
        count_stream(df, [made(0, "count() > 1", None)], resolver(df))


def test_keys_share_calls_and_states(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [{"ts": (start + datetime.timedelta(seconds=7 * i + u % 5)).isoformat(), "channel": "c", "event_id": "1", "computer": "pc", "provider": "p", "record_id": f"{i:02}-{u:03}", "file": "f", "f_user": f"u{u}", "f_k": str(i % 3)} for u in range(300) for i in range(9)]
    rows.append(dict(rows[0], ts=(start + datetime.timedelta(days=1)).isoformat(), record_id="end", f_user="z"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    rules = [made(0, "count(k) by user >= 2", "20s")]
    for buckets, most in ((4, 4), (1 << 12, 301)):
        stream = spark.readStream.schema(KIND).json(str(tmp_path / "in"))
        name = f"shared_{buckets}"
        query = count_stream(stream, rules, resolver(stream), delay="1 minute", buckets=buckets).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        try:
            query.processAllAvailable()
            got = sorted(tuple(r) for r in spark.table(name).collect() if r.agg_key != "z")
            states = max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])
        finally:
            query.stop()
        batch = spark.read.schema(KIND).json(str(tmp_path / "in")).where("record_id <> 'end'")
        assert got == sorted(tuple(r) for r in count_windows(batch, rules, resolver(batch))[0].collect()) and len(got) > 300
        assert 0 < states <= most
