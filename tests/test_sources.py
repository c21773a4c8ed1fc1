"""JSON files split inside, and files that are left out by their first record's channel."""

import json
import random

import pytest

from tracewell.operators.detect import detections, resolver
from tracewell.plans.rules import parse_rules
from tracewell.sources import files, prune
from tracewell.queries import RULES


def record(i, rng):
    parts = ["}{", '"', "\\", "a", "[", "]", " {x} ", "\n", "é", '\\"', "},\n{"]
    return {"Channel": "c", "EventID": i, "RecordNumber": i, "Msg": "".join(rng.choices(parts, k=rng.randint(0, 30))), "In": {"a": {"b": i}}, "L": [{"z": 1}, {}]}


@pytest.mark.parametrize("block", [97, 400, 1 << 27])
def test_objects_across_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    told = [record(i, rng) for i in range(90)]
    (tmp_path / "array.json").write_text(json.dumps(told[:40], indent=1))
    (tmp_path / "behind.json").write_text("".join(map(json.dumps, told[40:80])) + "\n")
    (tmp_path / "spread.json").write_text("\n\n".join(json.dumps(x, indent=2, ensure_ascii=False) for x in told[80:]))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text("[]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        df = files.json_files(spark, str(tmp_path))
        got = {int(r.record_id): r for r in df.collect()}
        assert len(df.collect()) == len(told)
        tasks = files.read_text(spark, str(tmp_path), line_end="}").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {i: r.event_data["Msg"] for i, r in got.items()} == {x["RecordNumber"]: x["Msg"].strip() for x in told}
    assert got[7].event_data["b"] == "7" and (block > 1 << 20 or tasks > 10)


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_objects_across_ranges(spark, tmp_path, monkeypatch, batch):
    """Objects that lie in one batch of pieces are joined there; only the others are brought together by a shuffle."""
    rng = random.Random(batch)
    told = [record(i, rng) for i in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(told[:30]))
    (tmp_path / "b.json").write_text("".join(json.dumps(x, indent=1) for x in told[30:]))
    made, real, kind = {}, files.cut, "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(files, "cut", lambda df, name: made.setdefault(name, real(df, name)))
    before = spark.conf.get(kind)
    spark.conf.set(kind, batch)
    try:
        df = files.json_files(spark, str(tmp_path))
    finally:
        spark.conf.set(kind, before)
    assert {int(r.record_id): r.event_data["Msg"] for r in df.collect()} == {x["RecordNumber"]: x["Msg"].strip() for x in told} and df.count() == 60
    apart = made["json-objects"].where("not (begins and ends)").count()
    assert apart <= 4 if batch == 10_000 else apart > 10


def test_braces_in_strings(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Msg":"if (x) {a}   {b}"}{"Msg":"}{"} {"Msg": "\\\\"}{"Msg":"x"')
    assert [r.event_data["Msg"] for r in files.json_files(spark, str(tmp_path)).orderBy("file").collect()][:3] == ["if (x) {a}   {b}", "}{", "\\"]


def lines(tmp_path):
    for name, channel in (("a", "error"), ("b", "click"), ("c", "signup"), ("d", None)):
        rows = [{"EventID": i, "RecordNumber": f"{name}{i}", "user_id": 3, "k": 60} | ({"Channel": channel} if channel else {}) for i in range(4)]
        (tmp_path / f"{name}.jsonl").write_text("\n" + "\n".join(map(json.dumps, rows)) + "\n")
    return str(tmp_path)


def test_files_of_other_channels_are_not_read(spark, tmp_path):
    rules = parse_rules("---".join(RULES.split("---")[i] for i in (0, 2)))
    place = lines(tmp_path)
    channels = prune.rule_channels(rules)
    assert channels == {"error", "signup", "purchase"}
    read = files.json_lines(spark, place, channels=channels)
    assert sorted({r.record_id[0] for r in read.collect()}) == ["a", "c"]
    scan = read._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.selectedPartitions().totalNumberOfFiles() == 2
    whole = files.json_lines(spark, place)
    key = lambda df: sorted((r.record_id, r.rule_id) for r in detections(df, rules, resolver(df)).collect())
    assert key(read) == key(whole) and key(read)


def test_rules_of_any_channel_read_all_files(spark, tmp_path):
    rules = parse_rules(RULES)  # one of them names no channel
    assert prune.rule_channels(rules) is None and prune.rule_channels([]) is None
    assert files.json_lines(spark, lines(tmp_path), channels=prune.rule_channels(rules)).count() == 16
    assert files.json_lines(spark, lines(tmp_path), channels=["nowhere"]).count() == 0


def test_parquet_files(spark, tmp_path):
    df = spark.createDataFrame([(c, i) for c in ("a", "B", "c") for i in range(5)], "Channel string, n int")
    df.repartition(3, "Channel").sortWithinPartitions("n").write.partitionBy("n").parquet(str(tmp_path / "mixed"))
    for c in ("a", "B", "c"):
        df.where(df.Channel == c).coalesce(1).write.parquet(str(tmp_path / "own" / f"x{c}"))
    assert sorted({r.Channel for r in prune.parquet_files(spark, str(tmp_path / "own"), ["b", "c*"]).collect()}) == ["B", "c"]
    assert prune.parquet_files(spark, str(tmp_path / "own"), None).count() == 15
