"""CSV and JSON lines against Python's own readers, the logon outputs."""

import csv
import json

from pyspark.sql import functions as F

from tracewell.operators import reports
from tracewell.operators.detect import resolver
from tracewell.sources import sinks


def test_csv(spark, tmp_path):
    values = ["1", "-2.5", "1e5", ".5", "+3.", "NaN", "inf", "1,5", "", None, 'say "x"', "a\n b", " 7 ", "0x1", "1_0"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], 'v string, `n "q"` int')
    lines = [r.value for r in sinks.csv_text(df).collect()]
    assert [next(csv.reader([x]))[0] for x in lines] == [" ".join((v or "").split()) for v in values]
    quoted = [x.startswith('"') for x in lines]
    assert quoted == [False] * 7 + [True] * 5 + [False, True, True]
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"))
    rows = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert rows[0] == '"v","n ""q"""' and len(rows) == len(values) + 1
    assert sinks.csv_text(df, multiline=True).where("value like '%\n%'").count() == 1


def test_json(spark):
    rows = [
        ("1", "a: 1 ¦ b: x: y ¦ a: true ¦ c: \"q", "T1 ¦ T2", ""), ("x", "-", "", "k: v"), ("true", "no fields here", None, None), (None, "a: 1 ¦ a: 1", "T", "plain"), ("9" * 30, "d[1]: é\\n ¦ d[2]: ", "T", "k: 05"),
    ]
    df = spark.createDataFrame(rows, "RecordID string, Details string, MitreTags string, ExtraFieldInfo string")
    for lines in (True, False):
        got = [json.loads(r.value) for r in sinks.json_timeline(df, lines=lines).collect()]
        assert got == [
            {"RecordID": 1, "Details": {"a": ["1", "true"], "b": "x: y", "c": '"q"'}, "MitreTags": ["T1", "T2"], "ExtraFieldInfo": {}},
            {"RecordID": "x", "Details": {}, "ExtraFieldInfo": {"k": "v"}}, {"RecordID": True, "Details": "no fields here"},
            {"Details": {"a": ["1", "1"]}, "MitreTags": ["T"], "ExtraFieldInfo": {}}, {"RecordID": "9" * 30, "Details": {"d[1]": "é\\n", "d[2]": ""}, "MitreTags": ["T"], "ExtraFieldInfo": {"k": 5}},
        ]
    assert list(json.loads(sinks.json_timeline(df).first().value)["Details"]) == ["a", "b", "c"]


def test_logon_outputs(spark, tmp_path):
    rows = [("Security", "4624", {"TargetUserName": "a'b"}, 5), ("Security", "4625", {"TargetUserName": "ab"}, 6), ("Security", "4624", {"TargetUserName": "ab"}, 7), ("Security", "1", {}, 8), (reports.ROUTES[2][0], "21", {"UserDataUser": "X\\Y\\z"}, 9), (reports.ROUTES[4][0], "302", {"RdsGtwUsername": "alone"}, None)]
    df = spark.createDataFrame([(c, e, "pc", m, t) for c, e, m, t in rows], "channel string, event_id string, computer string, event_data map<string,string>, t long").withColumn("ts", F.timestamp_seconds("t"))
    made = reports.logons(df, resolver(df))
    out = {k: v.collect() for k, v in reports.logon_outputs(made).items()}
    assert [(r.n, r.event, r.user) for r in out["failed"]] == [(1, "Sec 4625", "ab")]
    assert {(r.n, r.event, r.user, r.domain) for r in out["successful"]} == {(2, "Sec 4624", "ab", "-"), (1, "RDS-LSM 21", "z", "X\\Y"), (1, "RDS-GTW 302", "alone", "-")}
    sinks.write_logons(made, str(tmp_path / "logons"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "logons-successful")).count() == 3


def test_exports_with_another_header(spark, tmp_path):
    from tracewell.operators import timeline
    from tracewell.sources import files

    (tmp_path / "a.csv").write_text('"Timestamp","Rule"\n"2024-01-02 00:00:00.000 +00:00","x, ""y"""\n')
    (tmp_path / "b.csv").write_text('"Timestamp","Rule"\n"2024-01-01 00:00:00.000 +00:00","z"\n')
    (tmp_path / "c.csv").write_text("Timestamp,Other\n1,2\n")
    (tmp_path / "d.csv").write_text("")
    at = [str(tmp_path / f"{n}.csv") for n in "abcd"]
    rows, out = files.read_exports(spark, at)
    assert out == at[2:] and [r.Rule for r in timeline.sort_export(rows).collect()] == ["z", 'x, "y"']
    assert files.read_exports(spark, at[3:])[1] == at[3:]
