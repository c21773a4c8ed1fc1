"""Truth tables of the rule language, windows against a plain loop, sources, sinks and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators.detect import count_detections, count_rows, for_present_channels, matches, resolver
from tracewell.operators.windows import greedy_windows
from tracewell.plans import rules as R
from tracewell.plans.aggregation import AggSpec, parse_count, parse_frame
from tracewell.plans.condition import compile_condition, tokens
from tracewell.plans.errors import RuleError
from tracewell.plans.leaves import Lists, selection, wildcard_regex
from tracewell.plans.scope import scope_of
from tracewell.sources import files, sinks
from tracewell.streaming.stream import detect_stream

#: selection, field values, does it match
CASES = [
    ({"A": "x"}, {"A": "X"}, True), ({"A": "x"}, {}, False), ({"A|neq": "x"}, {}, True), ({"A|neq": "x"}, {"A": "X"}, False),
    ({"A": "É"}, {"A": "é"}, False), ({"A|contains": "É"}, {"A": "xéx"}, True), ({"A": "*É"}, {"A": "xé"}, True),
    ({"A": "a*c"}, {"A": "a\nbc"}, True), ({"A": "a?c"}, {"A": "a\nc"}, False), ({"A": r"a\*c"}, {"A": "a*c"}, True), ({"A": r"a\*c"}, {"A": "abc"}, False),
    ({"A": r"a\\*"}, {"A": "a\\zz"}, True), ({"A": r"C:\\x"}, {"A": "C:\\x"}, True), ({"A": "ab"}, {"A": "ab\n"}, False),
    ({"A|startswith": "ab"}, {"A": "ABc"}, True), ({"A|endswith": "bc"}, {"A": "aBC"}, True), ({"A|contains|cased": "b"}, {"A": "aBc"}, False), ({"A|cased": "B"}, {"A": "b"}, True),
    ({"A|contains|all": ["a", "z"]}, {"A": "za"}, True), ({"A|contains|all": ["a", "z"]}, {"A": "a"}, False), ({"A|contains": ["a", "z"]}, {"A": "a"}, True),
    ({"A|neq": ["a", "b"]}, {"A": "c"}, True), ({"A|neq": ["a", "b"]}, {"A": "a"}, False),
    ({"A|re": "b.d"}, {"A": "abcd"}, True), ({"A|re": "B"}, {"A": "b"}, False), ({"A|re|i": "B"}, {"A": "b"}, True), ({"A|re": "a.b"}, {"A": "a\rb"}, True), ({"A|re": r"\w+$"}, {"A": "é"}, True),
    ({"A|contains|windash": " -f"}, {"A": "x /f"}, True), ({"A|contains|windash": "-f"}, {"A": "x –f"}, True), ({"A|endswith|windash": "-f"}, {"A": "/f"}, False),
    ({"A|base64|contains": "foobar"}, {"A": "xxZm9vYmFyxx"}, True), ({"A|base64offset|contains": "foobar"}, {"A": "eGZvb2Jhcg=="}, True), ({"A|base64": "foo"}, {"A": "foo"}, True),
    ({"A|wide|base64offset|contains": "ab"}, {"A": "YQBiAA=="}, True),
    ({"A|cidr": "192.168.0.0/24"}, {"A": "192.168.0.77"}, True), ({"A|cidr": "192.168.0.0/24"}, {"A": "192.168.1.1"}, False), ({"A|cidr": "fe80::/10"}, {"A": "FE80::1"}, True), ({"A|cidr": "bad"}, {"A": "1.1.1.1"}, False), ({"A|cidr": "10.0.0.0/8"}, {"A": "x"}, False),
    ({"A|gt": 3}, {"A": "4"}, True), ({"A|gte": 3}, {"A": "3"}, True), ({"A|lt": 3}, {"A": "-1"}, False), ({"A|lte": 3}, {"A": "1.5"}, False), ({"A|lt": 3}, {"A": " 2"}, False),
    ({"A|exists": True}, {"A": "x"}, True), ({"A|exists": False}, {}, True), ({"A|fieldref": "B"}, {"A": "x", "B": "x"}, True), ({"A|fieldref": "B"}, {"A": "x", "B": "X"}, False), ({"A|fieldref": "B"}, {"A": "x"}, False),
    ({"A|fieldref|contains": "B"}, {"A": "xYz", "B": "y"}, True), ({"A|endswithfield": "B"}, {"A": "xY", "B": "y"}, True), ({"A": None}, {}, True), ({"A": None}, {"A": "x"}, False),
    ({"A": {"min_length": 3}}, {"A": "éé"}, True), ({"A": {"regexes": "f"}}, {"A": "xaby"}, True), ({"A": {"allowlist": "f"}}, {"A": "xaby"}, False), ({"A": {"allowlist": "f"}}, {}, True), ({"A": {"value": "q"}}, {"A": "Q"}, True),
    ({"A": True}, {"A": "true"}, True), ({"A": 5}, {"A": "5"}, True), ([{"A": "x"}, {"B": "y"}], {"B": "y"}, True),
]


def test_leaves(spark):
    rows = [(i, v) for i, (_, v, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, event_data map<string,string>").withColumn("data_array", F.array().cast("array<string>")).withColumn("data_string", F.lit(""))
    resolve = resolver(df)
    hit = [F.when(F.col("i") == i, selection(s, resolve, Lists({"f": ["a.?b"]}))) for i, (s, _, _) in enumerate(CASES)]
    got = {r.i: r.p for r in df.select("i", F.coalesce(*hit).alias("p")).collect()}
    assert [(CASES[i], got[i]) for i in got if got[i] != CASES[i][2]] == []


@pytest.mark.parametrize("bad", [{"A|foo": "x"}, {"A|gt": "x"}, {"|neq": "x"}, {"A|re": "(?=x)"}, {"A|re": r"(a)\1"}])
def test_bad_leaves(spark, bad):
    with pytest.raises(RuleError):
        selection(bad, lambda n: F.lit(n), Lists())


def test_expressions_with_escapes(spark):
    """An escaped backslash before a digit is no back reference, an escaped bracket before ? no look-around."""
    df = spark.createDataFrame([("x\\1", "(?=y")], "A string, B string")
    assert df.select(selection({"A|re": r"x\\1"}, F.col, Lists()), selection({"B|re": r"\(\?=y"}, F.col, Lists())).first() == (True, True)
    with pytest.raises(RuleError):
        selection({"A|re": r"(x)\\\1"}, F.col, Lists())


@pytest.mark.parametrize("text", ["a and", "and a", "a b", "not not a", "(a", "a)", "a & b", "x", "", "1 of them"])
def test_bad_conditions(spark, text):
    with pytest.raises(RuleError):
        compile_condition(text, {"a": F.lit(True), "b": F.lit(False)})


@pytest.mark.parametrize("text,want", [("a or b and b", True), ("(a or b) and b", False), ("not b and a", True), ("1 of a*", True), ("all of *", False), ("not (a and b)", True)])
def test_conditions(spark, text, want):
    p = compile_condition(text.replace("all of *", "a and b"), {"a": F.lit(True), "b": F.lit(False)})
    assert spark.range(1).select(p.alias("p")).first().p is want
    assert tokens("a and(b)") == ["a", "and", "(", "b", ")"]


def test_aggregation_text():
    assert parse_count("count(user) by a,b >= 5", "1h") == AggSpec("user", ("a", "b"), ">=", 5, 3600)
    assert parse_count(" count() > 3") == AggSpec(None, (), ">", 3, None)
    assert [parse_frame(x) for x in ("15s", "2d", "7", "x", None)] == [15, 172800, 7, None, None]
    for bad in ("sum(x) > 1", "count(a.b) > 1", "count() >", "count() by a.b > 1"):
        with pytest.raises(RuleError):
            parse_count(bad)


def loop(rows, frame, holds, distinct):
    out, i = [], 0
    while i < len(rows):
        r = max(j for j in range(i, len(rows)) if rows[j][0] - rows[i][0] <= frame)
        c = len({v for _, v in rows[i : r + 1]}) if distinct else r - i + 1
        if holds(c):
            out.append((rows[i][0], c))
            i = r + 1
        else:
            i += 1
    return out


@pytest.mark.parametrize("op,n,distinct", [(">=", 3, False), ("==", 2, False), ("<", 2, False), (">", 1, True), ("<=", 1, True)])
def test_windows(spark, op, n, distinct):
    rng = random.Random(n)
    data = [(k, rng.randrange(60) * 1_000_000, i, str(rng.randrange(3))) for k in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(data, "k string, t long, tie int, v string")
    got = greedy_windows(df, ["k"], "t", AggSpec("v" if distinct else None, ("k",), op, n, 5), value="v" if distinct else None, ties=["tie"])
    holds = {">=": lambda c: c >= n, "==": lambda c: c == n, "<": lambda c: c < n, ">": lambda c: c > n, "<=": lambda c: c <= n}[op]
    want = [(k, *x) for k in ("a", "b") for x in loop([(t, v) for kk, t, i, v in sorted(data, key=lambda d: (d[1], d[2])) if kk == k], 5_000_000, holds, distinct)]
    assert sorted((r.k, r.win_start, r.win_count) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("op,n,distinct", [(">=", 4, False), ("==", 12, True)])
def test_windows_over_chunks(spark, op, n, distinct):
    """A key without quiet times, far larger than a chunk, with frames that reach over chunks; equal times and rows."""
    rng = random.Random(n)
    data = [("hot", rng.randrange(100) * 1_000_000, i, str(rng.randrange(40))) for i in range(150)] + [(k, i * 1_500_000, i, str(i % 30)) for k, n_rows in (("cold", 5), ("warm", 40), ("mild", 75)) for i in range(n_rows)]
    df = spark.createDataFrame(data, "k string, t long, tie int, v string").repartition(3)
    got = greedy_windows(df, ["k"], "t", AggSpec("v" if distinct else None, ("k",), op, n, 9 if distinct else 4), value="v" if distinct else None, ties=["tie"], chunk=16)
    holds = {">=": lambda c: c >= n, "==": lambda c: c == n}[op]
    want = [(k, *x) for k in ("hot", "cold", "warm", "mild") for x in loop([(t, v) for kk, t, i, v in sorted(data, key=lambda d: (d[1], d[2])) if kk == k], (9 if distinct else 4) * 1_000_000, holds, distinct)]
    assert sorted((r.k, r.win_start, r.win_count) for r in got.collect()) == sorted(want) and len(want) > 4


def test_windows_empty_and_open(spark):
    df = spark.createDataFrame([("a", 0, ""), ("a", 9_000_000, ""), ("a", 9_500_000, "")], "k string, t long, v string")
    assert [r.n_rows for r in greedy_windows(df, ["k"], "t", AggSpec(None, (), ">=", 1)).orderBy("win_start").collect()] == [2, 1]
    assert greedy_windows(df.limit(0), ["k"], "t", AggSpec(None, (), ">=", 1, 5)).count() == 0


IDS = ["00000000-0000-0000-0000-00000000000" + str(i) for i in range(4)]


def test_rule_lists(tmp_path):
    (tmp_path / "exclude_rules.txt").write_text(f"# left out\n{IDS[0]} # why\nno id\n\n")
    (tmp_path / "noisy_rules.txt").write_text(IDS[1])
    (tmp_path / "proven_rules.txt").write_text("\n".join(IDS[:3]))
    rules = [R.parse_rules(RULE.replace("id: i", f"id: {i}"))[0] for i in IDS]
    left = lambda **k: [IDS.index(r.rule_id) for r in R.listed_rules(rules, str(tmp_path), **k)]
    assert left() == [2, 3] and left(noisy=True) == [1, 2, 3] and left(proven=True) == [2] and R.read_ids(str(tmp_path / "none")) == set()


RULE = "title: t\nid: i\nauthor: a\nlevel: low\nstatus: test\ndate: 2024-01-01\nlogsource: {}\ndetection: {s: {EventID: 7, Answer: yes}}\n"


def test_rules(tmp_path):
    (tmp_path / "a.yml").write_text(RULE + "---\n" + RULE.replace("id: i", "id: j"))
    (tmp_path / "bad.yml").write_text(RULE.replace("level: low", "level: huge"))
    found, errors = R.load_rules(str(tmp_path))
    assert [r.rule_id for r in found] == ["i", "j"] and len(errors) == 1
    assert found[0].raw["date"] == "2024-01-01" and found[0].raw["detection"]["s"] == {"EventID": 7, "Answer": "yes"}
    assert R.tuned(found, {"i": "high"})[0].level == "high" and R.load_counts(found)["status"]["test"] == 2
    assert R.parse_rules(RULE.replace("Answer: yes", "'Answer|expand': '%x%'")) == []
    assert R.placeholders([{"detection": {"s": {"A|expand": "%x%"}}}]) == ["x"]
    assert R.for_channels(R.parse_rules(RULE.replace("EventID: 7", "Channel: Sec")), {"sys"}) == []


def test_wildcards_against_a_matcher():
    import re

    rng = random.Random(1)

    def naive(p, s):
        if not p:
            return not s
        if p[0] == "*":
            return naive(p[1:], s) or (bool(s) and naive(p, s[1:]))
        return bool(s) and (p[0] == "?" and s[0] != "\n" or p[0] == s[0]) and naive(p[1:], s[1:])

    for _ in range(500):
        p, s = "".join(rng.choice("ab*?.") for _ in range(5)), "".join(rng.choice("ab.\n") for _ in range(5))
        assert bool(re.fullmatch(wildcard_regex(p), s)) == naive(p, s)


def test_sources_sinks_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    one = {"@timestamp": "2024-01-01T00:00:00.123Z", "EventID": 7, "Channel": "Sys", "Hostname": "h", "Answer": " yes ", "tags": ["x"]}
    (src / "a.jsonl").write_text(json.dumps(one) + "\n\n{broken\n" + json.dumps({"result": one}) + "\n")
    (src / ".hidden.jsonl").write_text(json.dumps(one))
    rows = files.json_lines(spark, str(src))
    assert rows.count() == 2 and {(r.event_id, r.channel, r.computer, r.event_data["Answer"], r.event_data.get("tags")) for r in rows.collect()} == {("7", "Sys", "h", "yes", None)}
    (tmp_path / "b.json").write_text(json.dumps([one, one]))
    (tmp_path / "c.json").write_text(json.dumps(one) + "\n" + json.dumps(one))
    assert files.json_files(spark, str(tmp_path / "b.json")).count() == files.json_files(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "d.json").write_text(json.dumps({"fields": ["EventID", "Channel"], "rows": [["1", "x"], ["2", "y"]]}))
    assert {r.event_id for r in files.export_rows(spark, str(tmp_path / "d.json")).collect()} == {"1", "2"}
    found = detect_stream(rows, R.parse_rules(RULE)).select("event_id", "rule_id")
    assert found.count() == 2
    sinks.write_csv(found, str(tmp_path / "csv"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "csv")).distinct().collect()) == ['"event_id","rule_id"', '7,"i"']
    with pytest.raises(Exception, match="already exists"):
        sinks.write_csv(found, str(tmp_path / "csv"))
    sinks.write_json_lines(found, str(tmp_path / "jsonl"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "jsonl")).collect()] == [{"event_id": 7, "rule_id": "i"}] * 2
    sinks.html_report({"Found": found}, str(tmp_path / "r.html"))
    assert "<td>7</td>" in (tmp_path / "r.html").read_text()
    rows.write.parquet(str(tmp_path / "parquet"))
    stream = detect_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "parquet")), R.parse_rules(RULE)).select("event_id")
    query = stream.writeStream.format("memory").queryName("found").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("found").count() == 2


def test_html_report_is_whole(spark, tmp_path):
    sinks.html_report({"All": spark.range(450).orderBy("id")}, str(tmp_path / "all.html"))
    page = (tmp_path / "all.html").read_text()
    assert [int(x.split("<")[0]) for x in page.split("<td>")[1:]] == list(range(450)) and "left out" not in page
    sinks.html_report({"Some": spark.range(450)}, str(tmp_path / "some.html"), rows=200)
    page = (tmp_path / "some.html").read_text()
    assert page.count("<td>") == 200 and "250 more rows are left out" in page


def test_scopes():
    def scope(**detection):
        return scope_of(R.Rule("p", {"detection": detection}, "i", "t")).channels

    one, two = {"Channel": "A"}, {"Channel": ["B", "C*"], "x": "y"}
    assert scope(s=one) == {"A"} and scope(s=two) == {"B", "C*"} and scope(s=[one, two]) == {"A", "B", "C*"}
    assert scope(s=one, t=two, condition="s or t") == {"A", "B", "C*"} and scope(s=one, t=two, condition="s and t") == {"A"}
    assert scope(s=one, t={"x": "y"}, condition="s and not t") == {"A"} and scope(s=one, t={"x": "y"}, condition="s or t") is None
    assert scope(s=one, condition="not s") is None and scope(s={"Channel|neq": "A"}) is None and scope(s={"Channel": None}) is None
    assert scope(s=[one, {"x": "y"}]) is None and scope(s=["word"]) is None and scope(s=one, condition="nope") is None


def test_matches_by_scope_are_those_of_each_predicate(spark):
    detections = [
        {"s": {"Channel": "a", "x": "1"}}, {"s": {"Channel": "A"}}, {"s": {"x": "2"}}, {"s": {"Channel": "b*"}}, {"a": {"Channel": "a"}, "condition": "not a"},
        {"s": {"Channel": ["a", "bc"]}, "t": {"x": "2"}, "condition": "s and not t"},
    ]
    rules = [R.Rule("p", {"detection": d}, str(i), "t") for i, d in enumerate(detections)]
    rows = [(f"{c}{x}", c, {"x": x}) for c in ("a", "A", "bc", "d", None, "") for x in ("1", "2", None)]
    df = spark.createDataFrame(rows, "record_id string, channel string, event_data map<string,string>").withColumn("data_array", F.array().cast("array<string>")).withColumn("data_string", F.lit(""))
    resolve = resolver(df)
    for chosen in (rules, rules[:2] + rules[3:4] + rules[5:], []):
        want = sorted((r.record_id, i) for i, rule in enumerate(chosen) for r in df.where(rule.predicate(resolve)).collect())
        assert sorted((r.record_id, r.rule_no) for r in matches(df, chosen, resolve).collect()) == want


def test_present_channels(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "channel string")
    rules = [R.Rule("p", {"detection": {"s": {"Channel": c}}}, c, "t") for c in ("A", "*z*")]
    kept, left = for_present_channels(df, rules, resolver(df))
    assert [r.channel for r in kept.collect()] == ["a"] and [r.rule_id for r in left] == ["A"]
    kept, left = for_present_channels(df, rules, resolver(df), most=2)
    assert kept.count() == 3 and len(left) == 2
    kept, left = for_present_channels(df.limit(0), rules, resolver(df))
    assert kept.count() == 0 and left == []


@pytest.mark.parametrize("op", ["==", ">=", "<", "<="])
def test_count_rows_hold_the_records_of_their_windows(spark, op):
    rng = random.Random(op)
    rows = [(rng.randrange(12), rng.choice("kl"), f"r{i:03}", rng.choice("xyz")) for i in range(120)]
    df = spark.createDataFrame(rows, "s int, key string, record_id string, computer string")
    df = df.select(F.timestamp_seconds("s").alias("ts"), F.create_map(F.lit("key"), "key").alias("event_data"), "record_id", "computer", F.lit("c").alias("channel"), F.col("record_id").alias("event_id"), F.lit("f").alias("file"))
    rule = R.Rule("p", {"detection": {"s": {"Channel": "c"}}}, "i", "t", agg=AggSpec(None, ("key",), op, 7, 1))
    made = count_rows(df, rule, count_detections(df, rule, resolver(df)), resolver(df)).collect()
    want = []
    for key in "kl":
        mine = sorted((s, r, c) for s, k, r, c in rows if k == key)
        at = 0
        while at < len(mine):
            inside = [m for m in mine[at:] if m[0] <= mine[at][0] + 1]
            holds = {"==": len(inside) == 7, ">=": len(inside) >= 7, "<": len(inside) < 7, "<=": len(inside) <= 7}[op]
            if holds:
                want.append((" ¦ ".join(sorted({m[2] for m in inside})), " ¦ ".join(sorted(m[1] for m in inside)), f"Count:{len(inside)} ¦ by:{key}"))
            at += len(inside) if holds else 1
    assert sorted((r.computer, r.event_id, r.details) for r in made) == sorted(want)


def test_nested_values(spark):
    raw = '{"Event":{"System":{"a":1},"EventData":{"x":" q ","Data":["u",null,{"k":true}],"n":{"m":[[1,2],[3]]}}},"xmlns":"z"}'
    df = spark.createDataFrame([(raw,), ("5",), (None,), ("{}",)], "raw string").select(F.try_parse_json("raw").alias("v"))
    got = [[tuple(p) for p in r[0]] for r in df.select(text.leaves(F.col("v"))).collect()]
    assert got == [[("Data[1]", "u"), ("k", "true"), ("m[1]", "1"), ("m[2]", "2"), ("m[1]", "3"), ("x", " q ")], [], [], []]
    assert [tuple(p) for p in df.select(text.leaves(F.col("v"), 4)).first()[0]][2] == ("m", "[[1,2],[3]]")


def test_templates_that_are_data(spark):
    df = spark.createDataFrame([("A %x% b %Data[2]% %zz%",), ("plain",), (None,), ("",), ("%x%",)], "t string")
    filled = text.template_of(F.col("t"), F.create_map(F.lit("x"), F.lit("1  2")), F.array(F.lit("d1"), F.lit("d2")))
    assert [r[0] for r in df.select(filled).collect()] == ["A 1 2 b d2 n/a", "plain", None, "", "1 2"]
