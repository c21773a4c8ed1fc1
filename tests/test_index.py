"""The index over many rules against each rule's own predicate."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_engine import CASES
from tracewell.operators.detect import matches, resolver
from tracewell.plans import index
from tracewell.plans.leaves import Lists
from tracewell.plans.rules import rule_of
from tracewell.plans.scope import homes_of

LISTS = Lists({"f": ["a.?b"]})
HEAD = {"author": "a", "level": "low", "status": "test", "date": "2024-01-01", "logsource": {}, "title": "t", "id": "i"}


def made(detection):
    return rule_of("inline", HEAD | {"detection": detection})


def both(spark, rows, detections):
    """Pairs of record and rule by the index, and by each predicate."""
    kind = "i int, channel string, event_id string, event_data map<string,string>"
    df = spark.createDataFrame(rows, kind).withColumn("data_array", F.map_values("event_data")).withColumn("data_string", F.concat_ws(" ", F.map_values("event_data")))
    rules, resolve = [made(d) for d in detections], resolver(df)
    got = {(r.i, r.rule_no) for r in matches(df, rules, resolve, LISTS).select("i", "rule_no").collect()}
    hits = df.select("i", F.array(*[r.predicate(resolve, LISTS) for r in rules]).alias("p")).collect()
    return got, {(r.i, k) for r in hits for k, p in enumerate(r.p) if p}


def test_every_kind_of_leaf(spark):
    rows = [(i, "c", "1", v) for i, (_, v, _) in enumerate(CASES)]
    got, want = both(spark, rows, [d for s, _, _ in CASES for d in ({"s": s}, {"s": s, "condition": "not s"})])
    assert got == want and len(want) > len(CASES)


def test_random_conditions(spark):
    rng = random.Random(4)
    leaf = lambda: rng.choice([
        {"Channel": rng.choice(["A", "b", ["a", "B", "c"], "a*"])}, {"EventID": rng.choice([1, "2", [1, 3]])}, {"x|contains": rng.choice(["o", "tw", ["e", "r"]])},
        {"x|neq": rng.choice(["one", ["one", "two"]])}, {"Channel|neq": "a"}, {"x|startswith": "t", "y": None}, {"x|endswith|cased": "E"}, {"x|re": "^t.*o$"}, {"y|gte": 5},
        {"|all": ["o", "n"]}, ["one", "t?o"], {"Data": ["one", "7"]}, {"x": ["THREE", "t*o"], "EventID|neq": 2}, {"x|contains|all": ["t", "o"]}, {"x": "*"},
    ])
    detections = []
    for _ in range(120):
        names = ["sa", "sb", "t"][: rng.randint(1, 3)]
        text = {1: ["sa", "not sa"], 2: ["sa and not sb", "1 of s*", "not (sa or sb)", "sa or not sb"], 3: ["all of s* and not t", "(sa or sb) and (sb or t)", "not (sa and sb) or t", "1 of s* and t"]}[len(names)]
        detections.append({n: leaf() for n in names} | {"condition": rng.choice(text)})
    rows = [(i, rng.choice(["a", "B", "c", None]), rng.choice(["1", "2", "3", None]), {k: v for k, v in (("x", rng.choice(["One", "two", "THREE", "", None])), ("y", rng.choice(["7", "3", "z", None]))) if v is not None}) for i in range(80)]
    got, want = both(spark, rows, detections)
    assert got == want and len(want) > 500


def test_too_many_alternatives(spark, monkeypatch):
    monkeypatch.setattr(index, "MOST_ALTERNATIVES", 3)
    detections = [{"a": {"x|contains": "o"}, "b": {"x|re": "w"}, "c": {"EventID": 1}, "d": {"EventID": 2}, "condition": c} for c in ("(a or b) and (c or d)", "not (a and b) and not (c and d)")]
    got, want = both(spark, [(i, "c", e, {"x": x}) for i, (e, x) in enumerate([("1", "o"), ("2", "w"), ("3", "o"), ("1", "z")])], detections)
    assert got == want and want


def test_equal_leaves_have_one_number():
    found = index.Numbered()
    one, two = made({"s": {"Channel": "A", "x": ["p", "q"]}}).build(found), made({"s": {"x": ["Q", "P"], "Channel|neq": "a"}}).build(found)
    assert len(found.leaves) == 2 and index.alternatives(one) == [(frozenset({0, 1}), frozenset())] and index.alternatives(two) == [(frozenset({1}), frozenset({0}))]


@pytest.mark.parametrize(("detection", "want"), [
    ({"s": {"Channel": "Sec", "EventID": [1, 2]}}, {("sec", "1"), ("sec", "2")}), ({"s": {"EventID": 4}}, {(None, "4")}), ({"s": {"Channel": "S*"}}, {(None, None)}),
    ({"a": {"Channel": "x"}, "b": {"EventID": 7}, "condition": "a and b"}, {("x", "7")}), ({"a": {"Channel": "x"}, "b": {"EventID": 7}, "condition": "a and not b"}, {("x", None)}),
    ({"a": {"Channel": "x"}, "b": {"EventID": 7}, "condition": "a or b"}, {("x", None), (None, "7")}),
])
def test_homes(detection, want):
    assert homes_of(made(detection)) == want


def test_no_rules(spark):
    assert matches(spark.range(3), [], lambda n: F.lit(n)).columns == ["id", "rule_no"]
