"""Many count rules in one pass: windows against a loop, and how often the records are read."""

import random
import re

from pyspark.sql import functions as F

from tests.test_engine import loop
from tracewell.operators import windows
from tracewell.operators.detect import resolver, timeline_rows
from tracewell.operators.windows import rule_windows
from tracewell.plans.aggregation import AggSpec
from tracewell.queries import RULES, _many_counts
from tracewell.plans.rules import parse_rules
from tracewell.sources.records import from_events

DIR = "/root/testdata/sf0.001"


def test_windows_of_many_rules(spark):
    """Small and large groups beside each other, with and without frames and fields."""
    rng = random.Random(8)
    specs = [AggSpec(f, ("k",), op, n, frame) for f in (None, "v") for op, n in ((">=", 3), ("==", 2), ("<", 3), (">", 1), ("<=", 2)) for frame in (4, 11, None)]
    data = [(r, k, rng.randrange(40) * 500_000, i, rng.choice([None, "x", "y", "z", ""])) for r in range(len(specs)) for k, n in (("a", 3), ("b", 21), (r"c\d", 8)) for i in range(n)]
    df = spark.createDataFrame(data, "rule_no int, k string, t long, tie int, v string").repartition(5)
    for chunk in (1 << 16, 8):
        got = rule_windows(df, ["k"], "t", specs, value="v", ties=["tie"], chunk=chunk).collect()
        want = []
        for r, s in enumerate(specs):
            for k in ("a", "b", r"c\d"):
                mine = sorted((x for x in data if x[:2] == (r, k)), key=lambda x: (x[2], x[3]))
                rows = [(t, v or "") for _, _, t, _, v in mine]
                holds = {">=": lambda c: c >= s.number, "==": lambda c: c == s.number, "<": lambda c: c < s.number, ">": lambda c: c > s.number, "<=": lambda c: c <= s.number}[s.op]
                if s.frame is not None:
                    want += [(r, k, *x) for x in loop(rows, s.frame * 1_000_000, holds, s.field is not None)]
                else:
                    want += [(r, k, *x) for x in open_loop(rows, holds, s.field is not None)]
        assert sorted((x.rule_no, x.k, x.win_start, x.win_count) for x in got) == sorted(want)


def test_large_groups_by_slots(spark, monkeypatch):
    """Framed rules of large groups in slots, without the tables of ranges; with slots that are too full the same by ranges."""
    rng = random.Random(5)
    specs = [AggSpec(f, ("k",), op, n, frame) for f in (None, "v") for op, n in ((">=", 3), ("==", 2), ("<", 3)) for frame in (0, 4, 9)]
    data = [(r, k, rng.randrange(n) * 750_000, i, rng.choice([None, "x", "y"])) for r in range(len(specs)) for k, n in (("a", 120), ("b", 9)) for i in range(n)]
    df = spark.createDataFrame(data, "rule_no int, k string, t long, tie int, v string").repartition(5)
    made, real = [], windows.cut
    monkeypatch.setattr(windows, "cut", lambda t, name: made.append(name) or real(t, name))
    found = lambda chunk: sorted(tuple(x) for x in rule_windows(df, ["k"], "t", specs, value="v", ties=["tie"], chunk=chunk).collect())
    whole = found(1 << 16)
    assert len(whole) > 200 and found(10) == whole and "window-slots" in made and "window-ranges" not in made
    for most in (2, 0):  # some groups, all groups
        monkeypatch.setattr(windows, "_MOST", most)
        assert found(10) == whole and "window-ranges" in made


def open_loop(rows, holds, distinct):
    """Without a frame: up to the last whole second between first and last row, then the rest."""
    first, last = rows[0][0], rows[-1][0]
    edge = first + (last - first) // 1_000_000 * 1_000_000
    out, i = [], 0
    while i < len(rows):
        z = edge if rows[i][0] <= edge else last
        r = max(j for j in range(i, len(rows)) if rows[j][0] <= z)
        c = len({v for _, v in rows[i : r + 1]}) if distinct else r - i + 1
        if holds(c):
            out.append((rows[i][0], c))
        i = r + 1 if holds(c) else i + 1
    return out


def test_one_scan(spark):
    records = from_events(spark, DIR)
    rows, errors = timeline_rows(records, [*parse_rules(RULES), *[r for r, _ in _many_counts()]], resolver(records))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^\]]*\].*events\.parquet", plan)) == 1 and not errors
    assert rows.where(F.col("rule_id").startswith("m")).count() > 20
