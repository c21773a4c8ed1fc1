"""Repeats over ranges of a timeline against a loop."""

import random

import pytest

from tracewell.operators import timeline


def loop(rows, by):
    last, out = {}, []
    for r in rows:
        part = r[0] if by else None
        before = last.get(part)
        out.append((*r[:2], *["DUP" if before and v == b and v not in ("-", "") and v is not None else v for v, b in zip(r[2:], before or r[2:], strict=True)]))
        last[part] = r[2:]
    return out


@pytest.mark.parametrize("by", [None, ["k"]])
@pytest.mark.parametrize("size", [5, 1000])
def test_repeats(spark, monkeypatch, by, size):
    monkeypatch.setattr(timeline, "RANGE_ROWS", size)
    rng = random.Random(size)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(["x", "x", "y", "-", "", None]), rng.choice(["p", "q"])) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, n int, v string, w string").repartition(3)
    made = timeline.mark_repeats(df, ["v", "w"], ["n"], by)
    assert sorted(map(tuple, made.collect()), key=lambda r: r[1]) == loop(rows, by)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert timeline.mark_repeats(df.limit(0), ["v"], ["n"], by).count() == 0
