"""Replacement of many keys at once against plain automata."""

import random

import pytest

from tracewell.functions import enrich


def longest(text, pairs):
    low = {}
    for k, v in pairs.items():
        low.setdefault(k.lower(), v)
    out, i = "", 0
    while i < len(text):
        k = max((k for k in low if k and text[i : i + len(k)].lower() == k), key=len, default=None)
        out, i = (out + low[k], i + len(k)) if k else (out + text[i], i + 1)
    return out


def earliest(text, pairs):
    out, b = "", 0
    for j in range(1, len(text) + 1):
        k = max((k for k in pairs if k and j - len(k) >= b and text[j - len(k) : j] == k), key=len, default=None)
        if k:
            out, b = out + text[b : j - len(k)] + pairs[k], j
    return out + text[b:]


@pytest.mark.parametrize("seed", range(6))
def test_overlapping_keys(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices("abAB.*", k=n))
    pairs = {word(rng.randint(0, 4)): word(rng.randint(0, 3)) for _ in range(7)}
    texts = [word(rng.randint(0, 14)) for _ in range(60)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", enrich.abbreviate(df.t, pairs).alias("a"), enrich.rewrite(df.t, pairs).alias("r")).collect()
    assert [(r.t, r.a, r.r) for r in got] == [(t, None if t is None else longest(t, pairs), None if t is None else earliest(t, pairs)) for t in texts]


def test_values_are_not_looked_at_again(spark):
    df = spark.createDataFrame([("abcd", "11", "Ä")], "a string, b string, c string")
    got = df.select(enrich.abbreviate(df.a, {"a": "b", "b": "z"}), enrich.rewrite(df.b, {"11": "eleven", "1": "one"}), enrich.abbreviate(df.c, {"ä": "x"})).first()
    assert tuple(got) == ("bzcd", "oneone", "Ä")
