"""Fingerprints against a plain version that counts bytes window by window."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import fingerprints as f

W = f.WINDOW


def slow_class(window):
    total = sum(round(c * math.log2(c) * (1 << 20)) for c in Counter(window).values())
    return (round(W * math.log2(W) * (1 << 20)) - total) * 1000 // round(W * math.log2(W) * (1 << 20))


def slow_classes(raw):
    return [slow_class(raw[i : i + W]) for i in range(len(raw) - W + 1)]


def slow_ranks(texts):
    n = Counter(c for t in texts for c in slow_classes(t))
    order = sorted(range(1001), key=lambda c: (n[c], c))
    return {c: i for i, c in enumerate(order) if c >= f.LEAST_CLASS}


def slow_features(raw, ranks):
    """Windows as bytes, in order, each once."""
    keys = [(ranks.get(c, math.inf), i) for i, c in enumerate(slow_classes(raw))]
    told = Counter()
    for s in range(1 - W, len(keys)):
        run = [k for k in keys[max(0, s) : s + W] if k[0] < math.inf]
        if run:
            told[min(run)[1]] += 1
    out = list(dict.fromkeys(raw[i : i + W] for i in sorted(told) if told[i] >= f.MENTIONS))
    return out or ([raw] if raw else [])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeghinorstuläß") for _ in range(rng.randint(2, 9))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    return [words(rng, n) for n in (60, 3, 200, 120, 120, 40)] + ["", "a", "a" * 500, "x" * 31, "y" * 32, "käse " * 80]


def test_features_and_filters():
    raw = [t.encode() for t in corpus()]
    table = slow_ranks(raw)
    ranks = np.array([table.get(c, int(f._NEVER)) for c in range(1001)], dtype=np.int32)
    for text, got in zip(raw, f.fingerprints(raw, ranks), strict=True):
        want = slow_features(text, table)
        assert got.features == len(want)
        bits = np.zeros((-(-len(want) // f.CHAIN), f.FILTER_BITS), dtype=np.uint8)
        for i, w in enumerate(want):
            h = int(f._window_hashes(np.frombuffer(w, dtype=np.uint8), np.array([0]))[0]) if len(slow_features(text, table)) > 1 or w != text else f._short_hash(text)
            for p in range(f.PROBES):
                bits[i // f.CHAIN, (h >> (11 * p)) & (f.FILTER_BITS - 1)] = 1
        assert np.array_equal(np.packbits(bits, axis=1), got.filters)


def test_classes_across_chunks(monkeypatch):
    raw = words(random.Random(6), 300).encode()
    whole, told = f.entropy_classes(np.frombuffer(raw, dtype=np.uint8)), None
    assert whole.tolist() == slow_classes(raw)
    line = np.arange(len(whole), dtype=np.int32) * 7919 % 1000
    told = f._mentions(line)
    monkeypatch.setattr(f, "_CHUNK", 97)
    assert f.entropy_classes(np.frombuffer(raw, dtype=np.uint8)).tolist() == whole.tolist()
    assert f._mentions(line).tolist() == told.tolist()


def slow_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    return [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)]


@pytest.mark.parametrize("range_bytes", [1 << 22, 600])
def test_every_row_and_its_successor(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(f, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(f, "STEP_BYTES", 900)
    rows = [(3 * i, t) for i, t in enumerate(corpus())] + [(100, None), (None, "no id"), (None, "none either"), (7, "same"), (7, "id"), (7, "id")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, 0, True, "e") for i, t in rows], "doc_id long, text string, bucket int, guest boolean, id string").repartition(5)
    got = f.compare(df).collect()
    ranks = f.rarity(df)
    table = slow_ranks([(t or "").encode() for _, t in rows])
    assert [int(r) for r in ranks] == [table.get(c, int(f._NEVER)) for c in range(1001)]
    want = []
    for i, a, b in slow_next(rows):
        half = len(a) // 2
        e = a[: len(a) - half] + b[:half]
        x, y, z = f.fingerprints([a.encode(), e.encode(), b.encode()], ranks)
        want.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), str(x), str(y), f.likeness(x, y), f.likeness(x, z)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_likeness():
    rng = random.Random(9)
    a, b = words(rng, 3000), words(rng, 3000)
    ranks = np.arange(1001, dtype=np.int32)
    x, y, half, same = f.fingerprints([a.encode(), b.encode(), (a[: len(a) // 2] + b[: len(b) // 2]).encode(), a.encode()], ranks)
    assert str(x) == str(same) and f.likeness(x, same) == 1
    assert f.likeness(x, y) < 0.05 and 0.35 < f.likeness(x, half) < 0.65 and f.likeness(x, half) == f.likeness(half, x)
    none = f.fingerprints([b""], ranks)[0]
    assert f.likeness(none, none) == 1 and f.likeness(none, x) == 0 == f.likeness(x, none)
    assert f.Fingerprint.parse(str(x)).filters.tolist() == x.filters.tolist() and base64.b64decode(str(x).split(":")[1]) == x.filters.tobytes()


def test_one_row_and_none(spark):
    one = f.compare(spark.createDataFrame([(5, "abc")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in one] == [(5, 3, hashlib.sha256(b"aba").hexdigest(), 1.0)]
    assert f.compare(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text(spark):
    rng = random.Random(2)
    long = words(rng, 400_000)  # some 2.6 MB
    got = {r.doc_id: r for r in f.compare(spark.createDataFrame([(1, long), (2, "short text"), (3, long)], "doc_id long, text string")).collect()}
    assert got[1].fingerprint == got[3].fingerprint and got[3].near_next == 1.0  # the last is followed by the first
    assert got[1].near_edited > 0.4 and got[1].near_next < 0.05
