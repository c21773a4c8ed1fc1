"""Source divergence against a dense version in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tracewell.llm import divergence as d


def slow(rows, least, k):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    terms = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low(text or ""))) for lang, source, text in rows]
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, ts in terms:
        docs[lang].update(set(ts))
        count[lang, source].update(ts)
    out = []
    kept = {lang: [t for t, n in docs[lang].items() if n >= least] for lang in {x[0] for x in terms}}
    share = lambda n, total, v: 1 + 1_000_000_000 * (n + 5) // (total + 5 * v)
    p = {}
    for (lang, source), c in count.items():
        total = sum(c[t] for t in kept[lang])
        p[lang, source] = {t: share(c[t], total, len(kept[lang])) for t in kept[lang]}
    for lang, source in p:
        others = [s for of, s in p if of == lang and s != source]
        pairs = [(s, sum(abs(p[lang, source][t] - p[lang, s][t]) for t in kept[lang])) for s in others]
        whole = Counter()
        for (of, _), c in count.items():
            if of == lang:
                whole.update({t: c[t] for t in kept[lang]})
        q = {t: share(whole[t], sum(whole.values()), len(kept[lang])) for t in kept[lang]}
        over = [(t, p[lang, source][t] - q[t]) for t in kept[lang] if count[lang, source][t] and p[lang, source][t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", over, k)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    vocabulary = ["Haus", "haus", "straße", "STRASSE", "x", "y1z", "ünïcode", "İ", "日本", "don't", *[f"w{chr(97 + i)}" for i in range(20)]]
    made = [(rng.choice(["de", "en", None]), rng.choice(["a", "b", "c", "", None]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for _ in range(150)]
    return [*made, ("fr", "a", "only rare terms"), ("fr", "b", None), ("it", "a", ""), *[made[0]] * 5]


@pytest.mark.parametrize(("seed", "least", "k", "few"), [(1, 3, 5, 4096), (2, 30, 50, 4096), (3, 5, 3, 1)])
def test_against_dense_version(spark, monkeypatch, seed, least, k, few):
    monkeypatch.setattr(d, "_PIECE", 10)
    monkeypatch.setattr(d, "_HELD", 7)
    rows = rows_of(seed)
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "lang string, source string, text string, term string, n int, p int").repartition(3)
    got = d.audit(df, least=least, k=k)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == slow(rows, least, k)


@pytest.mark.parametrize("few", [1, 4, 4096])
def test_top_cuts_ties_by_bytes(spark, few):
    rng = random.Random(few)
    rows = []
    for g in ("hot", "small", None):
        n = {"hot": 700, "small": 4}.get(g, 60)
        items = {"".join(rng.choices("abé日", k=rng.randint(0, 6))) for _ in range(n)}
        rows += [(g or "x", i, rng.choice([7, 7, 7, 8, 1_000_000_000, 0])) for i in items]
    got = d.top(spark.createDataFrame(rows, "g string, item string, value long"), ["g"], 9, few=few).collect()
    want = []
    for g in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:9]
        want += [(*r, i + 1) for i, r in enumerate(ranked)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_empty_table(spark):
    assert d.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_very_long_text(spark):
    text = "alpha beta " * 200_000 + "g" * 2_000_000
    got = d.audit(spark.createDataFrame([("en", "a", text), ("en", "b", "alpha beta beta")], "lang string, source string, text string"), least=2).collect()
    assert sorted(tuple(r) for r in got) == slow([("en", "a", text), ("en", "b", "alpha beta beta")], 2, 50)
