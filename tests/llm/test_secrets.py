"""The trigram index against scans of every text."""

import random
import re

import pytest

from tracewell.llm import secret_scan as S

PATTERNS = [r"(?i)token=[a-z]+", r"(?i)secret", r"(?i:É)xyz", r"(?i)abc(?-i:kit)+", r"(?ai)secret key", r"foo(?i:bar|ſun)baz", r"(?i)[ks]ey=\d", r"(?i)xmas|İz", r"(abc|def)+gh?i", r"^no$", r"a{3,}b", r"(?:x(?i:T)oken){2}"]
TEXTS = ["toKen=abc", "ſecret", "SECRET", "éxyz Éxyz", "ABCkitkit abcKIT", "Secret Key", "fooBARbaz fooſUNbaz fooSunbaz", "Key=1 ſey=2", "XMAſ", "izİZ", "abcdefghi abcgi", "no", "aaaaab", "xtokenxToken", "", "secret key"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_index_loses_nothing(pattern, monkeypatch):
    rng = random.Random(pattern)
    texts = TEXTS + [" ".join(rng.choices(TEXTS, k=40)) for _ in range(20)]
    for step in (1 << 20, 16):  # the second cuts texts into pieces
        monkeypatch.setattr(S, "STEP_BYTES", step)
        found = S.Index((S.Rule("r", pattern),)).scan([t.encode() for t in texts])
        assert [[(a, b) for a, _, _, b in x] for x in found] == [[m.span() for m in re.finditer(pattern, t)] for t in texts]


def test_rules_keep_their_trigrams():
    assert S.trigrams(S.trigram_query("(?ai)secret"))
    assert S.trigram_query("(?i)secret") == S._all([b"ecr", b"cre", b"ret"])


def test_nulls_repeats_and_clashing_columns(spark):
    long = "x" * 1_200_000 + " password=abcdefgh " + "0" * 30
    rows = [(1, None), (1, None), (None, "token: abcdef"), (2, ""), (3, long), (3, long)]
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, n_hex int, kind string")
    got = sorted(((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.spans) for r in S.report(df).collect()))
    assert got == sorted([("1", 0, 0, 0, ""), ("1", 0, 0, 0, ""), ("None", 1, 0, 0, "assign:0:13"), ("2", 0, 0, 0, "")] + 2 * [("3", 1, 0, 1, f"assign:1200001:1200018,hex:1200019:{len(long)}")])
    assert S.report(df.limit(0)).count() == 0
