"""Byte-level BPE of long words, long texts and other patterns, against tiktoken."""

import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from tracewell.llm import bpe

with open(P.path("byte_bpe_50k.tiktoken"), "rb") as _file:
    RANKS = bpe.parse_ranks(_file.read())
TABLES = bpe.tables(RANKS)


def encoding(pattern=P.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture
def coder():
    c = bpe.Codec(*TABLES, P.PATTERN)
    yield c
    c.close()


def _long_words(rng, n):
    letters = "abcdefghijklmnopqrstuvwxyz"
    yield "".join(rng.choice(letters) for _ in range(n))
    yield "".join(rng.choice(letters + letters.upper()) for _ in range(n))
    yield "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n // 3))
    yield "".join(rng.choice("aheins") * rng.randint(1, 200) for _ in range(n // 90))
    for period in ("a", "aab", "ing", "thein", "".join(rng.choice("thein") for _ in range(7))):
        yield "x" + period * (n // len(period))
    yield "=" + "-" * n


@pytest.mark.parametrize("n", [65, 128, 700, 4000])
def test_long_words(coder, n):
    enc, rng = encoding(), random.Random(n)
    for word in _long_words(rng, n):
        assert coder.encode_long(word.encode()).tolist() == enc.encode_ordinary(word), word[:40]


def test_long_words_in_small_segments(coder, monkeypatch):
    """Segments, and queries that go on from the last one's state, change nothing."""
    monkeypatch.setattr(bpe, "SEGMENT", 150)
    monkeypatch.setattr(bpe, "STATE_ROWS", 500)
    enc = encoding()
    for word in _long_words(random.Random(5), 1500):
        assert coder.encode_long(word.encode()).tolist() == enc.encode_ordinary(word), word[:40]


def test_long_words_take_time_in_proportion(coder):
    """A word of 1 MB, and one without any variety, come back whole."""
    rng = random.Random(3)
    for word in ("".join(rng.choice("etaoinshrdlu") for _ in range(1 << 20)).encode(), b"-" * (1 << 20)):
        ids = coder.encode_long(word)
        assert coder.decode(ids) == word
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(100_000))
    assert coder.encode_long(word.encode()).tolist() == encoding().encode_ordinary(word)


def test_long_text_comes_in_parts(coder, monkeypatch):
    monkeypatch.setattr(bpe, "STEP", 4000)
    text = "Ünïcode words,  and\n\nlines… 漢字 don't stop; " * 400
    want = encoding().encode_ordinary(text)
    n, ids_sha, data_sha, ids, raw = bpe._joined(coder.stream(text), True)
    assert (n, ids, raw.decode()) == (len(want), want, text)
    assert ids_sha == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and data_sha == hashlib.sha256(text.encode()).hexdigest()


def test_codes_are_bounded_by_bytes(coder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3000)
    enc, rng = encoding(), random.Random(4)
    for _ in range(6):
        texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(5)]
        ids, data, n = coder.run(pa.array(texts))
        assert [list(map(int, x.split())) for x in ids.to_pylist()] == [enc.encode_ordinary(t) for t in texts] and data.to_pylist() == [t.encode() for t in texts]
        assert n.to_pylist() == [len(x.split()) for x in ids.to_pylist()]
        assert len(coder.known) < 450


@pytest.mark.parametrize("pattern", [P.PATTERN, r"\w+ \w+|\s+|\S", r"(?s).{1,3}", r"([^ ])+ ?| "])
def test_patterns(spark, pattern):
    texts = ["", None, "one two  three", " x\n y z ", "a,b c;d É!? ñandú's 漢 字", "it's 9.5% (ok)", "tab\tand\x0bmore \n", " ", "  ", "'s", "x ' y", "-- — ×÷ À"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    enc = encoding(pattern)
    got = {r.doc_id: r for r in bpe.encode_decode(df, pattern=pattern, outputs=True).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == enc.encode_ordinary(t or "") and got[i].decoded == (t or "") and got[i].n_tokens == len(got[i].ids)


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
