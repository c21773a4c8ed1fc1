"""The training-data operators against brute force on small fixtures with nulls, ties, repeats and clashing names."""

import base64
import hashlib
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewell.llm import bpe, chat_tools, hnsw, lsm_dedup, mixing, ngram_join, quality_gam, secret_scan, sharding, toxicity
from tracewell.llm.components import components
from tracewell.llm.shared import hash_words, shingle_hashes, without

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rep string, size string"


def word(rng):
    return "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))


def docs(spark, n=160, seed=3):
    """Documents with exact and near copies, empty, null and long texts, repeated rows, a null id."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        kind = i % 8
        if kind == 1 and texts:
            texts.append(rng.choice(texts))
        elif kind in (2, 3) and texts:
            w = (rng.choice(texts) or "x").split(" ")
            w[rng.randrange(len(w))] = word(rng).upper()
            texts.append(" ".join(w))
        elif kind == 4 and texts:
            texts.append((rng.choice(texts) or "").replace(" ", " \t", 1) + "\n")
        else:
            texts.append(" ".join(word(rng) for _ in range(rng.choice([1, 3, 4, 5, 8, 40, 90, 200]))))
    texts += ["", None, " \n", "one two three four", "ONE two three four", "é" * 3000 + " x", "one two three"]
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t or ""), "d", "r", "z") for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], rows[5], (None, texts[5], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("width", [16, 1])
def test_exact_dedup(spark, width):
    df, rows = docs(spark)
    got = lsm_dedup.deduplicate(df, memtable=16, width=width).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(normal(t), []).append((-len(t or ""), float("inf") if i is None else i))
    want = {}
    for k, v in groups.items():
        want[hashlib.sha256(k.encode()).hexdigest()] = (min(v)[1], len(v))
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    assert sum(r.kept for r in got) == len(groups)
    kept = lsm_dedup.keep_best(df)
    assert kept.columns == df.columns and sorted(normal(r.text) for r in kept.collect()) == sorted(groups)


def test_lsm_index():
    rng = np.random.default_rng(1)
    rows = np.zeros(5000, dtype=lsm_dedup._HASHED)
    rows["digest"] = [hashlib.sha256(bytes([x])).digest()[:15] + b"\x01" for x in rng.integers(0, 200, 5000)]
    rows["chars"], rows["id"], rows["rows"], rows["same"] = rng.integers(0, 5, 5000), rng.integers(0, 900, 5000), 1, 1
    index = lsm_dedup.LsmIndex(memtable=64)
    index.put(rows)
    got = index.rows()
    assert len(got) == len(set(rows["digest"])) and got["rows"].sum() == 5000
    for r in got:
        own = rows[rows["digest"] == r["digest"]]
        assert (-r["chars"], r["id"]) == min((-a, b) for a, b in zip(own["chars"], own["id"], strict=True))


def test_near_copies(spark):
    df, rows = docs(spark, 300)
    rows_by = [(i, shingles(t)) for i, t, *_ in rows]
    key = lambda i: float("inf") if i is None else i
    root = {key(i): key(i) for i, _ in rows_by}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(rows_by):
        for j, y in rows_by[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(key(i)), find(key(j))
                root[max(p, q)] = min(p, q)
    got = ngram_join.near_copies(df).collect()
    assert len(got) == len(rows)
    by_id = {}
    for i, s in rows_by:
        by_id.setdefault(key(i), set()).add(len(s))
    for r in got:
        assert r.n_shingles in by_id[key(r.doc_id)] and key(r.component_id) == find(key(r.doc_id))
    assert ngram_join.near_copies(df.limit(0)).count() == 0


def test_signatures_meet():
    """Linked sets share a signature, whatever is frequent."""
    rng = np.random.default_rng(5)
    pool = np.sort(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    for share in (0.0, 0.5, 1.0):
        level = dict(zip(pool.tolist(), np.where(rng.random(len(pool)) < share, rng.integers(1, 4, len(pool)), 0).tolist(), strict=True))
        levels = lambda x: np.array([level[t] for t in x.tolist()])  # noqa: E731, B023
        for n in (1, 2, 3, 5, 9, 40, 300):
            for _ in range(20):
                x = np.sort(rng.choice(pool, n, replace=False))
                kept = rng.choice(x, n - int(rng.integers(0, n // 4 + 1)), replace=False)
                y = np.unique(np.concatenate([kept, rng.choice(pool, int(rng.integers(0, n // 4 + 1)))]))
                if ngram_join._linked(x, y):
                    a, b = ngram_join.signatures(x, levels(x)), ngram_join.signatures(y, levels(y))
                    assert set(a[0]) & set(b[0]) or set(a[1]) & set(b[1])


def test_near_copies_of_repeated_and_null_ids(spark):
    """Two texts of one id and one size, each linked with another id; rows without an id are told apart."""
    rng = random.Random(12)
    text = lambda: " ".join(word(rng) + str(rng.randint(0, 99)) for _ in range(120))
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    a, b, c, d = text(), text(), text(), text()
    rows = [(5, a), (5, b), (7, near(a)), (9, near(b)), (None, c), (None, near(c)), (None, d), (11, near(d)), (None, "x y")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in ngram_join.near_copies(df).collect())
    assert got == sorted([("5", "5"), ("5", "5"), ("7", "5"), ("9", "5"), ("None", "None"), ("None", "None"), ("None", "11"), ("11", "11"), ("None", "None")])
    kept = ngram_join.keep_first(df)
    assert kept.columns == df.columns
    texts = [r.text for r in kept.collect()]
    assert sorted(t for t in texts if t not in (c, near(c))) == sorted([a, b, near(d), "x y"]) and sum(t in (c, near(c)) for t in texts) == 1


def test_hashing():
    words, first, start, length = hash_words([b"One two", b"", b"two  one\n"])
    assert list(np.diff(first)) == [2, 0, 2] and words[0] == words[3] and words[1] == words[2] and list(length) == [3, 3, 3, 3]
    assert len(shingle_hashes(words)) == 1 and len(shingle_hashes(words[:0])) == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r.id: r.root for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}
    assert components(links.limit(0)).count() == 0


def test_without(spark):
    df, rows = docs(spark)
    left = without(df, spark.createDataFrame([(3,), (5,), (None,)], "doc_id long"))
    assert left.columns == df.columns and left.count() == sum(r[0] not in (3, 5) for r in rows)


def test_mixing(spark):
    df, rows = docs(spark)
    mixed = mixing.mix(df.repartition(2))
    got = mixed.collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    names = [c for c in mixed.columns if c not in df.columns]
    assert names[0] == "size_"
    by = {}
    for r in got:
        x = by.setdefault(r.source, [0, r.target, 0])
        assert r["size_"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r["size_"]
        x[0], x[2] = x[0] + r["size_"], x[2] + r.taken
    assert all(r.source_size == by[r.source][0] for r in got)
    order = sorted(by, key=lambda s: (s is None, s))
    want = mixing.targets([(s, by[s][0]) for s in order])
    assert [by[s][1] for s in order] == want and all(abs(by[s][2] - by[s][1]) <= 0.5 for s in order)
    assert abs(sum(want) - sum(x[0] for x in by.values())) < 1e-6
    drawn = mixing.draw(df)
    assert drawn.columns == df.columns
    n = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in drawn.collect())
    assert n == sum(r.taken for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("range_rows", [3, 4096])
def test_mixing_by_brute_force(spark, monkeypatch, range_rows):
    """Targets by hand, documents in the order of their keys, cut where the budget ends."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    df, rows = docs(spark, 300)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, by = 0, {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
        total += size(r[1])
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    own = {s: sum(size(r[1]) for r in by[s]) for s in order}
    target, full = {}, []
    while True:  # a source at its limit leaves its excess to the others, by weight
        left, weights = total - sum(3 * own[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * own[s] if s in full else left * weight[s] / weights for s in order}
        above = [s for s in order if s not in full and target[s] > 3 * own[s]]
        if not above:
            break
        full += above
    keys = df.select("doc_id", "text", F.xxhash64(F.lit(20), F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))).alias("k"), F.xxhash64("text").alias("h")).collect()
    keys = {(r.doc_id, r.text): (r.k, -1 if r.doc_id is None else r.doc_id, size(r.text), r.h) for r in keys}
    want = []
    for s in order:
        times, rest = divmod(round(target[s]), own[s]) if own[s] else (0, 0)
        if target[s] >= 3 * own[s]:
            times, rest = 3, 0
        for r in sorted(by[s], key=lambda r: keys[r[0], r[1]]):
            n = size(r[1])
            want.append((str(r[0]), n, own[s], round(float(target[s]), 6), times * n + min(n, rest)))
            rest -= min(n, rest)
    got = mixing.mix(df).collect()
    assert sorted((str(r.doc_id), r["size_"], r.source_size, round(r.target, 6), r.taken) for r in got) == sorted(want)
    assert mixing.mix(df.limit(0)).count() == 0


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 800)]) == [300.0, 300.0, 400.0]
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)]) == [0.0]


def test_bpe(spark):
    import public_tokenizers as P
    import tiktoken

    df, rows = docs(spark)
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        raw = f.read()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(raw), special_tokens={})
    rng = random.Random(2)
    odd = ["".join(rng.choice(" \n\taé'sd9٣½ .<|endoftext|>　\x85\x1c🙂") for _ in range(30)) for _ in range(150)] + ["x" * 2000, " " * 500]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    texts = [(i, t or "") for i, t, *_ in rows] + list(enumerate(odd, 1000))
    got = bpe.encode_decode(df.select("doc_id", "text").unionByName(more), outputs=True).collect()
    want = sorted((str(i), t, enc.encode_ordinary(t)) for i, t in texts)
    assert sorted((str(r.doc_id), r.decoded, list(r.ids)) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_secrets(spark):
    fixtures = ["", None, "password=abc", "Password: 'abcdef' token==xyzabc", "AKIA" + "A" * 15, "éé AKIA" + "B" * 16 + " API_KEY:\"k/e+y=._-1\"", "f" * 23 + "g" + "0" * 24, "paſsword=abcdef", "secret\n=abcdef", "apikey   =   \"0123456789abcdef01234567", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(fixtures)], "doc_id long, text string, spans string")
    base = [("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    got = {r.doc_id: r for r in secret_scan.report(df).collect()}
    assert len(got) == len(fixtures)
    for i, t in enumerate(fixtures):
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p, g, n) in enumerate(base) for m in p.finditer(t or "") if len(m[g]) >= n)
        told = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]
    assert "private_key:" in got[10].spans and "code_host:" in got[11].spans


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is True
    assert secret_scan.trigram_query("abc[^x]?x*") == b"abc"
    q = secret_scan.trigram_query("(foo|bar)baz")
    assert secret_scan.trigrams(q) >= {b"foo", b"bar", b"baz"}


@pytest.mark.parametrize("limit", [1 << 30, 3000, 700, 1])
def test_sharding(spark, limit):
    df, rows = docs(spark)
    got = sharding.shard(df, limit=limit).collect()
    assert len(got) == len(rows)
    key = lambda i: int(hashlib.md5(b"" if i is None else str(i).encode()).hexdigest()[:15], 16)
    bits = lambda r: format(key(r.doc_id), "060b")
    held = {}
    for r in got:
        assert bits(r).startswith(r.shard) and len(r.shard) == r.shard_bits
        held[r.shard] = held.get(r.shard, 0) + r.bytes
    for r in got:
        assert r.shard_bytes == held[r.shard] and r.oversized == (held[r.shard] > limit)
        assert not r.oversized or r.shard_bits == 60
        if r.shard:  # the bucket above was too large
            assert sum(x.bytes for x in got if bits(x).startswith(r.shard[:-1])) > limit
    assert sharding.shard(df.limit(0), limit=limit).count() == 0


def test_chat_tools(spark):
    call = lambda *cs: json.dumps({"tool_calls": list(cs)})
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "héllo \"x\""), (1, 2, "assistant", call({"id": "b", "name": "get", "arguments": {"z": 1, "a": "q"}, "depends_on": ["a"]}, {"id": "a", "name": "get", "arguments": {"a": 5}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "A"})), (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": None})), (1, 5, "user", None), (1, 6, "assistant", "bye"), (1, 6, "assistant", "bye"),
        (2, 1, "assistant", call({"id": "p", "name": "get", "arguments": {"a": "1"}, "depends_on": ["q"]}, {"id": "q", "name": "none", "depends_on": ["p"]})), (None, None, None, None), (2, 9, "assistant", "late"),
    ]
    df = spark.createDataFrame([(*r, "n", "c") for r in rows], "conv_id long, turn long, role string, text string, name string, conv string")
    got = {(r.conv_id, r.call_id): r for r in chat_tools.link(df, schemas=chat_tools.SCHEMAS | {"get": (("a", "string", True), ("z", "integer", False))}).collect() if r.status != "message"}
    assert {k: (r.status, r.level, r.problems, r.n_results) for k, r in got.items()} == {
        (1, "1:1"): ("unanswered", 0, "", 0), (1, "b"): ("unanswered", 1, "", 0), (1, "a"): ("linked", 0, "a: not string", 1), (1, "zz"): ("orphan", 0, "", 1), (1, "1:5"): ("linked", 0, "prompt: empty", 2),
        (2, "p"): ("unanswered", None, "", 0), (2, "q"): ("unanswered", None, "unknown tool", 0), (2, "2:8"): ("orphan", 0, "", 1),
    }
    assert json.loads(got[1, "b"].record) == {"arguments": {"a": "q", "z": 1}, "id": "b", "name": "get", "result": None} and got[1, "b"].record.startswith('{"arguments":{"a":"q","z":1},"id"')
    assert chat_tools.link(df.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    v = np.concatenate([base, base[:30] + 0.05 * rng.normal(size=(30, 16)), base[:1] + 0.02 * rng.normal(size=(200, 16))]).astype(np.float32)
    rows = [(i, [float(x) for x in a]) for i, a in enumerate(v)]
    rows += [(900, [float(x) for x in v[3]]), (901, [0.0] * 16), (902, None), (903, [float("nan")] * 16), (904, []), (905, [1.0, 2.0]), (None, [float(x) for x in v[4]]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1, 1.0) for r in rows], "vec_id long, embedding array<float>, label int, v double")
    ok = [(i, np.array(a)) for i, a in rows if a and all(np.isfinite(a)) and any(a)]
    unit = [(i, a / np.linalg.norm(a)) for i, a in ok]
    links = [[len(a) == len(b) and a @ b >= 0.95 for _, b in unit] for _, a in unit]
    want = sorted((str(i), sum(x) - 1) for (i, _), x in zip(unit, links, strict=True))
    got = hnsw.near_vectors(df, shards=3).collect()
    assert len(got) == len(rows)
    none = [r for r in got if r.vec_id in (901, 902, 903, 904)]
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in none)
    mine = sorted((str(r.vec_id), r.n_links) for r in got if r not in none)
    assert sum(n for _, n in mine) >= 0.98 * sum(n for _, n in want) and all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(mine, want, strict=True))
    assert {r.vec_id: r.component_id for r in got}[900] == 3 and hnsw.near_vectors(df.limit(0)).count() == 0


def test_audit_without_links():
    """A shard without links inside is audited with points at the threshold from its vectors."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    v = unit(rng.normal(size=(4000, 64)))
    graph = hnsw.Graph(v, np.minimum((rng.exponential(1 / np.log(hnsw.LINKS), len(v))).astype(int), 8))
    chosen, far = np.arange(200, 328), unit(rng.normal(size=(128, 64)))
    assert (v[chosen] @ v.T >= 0.95).sum() == 128 and not (far @ v.T >= 0.95).any()
    ask = (0.95, np.concatenate([v[chosen], far]), np.concatenate([chosen, np.full(128, -1)]), chosen)
    width = graph.audited(*ask)
    near = hnsw.points_at(v, 0.955)
    found = {int(r): x for r, x, _ in graph.search(near, width, 0.95)}
    assert np.mean([i in found.get(i, ()) for i in range(len(v))]) >= 0.96
    graph.layers[0][:, 2:] = -1  # a worse graph takes a wider beam
    assert graph.audited(*ask) > width


def test_quality(spark):
    rng = random.Random(6)
    good = [" ".join(word(rng) for _ in range(60)) + "." for _ in range(200)]
    bad = [" ".join(word(rng).upper() + "!!" for _ in range(60)) for _ in range(60)] + [" ".join([word(rng)] * 50) for _ in range(60)]
    rows = [(i, t, 0.5) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(rows + [(900, None, 1.0), (901, "", 1.0), (None, good[0], 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in rows] + [(None, 1, 0), (3, None, 0), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_gam.classify(df, labels).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and all(r.predicted == (r.doc_id < 200) for r in held if r.doc_id < 900)
    assert {r.predicted for r in quality_gam.classify(df, labels.limit(0)).collect()} == {1}
    assert quality_gam.keep_good(df, quality_gam.fit(df, labels)).columns == df.columns


def test_ordinal():
    """Four ordered grades by how many marked words a text has."""
    rng = random.Random(8)
    texts, grades = [], []
    for _ in range(900):
        g = rng.randrange(4)
        w = [word(rng) for _ in range(40)] + rng.sample(["zzbad", "zzworse", "zzworst"], g)
        rng.shuffle(w)
        texts.append(" ".join(w).encode())
        grades.append(g)
    rows = toxicity.features(texts)
    model = toxicity.train(rows[:600], np.array(grades[:600]), n_grades=4)
    p = model.above(rows[600:])
    assert (np.diff(model.thresholds) > 0).all() and ((p >= 0.5).sum(axis=1) == grades[600:]).mean() > 0.95
    assert np.corrcoef(p.sum(axis=1), grades[600:])[0, 1] > 0.95


def test_toxicity(spark):
    rng = random.Random(9)
    rows = [(i, " ".join([word(rng) for _ in range(30)] + ["Zzbad,"] * (i % 5 == 0)), "x") for i in range(300)] + [(900, None, "x"), (None, "zzbad", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    got = toxicity.grade(df, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")).collect()
    assert len(got) == 302 and all(r.predicted == (r.doc_id % 5 == 0) for r in got if r.held_out and r.doc_id < 300)
    assert toxicity.grade(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_toxicity_grades(spark):
    """Grades above 1 are learnt from the labels as they are."""
    rng = random.Random(10)
    marks = ["zzbad", "zzworse", "zzworst"]
    rows = [(i, " ".join([word(rng) for _ in range(30)] + marks[: i % 4])) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 4) for i in range(600)], "doc_id long, toxic int")
    got = [r for r in toxicity.grade(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect() if r.held_out]
    assert {r.predicted for r in got} == {0, 1, 2, 3} and np.mean([r.predicted == r.doc_id % 4 for r in got]) > 0.9


def smallest_of_linked(rows):
    """Ids that stay of groups of near copies: the smallest of each, by all pairs."""
    sets = {r.doc_id: shingles(r.text) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(i for i in root if find(i) == i)


def test_pipeline(spark, tmp_path):
    """Each stage against what brute force says of its own input: whom the scores reject, the longest of equal texts, the
    smallest of linked ones, words per source, ids of tiktoken."""
    import tiktoken

    import corpus_pipeline as pipe

    df, _ = docs(spark, 120)
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    rng = random.Random(12)
    junk = spark.createDataFrame([(1000 + i, " ".join(rng.choice(["$$$", "%%", "###!", "0x0"]) for _ in range(40)), "en", "s1", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    base = df.where("doc_id is not null").select(*[F.col(c).cast(junk.schema[c].dataType).alias(c) for c in cols]).dropDuplicates(["doc_id"])
    base.unionByName(junk).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(1000 + i, 0) for i in range(60)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    cur = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = cur.collect()
    scored = {r.doc_id: r for r in quality_gam.classify(cur, labels).collect()}
    for k, (name, stage) in enumerate(pipe.STAGES):
        out = stage(spark, cur, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        cur = spark.read.parquet(str(tmp_path / f"out{k}"))
        now = cur.collect()
        if k < 4:
            assert cur.columns == cols
        if name == "quality classifier":
            assert sorted(r.doc_id for r in now) == sorted(i for i, r in scored.items() if r.score >= 0.3)
            assert not any(r.doc_id >= 1000 for r in now) and {r.doc_id for r in now} >= {r.doc_id for r in before if r.doc_id < 100 and len((r.text or "").split()) > 20}
        if name == "exact dedup":
            best = {}
            for r in before:
                best[normal(r.text)] = min(best.get(normal(r.text), (0, 1 << 62)), (-len(r.text or ""), r.doc_id))
            assert sorted(r.doc_id for r in now) == sorted(i for _, i in best.values())
        if name == "n-gram Jaccard join":
            assert sorted(r.doc_id for r in now) == smallest_of_linked(before)
        if name == "mixing sources":
            count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            sizes = {}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + count(r.text)
            order = sorted(sizes, key=lambda s: (s is None, s))
            for s, target in zip(order, mixing.targets([(s, sizes[s]) for s in order]), strict=True):
                assert abs(sum(count(r.text) for r in now if r.source == s) - target) <= 0.5
            whole = {r.doc_id: r.text or "" for r in before}
            assert all(whole[r.doc_id].strip().startswith((r.text or "").strip()) for r in now)
        if name == "byte-level BPE":
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines())}
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = [(r.doc_id, len(ids := enc.encode_ordinary(r.text or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in before]
            assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in now) == sorted(want)
        before = now


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipe

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipe.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot(spark, how):
    from tracewell.llm.shared import join_hot

    rows = [(i, i % 7 if i % 3 else 1) for i in range(60)] + [(100, None), (101, 50)]
    left = spark.createDataFrame(rows, "id int, k int")
    right = left.where("k is not null and k <> 50").groupBy("k").count().withColumn("x", F.col("k") * 10)
    want = sorted(map(str, left.join(right, ["k"], how).collect()))
    for hot_rows in (1, 5, 1000):
        assert sorted(map(str, join_hot(left, right, ["k"], "count", how=how, hot_rows=hot_rows).select("k", "id", "count", "x").collect())) == want


def test_scores_by_hand(spark):
    """op1: the base, a table entry for each feature's bin and for each pair's cell, added row by row; op2: P(grade >= k)
    from the formula, row by row."""
    import math
    from bisect import bisect_right

    rng = random.Random(31)
    rows = [(i, " ".join(word(rng) + ("!!" if i % 3 == 0 else "") + (" zzbad" if i % 4 == 0 and rng.random() < 0.1 else "") for _ in range(rng.randint(1, 60)))) for i in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), i % 4 // 2) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality_gam.fit(df, labels)
    assert len(model.pairs) == 6
    got = {r.doc_id: r for r in quality_gam.score(df, model).collect()}
    for i, t in rows:
        x = quality_gam.features([(t or "").encode()])[0]
        at = [bisect_right(e.tolist(), v) for e, v in zip(model.edges, x.tolist(), strict=True)]
        total = model.base + sum(t[b] for t, b in zip(model.tables, at, strict=True)) + sum(t[at[j]][at[k]] for j, k, t in model.pairs)
        assert abs(got[i].score - 1 / (1 + math.exp(-total))) < 1e-9 and got[i].predicted == int(got[i].score >= 0.3)
    ordinal = toxicity.fit(df, labels, n_grades=4)
    graded = {r.doc_id: r for r in toxicity.score(df, ordinal).collect()}
    weight = dict(zip(ordinal.features.tolist(), ordinal.weights.tolist(), strict=True))
    for i, t in rows:
        total = sum(weight.get(f, 0) for f in toxicity.features([(t or "").encode()])[0].tolist())
        p = [1 / (1 + math.exp(-(total - k))) for k in ordinal.thresholds]
        assert len(p) == 3 and abs(graded[i].expected_severity - sum(p)) < 1e-9 and graded[i].predicted == sum(x >= 0.5 for x in p)
    empty = df.limit(0)
    assert quality_gam.classify(empty, labels).count() == 0 and toxicity.grade(empty, labels).count() == 0


def test_ordinal_fit_is_that_of_all_features(spark):
    """Choosing features on the executors changes nothing."""
    rng = random.Random(32)
    rows = [(i, " ".join([word(rng) for _ in range(30)] + ["zzbad"] * (i % 5 == 0))) for i in range(200)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(3, None), (7, 9), (8, -2)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, n_grades=2)
    learnt = {r.doc_id for r in df.where(~quality_gam.held_out("doc_id")).collect()}
    used = [(i, t) for i, t in rows if i in learnt]
    y = np.array([1 if i % 5 == 0 or i == 7 else 0 for i, _ in used])
    whole = toxicity.train([toxicity.features([t.encode()])[0] for _, t in used], y, n_grades=2)
    assert set(model.features) <= set(whole.features) and np.allclose(model.thresholds, whole.thresholds, atol=0.05)
    a, b = model.above([toxicity.features([t.encode()])[0] for _, t in rows]), whole.above([toxicity.features([t.encode()])[0] for _, t in rows])
    assert np.abs(a - b).max() < 0.05
