"""HNSW graphs with layers against brute force, and clusters of near copies."""

import time
import tracemalloc

import numpy as np

from tracewell.llm import hnsw


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_with_layers(spark):
    """6,000 vectors in layered graphs: links of brute force are found, none below the threshold."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(1500, 32))
    v = np.concatenate([centres + 0.1 * rng.normal(size=centres.shape) for _ in range(3)] + [rng.normal(size=(1500, 32))]).astype(np.float32)
    graph = hnsw.Graph(unit(v[:3000].astype(float)), np.minimum(rng.exponential(1 / np.log(hnsw.LINKS), 3000).astype(int), 8))
    assert len(graph.members) >= 1
    u = unit(v.astype(float))
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in hnsw.near_vectors(df, shards=2).collect()}
    n = np.array([got[i].n_links for i in range(len(v))])
    assert (n <= links.sum(axis=1)).all() and n.sum() >= 0.98 * links.sum() > 3000
    root = np.arange(len(v))
    while True:  # smallest number reachable
        new = np.minimum(root, np.where(links, root[None, :], len(v)).min(axis=1))
        if (new == root).all():
            break
        root = new
    assert np.mean([got[i].component_id == root[i] for i in range(len(v))]) >= 0.98


def test_cluster_of_near_copies():
    """Full beams are answered by blocks of the whole shard: exact, and in seconds."""
    rng = np.random.default_rng(22)
    v = unit(np.concatenate([rng.normal(size=(1, 32)) + 0.02 * rng.normal(size=(6000, 32)), rng.normal(size=(3000, 32))]))
    graph = hnsw.Graph(v, np.minimum(rng.exponential(1 / np.log(hnsw.LINKS), len(v)).astype(int), 8))
    began = time.time()
    found = {int(r): len(x) for r, x, whole in graph.search(v[:3000], hnsw.BEAM, 0.95) if whole}
    assert found == dict(enumerate((v[:3000] @ v.T >= 0.95 - 1e-9).sum(axis=1).tolist())) and time.time() - began < 30


def planted(n, d, rng):
    """Vectors at random, a quarter of them with two others at cosines of 0.955 and 0.97."""
    base = unit(rng.normal(size=(n // 2, d)))
    some = base[: n // 4]
    return np.concatenate([base, hnsw.points_at(some, 0.955), unit(hnsw.points_at(some[::-1], 0.97))])


def test_graphs_are_searched_at_20000(monkeypatch):
    """One shard of 20,000 vectors: the audit is content with a narrow beam, no query is compared with the whole shard,
    and the links of brute force are found."""
    v = planted(20_000, 64, np.random.default_rng(31))
    graph = hnsw.Graph(v, np.minimum(np.random.default_rng(5).exponential(1 / np.log(hnsw.LINKS), len(v)).astype(int), 8))
    some = np.arange(0, len(v), 160)
    width = graph.audited(0.95, v[some], some, some)
    assert width <= 4 * hnsw.BEAM
    monkeypatch.setattr(hnsw.Graph, "_scan", lambda self, queries, rows, threshold: iter(()) if not len(rows) else 1 / 0)
    asked = np.arange(0, len(v), 10)
    found = {int(asked[r]): set(x.tolist()) for r, x, _ in graph.search(v[asked], width, 0.95)}
    want = {int(i): set(np.flatnonzero(v[i] @ v.T >= 0.95).tolist()) for i in asked}
    hit, total = sum(len(found.get(i, set()) & (x - {i})) for i, x in want.items()), sum(len(x) - 1 for x in want.values())
    assert total > 1500 and hit >= 0.98 * total
    assert all(found[i] <= set(np.flatnonzero(v[i] @ v.T >= 0.95 - 1e-8).tolist()) for i in found)


def test_counts_from_both_ends(spark):
    """20,000 vectors over four shards: n_links against brute force, and the same from either end of a pair."""
    v = planted(20_000, 32, np.random.default_rng(32)).astype(np.float32)
    got = {r.vec_id: r for r in hnsw.near_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")).collect()}
    u = unit(v.astype(float))
    n, want, pairs = np.array([got[i].n_links for i in range(len(v))]), np.zeros(len(v), int), []
    for a in range(0, len(v), 2000):
        hits = np.argwhere(u[a : a + 2000] @ u.T >= 0.95) + [a, 0]
        hits = hits[hits[:, 0] != hits[:, 1]]
        want += np.bincount(hits[:, 0], minlength=len(v))
        pairs.append(hits)
    assert (n <= want).all() and n.sum() >= 0.98 * want.sum() > 10_000
    pairs = np.concatenate(pairs)
    alone = pairs[(want[pairs[:, 0]] == 1) & (want[pairs[:, 1]] == 1)]
    assert (n[alone[:, 0]] == n[alone[:, 1]]).all()
    assert np.mean([got[a].component_id == got[b].component_id for a, b in pairs.tolist()]) >= 0.98


def test_graphs_travel_in_pieces(spark, monkeypatch):
    """Whatever the shards, no row holds a whole graph; blocks of queries meet groups of graphs of two lengths, and the links
    of brute force are found."""
    rows, real = {}, hnsw.cut

    def kept(df, name):
        out = real(df, name)
        if name == "graphs":
            rows[name] = out.toArrow()
        return out

    monkeypatch.setattr(hnsw, "cut", kept)
    monkeypatch.setattr(hnsw, "BLOCK", 512)
    monkeypatch.setattr(hnsw, "TASKS", 1, raising=False)
    monkeypatch.setattr(hnsw, "MOST_BLOCK", 700)
    v = [*planted(3000, 32, np.random.default_rng(41)).astype(np.float32), *planted(600, 16, np.random.default_rng(42)).astype(np.float32)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in hnsw.near_vectors(df, shard_rows=600).collect()}
    table = rows["graphs"]
    assert table["shard"].to_pylist() and len(set(table["shard"].to_pylist())) == 6
    assert table.nbytes / table.num_rows < 1 << 16 and max(x.nbytes for b in table.to_batches(1) for x in b.columns) < 1 << 16
    want, found = 0, 0
    for first, last in ((0, 3000), (3000, 3600)):
        u = unit(np.array(v[first:last]).astype(float))
        links = (u @ u.T >= 0.95).sum(axis=1) - 1
        n = np.array([got[i].n_links for i in range(first, last)])
        assert (n <= links).all()
        want, found = want + links.sum(), found + n.sum()
    assert len(got) == 3600 and found >= 0.98 * want > 2000


def peak(build):
    tracemalloc.start()
    try:
        build()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_graph_is_bounded():
    """Neither long vectors nor a node that many others point to make a step take more than a few dozen MB."""
    rng = np.random.default_rng(43)
    long = unit(rng.normal(size=(700, 2048)))
    assert peak(lambda: hnsw.Graph(long, np.zeros(700, int))) < 64 + 3 * long.nbytes / 1e6
    hub = unit(np.concatenate([np.ones((1, 64)), 1 + 0.75 * rng.normal(size=(2500, 64))]))
    assert peak(lambda: hnsw.Graph(hub, np.zeros(len(hub), int))) < 100
