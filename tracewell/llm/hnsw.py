"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Vectors are normalised in double precision and equal ones stand for each other. Shards are dealt by a hash of the
identifier; each task builds its shard's graph: layers of exponentially fewer nodes, inserted in batches whose
candidates come from a beam search of the graph so far and from the batch itself, with the usual diversity
rule for neighbours. An audit looks up links of the shard's and of all vectors, and points placed at the threshold from
vectors of the shard, and widens the beam until recall is reached. Every vector then queries every shard; the few whose
beam is full of links, as in a cluster of near copies, are compared with the whole shard, block by block. Cosines of
what was found are verified in double precision. A pair that one side's search found counts for both; counts of whole
comparisons stand by themselves. A task's links are reduced to a spanning forest before they leave it.

Graphs travel in small pieces: a task holds one block of queries and takes the graphs of its group of shards one after
another, so that neither a row nor a task grows with the table.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.components import components
from tracewell.llm.shared import join_hot, mix, small_batches
from tracewell.storage import cut, drop_cut

#: Neighbours a node is given, and may gather before it is pruned; width of the beam that looks for them.
LINKS, ROOM, BUILD_BEAM = 12, 36, 32
#: Shards, and rows of one at most: more rows mean more shards.
SHARDS, SHARD_ROWS = 4, 1 << 16
#: Bytes of a shard's vectors in double precision, of a block of queries as they are, and of a piece of a graph, at most.
SHARD_BYTES, BLOCK_BYTES, PIECE = 1 << 26, 1 << 25, 1 << 15
#: Queries of a block, from which there is more than one and at most; graphs that one task takes at most; tasks a core.
BLOCK, MOST_BLOCK, GRAPHS, TASKS = 8192, 1 << 17, 16, 12
#: Queries of one vectorised search, fewer where it would mark more than CELLS cells or gather more than NUMBERS numbers.
TOGETHER, CELLS, NUMBERS = 512, 1 << 25, 1 << 21
#: Of a beam's integers: a free place, the bits of a node; how far cosines in single precision may be off.
EMPTY, NODE, OFF = -2, (1 << 31) - 1, 1e-3
#: Vectors of a shard, and of the whole table, that an audit looks up, the recall it asks for, the first beam.
AUDIT, RECALL, BEAM = 128, 0.98, 12


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best `width` nodes of a layer for each query, and their cosines as the vectors' type has them, best first; -1 where
    there are fewer. entries: a row of nodes to start from per query, -1 for none."""
    q, n = len(queries), len(vectors)
    step = max(1, min(TOGETHER, TOGETHER * 64 // width, CELLS // n, NUMBERS // (vectors.shape[1] * max(links.shape[1], entries.shape[1]))))
    if q > step:
        parts = [beam(vectors, links, queries[a : a + step], entries[a : a + step], width) for a in range(0, q, step)]
        return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    queries = queries.astype(vectors.dtype, copy=False)
    seen = np.zeros(q * n, dtype=bool)
    # cosine in steps of 2**-30, node, and whether its neighbours are still to be looked at, in one integer
    held, worst = np.full((q, width), EMPTY), np.full(q, EMPTY)
    rows, new = np.arange(q), entries
    while len(rows):
        at = np.flatnonzero(new >= 0)
        c = new.ravel().take(at).astype(np.int64)
        cell = (r := rows.take(at // new.shape[1])) * n + c
        fresh = np.flatnonzero(~seen.take(cell))
        r, c = r.take(fresh), c.take(fresh)
        seen[cell.take(fresh)] = True
        s = np.einsum("nd,nd->n", vectors.take(c, axis=0), queries.take(r, axis=0))
        c = (np.maximum(s + 1.0, 0) * 2.0**30).astype(np.int64) << 32 | c << 1 | 1
        better = np.flatnonzero(c > worst.take(r))
        r, c = r.take(better), c.take(better)
        if len(r):
            first = np.flatnonzero(np.diff(r, prepend=-1))  # r goes up
            own, count = r.take(first), np.diff(first, append=len(r))
            both = np.full((len(own), width + int(count.max())), EMPTY)
            both[:, :width] = held.take(own, axis=0)
            both[np.repeat(np.arange(len(own)), count), width + np.arange(len(r)) - np.repeat(first, count)] = c
            best = np.partition(both, both.shape[1] - width, axis=1)[:, -width:]
            held[own], worst[own] = best, best[:, 0]
        part = held.take(rows, axis=0)
        at = np.where(part & 1, part, EMPTY).argmax(axis=1)
        c = part[np.arange(len(rows)), at]
        live = c & 1 == 1
        rows, at, c = rows[live], at[live], c[live]
        held[rows, at] -= 1
        new = links.take(c >> 1 & NODE, axis=0)
    held = -np.sort(-held, axis=1)
    return np.where(held < 0, -1, held >> 1 & NODE), np.where(held < 0, -np.inf, (held >> 32) / 2.0**30 - 1)


def diverse(vectors: np.ndarray, of: np.ndarray, cands: np.ndarray, keep: int) -> np.ndarray:
    """For each node of `of`, up to `keep` of its candidates (-1: none): from the nearest on, those nearer to the
    node than to any chosen before; free places go to the nearest of the others."""
    step = max(1, NUMBERS // (cands.shape[1] * max(cands.shape[1], vectors.shape[1])))
    if len(of) > step:
        return np.concatenate([diverse(vectors, of[a : a + step], cands[a : a + step], keep) for a in range(0, len(of), step)])
    sims = np.where(cands < 0, -np.inf, np.einsum("ncd,nd->nc", vectors[cands], vectors[of]))
    order = np.argsort(-sims, axis=1, kind="stable")
    cands, sims = np.take_along_axis(cands, order, axis=1), np.take_along_axis(sims, order, axis=1)
    twice = np.zeros(cands.shape, dtype=bool)
    twice[:, 1:] = (cands[:, 1:] == cands[:, :-1]) & (cands[:, 1:] >= 0)
    sims[twice] = -np.inf
    gathered = vectors[cands]
    among = gathered @ gathered.transpose(0, 2, 1)
    chosen = np.zeros(cands.shape, dtype=bool)
    worst = np.full(cands.shape, -np.inf)  # greatest cosine to a chosen one
    count = np.zeros(len(of), dtype=int)
    for j in range(cands.shape[1]):
        ok = (sims[:, j] > worst[:, j]) & (count < keep)
        chosen[ok, j] = True
        count += ok
        worst[ok] = np.maximum(worst[ok], among[ok, j])
    rank = np.where(chosen, 0, 1) * cands.shape[1] + np.arange(cands.shape[1])
    rank[np.isneginf(sims)] = 10 * cands.shape[1]
    best = np.argsort(rank, axis=1)[:, :keep]
    out = np.take_along_axis(np.where(np.isneginf(sims), -1, cands), best, axis=1)
    return np.pad(out, ((0, 0), (0, max(0, keep - out.shape[1]))), constant_values=-1)


class Graph:
    """members: the nodes of each layer above the lowest; layers: neighbours in each layer, the lowest first, by place
    among its members."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        n = len(vectors)
        members = [np.flatnonzero(levels >= k) for k in range(1, int(levels.max(initial=0)) + 1)]
        members = [m for m in members if len(m) > 64]
        self._hold(vectors, members, [np.full((k, ROOM), -1, dtype=np.int32) for k in (n, *map(len, members))])
        for k in range(len(members), -1, -1):
            self._fill(k)

    def _hold(self, vectors: np.ndarray, members: list[np.ndarray], layers: list[np.ndarray]) -> None:
        self.vectors, self.members, self.layers = vectors, members, layers
        rough = vectors.astype(np.float32)
        self.parts = [rough, *(rough[m] for m in members)]  # the vectors of each layer, as beams compare them
        self.top = (members[-1] if members else np.arange(len(vectors)))[:64]  # the start: looked at whole

    def arrays(self) -> dict[str, np.ndarray]:
        """What of() makes the graph of again, besides its vectors."""
        return {f"layer{k}": x for k, x in enumerate(self.layers)} | {f"members{k}": x.astype(np.int32) for k, x in enumerate(self.members)}

    @classmethod
    def of(cls, vectors: np.ndarray, arrays: dict[str, np.ndarray]) -> Graph:
        graph = cls.__new__(cls)
        taken = {name: [arrays[f"{name}{k}"] for k in range(sum(x.startswith(name) for x in arrays))] for name in ("members", "layer")}
        graph._hold(vectors, taken["members"], taken["layer"])
        return graph

    def _places(self, k: int, nodes: np.ndarray) -> np.ndarray:
        """Places of nodes among the members of layer k; -1 stays."""
        return np.where(nodes < 0, -1, np.searchsorted(self.members[k - 1], nodes)) if k else nodes

    def _fill(self, k: int) -> None:
        links, vectors = self.layers[k], self.parts[k]
        # nodes of higher layers first, as searches enter this layer there
        order = [self._places(k, x) for x in (self.top, *reversed(self.members[k:]))]
        nodes = np.concatenate([*order, np.arange(len(vectors))])
        nodes = nodes[np.sort(np.unique(nodes, return_index=True)[1])]
        top = order[0][:2]
        inside = np.zeros(len(vectors) + 1, dtype=bool)
        held = np.zeros(len(vectors), dtype=np.int64)
        done = 0
        while done < len(nodes):
            new = nodes[done : done + min(max(64, done), TOGETHER)]
            among = vectors[new] @ vectors[new].T
            np.fill_diagonal(among, -np.inf)
            close = np.argsort(-among, axis=1, kind="stable")[:, : LINKS]
            cands = [np.where(np.take_along_axis(among, close, axis=1) > -np.inf, new[close], -1)]
            if done:
                starts = self._places(k, self.entries(vectors[new], k))
                starts = np.concatenate([np.where(inside[starts], starts, -1), np.broadcast_to(top, (len(new), len(top)))], axis=1)
                starts[:, -2:][(starts[:, -2:, None] == starts[:, None, :-2]).any(axis=2)] = -1
                cands.append(beam(vectors, links, vectors[new], starts, BUILD_BEAM)[0])
            chosen = diverse(vectors, new, np.concatenate(cands, axis=1), LINKS)
            links[new, :LINKS] = chosen
            held[new] = (chosen >= 0).sum(axis=1)
            self._back(vectors, links, held, np.repeat(new, LINKS), chosen.ravel())
            inside[new] = True
            done += len(new)

    @staticmethod
    def _back(vectors: np.ndarray, links: np.ndarray, held: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        """Give the targets a link to the source as well; a list that has no room is pruned."""
        ok = target >= 0
        ok[ok] = ~(links[target[ok]] == source[ok][:, None]).any(axis=1)
        order = np.argsort(target[ok], kind="stable")
        source, target = source[ok][order], target[ok][order]
        own, first, n = np.unique(target, return_index=True, return_counts=True)
        alike = np.argsort(n, kind="stable")  # those that gain as many together: few places are left empty
        own, first, n = own[alike], first[alike], n[alike]
        for a in range(0, len(own), 1024):
            o, f, c = own[a : a + 1024], first[a : a + 1024], n[a : a + 1024]
            width = int(c.max())
            at = f[:, None] + np.arange(width)
            new = np.where(np.arange(width) < c[:, None], source[np.minimum(at, len(source) - 1)], -1)
            fits = held[o] + c <= ROOM
            t, spot = np.repeat(o[fits], c[fits]), np.concatenate([held[x] + np.arange(y) for x, y in zip(o[fits], c[fits], strict=True)]) if fits.any() else np.zeros(0, int)
            links[t, spot] = new[fits][np.arange(width) < c[fits][:, None]]
            held[o[fits]] += c[fits]
            full = ~fits
            if full.any():
                pruned = diverse(vectors, o[full], np.concatenate([links[o[full]], new[full]], axis=1), 2 * LINKS)
                links[o[full]] = -1
                links[o[full], : 2 * LINKS] = pruned
                held[o[full]] = (pruned >= 0).sum(axis=1)

    def entries(self, queries: np.ndarray, to: int = 0) -> np.ndarray:
        """Where to enter layer `to`: greedy descent through the layers above it."""
        sims = queries @ self.vectors[self.top].T
        best = self.top[np.argsort(-sims, axis=1)[:, :4]]
        for k in range(len(self.members), to, -1):
            found = beam(self.parts[k], self.layers[k], queries, self._places(k, best), 4)[0]
            best = np.where(found < 0, -1, self.members[k - 1][found])
        return best

    def search(self, queries: np.ndarray, width: int, threshold: float) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(query, nodes found with at least the threshold, whether all nodes were compared): they are for queries whose
        beam is full of links."""
        width = min(width, len(self.vectors))
        step = max(1, min(TOGETHER, TOGETHER * 64 // width, CELLS // len(self.vectors), 2 * NUMBERS // (width * self.vectors.shape[1])))
        full = []
        for a in range(0, len(queries), step):
            part = queries[a : a + step]
            nodes, sims = beam(self.parts[0], self.layers[0], part, self.entries(part), width)
            hits = sims >= threshold - OFF
            r, c = np.nonzero(hits)
            hits[r, c] = np.einsum("nd,nd->n", self.vectors[nodes[r, c]], part[r]) >= threshold - 1e-9
            all_ = hits.all(axis=1)
            full.append(a + np.flatnonzero(all_))
            for r in np.flatnonzero(hits.any(axis=1) & ~all_):
                yield a + r, nodes[r][hits[r]], False
        for r, found in self._scan(queries, np.concatenate(full) if full else np.zeros(0, int), threshold):
            yield r, found, True

    def _scan(self, queries: np.ndarray, rows: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        step = max(1, (1 << 22) // len(self.vectors))
        for b in range(0, len(rows), step):
            hits = queries[rows[b : b + step]] @ self.vectors.T >= threshold - 1e-9
            for k in np.flatnonzero(hits.any(axis=1)):
                yield rows[b + k], np.flatnonzero(hits[k])

    def audited(self, threshold: float, queries: np.ndarray, own: np.ndarray, sources: np.ndarray) -> int:
        """The narrowest beam, by doubling, that finds RECALL of the queries' links and of the sources from points at the
        threshold from them (where links are few only these tell). own: each query's node, -1 if it has none."""
        exact = 0
        for a in range(0, len(queries), 64):
            sims = queries[a : a + 64] @ self.vectors.T
            mine = np.flatnonzero(own[a : a + 64] >= 0)
            sims[mine, own[a + mine]] = -np.inf
            exact += int((sims >= threshold - 1e-9).sum())
        placed = points_at(self.vectors[sources], threshold)
        width = min(BEAM, len(self.vectors))
        while width < len(self.vectors):
            links = sum(int((x != own[r]).sum()) for r, x, _ in self.search(queries, width, threshold))
            told = beam(self.parts[0], self.layers[0], placed, self.entries(placed), width)[0] if len(placed) else np.zeros((0, 1))
            if links >= RECALL * exact and (told == sources[:, None]).any(axis=1).sum() >= RECALL * len(sources):
                break
            width *= 2
        return min(width, len(self.vectors))


def points_at(vectors: np.ndarray, cosine: float) -> np.ndarray:
    """A point at the given cosine from each unit vector, in a direction that depends on the number of vectors only."""
    aside = np.random.default_rng(len(vectors)).normal(size=vectors.shape)
    aside -= (aside * vectors).sum(axis=1, keepdims=True) * vectors
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.divide(aside, length, out=np.zeros_like(aside), where=length > 1e-12)
    return cosine * vectors + math.sqrt(max(0.0, 1 - cosine * cosine)) * aside


def _joining(parent: np.ndarray, x: int, nodes: np.ndarray) -> np.ndarray:
    """Of the nodes those whose links to x join what was apart; parent, a node's way to the smallest one of its
    component, then has all of them together."""
    at = np.concatenate(([x], nodes))
    root = parent[at]
    while ((up := parent[root]) != root).any():
        root = up
    apart, first = np.unique(root, return_index=True)
    parent[apart] = parent[at] = apart[0]
    return nodes[first[first > 0] - 1]


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the rows that have it and their vectors."""
    lists = column.combine_chunks()
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == sizes[0]).all():
        return {int(sizes[0]): (np.arange(len(sizes)), values[offsets[0] : offsets[-1]].reshape(len(sizes), -1))}
    at = {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}
    return {d: (rows, values[offsets[rows][:, None] + np.arange(d)]) for d, rows in at.items()}


def _unit(v: np.ndarray) -> np.ndarray:
    """Normalised vectors in double precision."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def near_vectors(embeddings: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", *, threshold: float = 0.95, shards: int = SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept.

    Two rows link if the cosine of their vectors in double precision is at least `threshold`; links are those
    found, none is below. n_links counts other rows; component_id is the smallest vec_id reachable by links,
    itself included; kept says whether that is the row's own. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths. Rows with equal vectors are
    linked with each other and searched once. A pair of which one side's search found the other counts for both, but for
    one case: that the side that found it was compared with a whole shard, and the other one's beam, not full, missed it. Rows that share a vec_id count each; a null vec_id has no
    component of its own: its component_id is null unless a link gives it one. An empty table gives an empty
    result; other columns are not looked at.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    kind = "float" if embeddings.schema[embedding].dataType == T.ArrayType(T.FloatType()) else "double"  # floats are shuffled as they are
    x = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists("v", lambda c: c != 0)
    x = x.withColumn("v", F.when(~F.coalesce(bad, F.lit(True)), F.col("v")))
    x = x.withColumn("id", F.coalesce("vec_id", F.lit((1 << 63) - 1)))
    usable = x.where("v is not null")
    classes = usable.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # classes with one smallest id (repeated ids) still need keys of their own
    classes = classes.withColumn("key", F.xxhash64("rep", "v"))
    n, longest = (classes := cut(classes, "vectors")).agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    n_shards = max(shards, math.ceil(n / max(1, min(shard_rows, SHARD_BYTES // (8 * longest)))))
    plain_type = np.float32 if kind == "float" else np.float64
    audit = classes.orderBy(F.xxhash64("key", F.lit(77)), "key").limit(4 * AUDIT).select("key", "v").toArrow()
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int"))

    asked_by = {d: (np.asarray(audit["key"])[at], _unit(v)) for d, (at, v) in _by_length(audit["v"]).items()}

    def build(table: pa.Table) -> pa.Table:
        key, rep, copies = (np.asarray(table[c]) for c in ("key", "rep", "copies"))
        out = []
        for d, (at, plain) in _by_length(table["v"]).items():
            order = np.argsort(key[at])
            at, plain = at[order], plain[order]
            v = _unit(plain)
            u = (mix(key[at].view(np.uint64)) >> np.uint64(11)).astype(float) / 2.0**53
            graph = Graph(v, np.minimum((-np.log(u + 1e-18) / math.log(LINKS)).astype(int), 8))
            chosen = np.argsort(mix(key[at].view(np.uint64) ^ np.uint64(77)))[:AUDIT]
            far, far_v = asked_by.get(d, (key[:0], v[:0]))
            other = np.flatnonzero(~np.isin(far, key[at]))[:AUDIT]
            width = graph.audited(threshold, np.concatenate([v[chosen], far_v[other]]), np.concatenate([chosen, np.full(len(other), -1)]), chosen)
            packed = io.BytesIO()
            np.savez(packed, width=width, keys=key[at], reps=rep[at], copies=copies[at], vectors=plain, **graph.arrays())
            whole = packed.getvalue()
            pieces = [whole[a : a + PIECE] for a in range(0, len(whole), PIECE)]
            out.append(pa.table({"d": pa.array([d] * len(pieces), pa.int32()), "part": pa.array(range(len(pieces)), pa.int32()), "last": [len(pieces) - 1 - i == 0 for i in range(len(pieces))], "piece": pa.array(pieces, pa.binary())}))
        out = pa.concat_tables(out)
        return out.add_column(0, "shard", pa.array([table["shard"][0].as_py()] * out.num_rows, pa.int32()))

    graphs = cut(dealt.repartitionById(n_shards, "shard").groupBy("shard").applyInArrow(build, "shard int, d int, part int, last boolean, piece binary"), "graphs")
    # a task holds a block of queries and takes a group's graphs one after another: queries are copied for each group,
    # graphs for each block
    tasks = TASKS * spark.sparkContext.defaultParallelism
    per = max(1, min(GRAPHS, n_shards // math.ceil(math.sqrt(tasks))))
    groups = math.ceil(n_shards / per)
    most = max(1, min(MOST_BLOCK, BLOCK_BYTES // (longest * np.dtype(plain_type).itemsize)))
    blocks = max(1, math.ceil(n / most), min(math.ceil(n / BLOCK), math.ceil(tasks / groups)))
    task = (F.col("group") * blocks + F.col("block")).cast("int").alias("task")
    asked = classes.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.select(task, F.lit(-1).alias("shard"), *(F.lit(None).cast(t).alias(c) for c, t in (("d", "int"), ("part", "int"), ("last", "boolean"), ("piece", "binary"))), "key", "rep", "copies", "v")
    sent = graphs.withColumn("group", F.pmod("shard", F.lit(groups))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select(task, "shard", "d", "part", "last", "piece", *(F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("key", "rep", "copies", "v")))

    def ask(shard: int, d: int, pieces: list[bytes], units: dict[int, tuple[np.ndarray, np.ndarray]], asking: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """kind 0: a link of the ids a and b; 1: class a has n links in shard b, all compared; 2: classes a and b are linked,
        a asked, b has n rows and a has m."""
        if d not in units:
            return
        with np.load(io.BytesIO(b"".join(pieces))) as file:
            held = {x: file[x] for x in file.files}
        pieces.clear()
        keys, reps, copies, width = (held.pop(x) for x in ("keys", "reps", "copies", "width"))
        graph = Graph.of(_unit(held.pop("vectors")), held)
        at, plain = units[d]
        key, ids, own = (x[at] for x in asking)
        parent = np.arange(len(keys) + len(key))
        for s in range(0, len(key), BLOCK):
            v = _unit(plain[s : s + BLOCK])
            out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for r, nodes, compared in graph.search(v, int(width), threshold):
                me = s + r
                nodes = nodes[(keys[nodes] != key[me]) & (graph.vectors[nodes] @ v[r] >= threshold)]
                if len(nodes):
                    new = _joining(parent, len(keys) + me, nodes)
                    out.append((0, np.full(len(new), ids[me]), reps[new], np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)))
                if compared:
                    out.append((1, key[me : me + 1], np.array([shard]), copies[nodes].sum(keepdims=True), np.zeros(1, np.int64)))
                else:
                    out.append((2, np.full(len(nodes), key[me]), keys[nodes], copies[nodes], np.full(len(nodes), own[me])))
            if out:
                columns = [np.concatenate([np.full(len(x[1]), x[0]) for x in out]), *(np.concatenate([x[i] for x in out]) for i in range(1, 5))]
                yield pa.record_batch({c: pa.array(x, pa.int64()) for c, x in zip(("kind", "a", "b", "n", "m"), columns, strict=True)})

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        units: dict[int, tuple[np.ndarray, np.ndarray]] | None = None
        asking: list[np.ndarray] = []
        pieces: list[bytes] = []
        for batch in batches:
            first = int(np.searchsorted(np.asarray(batch.column("shard")), 0))
            if first:
                left.append(batch.slice(0, first).select(["key", "rep", "copies", "v"]))
            for g in batch.slice(first).select(["shard", "d", "last", "piece"]).to_pylist():
                if units is None:
                    table = pa.Table.from_batches(left) if left else None
                    left = []
                    units = _by_length(table["v"]) if table is not None else {}
                    asking = [np.asarray(table[c]) for c in ("key", "rep", "copies")] if table is not None else []
                pieces.append(g["piece"])
                if g["last"]:
                    yield from ask(g["shard"], g["d"], pieces, units, asking)
                    pieces.clear()
        pa.default_memory_pool().release_unused()  # the worker lives on, other tasks need the room

    found = asked.unionByName(sent).repartitionById(groups * blocks, "task").sortWithinPartitions("shard", "d", "part").drop("task")
    found = cut(found.mapInArrow(query, "kind long, a long, b long, n long, m long"), "vector-links")
    compared, pairs = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("shard"), "n"), found.where("kind = 2")
    turned = pairs.select(F.col("b").alias("key"), F.col("a").alias("other"), F.col("m").alias("n"))
    pairs = pairs.select(F.col("a").alias("key"), F.col("b").alias("other"), "n").unionByName(turned).dropDuplicates(["key", "other"])
    pairs = pairs.withColumn("shard", F.pmod(F.xxhash64("other"), F.lit(n_shards)).cast("long")).join(compared.select("key", "shard"), ["key", "shard"], "left_anti")
    counts = pairs.select("key", "n").unionByName(compared.select("key", "n")).groupBy("key").agg(F.sum("n").alias("k"))
    roots = components(found.where("kind = 0").select("a", "b"))
    classes = classes.join(counts, "key", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("v", "copies", (F.coalesce("k", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    classes = cut(classes, "vector-roots")
    drop_cut(graphs, found, roots)
    linked = join_hot(usable, classes, ["v"], "copies").select("vec_id", "id", "n_links", "root")
    alone = x.where("v is null").select("vec_id", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("root"))
    both = linked.unionByName(alone)
    return both.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.when(F.col("root") != (1 << 63) - 1, F.col("root")).alias("component_id"), F.coalesce(F.col("vec_id") == F.col("root"), F.lit(False)).alias("kept"))
