"""Self-join of texts on the Jaccard similarity of their word shingles, by token-combination prefixes.

A text's tokens are its distinct shingles, ordered by one global order: rare tokens first, then the frequent
ones by rising level of frequency, as bit filters tell it (one that errs calls a token frequent for all texts). Linked sets x and y differ in floor(|x| / 4) tokens of x at most, so any part of x
that outlasts the loss of that many tokens must meet y. A rare token counts alone. Frequent tokens are dealt
into classes by their hash, and two of a class count as one combination: killing a class of c tokens costs
c - 1 losses. The prefix is extended until killing it costs more than the allowed losses; linked sets then
share a rare token, or a pair of tokens of one class, of their prefixes. The number of classes follows the
set's size octave, so that combinations stay in proportion to the prefix; a set also indexes the octave below
if a partner can be there.

Copies (equal sets) leave one representative before anything is indexed. A signature's holders are first
compared with one anchor each; components of the verified links then decide which signatures still join
different components, and only there all pairs are looked at, block by block, with an exact bound by parity
bitmaps before anything is emitted: first pairs that would join components if they hold, then all that are
left. Each candidate is verified on whole token sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.components import components
from tracewell.llm.shared import HOT_KEYS, as_bytes, bit_filter, free_name, hash_words, id_filter, join_hot, maybe_in, mix, shingle_hashes, small_batches, steps, without
from tracewell.storage import cut, drop_cut

#: Sightings from which on a token is of frequency level 1, 2, 3; below, it is rare. A sighting counts in a chunk of
#: CHUNK tokens only from SEEN on. A frequent token that counts as rare costs time but no link.
LEVELS, CHUNK, SEEN = (32, 1 << 10, 1 << 15), 1 << 20, 3
#: Tasks over which a frequent combination's holders are dealt; holders in one block; bits of a parity bitmap.
SALT, BLOCK, BITS = 16, 1024, 4096
#: Tokens of both sides of the pairs that one block verifies, more or less: a pair of long texts has one for itself.
GROUP = 1 << 18
#: Keys from here on stand for rows without a doc_id.
NO_ID = 1 << 62
SETS = "doc long, n long, a long, b long, bits binary, token long, seen long"


def token_sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    words, first, _, _ = hash_words(texts)
    for i in range(len(texts)):
        yield shingle_hashes(words[first[i] : first[i + 1]], shingle)


def parity(tokens: np.ndarray) -> bytes:
    return np.packbits((np.bincount((tokens >> np.uint64(52)).astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes()


def levels_of(tokens: np.ndarray, filters: list[np.ndarray]) -> np.ndarray:
    """The frequency level of each token, 0 for a rare one."""
    out = np.zeros(len(tokens), dtype=np.int64)
    at = np.arange(len(tokens))
    for level, table in enumerate(filters, 1):
        at = at[maybe_in(table, tokens[at].view(np.int64))]
        out[at] = level
    return out


def signatures(tokens: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single tokens and combinations that a set indexes. levels: each token's frequency level."""
    n = len(tokens)
    need = n // 4 + 1
    rare = tokens[levels == 0]
    if len(rare) >= need:
        return rare[:need], np.zeros(0, dtype=np.uint64)
    hot = tokens[levels > 0]
    hot = hot[np.lexsort((mix(hot), levels[levels > 0]))]
    octave = n.bit_length() - 1
    singles, pairs = [rare], []
    for o in [octave] + [octave - 1] * (octave > 0 and 3 * n < 4 << octave):
        if o == 0:
            singles.append(hot)
            continue
        group = mix(hot) % np.uint64(max(1, (1 << o) >> 3))
        order = np.argsort(group, kind="stable")
        nth = np.empty(len(hot), dtype=np.int64)  # place within the group, in the global order
        starts = np.flatnonzero(np.diff(group[order].astype(np.int64), prepend=-1))
        nth[order] = np.arange(len(hot)) - np.repeat(starts, np.diff(np.append(starts, len(hot))))
        end = int(np.searchsorted(np.cumsum(nth > 0), need - len(rare))) + 1
        for g in np.unique(group[:end][nth[:end] > 0]):
            x = np.sort(hot[:end][group[:end] == g])
            i, j = np.triu_indices(len(x), 1)
            pairs.append(mix(mix(x[i]) + x[j] + np.uint64(o)))
    return np.unique(np.concatenate(singles)), np.concatenate(pairs) if pairs else np.zeros(0, dtype=np.uint64)


def _keep_maybe(batches: Iterator[pa.RecordBatch], wanted, inside: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = maybe_in(wanted.value, np.asarray(batch.column(0)))
        if (found if inside else ~found).any():
            yield batch.filter(pa.array(found if inside else ~found))


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, shingle: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    A-Z are lower-cased and words are [^\\x20\\x09-\\x0D]+; a set holds the text's distinct shingles, with fewer
    words the whole sequence as one; without words (or null text) it is empty and linked with nothing. Texts
    link when 100 * |x and y| >= 75 * |x or y|. component_id is the smallest doc_id reachable by links, itself
    included. Tokens are 64-bit hashes of whole shingles. Rows that share a doc_id are looked at on their own,
    and a link of one of them counts for that doc_id. doc_ids are below 2**62. Rows with a null doc_id are told apart
    by their texts and sort last; a component of null ids alone has a null component_id. An empty table gives an
    empty result; other columns are not looked at.
    """
    rows = _near(docs, text, doc_id, shingle)
    return rows.select(F.when(F.col("doc") < NO_ID, F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("root") < NO_ID, F.col("root")).alias("component_id"))


def _key(text: str, doc_id: str) -> Column:
    """doc_id; a row without one gets a key made of its text, behind all doc_ids."""
    return F.coalesce(F.col(doc_id).cast("long"), F.shiftrightunsigned(F.xxhash64(F.col(text).cast("string")), 2) + F.lit(NO_ID))


def _near(docs: DataFrame, text: str, doc_id: str, shingle: int) -> DataFrame:
    """(doc, n, root) of each row: its key, the size of its set, the smallest key of its component."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(_key(text, doc_id).alias("doc"), F.col(text).cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, size = [], 0

        def seen() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(pool), return_counts=True)
            keep = n >= SEEN
            return _rows(SETS, {"token": tokens[keep].view(np.int64), "seen": n[keep]}, int(keep.sum()))

        for batch in steps(batches):
            out = {"doc": np.asarray(batch.column(0)), "n": [], "a": [], "b": [], "bits": []}
            for tokens in token_sets(as_bytes(batch.column(1)), shingle):
                out["n"].append(len(tokens))
                out["a"].append(int(mix(tokens).sum(dtype=np.uint64).view(np.int64)) if len(tokens) else 0)
                out["b"].append(int(np.bitwise_xor.reduce(mix(tokens ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(tokens) else 0)
                out["bits"].append(parity(tokens))
                pool.append(tokens)
                size += len(tokens)
            yield _rows(SETS, out, batch.num_rows)
            if size >= CHUNK:
                yield seen()
                pool, size = [], 0
        if size:
            yield seen()

    measured = cut(docs.mapInArrow(measure, SETS), "ngram-sets")
    seen = cut(measured.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= LEVELS[0]), "ngram-frequent")
    counts = seen.agg(*[F.count_if(F.col("seen") >= x) for x in LEVELS]).first()
    filters = [bit_filter(seen.where(F.col("seen") >= x), "token", max(16, (16 * n).bit_length())) for x, n in zip(LEVELS, counts, strict=True) if n]
    frequent = spark.sparkContext.broadcast(filters)  # 16 MB each at most
    sets = measured.where("doc is not null").select("doc", "n", "a", "b", "bits")

    classes = cut(sets.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")), "ngram-classes")
    whose = ["a", "b", "n"]
    others = join_hot(sets.select("doc", *whose), classes.where("copies > 1"), whose, "copies").where("doc <> rep").select("doc")
    copies = id_filter(others, "doc")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            ids = np.asarray(batch.column(0))
            sig, doc, part = [], [], []
            found = list(token_sets(as_bytes(batch.column(1)), shingle))
            levels = np.split(levels_of(np.concatenate(found), frequent.value), np.cumsum([len(x) for x in found])[:-1])
            for i, tokens, level in zip(ids, found, levels, strict=True):
                if len(tokens):
                    singles, combos = signatures(tokens, level)
                    sig += [singles, combos]
                    doc.append(np.full(len(singles) + len(combos), i))
                    part.append(np.repeat([0, 1 + int(i) * 0x9E3779B1 % SALT], [len(singles), len(combos)]))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(part), pa.int32())], names=["sig", "doc", "part"])

    schema = "sig long, doc long, part int"
    plain = docs.mapInArrow(lambda x: sign(_keep_maybe(x, copies, False)), schema)
    # those that the filter takes for copies, less the copies
    doubt = docs.mapInArrow(lambda x: _keep_maybe(x, copies, True), "doc long, text string")
    doubt = doubt.join(classes.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi").select("doc", "text").mapInArrow(sign, schema)
    holders = Window.partitionBy("sig", "part")
    posts = plain.unionByName(doubt).withColumn("anchor", F.min("doc").over(holders)).withColumn("other", F.max("doc").over(holders))
    posts = cut(posts.where("anchor <> other or part > 0").drop("other").distinct(), "ngram-posts")

    # first each document and the anchor that it shares most signatures with
    near = posts.where("doc <> anchor").groupBy("doc", "anchor").agg(F.count(F.lit(1)).alias("k"))
    near = near.groupBy("doc").agg(F.max(F.struct("k", -F.col("anchor"))).alias("best")).select((-F.col("best.col2")).alias("a"), F.col("doc").alias("b"))
    salted = posts.where("part > 0").groupBy("sig", "anchor").count().select("sig", "anchor")
    lead = salted.groupBy("sig").agg(F.min("anchor").alias("lead"))
    lead = salted.join(lead, "sig").where("anchor <> lead").groupBy("lead", "anchor").count().select(F.col("lead").alias("a"), F.col("anchor").alias("b"))
    stars = cut(near.unionByName(lead).distinct(), "ngram-stars")
    pairs = cut(_bounded(stars, sets), "ngram-pairs")
    links = verified(docs, pairs, shingle)
    passing = [seen, posts, stars, pairs, links]
    tried = pairs.select("a", "b")
    for forest in (True, False):
        roots = cut(components(links), "ngram-roots")
        found = cut(_crossing(posts, sets, roots, forest, passing).join(tried, ["a", "b"], "left_anti"), "ngram-pairs")
        tried = tried.unionByName(found.select("a", "b"))
        more = verified(docs, found, shingle)
        links = cut(links.unionByName(more), "ngram-links")
        passing += [roots, found, more, links]
    roots = cut(components(links), "ngram-roots")
    drop_cut(*passing)
    classes = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(*whose, "copies", F.coalesce("root", "rep").alias("root"))
    rows = join_hot(sets.where("n > 0").select("doc", *whose), cut(classes, "ngram-rooted"), whose, "copies").select("doc", "n", "root")
    return rows.unionByName(sets.where("n = 0").select("doc", "n", F.col("doc").alias("root")))


def _rows(schema: str, columns: dict, n: int) -> pa.RecordBatch:
    """A batch of the schema; columns that aren't given are null."""
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(n, kinds[k]) for c, k in fields], names=[c for c, _ in fields])


def _crossing(posts: DataFrame, sets: DataFrame, roots: DataFrame, forest: bool, passing: list[DataFrame]) -> DataFrame:
    """Pairs (a, b, w: tokens of both) of different components that share a signature and that the bound can't rule out.

    Signatures with the same first holder are looked at together, each pair of their documents once. A large
    group is dealt into pairs of blocks. forest: of a block's pairs, by rising difference, only those that join
    what the ones before left apart, so that there are fewer than documents; otherwise all of them."""
    held = posts.select("sig", "doc").join(roots.withColumnRenamed("id", "doc"), "doc", "left").select("sig", "doc", F.coalesce("root", "doc").alias("root"))
    same = (F.bit_xor(F.xxhash64("doc")).alias("x"), F.sum(F.shiftright(F.xxhash64("doc", F.lit(1)), 24)).alias("y"), F.count(F.lit(1)).alias("m"))
    mixed = held.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("doc").alias("label"), *same).where("lo < hi")
    mixed = mixed.groupBy("m", "x", "y").agg(F.min(F.struct("sig", "label")).alias("s")).select("s.*")  # signatures with the same holders say the same
    rows = held.join(mixed, "sig").groupBy("label", "doc").agg(F.min("root").alias("root"), F.collect_list("sig").alias("sigs"))  # a document's own signatures
    rows = cut(rows, "ngram-held")
    passing.append(rows)
    # few labels have more than a block, so that theirs are sent to all instead of dealing all rows by label
    blocks = cut(rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).where("parts > 1"), "ngram-blocks")
    passing.append(blocks)
    about = sets.groupBy("doc", "n", "a", "b").agg(F.first("bits").alias("bits")).drop("a", "b")  # of an id that repeats each text
    rows = rows.join(F.broadcast(blocks) if blocks.count() <= HOT_KEYS else blocks, "label", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("doc"), "parts")).join(about, "doc")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("label", F.least("i", "k").alias("lo"), F.greatest("i", "k").alias("hi"), "i", "doc", "root", "sigs", "n", "bits")

    def block(table: pa.Table) -> pa.Table:
        i, lo, inside = np.asarray(table["i"]), table["lo"][0].as_py(), table["lo"][0].as_py() == table["hi"][0].as_py()
        doc, root, n = np.asarray(table["doc"]), np.asarray(table["root"]).copy(), np.asarray(table["n"])
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), dtype=np.uint64).reshape(len(doc), BITS // 64)
        sigs = table["sigs"].combine_chunks()
        sig, at = sigs.flatten().to_numpy(), sigs.offsets.to_numpy() - sigs.offsets[0].as_py()
        order = np.argsort(sig, kind="stable")
        owner = np.repeat(np.arange(len(doc)), np.diff(at))[order]
        begin, end = (np.searchsorted(sig[order], sig, side=side) for side in ("left", "right"))
        one, other, apart = [], [], []
        for r in range(len(doc)):
            if not inside and i[r] != lo:
                continue
            near = np.zeros(len(doc), dtype=bool)
            for a, b in zip(begin[at[r] : at[r + 1]].tolist(), end[at[r] : at[r + 1]].tolist(), strict=True):
                if b - a > 1:
                    near[owner[a:b]] = True
            near[: r + 1] &= not inside
            c = np.flatnonzero(near)
            if not inside:
                c = c[i[c] != lo]
            c = c[(root[c] != root[r]) & (4 * np.minimum(n[c], n[r]) >= 3 * np.maximum(n[c], n[r]))]
            if len(c):
                differ = np.bitwise_count(bits[c] ^ bits[r]).sum(axis=1, dtype=np.int64)
                ok = 7 * differ <= n[c] + n[r]  # the bitmaps' difference is the sets' at most
                one.append(np.full(int(ok.sum()), r))
                other.append(c[ok])
                apart.append(differ[ok])
        x, y, d = (np.concatenate(z) if z else np.zeros(0, dtype=np.int64) for z in (one, other, apart))
        if forest:
            keep = []
            for e in np.argsort(d, kind="stable").tolist():
                p, q = root[x[e]], root[y[e]]
                if p != q:
                    root[root == q] = p
                    keep.append(e)
            x, y = x[keep], y[keep]
        return pa.table({"a": pa.array(np.minimum(doc[x], doc[y]), pa.int64()), "b": pa.array(np.maximum(doc[x], doc[y]), pa.int64()), "w": pa.array(n[x] + n[y], pa.int64())})

    return rows.groupBy("label", "lo", "hi").applyInArrow(block, "a long, b long, w long").where("a <> b").groupBy("a", "b").agg(F.max("w").alias("w"))


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parity bitmaps don't rule out, with w: the tokens of both."""
    wanted = id_filter(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct(), "doc")
    about = sets.select("doc", "n", "bits").mapInArrow(lambda x: _keep_maybe(x, wanted, True), "doc long, n long, bits binary")
    side = lambda c: about.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = np.asarray(batch.column(2)), np.asarray(batch.column(3))
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64) for c in (4, 5))
                ok = (7 * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= n + m) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n + m)], names=["a", "b", "w"]).filter(pa.array(ok))

    return both.mapInArrow(rule_out, "a long, b long, w long").groupBy("a", "b").agg(F.max("w").alias("w"))


def verified(docs: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose whole token sets link. Only texts of candidates are shuffled: pairs that share
    their smallest partner are checked together, so that a text comes once for many pairs, in blocks of about
    GROUP tokens."""
    ids = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    wanted = id_filter(ids, "doc")
    texts = docs.mapInArrow(lambda x: _keep_maybe(x, wanted, True), "doc long, text string")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label"))
    dealt = pairs.join(label, "a")
    sizes = cut(dealt.groupBy("label").agg(F.ceil(F.sqrt(F.sum("w") / GROUP)).alias("k")).where("k > 1"), "ngram-sizes")
    few = F.col("k") == 1  # small groups share a block
    blocks = max(1, (pairs.agg(F.sum("w")).first()[0] or 0) // GROUP)
    dealt = dealt.join(F.broadcast(sizes) if sizes.count() <= HOT_KEYS else sizes, "label", "left").withColumn("k", F.coalesce("k", F.lit(1))).select("a", "b", F.when(few, F.pmod(F.xxhash64("label"), F.lit(blocks))).otherwise(F.col("label")).alias("g"), F.when(few, -1).otherwise(F.pmod(F.xxhash64("a"), "k")).alias("i"), F.when(few, -1).otherwise(F.pmod(F.xxhash64("b"), "k")).alias("j"))
    dealt = cut(dealt, "ngram-dealt")
    block = [F.col(c).alias(f"of_{c}") for c in ("g", "i", "j")]
    need = dealt.select(*block, F.col("a").alias("doc")).unionByName(dealt.select(*block, F.col("b").alias("doc"))).distinct()
    held = need.join(texts, "doc")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for batch in steps(left.select(["doc", "text"]).to_batches()):
            for i, tokens in zip(batch.column(0).to_pylist(), token_sets(as_bytes(batch.column(1)), shingle), strict=True):
                sets.setdefault(i, []).append(tokens)  # a repeated id has several texts
        ok = []
        for a, b in zip(right["a"].to_pylist(), right["b"].to_pylist(), strict=True):
            ok.append(any(_linked(x, y) for x in sets[a] for y in sets[b]))
        return right.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = cut(held.groupBy("of_g", "of_i", "of_j").cogroup(dealt.groupBy("g", "i", "j")).applyInArrow(check, "a long, b long"), "ngram-links")
    drop_cut(dealt, sizes)
    return links


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= 75 * (len(x) + len(y) - common)


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, shingle: int = 5) -> DataFrame:
    """The rows of docs that have the smallest doc_id of their component, with all their columns. Rows that share a
    doc_id, and equal texts without one, stay or go together."""
    found = _near(docs, text, doc_id, shingle)
    gone = cut(found.where("root <> doc").select("doc"), "ngram-gone")
    key = free_name(docs.columns, "key")
    return without(docs.withColumn(key, _key(text, doc_id)), gone, key).drop(key)
