"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import WORD, free_name
from tracewell.storage import cut, drop_cut

#: Rows a range of the random key holds on average; more rows in a source mean more ranges, not longer ones.
RANGE_ROWS = 4096
#: Sources whose plan is broadcast (under 100 bytes each); that of more is joined.
SENT = 100_000
WEIGHTS = (5, 2, 1)
#: A source gives its own size at most so many times.
REPEATS = 3


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """Words each source should give. sizes: by code point, null last. The weights repeat over the sources and
    share 100 % of all sizes; a source stops at `repeats` times its size, and the excess is shared by weight
    among the others until none is above."""
    total = sum(n for _, n in sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        left = total - sum(repeats * sizes[i][1] for i in full)
        open_weight = sum(w for i, w in enumerate(weight) if i not in full)
        share = [repeats * n if i in full else left * w / open_weight for i, ((_, n), w) in enumerate(zip(sizes, weight, strict=True))]
        above = {i for i, (x, (_, n)) in enumerate(zip(share, sizes, strict=True)) if i not in full and x > repeats * n}
        if not above:
            return [float(x) for x in share]
        full |= above
        if len(full) == len(sizes):
            return [float(repeats * n) for _, n in sizes]


def _plan(rows: DataFrame, name: str, size: str, key: str, weights: tuple[int, ...], repeats: int) -> list[tuple]:
    """For each source: name, size, target, how often all of it is given, words beyond that, number of ranges of the
    key, the range in which those words end and the words before it (after the last range if all are given)."""
    spark = rows.sparkSession
    by_source = rows.groupBy(name).agg(F.sum(size), F.count(F.lit(1))).collect()
    by_source = sorted(map(tuple, by_source), key=lambda r: r[0])
    plan = []
    for (s, n, k), goal in zip(by_source, targets([(s, n) for s, n, _ in by_source], weights, repeats), strict=True):
        whole = min(repeats, int(goal // n)) if n else 0
        rest = max(0, min(n, round(goal) - whole * n)) if whole < repeats else 0
        plan.append((s, n, goal, whole, rest, max(1, k // RANGE_ROWS)))
    ranges = _few(spark.createDataFrame([(s, p, r) for s, _, _, _, r, p in plan], "name string, ranges long, rest long"), len(plan))
    sums = rows.select(F.col(name).alias("name"), F.col(size).alias("size"), F.col(key).alias("key")).join(ranges, "name")
    sums = sums.groupBy("name", "rest", _range(F.col("key"), F.col("ranges")).alias("range")).agg(F.sum("size").alias("size"))
    # prefix sums in two levels: over blocks of ranges, and within each block
    sums = sums.withColumn("block", F.expr(f"range div {RANGE_ROWS}"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("name", "block").agg(F.sum("size").alias("of")).select("name", "block", F.coalesce(F.sum("of").over(before("name").orderBy("block")), F.lit(0)).alias("base"))
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(before("name", "block").orderBy("range")), F.lit(0))).join(blocks, ["name", "block"])
    sums = sums.withColumn("before", F.col("before") + F.col("base")).where("before <= rest and before + size > rest")
    cuts = {r["name"]: (r["range"], r["before"]) for r in sums.select("name", "range", "before").collect()}  # one row a source at most
    return [(*row, *cuts.get(row[0], (row[5], 0))) for row in plan]


def _range(key: Column, ranges: Column) -> Column:
    """The key's upper 32 bits pick one of the source's equal ranges, in order."""
    return F.floor((F.shiftright(key, 32) + F.lit(1 << 31)) * ranges / F.lit(1 << 32)).cast("long")


def _few(rows: DataFrame, n: int) -> DataFrame:
    """rows to be broadcast unless they are many."""
    return F.broadcast(rows) if n <= SENT else rows


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", *, n_words: Column | None = None, text_hash: Column | None = None, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 20) -> DataFrame:
    """docs with columns size, source_size, target and taken added (renamed with underscores if docs has them).

    size: words of the text (null: 0). taken: words the mix takes, repeats counted. A source first gives
    all its documents as often as its target holds its size whole; the rest comes from the documents in the
    order of a hash of doc_id, and the document at the cut gives exactly the words that are missing. Rounded
    to whole words, each source gives its target. Null sources form one source that sorts last, null doc_ids
    hash by their text, repeated rows count separately, ties of the hash are ordered by doc_id, size and text. An
    empty table gives an empty result. Reruns agree. Where docs no longer hold the texts, n_words and text_hash
    say what was computed from them.

    Two rows per source reach the driver; all else is sums over ranges of the key. Only the range in which a
    source's budget ends is shuffled and sorted: what lies before it gives all, what lies behind it nothing more.
    """
    names: list[str] = []
    for wish in ("size", "source_size", "target", "taken", "mix_key", "mix_tie", "mix_source", "mix_range", "mix_before", "mix_full", "mix_rest", "mix_ranges", "mix_cut"):
        names.append(free_name([*docs.columns, *names], wish))
    size, source_size, target, taken, key, tie, name, piece, before, full, rest, ranges, at = names
    # a null source gets a key of its own; 1 before 2, so null sorts last
    source_key = F.when(F.col(source).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))
    n_words, tied = words(F.col(text)) if n_words is None else n_words, F.xxhash64(F.col(text).cast("string")) if text_hash is None else text_hash
    columns = [*docs.columns, size, source_size, target, taken]
    docs = docs.withColumn(name, source_key).withColumn(key, F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), tied.cast("string"))))
    slim = cut(docs.select(name, n_words.alias(size), key), "mix-sizes")
    plan = _plan(slim, name, size, key, weights, repeats)
    drop_cut(slim)
    plan_df = docs.sparkSession.createDataFrame(plan, f"`{name}` string, `{source_size}` long, `{target}` double, `{full}` long, `{rest}` long, `{ranges}` long, `{at}` long, `{before}` long")
    docs = docs.join(_few(plan_df, len(plan)), name).withColumn(piece, _range(F.col(key), F.col(ranges)))
    within = Window.partitionBy(name).orderBy(key, doc_id, size, tie).rowsBetween(Window.unboundedPreceding, -1)
    here = docs.where(F.col(piece) == F.col(at)).withColumn(size, n_words).withColumn(tie, tied).withColumn(before, F.col(before) + F.coalesce(F.sum(size).over(within), F.lit(0)))
    here = here.withColumn(taken, F.least(F.greatest(F.col(rest) - F.col(before), F.lit(0)), F.col(size)))
    there = docs.where(F.col(piece) != F.col(at)).withColumn(size, n_words).withColumn(taken, F.when(F.col(piece) < F.col(at), F.col(size)).otherwise(F.lit(0)))
    docs = there.unionByName(here.drop(tie)).withColumn(taken, F.col(full) * F.col(size) + F.col(taken))
    return docs.select(*columns)


def expand(mixed: DataFrame, columns: list[str], text: str = "text", size: str = "size", taken: str = "taken") -> DataFrame:
    """The rows that a mix takes: a document as often as it is taken whole, and a part of `taken mod size`
    words, cut behind its last word, for the document at its source's cut. A document without words takes
    no room in the budget and stays once."""
    whole = F.when(F.col(size) > 0, F.floor(F.col(taken) / F.col(size))).otherwise(F.lit(1)).cast("int")
    left = F.when(F.col(size) > 0, F.col(taken) % F.col(size)).otherwise(F.lit(0)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<int>")))
    part = free_name(mixed.columns, "part")
    rows = mixed.withColumn(part, F.explode(copies))
    parts = F.slice(F.split(F.regexp_replace(F.col(text), r"\A[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), F.lit(1), F.col(part))
    return rows.withColumn(text, F.when(F.col(part) < 0, F.col(text)).otherwise(F.array_join(parts, " "))).select(*columns)


def draw(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The documents of the mix, with the columns of docs: repeated as often as they are taken whole, cut where their
    source's budget ends. Null and empty texts take no words and stay once; null sources are one of their own, the last;
    null ids, repeated rows and columns named like the mix's own change nothing; an empty table gives an empty one."""
    names = {c: free_name(docs.columns, c) for c in ("size", "taken")}
    return expand(mix(docs, text, source, doc_id), docs.columns, text, names["size"], names["taken"])


def query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; texts are read once and not shuffled. Null texts and
    sources, ties and repeated rows are treated as in mix(); other columns are not looked at; an empty table gives an
    empty result."""
    slim = docs.select("doc_id", "source", words(F.col("text")).alias("n_words"), F.xxhash64("text").alias("text_hash"))
    mixed = mix(cut(slim, "mix-sizes"), n_words=F.col("n_words"), text_hash=F.col("text_hash"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
