"""Helpers the training-data operators share: word hashing, bit filters, steps through batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and U+0009..U+000D.
SPACES = b" \t\n\x0b\x0c\r"
#: The same as a character class for Java and RE2 regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step handles; a longer text makes a step of its own.
STEP_BYTES = 1 << 20


#: Rows of an Arrow batch where Spark's own number, which suits rows of few bytes, stands: texts are longer.
BATCH_ROWS, _DEFAULT_ROWS, _ROWS = 500, "10000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have texts sent to Python in small batches, unless the session has a number of its own: a batch lies in
    memory twice on either side."""
    if spark.conf.get(_ROWS, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def steps(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `limit` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        start = 0
        while start < len(column):
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), len(column))
            yield batch.slice(start, end - start)
            start = end
    pa.default_memory_pool().release_unused()  # the worker lives on, other tasks need the room


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for n positions."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _BASE_INVERSE):
            column = np.full(n, base, dtype=np.uint64)
            column[0] = 1
            made.append(np.multiply.accumulate(column))
        _powers = tuple(made)
    return _powers[0][:n], _powers[1][:n]


def hash_words(texts: list[bytes], lower: bool = True, space: np.ndarray = _IS_SPACE, head: int = 0) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words of the texts in order, the index of each text's first word (one more at the
    end), and each word's first byte and length within the joined bytes. Words are runs of bytes other than
    SPACES, or than those that the table `space` marks; `lower` folds A-Z first. With `head`, hashes of each word's
    first `head` bytes come fifth."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(space[raw].view(np.int8), prepend=1))  # a word's start, the space after it, in turn
    start, end = edge[0::2], edge[1::2]
    sums = _LETTER[_LOWER[raw] if lower else raw]
    up, down = _power(len(raw))
    sums *= up
    np.cumsum(sums, out=sums)
    before = np.where(start > 0, sums[start - 1], np.uint64(0))
    length = end - start

    def upto(n: np.ndarray) -> np.ndarray:
        return mix((sums[start + n - 1] - before) * down[start] + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    first = np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))
    return (upto(length), first, start, length, *([upto(np.minimum(length, head))] if head else []))


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; with fewer words the whole sequence is the only one;
    without words there are none."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total = mix(total) * np.uint64(0xA0761D6478BD642F) + words[i : len(words) - k + 1 + i]
    return np.unique(mix(total))


def bit_filter(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A Bloom filter of 2**bits bits (at most 16 MB, whatever the input) over a column of 64-bit integers,
    built on the executors; three probes a value."""
    size = 1 << min(bits, 27)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size // 8, dtype=np.uint8)
        for batch in batches:
            for at in probes(np.asarray(batch.column(0)), size):
                np.bitwise_or.at(table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        parts = table.reshape(-1, min(len(table), 8192))
        full = np.flatnonzero(parts.any(axis=1))
        if len(full):
            yield pa.record_batch({"part": pa.array(full), "bits": pa.array([parts[i].tobytes() for i in full])})

    def merged(table: pa.Table) -> pa.Table:
        out = None
        for x in table.column("bits").to_pylist():
            x = np.frombuffer(x, dtype=np.uint8)
            out = x.copy() if out is None else out | x
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([out.tobytes()])})

    schema = "part long, bits binary"
    parts = df.select(column).where(F.col(column).isNotNull()).mapInArrow(partial, schema)
    table = np.zeros(size // 8, dtype=np.uint8)
    width = min(len(table), 8192)
    for part, bits_ in parts.groupBy("part").applyInArrow(merged, schema).collect():
        table[part * width : (part + 1) * width] = np.frombuffer(bits_, dtype=np.uint8)
    return table


def probes(values: np.ndarray, size: int) -> list[np.ndarray]:
    x = mix(values.astype(np.int64).view(np.uint64))
    mask = np.uint64(size - 1)
    return [x & mask, (x >> np.uint64(20)) & mask, (x >> np.uint64(37)) & mask]


def maybe_in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be in the filter; none that is in it is missed."""
    found = np.ones(len(values), dtype=bool)
    for at in probes(values, len(table) * 8):
        found &= (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def id_filter(ids: DataFrame, column: str):
    """A broadcast bit filter (16 MB at most) over a column of ids."""
    n = ids.count()
    table = bit_filter(ids, column, max(16, (16 * n).bit_length())) if n else np.zeros(1 << 13, dtype=np.uint8)
    return ids.sparkSession.sparkContext.broadcast(table)


def without(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs less the rows whose id is among ids (its first column). Rows that a bit filter clears aren't
    shuffled; the few others are joined. A null id is never among them."""
    name = free_name(docs.columns, "gone")
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias(name)).where(F.col(name).isNotNull()).distinct()
    sent = id_filter(ids, name)
    at = docs.columns.index(doc_id)

    def part(batches: Iterator[pa.RecordBatch], maybe: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at).cast(pa.int64())
            found = maybe_in(sent.value, np.asarray(column.fill_null(0))) & np.asarray(column.is_valid())
            if (found == maybe).any():
                yield batch.filter(pa.array(found == maybe))

    doubt = docs.mapInArrow(lambda x: part(x, True), docs.schema)
    doubt = doubt.join(ids, F.col(doc_id).cast("long") == F.col(name), "left_anti")
    return docs.mapInArrow(lambda x: part(x, False), docs.schema).unionByName(doubt)


#: Keys that are broadcast at most; rows a key has at least to be one of them.
HOT_KEYS, HOT_ROWS = 100_000, 4096


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, *, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """left joined with right on keys. right has one row a key, and in `weight` how many rows of left have it.
    Frequent keys don't meet in one task: right's rows for them, HOT_KEYS at most as their rows add up to
    left's, are broadcast. Null keys meet nothing. how: inner or left."""
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    limit = max(hot_rows, total // HOT_KEYS)
    hot = right.where(F.col(weight) > limit)
    if hot.head() is None:
        return left.join(right, keys, how)
    few = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(weight) <= limit), keys, how)
    return left.join(F.broadcast(hot), keys).unionByName(few)


def free_name(taken: list[str], wish: str) -> str:
    """`wish`, with underscores added until no column of `taken` has that name (case ignored)."""
    while wish.lower() in {c.lower() for c in taken}:
        wish += "_"
    return wish
