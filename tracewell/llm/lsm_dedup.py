"""Exact deduplication over a log-structured merge index.

Every task keeps a bounded memtable of digests. A full memtable is flushed as a run: rows sorted by digest,
with a bit filter of their digests. Size-tiered compaction merges runs; of one digest's entries it keeps the
row with the most code points, then the smallest identifier, and adds up the counts. A task emits its one
compacted run, so a group of copies leaves one row a task, however large it is. Runs then meet by digest
range, where the same compaction makes the final index. Rows whose digest the index counts more than once
are hits: their normalised bytes are verified, in that all texts of one digest must be one text. Equal texts of
a task are aggregated before they are shuffled, so that a group of copies costs one text a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import HOT_KEYS, SPACES, as_bytes, bit_filter, free_name, join_hot, maybe_in, probes, small_batches, steps, without
from tracewell.storage import cut, drop_cut

#: A null identifier sorts behind every other.
NO_ID = (1 << 63) - 1
INDEX = "digest binary, keep_chars long, keep_id long, rows long, same long"
_HASHED = np.dtype([("digest", "S16"), ("chars", "i8"), ("id", "i8"), ("rows", "i8"), ("same", "i8")])


class Run:
    """Rows sorted by digest, one a digest, and a bit filter over them (16 bits a row)."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.bits = np.zeros(1 << max(3, int(len(rows) * 2).bit_length()), dtype=np.uint8)
        for at in self._probes(rows["digest"]):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def _probes(self, digests: np.ndarray) -> list[np.ndarray]:
        words = np.ascontiguousarray(digests).view(np.int64)[::2]
        return probes(words, len(self.bits) * 8)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Position of each digest in the run, -1 if it isn't there; the filter spares most searches."""
        out = np.full(len(digests), -1, dtype=np.int64)
        maybe = np.flatnonzero(maybe_in(self.bits, np.ascontiguousarray(digests).view(np.int64)[::2]))
        at = np.searchsorted(self.rows["digest"], digests[maybe])
        at[at == len(self.rows)] = 0
        hit = self.rows["digest"][at] == digests[maybe] if len(self.rows) else np.zeros(0, dtype=bool)
        out[maybe[hit]] = at[hit]
        return out


def compact(parts: list[np.ndarray]) -> np.ndarray:
    """One sorted array with one row a digest: most code points first, then the smallest identifier; `rows`
    adds up, `same` counts rows that tie with the one kept in both."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows["id"], -rows["chars"], rows["digest"]))]
    if not len(rows):
        return rows
    digest = rows["digest"]
    first = np.flatnonzero(np.concatenate(([True], digest[1:] != digest[:-1])))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
    ties = (rows["chars"] == rows["chars"][first][group]) & (rows["id"] == rows["id"][first][group])
    out = rows[first].copy()
    out["rows"] = np.add.reduceat(rows["rows"], first)
    out["same"] = np.add.reduceat(np.where(ties, rows["same"], 0), first)
    return out


class LsmIndex:
    """memtable: rows before a flush. fan: runs of one size class before they are merged."""

    def __init__(self, memtable: int = 1 << 17, fan: int = 4):
        self.memtable, self.fan = memtable, fan
        self.fresh: list[np.ndarray] = []
        self.n = 0
        self.runs: list[Run] = []

    def put(self, rows: np.ndarray) -> None:
        for start in range(0, len(rows), self.memtable):
            part = rows[start : start + self.memtable]
            self.fresh.append(part)
            self.n += len(part)
            if self.n >= self.memtable:
                self.flush()

    def flush(self) -> None:
        if not self.n:
            return
        rows = compact(self.fresh)
        self.fresh, self.n = [], 0
        for run in self.runs:  # entries that an older run has are folded into it in place, unless a better row came
            at = run.find(rows["digest"])
            had = at >= 0
            old = run.rows[at[had]]
            new = rows[had]
            worse = (new["chars"] < old["chars"]) | ((new["chars"] == old["chars"]) & (new["id"] > old["id"]))
            keep = np.flatnonzero(had)[worse]
            run.rows["rows"][at[keep]] += rows["rows"][keep]
            rows = np.delete(rows, keep)
        if len(rows):
            self.runs.append(Run(rows))
        while len(self.runs) >= self.fan and len({len(r.rows).bit_length() // 2 for r in self.runs[-self.fan :]}) == 1:
            self.runs[-self.fan :] = [Run(compact([r.rows for r in self.runs[-self.fan :]]))]

    def rows(self) -> np.ndarray:
        self.flush()
        if len(self.runs) > 1:
            self.runs = [Run(compact([r.rows for r in self.runs]))]
        return self.runs[0].rows if self.runs else np.zeros(0, dtype=_HASHED)


def _batches(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), 1 << 16):
        x = rows[start : start + (1 << 16)]
        digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(np.ascontiguousarray(x["digest"]))])
        yield pa.RecordBatch.from_arrays([digests.cast(pa.binary()), *(pa.array(x[c]) for c in ("chars", "id", "rows", "same"))], names=["digest", "keep_chars", "keep_id", "rows", "same"])


def _normal(text: bytes) -> bytes:
    return text.translate(None, SPACES)


def _key(sha: bytes, width: int) -> bytes:
    """The index's 16 bytes; fewer than 16 are used only to test collisions. The last byte is never 0, which
    numpy would cut off."""
    return sha[:width].ljust(15, b"\x01")[:15] + bytes([sha[15] | 1 if width == 16 else 1])


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, memtable: int = 1 << 17, width: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of [\\x20\\x09-\\x0D]. Of equal texts the row with
    the most code points stays, then the smallest doc_id. Null text counts as empty; a null doc_id sorts last
    and may stay as keep_id null. Of rows that repeat the kept row's doc_id and length, exactly one is kept.
    An empty table gives an empty result; other columns are not looked at. `memtable` bounds the rows a task
    holds unsorted; `width` is the digest's bytes in the index (16; fewer only to test collisions).
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession

    def digests(batch: pa.RecordBatch) -> tuple[list[bytes], list[bytes]]:
        normal = [_normal(x) for x in as_bytes(batch.column(1))]
        return normal, [hashlib.sha256(x).digest() for x in normal]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sha = digests(batch)[1]
            chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.binary()), pa.array([_key(x, width) for x in sha], pa.binary()), chars], names=["id", "sha", "digest", "chars"])

    def flush_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LsmIndex(memtable)
        for batch in batches:
            rows = np.zeros(batch.num_rows, dtype=_HASHED)
            rows["digest"] = batch.column(1).to_pylist()
            rows["chars"] = np.asarray(batch.column(2))
            rows["id"] = np.asarray(pc.fill_null(batch.column(0), NO_ID))
            rows["rows"] = rows["same"] = 1
            index.put(rows)
        yield from _batches(index.rows())

    def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LsmIndex(memtable)
        for batch in batches:
            rows = np.zeros(batch.num_rows, dtype=_HASHED)
            for c, name in zip(_HASHED.names, batch.schema.names, strict=True):
                rows[c] = batch.column(name).to_pylist() if c == "digest" else np.asarray(batch.column(name))
            index.put(rows)
        yield from _batches(index.rows())

    rows = cut(slim.mapInArrow(measure, "id long, sha binary, digest binary, chars long"), "lsm-rows")
    runs = rows.select("id", "digest", "chars").mapInArrow(flush_runs, INDEX)
    index = cut(runs.repartition("digest").mapInArrow(merge_runs, INDEX), "lsm-index")
    word = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    several = index.where("rows > 1").select(word.alias("word"))
    n = several.count()
    hits = bit_filter(several, "word", max(16, (16 * n).bit_length())) if n else np.zeros(1 << 13, dtype=np.uint8)
    hits_sent = spark.sparkContext.broadcast(hits)  # at most 16 MB

    def hit_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            normal, sha = digests(batch)
            keys = [_key(x, width) for x in sha]
            chosen = pa.array(maybe_in(hits_sent.value, np.array([int.from_bytes(x[:7], "big") for x in keys], dtype=np.int64)))
            out = [pa.array(keys, pa.binary()), pa.array(normal, pa.binary())]
            yield pa.RecordBatch.from_arrays([x.filter(chosen) for x in out], names=["digest", "normal"])

    texts = slim.mapInArrow(hit_texts, "digest binary, normal binary").distinct() if n else slim.limit(0).select(F.lit(b"").alias("digest"), F.lit(b"").alias("normal"))
    differ = cut(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "lsm-differ")
    top = (F.col("chars") == F.col("keep_chars")) & (F.coalesce("id", F.lit(NO_ID)) == F.col("keep_id"))
    if differ.head() is None:
        found = join_hot(rows, index, ["digest"], "rows").select("id", "sha", "keep_id", "rows", "same", top.alias("top"))
    else:  # two texts under one digest: their rows are grouped by the whole digest of their bytes
        clash = rows.join(F.broadcast(differ) if differ.count() <= HOT_KEYS else differ, "digest", "left_semi")
        one = F.struct(-F.col("chars"), F.coalesce("id", F.lit(NO_ID)))
        groups = clash.groupBy("sha").agg(F.min(one).alias("one"), F.count(F.lit(1)).alias("rows"))
        groups = groups.select("sha", (-F.col("one.col1")).alias("keep_chars"), F.col("one.col2").alias("keep_id"), "rows", F.lit(2).cast("long").alias("same"))
        found = join_hot(rows.join(differ, "digest", "left_anti"), index.join(differ, "digest", "left_anti"), ["digest"], "rows")
        columns = ["id", "sha", "keep_id", "rows", "same", top.alias("top")]
        found = found.select(*columns).unionByName(join_hot(clash, groups, ["sha"], "rows").select(*columns))
    if index.where("same > 1").head() is not None or differ.head() is not None:  # repeated rows of the one that stays: one of them is kept
        found = cut(found, "lsm-found")
        again = found.where("top and same > 1").withColumn("nth", F.row_number().over(Window.partitionBy("sha").orderBy("id")))
        found = found.where("not (top and same > 1)").unionByName(again.withColumn("top", F.col("nth") == 1).drop("nth"))
        drop_cut(rows, index)
    drop_cut(differ)
    none = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return found.select(F.col("id").alias("doc_id"), none.alias("keep_id"), F.col("rows").alias("group_size"), F.col("top").alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_best(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts, as deduplicate says.
    Null and empty texts are equal; where ids repeat, of equal rows of an id the first is taken."""
    found = cut(deduplicate(docs, text, doc_id), "lsm-found")
    repeated = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if repeated.head() is None:
        return without(docs, found.where("not kept").select("doc_id"), doc_id)
    # ids that repeat don't tell rows apart: of equal rows of an id the first is taken, if its text stays
    sha, nth, key = (free_name(docs.columns, x) for x in ("sha", "nth", "key"))
    rows = docs.withColumn(sha, F.sha2(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACES.decode(), ""), 256)).withColumn(key, F.col(doc_id).cast("long"))
    longest = Window.partitionBy(key, sha).orderBy(F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))).desc(), F.col(text))
    rows = rows.withColumn(nth, F.row_number().over(longest)).where(F.col(nth) == 1)
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    names = {c: free_name(docs.columns, c) for c in kept.columns}
    kept = kept.withColumnsRenamed(names)
    return rows.join(kept, F.col(key).eqNullSafe(F.col(names["kept_id"])) & (F.col(sha) == F.col(names["kept_sha"])), "left_semi").drop(sha, nth, key)
