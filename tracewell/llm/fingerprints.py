"""Document fingerprints by improbable features: byte windows ranked by how rare their entropy is in the corpus, the
selected ones in chained Bloom filters, compared by normalised bit overlap.

A window is WINDOW bytes of UTF-8. Its entropy falls into one of 1,001 classes; the fewer windows of the corpus a class
has, the earlier its rank. Every run of WINDOW successive windows points to its earliest rank (the leftmost of equal
ones), and windows that MENTIONS runs point to are the features. CHAIN features fill a filter of FILTER_BITS bits, then
the next begins.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import STEP_BYTES, as_bytes, mix, small_batches, steps

WINDOW, MENTIONS, CHAIN, FILTER_BITS, PROBES = 32, 12, 160, 2048, 5
#: Entropy classes below this hold runs of few characters and are never features.
LEAST_CLASS, CLASSES = 100, 1001
#: Bytes of text and largest number of the ranges that documents are dealt to.
RANGE_BYTES, MOST_RANGES = 4 << 20, 100_000

_UNIT = 1 << 20
_C = np.arange(WINDOW + 1)
#: c * log2(c) in whole units, so that sums are exact wherever a window lies.
_TERM = np.rint(_C * np.log2(np.maximum(_C, 1)) * _UNIT).astype(np.int64)
_GROW = np.diff(_TERM)
_FULL = int(_TERM[WINDOW])
_CHUNK, _NEVER = 1 << 16, np.int32(1 << 30)


def entropy_classes(raw: np.ndarray) -> np.ndarray:
    """Class (0 to 1000 thousandths of the largest entropy) of each window of the bytes."""
    n = len(raw) - WINDOW + 1
    out = np.zeros(max(0, n), dtype=np.int16)
    for at in range(0, n, _CHUNK):
        b = raw[at : min(at + _CHUNK, n) + WINDOW - 1]
        before, after = np.zeros(len(b), dtype=np.uint8), np.zeros(len(b), dtype=np.uint8)
        for lag in range(1, WINDOW):  # how many of the other bytes of a window on either side are the same
            same = (b[lag:] == b[:-lag]).view(np.uint8)
            before[lag:] += same
            after[:-lag] += same
        sums = np.empty(len(b) - WINDOW + 1, dtype=np.int64)
        sums[0] = _TERM[np.bincount(b[:WINDOW])].sum()
        np.cumsum(_GROW[before[WINDOW:]] - _GROW[after[: len(b) - WINDOW]], out=sums[1:])
        sums[1:] += sums[0]
        out[at : at + len(sums)] = (_FULL - sums) * (CLASSES - 1) // _FULL
    return out


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of each class by the number of windows it has in all texts, the rarest first (of equal ones the lower class).
    What reaches the driver is one number a class."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLASSES, dtype=np.int64)
        for part in steps(batches, 0):
            texts = as_bytes(part.column(0))
            classes = entropy_classes(np.frombuffer(b"".join(texts), dtype=np.uint8))
            at = 0
            for t in texts:
                if len(t) >= WINDOW:
                    seen += np.bincount(classes[at : at + len(t) - WINDOW + 1], minlength=CLASSES)
                at += len(t)
        held = np.flatnonzero(seen)
        yield pa.record_batch({"class": pa.array(held, pa.int32()), "n": pa.array(seen[held])})

    total = np.zeros(CLASSES, dtype=np.int64)
    for c, n in docs.select(text).mapInArrow(count, "class int, n long").groupBy("class").agg(F.sum("n")).collect():
        total[c] = n
    ranks = np.empty(CLASSES, dtype=np.int32)
    ranks[np.lexsort((np.arange(CLASSES), total))] = np.arange(CLASSES, dtype=np.int32)
    ranks[:LEAST_CLASS] = _NEVER
    return ranks


def _mentions(ranks: np.ndarray) -> np.ndarray:
    """How many runs point to each window; ranks are those of all texts, _NEVER between them."""
    out = np.zeros(len(ranks), dtype=np.uint8)
    reach = WINDOW - 1
    for at in range(0, len(ranks), _CHUNK):
        low, end = max(0, at - reach), min(len(ranks), at + _CHUNK)
        high = min(len(ranks), end + reach)
        n = high - low + 2 * reach
        key = np.full(-(-n // WINDOW) * WINDOW, np.int64(_NEVER) << 32)
        key[reach : reach + high - low] = (ranks[low:high].astype(np.int64) << 32) | np.arange(high - low)
        blocks = key.reshape(-1, WINDOW)
        head = np.minimum.accumulate(blocks, axis=1).ravel()
        tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(tail[: len(key) - reach], head[reach:])
        told = least[least < np.int64(_NEVER) << 32] & 0xFFFFFFFF
        out[at:end] = np.bincount(told, minlength=high - low)[at - low : end - low]
    return out


def _short_hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def _window_hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[at].copy().view(np.uint64)
    h = np.zeros(len(at), dtype=np.uint64)
    for i in range(words.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, i])
    return h


@dataclass(frozen=True)
class Fingerprint:
    """A text's number of features and its filters, one row of bytes each."""

    features: int
    filters: np.ndarray

    def __str__(self) -> str:
        return f"{self.features}:{base64.b64encode(self.filters.tobytes()).decode()}"

    @staticmethod
    def parse(text: str) -> Fingerprint:
        n, _, body = text.partition(":")
        return Fingerprint(int(n), np.frombuffer(base64.b64decode(body), dtype=np.uint8).reshape(-1, FILTER_BITS // 8))


def _digest(texts: list[bytes], classes: list[np.ndarray], ranks: np.ndarray) -> list[Fingerprint]:
    """Fingerprints of texts whose windows' classes are known. A text without a feature has a hash of the whole as its
    only one; an empty text has none."""
    gap = np.full(WINDOW - 1, _NEVER, dtype=np.int32)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    counts = np.array([len(c) for c in classes], dtype=np.int64)
    firsts = np.cumsum([0, *(counts + len(gap))])  # of each text's windows in `line`
    line = np.concatenate([x for c in classes for x in (ranks[c], gap)])
    at = np.flatnonzero(_mentions(line) >= MENTIONS)
    doc = np.searchsorted(firsts, at, side="right") - 1
    hashes = _window_hashes(raw, starts[doc] + at - firsts[doc]) if len(at) else np.zeros(0, dtype=np.uint64)
    bare = np.array([i for i in np.setdiff1d(np.arange(len(texts)), doc) if texts[i]], dtype=np.int64)
    doc, at = np.concatenate([doc, bare]), np.concatenate([at, firsts[bare]])
    hashes = np.concatenate([hashes, np.array([_short_hash(texts[i]) for i in bare], dtype=np.uint64)])
    order = np.lexsort((at, hashes, doc))  # of windows that repeat within a text the first counts
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(doc[order]) != 0) | (np.diff(hashes[order].view(np.int64)) != 0)
    kept = np.sort(order[new])
    kept = kept[np.lexsort((at[kept], doc[kept]))]
    doc, hashes = doc[kept], hashes[kept]
    n = np.bincount(doc, minlength=len(texts))
    chain = -(-n // CHAIN)
    begin = np.cumsum([0, *chain])
    nth = np.arange(len(doc)) - np.cumsum([0, *n])[doc]
    bits = np.zeros((int(begin[-1]), FILTER_BITS), dtype=np.uint8)
    for i in range(PROBES):
        bits[begin[doc] + nth // CHAIN, (hashes >> np.uint64(11 * i)) & np.uint64(FILTER_BITS - 1)] = 1
    packed = np.packbits(bits, axis=1)
    return [Fingerprint(int(n[i]), packed[begin[i] : begin[i + 1]]) for i in range(len(texts))]


def _one_way(a: Fingerprint, b: Fingerprint) -> float:
    """Mean over a's filters, weighted by features, of the best overlap with a filter of b."""
    x, y = a.filters.view(np.uint64), b.filters.view(np.uint64)
    na, nb = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    best = np.zeros(len(x))
    rows = max(1, (1 << 20) // y.size)
    m, away = float(FILTER_BITS), 3 + np.sqrt(2 * np.log(len(y)))  # the best of many filters lies farther from the mean
    for at in range(0, len(x), rows):
        part, p = x[at : at + rows], na[at : at + rows, None].astype(float)
        both = np.bitwise_count(part[:, None] & y[None]).sum(axis=2, dtype=np.int64)
        chance = p * nb / m
        chance += away * np.sqrt(chance * (1 - p / m) * (1 - nb / m) * m / (m - 1))
        most = np.minimum(p, nb)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(most > chance, (both - chance) / (most - chance), 0)
        best[at : at + rows] = np.clip(score, 0, 1).max(axis=1)
    sizes = np.full(len(x), CHAIN)
    sizes[-1] = a.features - CHAIN * (len(x) - 1)
    return float((best * sizes).sum() / a.features)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1: how much of the text with fewer features the other one has, above what chance explains (mean of the bits in
    common and three standard deviations, more where there are many filters to be the best one). Equal fingerprints give 1, an empty and another text 0."""
    if a.features == b.features and np.array_equal(a.filters, b.filters):
        return 1.0
    if not a.features or not b.features:
        return 0.0
    if a.features == b.features:
        return (_one_way(a, b) + _one_way(b, a)) / 2
    return _one_way(a, b) if a.features < b.features else _one_way(b, a)


def _classes_of(texts: list[bytes]) -> list[np.ndarray]:
    whole = entropy_classes(np.frombuffer(b"".join(texts), dtype=np.uint8))
    starts = np.cumsum([0, *map(len, texts)])
    return [whole[s : s + max(0, len(t) - WINDOW + 1)] for s, t in zip(starts, texts, strict=False)]


def fingerprints(texts: list[bytes], ranks: np.ndarray) -> list[Fingerprint]:
    return _digest(texts, _classes_of(texts), ranks)


def _compared(texts: list[str], ranks: np.ndarray) -> list[tuple]:
    """A row for each text but the last: what it gives with its successor."""
    raw = [t.encode() for t in texts]
    classes = _classes_of(raw)
    own = _digest(raw, classes, ranks)
    heads, tails = [], []
    for t, after in zip(texts, texts[1:], strict=False):
        half = len(t) // 2
        heads.append(t[: len(t) - half].encode())
        tails.append(after[:half].encode())
    seam = _classes_of([(h[1 - WINDOW :] + t[: WINDOW - 1]) for h, t in zip(heads, tails, strict=True)])
    edited = [h + t for h, t in zip(heads, tails, strict=True)]
    of = [  # windows within a half are those of the two originals
        np.concatenate([classes[i][: max(0, len(h) - WINDOW + 1)], seam[i], classes[i + 1][: max(0, len(t) - WINDOW + 1)]])
        for i, (h, t) in enumerate(zip(heads, tails, strict=True))
    ]
    changed = _digest(edited, of, ranks) if edited else []
    return [
        (len(texts[i]), hashlib.sha256(e).hexdigest(), str(own[i]), str(c), likeness(own[i], c), likeness(own[i], own[i + 1]))
        for i, (e, c) in enumerate(zip(edited, changed, strict=True))
    ]


def _dealt(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(bucket, guest, id, text): documents in ranges of their ids, each range followed by its guest, the document that
    comes next. What reaches the driver are the ranges' borders and first ids."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    ranges = min(MOST_RANGES, size // RANGE_BYTES + 1)
    cuts = docs.select(F.col(doc_id).cast("double").alias("id")).approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    borders = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    dealer = Bucketizer(splits=borders, inputCol="as_double", outputCol="bucket", handleInvalid="keep")  # null ids: a last range
    rows = dealer.transform(rows.withColumn("as_double", F.coalesce(F.col("id").cast("double"), F.lit(float("nan"))))).drop("as_double").withColumn("bucket", F.col("bucket").cast("int"))
    firsts = sorted(map(tuple, rows.groupBy("bucket").agg(F.min("id")).collect()), key=lambda r: r[0])
    if not firsts:
        return rows.select("bucket", F.lit(False).alias("guest"), "id", "text")
    after = [(b, firsts[(k + 1) % len(firsts)][1]) for k, (b, _) in enumerate(firsts)]
    invited = docs.sparkSession.createDataFrame(after, "bucket int, id long")
    guests = rows.drop("bucket").join(F.broadcast(invited.withColumnRenamed("id", "first")), F.col("id").eqNullSafe(F.col("first")))  # one row a range
    guests = guests.groupBy("bucket", "id").agg(F.min("text").alias("text"))  # of rows with the same id the first
    return rows.select("bucket", F.lit(False).alias("guest"), "id", "text").unionByName(guests.select("bucket", F.lit(True).alias("guest"), "id", "text"))


def compare(docs: DataFrame, ranks: np.ndarray | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by as many (or all) first ones of the document
    with the next doc_id; the last is followed by the first. A single document is followed by itself. Null texts count
    as empty, null ids come last, and rows with the same id follow each other by their texts. Windows are ranked by
    `ranks`, by default those of docs' own texts (rarity), so fingerprints of one table compare with each other;
    pass the ranks of the first table to compare with later ones. Other columns are left alone. ids are read as longs."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(rarity(docs, text) if ranks is None else ranks)  # 1,001 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        guest: list[bool] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(i, *r) for i, g, r in zip(ids, guest, _compared(texts, sent.value), strict=False) if not g]
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kinds)

        for batch in batches:
            for i, g, t in zip(batch.column("id"), batch.column("guest"), batch.column("text"), strict=True):
                ids.append(i.as_py())
                guest.append(g.as_py())
                texts.append(t.as_py())
                size += len(texts[-1])
                if size > STEP_BYTES and len(texts) > 1:
                    yield out()
                    ids, texts, guest, size = ids[-1:], texts[-1:], guest[-1:], len(texts[-1])
        if len(texts) > 1:
            yield out()
        pa.default_memory_pool().release_unused()

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)))
    dealt = _dealt(docs, doc_id, text).repartition("bucket").sortWithinPartitions("bucket", "guest", F.asc_nulls_last("id"), "text")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
