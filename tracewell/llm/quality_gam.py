"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic gradient boosting visits one feature after another and fits a shallow tree to it; the trees of a
feature add up to one lookup table over its bins. The pairs whose joint tree gains most on what the features
alone leave get tables of their own in the same way. A score is a sum of looked-up bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import as_bytes, hash_words, small_batches, steps
from tracewell.storage import cut, drop_cut

#: Labelled rows that are learnt from at most, chosen by a hash of doc_id.
SAMPLE = 20_000
FEATURES = ("log_words", "mean_word", "distinct_words", "top_word", "repeated_next", "upper", "symbols", "stops", "digits", "lines", "not_ascii", "symbol_ends", "longest_word", "short_words", "repeated_lines", "bangs")


def _table(chosen: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chosen]] = True
    return out


_UPPER, _LETTERS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_SYMBOLS, _STOPS, _DIGITS, _LINES, _BANGS = _table("#$%&*+/<=>@[]\\^_`{|}~"), _table(".,;:?\"'()-"), _table("0123456789"), _table("\n"), _table("!")
_HIGH = np.arange(256) >= 128


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES per text; an empty text has zeros only."""
    words, first, start, length = hash_words(texts)
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    n = np.diff(first)
    share = lambda mask: (np.add.reduceat(mask[raw], begins, dtype=np.int64) - mask[10]) / np.maximum(sizes, 1)  # noqa: E731  less the joining line end
    out = np.zeros((len(texts), len(FEATURES)))
    letters = share(_LETTERS)
    symbol_end = (_SYMBOLS | _BANGS)[raw[start + length - 1]] if len(start) else np.zeros(0, dtype=bool)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        own, long = words[a:b], length[a:b]
        _, counts = np.unique(own, return_counts=True)
        k = b - a
        lines = [x for x in texts[i].split(b"\n") if x]
        out[i, :5] = np.log1p(k), long.mean(), len(counts) / k, counts.max() / k, (own[1:] == own[:-1]).sum() / k
        out[i, 11:15] = symbol_end[a:b].mean(), np.log1p(long.max()), (long <= 3).mean(), 1 - len(set(lines)) / len(lines)
    out[:, 5] = share(_UPPER) / np.maximum(letters, 1e-9)
    for j, mask in ((6, _SYMBOLS), (7, _STOPS), (8, _DIGITS), (9, _LINES), (10, _HIGH), (15, _BANGS)):
        out[:, j] = share(mask)
    out[n == 0] = 0
    return out


@dataclass
class Gam:
    """edges: bin borders of each feature. tables: a lookup table per feature; pairs: (j, k, table over both)."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for j, k, t in self.pairs:
            total += t[b[:, j], b[:, k]]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _cut_of(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best split of a histogram of gradients: [:place] and [place:]."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + ridge) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A shallow tree over the bins of one feature, as the value of each bin."""
    gain, at = _cut_of(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, ridge), _tree(g[at:], h[at:], depth - 1, ridge)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """One split on the first feature and, on either side, one on the second: gain, and the value of each cell."""
    best = (0.0, np.zeros(g.shape))
    for at in range(1, len(g)):
        value, gain = np.zeros(g.shape), 0.0
        for side in (slice(None, at), slice(at, None)):
            a, b = g[side].sum(axis=0), h[side].sum(axis=0)
            more, place = _cut_of(a, b, ridge)
            gain += more + a.sum() ** 2 / (b.sum() + ridge)
            value[side, :place] = -a[:place].sum() / (b[:place].sum() + ridge)
            value[side, place:] = -a[place:].sum() / (b[place:].sum() + ridge)
        gain -= g.sum() ** 2 / (h.sum() + ridge)
        if gain > best[0]:
            best = (gain, value)
    return best


def train(x: np.ndarray, y: np.ndarray, *, max_bins: int = 32, rounds: int = 150, rate: float = 0.15, depth: int = 2, n_pairs: int = 6, pair_rounds: int = 40, ridge: float = 1.0) -> Gam:
    """Fit on rows x with labels y of 0 and 1. Without rows, or with one label only, the score is constant."""
    if not len(y):
        return Gam([np.zeros(0)] * x.shape[1], 0.0, [np.zeros(1)] * x.shape[1])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])) for j in range(x.shape[1])]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Gam(edges, float(np.log(mean / (1 - mean))), [np.zeros(len(e) + 1) for e in edges])
    if y.min() == y.max():
        return model
    bins = model.bins(x)
    total = np.full(len(y), model.base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = gradients()
            step = rate * _tree(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)), depth, ridge)
            table += step
            total += step[bins[:, j]]

    def cells(j: int, k: int, coarse: int = 1) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(edges[j]) // coarse + 1, len(edges[k]) // coarse + 1)
        at = bins[:, j] // coarse * shape[1] + bins[:, k] // coarse
        g, h = gradients()
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_pair_tree(*cells(j, k, 4), ridge)[0], j, k) for j in range(x.shape[1]) for k in range(j)), reverse=True)
    model.pairs = [(j, k, np.zeros((len(edges[j]) + 1, len(edges[k]) + 1))) for _, j, k in gains[:n_pairs]]
    for _ in range(pair_rounds):
        for j, k, table in model.pairs:
            step = rate * _pair_tree(*cells(j, k), ridge)[1]
            table += step
            total += step[bins[:, j], bins[:, k]]
    return model


def held_out(doc_id):
    """crc32(doc_id as text) mod 5 is 0; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Gam:
    """Learn from at most `sample` labelled rows that aren't held out. Null labels and unknown ids are left out;
    of several labels of an id the largest counts. Where the sample ends, ties of the hash go by doc_id; without
    labelled rows, or with one label only, all scores are equal."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("double").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id"))
    chosen = cut(chosen.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample), "gam-sample")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # `sample` rows at most

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x = features(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    got = sorted(map(tuple, rows.select("id", "text", "y").mapInArrow(measure, "id long, y double, x array<double>").dropDuplicates(["id"]).collect()), key=lambda r: r[0])
    drop_cut(chosen)
    return train(np.array([r[2] for r in got]).reshape(len(got), len(FEATURES)), np.array([r[1] > 0 for r in got], dtype=float))


def score(docs: DataFrame, model: Gam, text: str = "text", doc_id: str = "doc_id", *, keep_from: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from keep_from on).

    Only the text counts. Null text counts as empty, and an empty text has a score as well; null doc_ids stay
    null; repeated rows get equal scores; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of 32 bins

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(features(as_bytes(batch.column(1)))))], names=["doc_id", "score"])

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= keep_from).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """score with a model fitted on the labels; both say what becomes of nulls, repeats, ties and empty tables."""
    return score(docs, fit(docs, labels, sample=sample))


def keep_good(docs: DataFrame, model: Gam, text: str = "text", *, keep_from: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores keep_from at least, with all their columns. Null text counts as empty;
    repeated rows stay or go together; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text=at):
            yield batch.filter(pa.array(sent.value.score(features(as_bytes(batch.column(at)))) >= keep_from))

    return docs.mapInArrow(work, docs.schema)
