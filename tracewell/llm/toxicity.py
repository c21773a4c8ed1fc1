"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Grades 0..K-1 share one weight vector w; thresholds t_1 < ... < t_(K-1) part them: P(grade >= k) is
sigmoid(w x - t_k). The expected severity is the sum of these over k. Features are hashes of the lower-cased
words and of their first bytes; those that tell nothing about the grade get no weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.quality_gam import held_out
from tracewell.llm.shared import as_bytes, hash_words, small_batches, steps
from tracewell.storage import cut, drop_cut

#: Labelled rows that are learnt from at most, chosen by a hash of doc_id; buckets features are hashed to.
SAMPLE, BUCKETS = 20_000, 1 << 20
#: A feature gets a weight if the mean grade of its rows lies so far from that of all: the squared difference over its
#: variance, which passes this in one of a hundred cases by chance.
TELLING = 6.6
#: Bytes of a word's beginning that make a feature of their own.
HEAD = 5
_BREAK = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct feature numbers of each text."""
    words, first, _, _, heads = hash_words(texts, space=_BREAK, head=HEAD)
    both = [(x % np.uint64(BUCKETS // 2)).astype(np.int32) for x in (words, heads)]
    both[1] += BUCKETS // 2
    return [np.unique(np.concatenate([x[first[i] : first[i + 1]] for x in both])) for i in range(len(texts))]


@dataclass
class Ordinal:
    """features: sorted numbers of those with a weight. thresholds: one less than there are grades."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        total = np.zeros(len(rows))
        for i, x in enumerate(rows):
            if len(x) and len(self.features):
                at = np.minimum(np.searchsorted(self.features, x), len(self.features) - 1)
                total[i] = self.weights[at[self.features[at] == x]].sum()
        return 1 / (1 + np.exp(-np.clip(total[:, None] - self.thresholds[None, :], -35, 35)))


def train(rows: list[np.ndarray], grades: np.ndarray, *, n_grades: int, epochs: int = 400, rate: float = 0.5, ridge: float = 1e-4) -> Ordinal:
    """Maximise the cumulative-link likelihood by adaptive gradient steps over all rows. Without rows every
    grade above 0 is unlikely."""
    thresholds = np.linspace(0, 1, n_grades - 1) + 3.0
    if not len(rows):
        return Ordinal(np.zeros(0, np.int32), np.zeros(0), thresholds)
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    # keep all features that part the grades
    n = np.bincount(flat, minlength=BUCKETS)
    moved = np.bincount(flat, (grades - grades.mean())[owner], BUCKETS) ** 2 / np.maximum(n, 1) / max(grades.var(), 1e-9)
    chosen = np.flatnonzero(moved > TELLING).astype(np.int32)
    if not len(chosen):
        chosen = np.array([moved.argmax()], dtype=np.int32)
    at = np.minimum(np.searchsorted(chosen, flat), len(chosen) - 1)
    used = chosen[at] == flat
    at, owner = at[used], owner[used]
    weights = np.zeros(len(chosen))
    gain = np.zeros(len(chosen) + n_grades - 1) + 1e-8
    for _ in range(epochs):
        total = np.bincount(owner, weights[at], len(rows))
        z = total[:, None] - thresholds[None, :]
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))  # P(grade >= k)
        edge = np.concatenate([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))], axis=1)
        slope = np.concatenate([np.zeros((len(rows), 1)), p * (1 - p), np.zeros((len(rows), 1))], axis=1)
        i = np.arange(len(rows))
        own = np.maximum(edge[i, grades] - edge[i, grades + 1], 1e-9)
        lower, upper = slope[i, grades] / own, slope[i, grades + 1] / own
        g_w = np.bincount(at, (lower - upper)[owner], len(chosen)) / len(rows) - ridge * weights
        g_t = np.array([(upper[grades == k].sum() - lower[grades == k + 1].sum()) for k in range(n_grades - 1)]) / len(rows)
        g = np.concatenate([g_w, g_t])
        gain += g**2
        step = rate * g / np.sqrt(gain)
        weights += step[: len(chosen)]
        thresholds = np.maximum.accumulate(thresholds + step[len(chosen) :])
    return Ordinal(chosen, weights, thresholds)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", *, n_grades: int | None = None, sample: int = SAMPLE) -> Ordinal:
    """Learn from at most `sample` labelled rows that aren't held out. Null grades and unknown ids are left out;
    of several grades of an id the largest counts. Grades go from 0 to the largest of the labels that aren't held out; with
    n_grades, those beyond the last count as the last. Where the sample ends, ties of the hash go by doc_id; without labelled rows
    every grade above 0 is unlikely."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id"))
    if n_grades is None:
        n_grades = max(2, (chosen.agg(F.max("y")).first()[0] or 0) + 1)
    chosen = cut(chosen.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample), "ordinal-sample")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # `sample` rows at most

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            x = features(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.tobytes() for a in x], pa.binary())], names=["id", "y", "x"])

    rows = cut(rows.select("id", "text", "y").mapInArrow(measure, "id long, y int, x binary").dropDuplicates(["id"]), "ordinal-rows")
    grade_ = F.greatest(F.lit(0), F.least("y", F.lit(n_grades - 1)))
    mean, spread = rows.agg(F.avg(grade_), F.var_pop(grade_)).first()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS)
        for batch in batches:
            x = [np.frombuffer(a, dtype=np.int32) for a in batch.column(1).to_pylist()]
            if x:
                flat = np.concatenate(x)
                seen += np.bincount(flat, minlength=BUCKETS)
                total += np.bincount(flat, np.repeat(np.clip(np.asarray(batch.column(0)), 0, n_grades - 1), [len(a) for a in x]), BUCKETS)
        some = np.flatnonzero(seen)
        yield pa.record_batch({"feature": pa.array(some), "n": pa.array(seen[some]), "total": pa.array(total[some])})

    # the features that train() keeps, BUCKETS at most; only theirs are brought together
    found = rows.select("y", "x").mapInArrow(tally, "feature long, n long, total double").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    moved = F.pow(F.col("total") - F.col("n") * F.lit(mean or 0.0), 2) / F.col("n") / F.lit(max(spread or 0.0, 1e-9))
    kept = np.sort(np.array([r[0] for r in found.where(moved > TELLING * (1 - 1e-9)).select("feature").collect()], dtype=np.int32))

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [a[np.isin(a, kept)].tobytes() for a in (np.frombuffer(b, dtype=np.int32) for b in batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["id", "y", "x"])

    got = sorted(map(tuple, rows.mapInArrow(narrowed, "id long, y int, x binary").collect()), key=lambda r: r[0])  # the telling features of `sample` rows
    drop_cut(chosen, rows)
    return train([np.frombuffer(r[2], dtype=np.int32) for r in got], np.clip(np.array([r[1] for r in got], dtype=np.int64), 0, n_grades - 1), n_grades=n_grades)


def score(docs: DataFrame, model: Ordinal, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (expected severity over the highest grade), predicted (the
    likeliest lowest grade: how many thresholds have a probability of a half or more), expected_severity.

    Null text counts as empty and has no features; null doc_ids stay null; repeated rows get equal scores; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            p = sent.value.above(features(as_bytes(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.mean(axis=1)), pa.array((p >= 0.5).sum(axis=1), pa.int32()), pa.array(p.sum(axis=1))], names=["doc_id", "score", "predicted", "expected_severity"])

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = out.mapInArrow(work, "doc_id long, score double, predicted int, expected_severity double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "expected_severity")


def grade(docs: DataFrame, labels: DataFrame, *, n_grades: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """score with a model fitted on the labels; both say what becomes of nulls, repeats, ties and empty tables."""
    return score(docs, fit(docs, labels, n_grades=n_grades, sample=sample))
