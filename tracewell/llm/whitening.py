"""Embedding whitening: MLlib's computeSVD on centred distributed rows, eigenvalues from singular values by the divisor n.

An entry c becomes the whole number x = floor(1024 * c) + 100000. Sums and deviations are exact; only what the
decomposition gives is rounded. What reaches the driver is one number a dimension and the matrix of components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.storage import cut, drop_cut

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Up to so many dimensions all components are computed from the Gramian, to double precision; beyond, the wanted ones
#: by the iteration that MLlib then takes (tolerance 1e-10).
EXACT_DIMENSIONS = 4096
#: Singular values below this share of the largest count as zero (rounding of the Gramian lies there): their components
#: have no whitened values.
ZERO = 3e-7
#: Entries that one vectorised step handles.
_STEP = 1 << 20
_LONG = 1 << 63


@dataclass(frozen=True)
class Whitener:
    """n vectors' exact sums per dimension, and per component its column of `components` and its eigenvalue."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x of the vectors that can be used. Left out: null vectors, those with null or non-finite entries or
    entries of 2**52 and more, and those whose length isn't the most frequent one (of equally frequent: the longest)."""
    c = lambda v: v.cast("double")
    bad = F.exists(vector, lambda v: F.coalesce(F.isnan(c(v)) | (F.abs(c(v)) >= float(1 << 52)), F.lit(True)))
    x = F.transform(F.when(~bad, F.col(vector)), lambda v: F.floor(c(v) * SCALE).cast("long") + SHIFT)
    made = vectors.select(F.col(vec_id).alias("vec_id"), x.alias("x")).where("x is not null")
    usual = made.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return made.where(F.size("x") == (usual["d"] if usual else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.int64)
    return flat.reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        rows = max(1, _STEP * batch.num_rows // max(1, len(batch.column("x").flatten()))) if batch.num_rows else 1
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, _matrix(part.column("x"))


def _totals(x: DataFrame) -> tuple[int, tuple[int, ...]]:
    """The number of rows and the exact sum of each dimension: one row a task and dimension is shuffled."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, m in _slices(batches):
            halves = [(m >> 32).sum(axis=0), (m & 0xFFFFFFFF).sum(axis=0)]  # neither half overflows
            here = [int(hi) * (1 << 32) + int(lo) for hi, lo in zip(*halves, strict=True)]
            n, total = n + len(m), here if total is None else [a + b for a, b in zip(total, here, strict=True)]
        if n:
            yield pa.record_batch({"pos": pa.array(range(-1, len(total)), pa.int32()), "total": pa.array(list(map(str, [n, *total])))})

    parts = x.select("x").mapInArrow(partial, "pos int, total string")
    rows = parts.groupBy("pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("pos").collect()
    return (int(rows[0]["total"]), tuple(int(r["total"]) for r in rows[1:])) if rows else (0, ())


def fit(x: DataFrame, k: int = COMPONENTS) -> Whitener:
    """The k first components of the rows of whole_numbers(). Without rows, without dimensions or without any spread
    there are none."""
    n, sums = _totals(x)
    d = len(sums)
    if not n or not d:
        return Whitener(n, sums, np.zeros((d, 0)), np.zeros(0))
    centred = F.zip_with("x", F.lit([s / n for s in sums]), lambda a, m: a.cast("double") - m)
    rows = MLUtils.convertVectorColumnsFromML(x.select(array_to_vector(centred).alias("row")), "row")
    svd = RowMatrix(rows, n, d).computeSVD(d if d <= EXACT_DIMENSIONS else k, rCond=ZERO) if _spread(x) else None
    if svd is None:
        return Whitener(n, sums, np.zeros((d, 0)), np.zeros(0))
    s, v = np.asarray(svd.s.toArray()), np.asarray(svd.V.toArray())
    return Whitener(n, sums, v[:, :k], s[:k] ** 2 / n)


def _spread(x: DataFrame) -> bool:
    """Whether two rows differ (MLlib can't decompose a matrix of zeros)."""
    return x.select(F.xxhash64("x").alias("h")).agg(F.min("h") < F.max("h")).first()[0] is True


def transform(x: DataFrame, by: Whitener) -> DataFrame:
    """vec_id, deviation (long; null where it doesn't fit), deviation_exact (the same as text), deviation_double and
    w, the whitened values, of each row."""
    n, sums = by.n, np.array(by.sums, dtype=object)
    means, scaled = np.array(by.means), by.components / np.sqrt(by.eigenvalues) if len(by.eigenvalues) else by.components
    most = max(map(abs, by.sums), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m in _slices(batches):
            reach = n * int(np.abs(m).max(initial=0)) + most
            if reach * reach * max(1, m.shape[1]) < _LONG:
                exact = ((m * n - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:  # Python's integers, which can't overflow
                exact = ((m.astype(object) * n - sums) ** 2).sum(axis=1).tolist()
            w = (m - means) @ scaled
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array([e if e < _LONG else None for e in exact], pa.int64()), pa.array(list(map(str, exact))), pa.array([float(e) for e in exact]), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))],
                ["vec_id", "deviation", "deviation_exact", "deviation_double", "w"],
            )

    kinds = [("deviation", T.LongType()), ("deviation_exact", T.StringType()), ("deviation_double", T.DoubleType()), ("w", T.ArrayType(T.DoubleType()))]
    return x.mapInArrow(run, T.StructType([x.schema["vec_id"], *[T.StructField(c, kind) for c, kind in kinds]]))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Per usable vector and component (1 to k, by falling eigenvalue): vec_id, component, n, deviation, whitened,
    explained, identity_error and deviation_exact.

    Which vectors are usable is said at whole_numbers(); the others have no rows. A null or repeated vec_id is kept as it
    is, other columns don't matter. Components without variance (fewer vectors or dimensions than k, equal vectors,
    empty tables) have no rows, as their whitened values would be quotients by zero. deviation is null where it doesn't
    fit a long; deviation_exact holds it as text."""
    x = cut(whole_numbers(vectors, vec_id, vector), "whitening-x")
    by = fit(x, k)
    made = cut(transform(x, by), "whitening-w")
    drop_cut(x)
    r = len(by.eigenvalues)
    w = F.col("w")
    pairs = [(i, j) for i in range(r) for j in range(i, r)]
    ones = [F.covar_pop(w[i], w[j]).alias(f"c_{i}_{j}") for i, j in pairs]
    sums = made.agg(F.sum("deviation_double").alias("total"), *ones).first()
    error = max((abs(sums[f"c_{i}_{j}"] - (i == j)) for i, j in pairs), default=0.0)
    trace = (sums["total"] or 0.0) / by.n**3 if by.n else 0.0
    each = made.select("vec_id", "deviation", "deviation_exact", F.posexplode("w").alias("at", "whitened"))
    explained = F.element_at(F.lit([float(e / trace) for e in by.eigenvalues] or [0.0]), F.col("at") + 1)
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(float(error)).alias("identity_error"), "deviation_exact")
