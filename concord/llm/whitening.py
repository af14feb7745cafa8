"""Whitening of embeddings: MLlib's SVD of centred rows, checked by the covariance of what comes out."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: From this many dimensions on the Gram matrix isn't decomposed whole: leading components come from MLlib's iterations over the rows.
WHOLE_DIMS = 2048
#: Singular values below this share of the largest are rounding noise: their squares, of which a Gram matrix of doubles is made, are below 10**-12 of the largest.
NOISE = 1e-6
_LIMB, _LIMBS = 31, 8


def whole_vectors(vectors: DataFrame, *, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """id, x: floor(scale * component as double) + offset as long; rows whose vector is null, or holds null, a component that isn't finite, or one that is no whole double when scaled (2**53 and beyond), are left out."""
    v = F.transform(vector_col, lambda c: c.cast("double") * scale)
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float(1 << 53)), F.lit(False)))
    rows = vectors.where(F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(c) + offset)).alias("x"))


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows n, sums of each dimension, offset, and for each component its unit vector (a column), variance and share of the total variance."""

    n: int
    sums: tuple[int, ...]
    offset: int
    vectors: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def centred(self, column) -> tuple[list, np.ndarray]:
        """Of a column of whole vectors: each row's sum of (n * x - S)**2, exact, and x - S / n. Vectors that are too short count as 0 before the offset."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lens = np.diff(column.offsets.to_numpy())
        x = np.full((len(lens), len(self.sums)), self.offset, dtype=np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        x[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
        if self.n * int(np.abs(x).max(initial=1)) < 1 << 62 and max(map(abs, self.sums), default=0) < 1 << 62:
            d = self.n * x - np.array(self.sums, dtype=np.int64)
            if int(np.abs(d).max(initial=1)) ** 2 * max(1, x.shape[1]) < 1 << 63:
                return (d * d).sum(axis=1).tolist(), d / self.n
        d = self.n * x.astype(object) - np.array(self.sums, dtype=object)
        return (d * d).sum(axis=1).tolist(), (d / self.n).astype(np.float64)

    def projected(self, column) -> tuple[list, np.ndarray]:
        """Deviations, and rows projected on the components over the roots of their variances."""
        deviation, c = self.centred(column)
        return deviation, c @ (self.vectors / np.sqrt(self.variances))


def _vectors_of(rows: DataFrame, make) -> DataFrame:
    """One column, v, of MLlib vectors, made by make(column x)."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.ascontiguousarray(make(batch.column("x")))
            ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel()))], ["v"])

    out = rows.select("x").mapInArrow(arrays, "v array<double>").select(array_to_vector("v").alias("v"))
    return MLUtils.convertVectorColumnsFromML(out, "v")


def fit_whitening(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000, components: int = 32) -> Whitening:
    """Fit on all rows that whole_vectors() keeps.

    Sums are whole numbers of any size.  Rows are centred, each component of n * x - S a
    whole number, before MLlib multiplies them: computeSVD of the centred rows gives unit
    eigenvectors and singular values s, and s**2 / n is a component's variance.  The total variance is
    not the sum of these, but that of the exact deviations, so that explained shares are right when
    only the leading components are known.  Up to WHOLE_DIMS dimensions one pass makes a Gram matrix,
    which the driver decomposes whole; beyond, MLlib iterates over the rows, which are written first.

    Components whose variance is nothing but rounding are left out, so there may be fewer
    than `components`: none for an empty table, one row, or equal rows.  Each vector's
    sign makes its largest entry positive.
    """
    rows = whole_vectors(vectors, id_col=id_col, vector_col=vector_col, scale=scale, offset=offset)
    n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    parts = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright("c", _LIMB)).alias("high"), F.sum(F.col("c").bitwiseAND((1 << _LIMB) - 1)).alias("low"))
    sums = [n * offset] * dims
    for at, there, high, low in parts.collect():  # a row for each dimension
        sums[at] = (high << _LIMB) + low + (n - there) * offset
    none = Whitening(n, tuple(sums), offset, np.zeros((dims, 0)), np.zeros(0), np.zeros(0))
    if n < 2 or not dims:
        return none

    def limbs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = sum(none.centred(batch.column("x"))[0])
            yield pa.RecordBatch.from_arrays([pa.array([total >> _LIMB * i & (1 << _LIMB) - 1], pa.int64()) for i in range(_LIMBS)], [f"t{i}" for i in range(_LIMBS)])

    found = rows.select("x").mapInArrow(limbs, ", ".join(f"t{i} long" for i in range(_LIMBS))).agg(*[F.sum(f"t{i}") for i in range(_LIMBS)]).first()
    total = float(Fraction(sum(t << _LIMB * i for i, t in enumerate(found)), n**3))
    if not total:
        return none
    whole = dims <= WHOLE_DIMS
    matrix = _vectors_of(rows, lambda x: none.centred(x)[1])
    svd = RowMatrix(matrix if whole else written(matrix, "centred"), n, dims).computeSVD(dims if whole else min(components, dims), rCond=NOISE)
    variances = svd.s.toArray()[:components] ** 2 / n
    v = svd.V.toArray()[:, :components]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, tuple(sums), offset, v, variances, variances / total)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance (centred first, divisor n) minus the identity; rows: whole_vectors() that were fitted."""
    k = len(model.variances)
    if not k:
        return 0.0
    covariance = RowMatrix(_vectors_of(rows, lambda x: model.projected(x)[1]), model.n, k).computeCovariance().toArray() * ((model.n - 1) / model.n)
    return float(np.abs(covariance - np.eye(k)).max())


def whitened_rows(vectors: DataFrame, model: Whitening, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """id, deviation, whitened (a list with an entry for each component) for every row that can be whitened.

    deviation is the exact sum over dimensions of (n * x - S)**2, null where 64 bits don't hold it.
    Null and repeated ids stay as they are; rows with a null vector or one that
    isn't finite are left out; vectors that are too short are filled with 0.
    """
    rows = whole_vectors(vectors, id_col=id_col, vector_col=vector_col, scale=scale, offset=model.offset)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, w = model.projected(batch.column("x"))
            ends = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            exact = pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), exact, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(w).ravel()))], ["id", "deviation", "whitened"])

    return rows.mapInArrow(apply, "id long, deviation long, whitened array<double>").withColumnRenamed("id", id_col)


def whitening_report(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000, components: int = 32) -> DataFrame:
    """A row for each row and component: id, component (from 1), n, deviation, whitened, explained, identity_error; see fit_whitening() and whitened_rows(). No components, no rows."""
    model = fit_whitening(vectors, id_col=id_col, vector_col=vector_col, scale=scale, offset=offset, components=components)
    error = identity_error(whole_vectors(vectors, id_col=id_col, vector_col=vector_col, scale=scale, offset=offset), model)
    shares = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    rows = whitened_rows(vectors, model, id_col=id_col, vector_col=vector_col, scale=scale).select(F.col(id_col), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    error = error if math.isfinite(error) else None
    return rows.select(id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "at").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
