"""Embedding whitening by digit-slice products: exact integer covariance from float64 matrix products.

An entry c of a vector becomes the integer x = floor(1024 * c) + 100000.  A task slices its block of x into limbs of
``LIMB`` bits; products of limb matrices in float64 are exact, as ``ROWS`` products of two limbs stay under 2^53.
Sums by limb place are merged over tasks by Spark as decimals and recombined by the driver as big integers, so
n^2 * V = n * X'X - S S' (what centring before multiplying gives, without rounding) is exact; one rounding to double
comes before the eigendecomposition.  A second pass takes the covariance of the whitened values; a third returns
the rows.

What the driver holds is d x d sums of one length of vectors, whatever the number of rows.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry are dropped; where lengths
differ, vectors of the most frequent length (the largest of such) are the table and others are dropped; x saturates
at 2^62; ``deviation`` is null where it exceeds a long, ``deviation_digits`` has it in full; a component without
variance (copies of one vector, n = 1) has null ``whitened``, ``explained`` is null where the trace is 0 and
``identity_error`` null where no component has variance; null and repeated vec_ids are carried, each row counts; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import settle, table

#: 2 * LIMB bits of a product and the bits of ROWS stay within the 53 of a double.
LIMB, ROWS = 12, 1 << 14
SCALE, SHIFT, MOST = 1024.0, 100_000, 1 << 62
COMPONENTS = 8
#: An eigenvalue below this share of the largest counts as none.
FLAT = 1e-13


def integers(values: np.ndarray) -> np.ndarray:
    """x of entries, as int64."""
    x = np.floor(SCALE * values.astype(np.float64))
    big = np.abs(x) >= MOST
    out = np.where(big, 0, x).astype(np.int64) + SHIFT
    out[big] = np.where(x[big] > 0, MOST, -MOST)
    return out


def limbs_of(x: np.ndarray) -> list[np.ndarray]:
    """Limbs of magnitudes, lowest first, each with the sign of its number, as float64."""
    sign, left, out = np.sign(x).astype(np.float64), np.abs(x), []
    while not out or left.any():
        out.append((left & ((1 << LIMB) - 1)) * sign)
        left = left >> LIMB
    return out


def limb_products(x: np.ndarray) -> list[np.ndarray]:
    """X'X of at most ROWS rows as int64 matrices by limb place: the sum of 2^(LIMB * place) * matrix."""
    limbs = limbs_of(x)
    out = [np.zeros((x.shape[1], x.shape[1]), np.int64) for _ in range(2 * len(limbs) - 1)]
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs[i:], i):
            product = (a.T @ b).astype(np.int64)
            out[i + j] += product if i == j else product + product.T
    return out


@dataclass(frozen=True)
class Fit:
    """Components of a table: n, sums by dimension, unit eigenvectors by column, eigenvalues (falling), trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def flat(self) -> np.ndarray:
        return self.values <= FLAT * max(self.values.max(initial=0.0), 0.0)


def finite_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vector (array of double) of the rows that remain."""
    v = F.col(vector).cast("array<double>")
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where("size(vector) > 0")
    return own.where(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and doubles of each length of vectors, ROWS rows at most."""
    column = batch.column("vector")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    starts, flat = column.offsets.to_numpy()[:-1], column.values.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for k in range(0, len(at), ROWS):
            own = at[k : k + ROWS]
            yield own, flat[starts[own][:, None] + np.arange(size)]


PARTIALS = "size int, i int, j int, place int, total long"


def sums_of(vectors: DataFrame) -> DataFrame:
    """size, i, j, place, total (decimal): j is -1 for sums by dimension, i and j are -1 for the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        weight: dict[int, int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for size, n in weight.items():
                columns = [np.array([-1]), np.array([-1]), np.array([0]), np.array([n])]
                i, j = np.triu_indices(size)
                for (own, place), m in held.items():
                    if own != size:
                        continue
                    sums = place < 0
                    part = [np.arange(size), np.full(size, -1), np.full(size, -1 - place), m] if sums else [i, j, np.full(len(i), place), m[i, j]]
                    columns = [np.concatenate(x) for x in zip(columns, part)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), size), pa.int32()), *[pa.array(c, pa.int32()) for c in columns[:3]], pa.array(columns[3], pa.int64())], names=["size", "i", "j", "place", "total"])
            held.clear()
            weight.clear()

        for batch in batches:
            for own, values in _matrices(batch):
                x, size = integers(values), values.shape[1]
                if size not in weight and len(weight) >= 8 or weight.get(size, 0) > 1 << 26:
                    yield from out()  # few lengths at a time, and totals that stay within a long
                weight[size] = weight.get(size, 0) + len(own)
                for place, m in enumerate(limb_products(x)):
                    held[size, place] = held.get((size, place), 0) + m
                for place, limb in enumerate(limbs_of(x)):
                    held[size, -1 - place] = held.get((size, -1 - place), 0) + limb.sum(axis=0).astype(np.int64)
        yield from out()

    return vectors.select("vector").mapInArrow(run, PARTIALS).groupBy("size", "i", "j", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def covariance(n: int, sums: list[int], products: list[list[int]]) -> np.ndarray:
    """V with divisor n from exact sums, each entry rounded once."""
    return np.array([[(n * g - a * b) / (n * n) for g, b in zip(row, sums)] for row, a in zip(products, sums)])


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of all ``vectors``; None if there are none."""
    sums = settle(sums_of(vectors), "whitening-sums")
    most = sums.where("i = -1").orderBy(F.desc("total"), F.desc("size")).first()
    if most is None:
        return None
    d, n = most["size"], int(most["total"])
    total, products = [0] * d, [[0] * d for _ in range(d)]
    for r in sums.where((F.col("size") == d) & (F.col("i") >= 0)).toLocalIterator():  # d * d sums by limb place
        value = int(r.total) << (LIMB * r.place)
        if r.j < 0:
            total[r.i] += value
        else:
            products[r.i][r.j] += value
    products = [[products[min(i, j)][max(i, j)] for j in range(d)] for i in range(d)]
    v = covariance(n, total, products)
    values, vectors_ = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    own = vectors_[:, order]
    own = own * np.where(np.take_along_axis(own, np.abs(own).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)
    return Fit(n, tuple(total), own, np.maximum(values[order], 0.0), float(np.trace(v)))


def _scaled(x: np.ndarray, fit: Fit) -> np.ndarray:
    """n * x - S, in int64 where it fits, else in big integers."""
    if (int(np.abs(x).max()) + 1) * fit.n + max(map(abs, fit.sums)) < MOST:
        return fit.n * x - np.array(fit.sums, np.int64)
    return fit.n * x.astype(object) - np.array(fit.sums, object)


def _deviations(y: np.ndarray) -> list[int]:
    """Sums of squares by row, exact: in digit slices where products don't fit a long."""
    if y.dtype == object:
        return [int(v) for v in (y * y).sum(axis=1)]
    if int(np.abs(y).max()) ** 2 * y.shape[1] < MOST:
        return (y * y).sum(axis=1).tolist()
    limbs = [a.astype(np.int64) for a in limbs_of(y)]
    out = np.zeros(len(y), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a * b).sum(axis=1).astype(object) * (1 << LIMB * (i + j))
    return out.tolist()


def whitened_values(y: np.ndarray, fit: Fit) -> np.ndarray:
    """Rows by components: (x - S/n) on each component over the root of its eigenvalue; 0 where it has none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (y / fit.n).astype(np.float64) @ fit.vectors / np.sqrt(fit.values)
    return np.where(fit.flat, 0.0, out)


def identity_error(vectors: DataFrame, fit: Fit) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity, over components with variance.

    Rows are centred exactly before they are projected, so what is left of a mean is rounding; it is taken off too."""
    d, k = len(fit.sums), len(fit.values)
    if fit.flat.all():
        return None
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, moment = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, values in _matrices(batch):
                if values.shape[1] == d:
                    w = whitened_values(_scaled(integers(values), fit), fit)
                    total, moment = total + w.sum(axis=0), moment + w.T @ w
        columns = [np.concatenate([i, np.arange(k)]), np.concatenate([j, np.full(k, -1)]), np.concatenate([moment[i, j], total])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()))], names=["i", "j", "total"])

    total, moment = np.zeros(k), np.zeros((k, k))
    for r in vectors.select("vector").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():  # k * k sums
        if r.j < 0:
            total[r.i] = r.total
        else:
            moment[r.i, r.j] = moment[r.j, r.i] = r.total
    error = np.abs(moment / fit.n - np.outer(total, total) / fit.n**2 - np.eye(k))
    return float(error[np.ix_(~fit.flat, ~fit.flat)].max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"


def whitened(vectors: DataFrame, fit: Fit | None, error: float | None) -> DataFrame:
    """A row for each vector and component."""
    if fit is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    d, k = len(fit.sums), len(fit.values)
    explained = [float(e) / fit.trace if fit.trace > 0 else None for e in fit.values]
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, values in _matrices(batch):
                if values.shape[1] != d:
                    continue
                y = _scaled(integers(values), fit)
                deviations = _deviations(y)
                flat = np.broadcast_to(fit.flat, (len(own), k)).ravel()
                at = np.repeat(np.arange(len(own)), k)
                long = pa.array([v if v < 1 << 63 else None for v in deviations], pa.int64())
                columns = [
                    batch.column("vec_id").take(pa.array(own[at])), pa.array(np.tile(np.arange(1, k + 1), len(own)), pa.int32()), pa.array(np.full(len(at), fit.n), pa.int64()),
                    long.take(pa.array(at)), pa.array(whitened_values(y, fit).ravel(), pa.float64(), mask=flat), pa.array(explained * len(own), pa.float64()),
                    pa.array([error] * len(at), pa.float64()), pa.array([str(v) for v in deviations], pa.string()).take(pa.array(at)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return vectors.mapInArrow(run, OUT)


def op11_digit_slice_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = finite_vectors(table(spark, sf_dir, "embeddings"))
    fit = fitted(vectors)
    return whitened(vectors, fit, identity_error(vectors, fit) if fit else None)
