"""Whitening of embeddings by the covariance of distinct vectors, weighted by how often each occurs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import fresh, staged, with_package

SCALE = 1024
SHIFT = 100_000
LARGEST = 1 << 52  # of a scaled entry: whole numbers up to here are exact as doubles
COMPONENTS = 8
LEAST_SHARE = 1e-11  # of the largest eigenvalue; below, a direction has no spread that doubles could tell from none
CHUNK = 1 << 14
_WIDTHS = ((np.int16, b"2"), (np.int32, b"4"), (np.int64, b"8"))


def grid_keys(column: pa.Array) -> list[bytes | None]:
    """Vectors on the grid ``floor(SCALE * c)`` as bytes, equal if and only if the vectors are; null if unusable.

    A vector is unusable if it is null, holds nulls, or entries that are not finite or not below LARGEST.
    The bytes are the numbers in the narrowest of three widths that holds all of them.
    """
    out: list[bytes | None] = []
    valid = column.is_valid().to_pylist()
    offsets = np.asarray(column.offsets)
    flat = column.values
    missing = np.asarray(flat.is_null()) if flat.null_count else None
    values = flat.cast(pa.float64(), safe=False).fill_null(0.0).to_numpy(zero_copy_only=False)
    for k, known in enumerate(valid):
        low, high = int(offsets[k]), int(offsets[k + 1])
        if not known or (missing is not None and missing[low:high].any()):
            out.append(None)
            continue
        part = np.floor(values[low:high] * SCALE)
        if not (np.abs(part) < LARGEST).all():  # also false for what is not a number
            out.append(None)
            continue
        top = np.abs(part).max(initial=0)
        kind, tag = _WIDTHS[0 if top < 1 << 15 else 1 if top < 1 << 31 else 2]
        out.append(tag + part.astype(kind).tobytes())
    return out


def grid_vectors(keys: list[bytes]) -> np.ndarray:
    """The vectors x (with SHIFT added) of such bytes, which have the same number of entries, as rows."""
    kinds = {tag: kind for kind, tag in _WIDTHS}
    rows = [np.frombuffer(k, kinds[k[:1]], offset=1) for k in keys]
    return np.array(rows, np.int64) + SHIFT


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Keys, vectors and weights of batches with the columns ``grid`` and ``weight``."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            keys = part.column(0).to_pylist()
            yield keys, grid_vectors(keys), part.column(1).to_numpy()


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums of every dimension as whole numbers, in two parts so that none leaves 64 bits."""
    high = low = None
    for _, x, w in _chunks(batches):
        # Halves of entries below 2**53 are below 2**27; weights are counts of rows.
        a, b = (w[:, None] * (x >> 27)).sum(0), (w[:, None] * (x & ((1 << 27) - 1))).sum(0)
        high, low = (a, b) if high is None else (high + a, low + b)
    if high is not None:
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(high))), "high": pa.array(high), "low": pa.array(low)})


def _products(mean: np.ndarray):
    """Weighted sums of products of centred vectors: the upper triangle of the matrix."""
    i, j = np.triu_indices(len(mean))

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for _, x, w in _chunks(batches):
            centred = x - mean
            total += (centred * w[:, None]).T @ centred
        yield pa.RecordBatch.from_pydict({"i": pa.array(i), "j": pa.array(j), "s": pa.array(total[i, j])})

    return of_batches


def _matrix(parts: DataFrame, size: int) -> np.ndarray:
    """A symmetric matrix from sums of the parts of its upper triangle; a row for each entry reaches the driver."""
    found = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        found[r.i, r.j] = found[r.j, r.i] = r.s
    return found


@dataclass(frozen=True)
class Fit:
    """What a fit keeps: the number of vectors, their sums, and the directions of most spread."""

    n: int
    sums: list[int]
    directions: np.ndarray  # a column for each component
    spread: np.ndarray  # eigenvalues
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.directions / np.sqrt(self.spread)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; null where 64 bits do not hold it."""
        sums = np.array(self.sums, object)
        rough = ((x - self.mean) ** 2).sum(1) * float(self.n) ** 2
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if largest < 1 << 62 and rough.max(initial=0) < 9e18:
            return ((self.n * x - sums.astype(np.int64)) ** 2).sum(1).tolist()
        exact = (((self.n * x.astype(object)) - sums) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The fit over ``grid, weight``, one row for each distinct vector; null where there are none.

    Two passes: weighted sums of every dimension, exact; then the products of the vectors, centred first,
    each vector once by its weight. Tasks send a number for each pair of dimensions, added up by Spark.
    """
    kind = "i long, high long, low long"
    found = distinct.mapInArrow(_sums, kind).groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    parts = {r.i: (int(r.high) << 27) + int(r.low) for r in found.collect()}  # a row for each dimension
    n = distinct.agg(F.sum("weight")).first()[0]
    if not n:
        return None
    sums = [parts[k] for k in sorted(parts)]
    empty = Fit(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    products = distinct.mapInArrow(_products(empty.mean), "i long, j long, s double")
    covariance = _matrix(products, len(sums)) / n
    spread, directions = np.linalg.eigh(covariance)
    best = np.argsort(-spread, kind="stable")[:components]
    best = best[spread[best] > max(spread.max(initial=0.0) * LEAST_SHARE, 0.0)]
    return Fit(n, sums, directions[:, best], spread[best], float(np.trace(covariance)))


def whitened(
    vectors: DataFrame, components: int = COMPONENTS, weights: str = "count", id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable vector and component.

    A vector c becomes the whole numbers x = floor(1024 * c) + 100000. Equal x are grouped first: each
    distinct x stands once in the fit, weighted with its count (or with one, ``weights="one"``), is whitened
    once, and the result is joined back to all rows that have it. So a vector on a third of all rows is one
    row of the fit, and the join back is split by Spark where one vector has most of the rows.

    Components are the unit eigenvectors of the covariance of x by falling eigenvalue, the same for all
    rows. ``n`` is the number of vectors of the fit, ``deviation`` the exact sum of (n * x - S)^2 (null where
    a long cannot hold it), ``whitened`` the centred x on the component over the root of its eigenvalue,
    ``explained`` the eigenvalue's share of the trace, ``identity_error`` the largest difference of the
    whitened vectors' covariance, measured over the fit, from the identity.

    Left out are vectors that are null, hold nulls or entries that are not finite, or as large as 2**52 on
    the grid; and vectors whose number of entries is not the most common one (of equally common ones the
    largest). Directions without spread (equal vectors only, fewer vectors than components) are no
    components, so a single vector or an empty table gives no rows. Null and repeated ids keep a result for
    each of their rows; other columns are ignored.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights are count or one")
    spark = with_package(vectors.sparkSession)
    id_type = dict(vectors.select(id_column).dtypes)[id_column]

    def on_grid(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grid_keys(batch.column(1)), pa.binary())], names=["id", "grid"])

    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = staged(rows.mapInArrow(on_grid, f"id {id_type}, grid binary").where("grid is not null"), "grid")
    size = F.expr("(length(grid) - 1) div int(decode(substring(grid, 1, 1), 'UTF-8'))")
    distinct = rows.groupBy("grid").agg(F.count("*").alias("weight")).withColumn("size", size)
    if weights == "one":
        distinct = distinct.withColumn("weight", F.lit(1).cast("long"))
    distinct = staged(distinct, "distinct")
    common = distinct.groupBy("size").agg(F.sum("weight").alias("n")).agg(F.max_by("size", F.struct("n", "size"))).first()[0]
    distinct = distinct.where(F.col("size") == common).select("grid", "weight")
    found = fit(distinct, components)
    schema = f"{id_column} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None or not len(found.spread):
        return spark.createDataFrame([], schema)
    width = len(found.spread)

    def projected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x, w in _chunks(batches):
            z = found.project(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * width), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(w), pa.array(found.deviations(x), pa.int64()), lists], names=["grid", "weight", "deviation", "z"]
            )

    done = staged(distinct.mapInArrow(projected, "grid binary, weight long, deviation long, z array<double>"), "whitened")
    error = _identity_error(done, found.n, width)
    shares = F.array(*[F.lit(float(s / found.trace)) for s in found.spread])
    joined = rows.join(done.select("grid", "deviation", "z"), "grid")
    return joined.select(F.col("id").alias(id_column), "deviation", F.posexplode("z").alias("place", "whitened")).select(
        id_column, (F.col("place") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _identity_error(done: DataFrame, n: int, width: int) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, from the values themselves."""
    column = [F.element_at("z", k + 1) for k in range(width)]
    means = done.agg(*[(F.sum(F.col("weight") * c) / n) for c in column]).first()

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(width)
        total, mean = np.zeros((width, width)), np.array(list(means))
        for batch in batches:
            z = batch.column(1).flatten().to_numpy().reshape(-1, width) - mean
            total += (z * batch.column(0).to_numpy()[:, None]).T @ z
        yield pa.RecordBatch.from_pydict({"i": pa.array(i), "j": pa.array(j), "s": pa.array(total[i, j])})

    covariance = _matrix(done.select("weight", "z").mapInArrow(products, "i long, j long, s double"), width) / n
    return float(np.abs(covariance - np.eye(width)).max())
