"""Embedding whitening by a distributed Jacobi-Davidson method.

The covariance is never formed.  All that the method asks of the data are
products of it with a few columns, each one pass over the centred vectors.  A
subspace is kept small on the driver; Rayleigh-Ritz in it gives approximate
components, and for each one that is not exact yet a correction equation,
projected against the components found so far, is solved by MINRES, all of them
side by side so that they share their passes.  Components are locked from the
largest on, when their residual is down to double precision.

Entries become integers, so sums are exact: a vector is x = shift + y with small
integers y, its centre is shift + rest / n, and y - rest / n loses nothing.

Defined results: rows whose vector is null, has no entries or holds a null, NaN or
infinite one are left out; repeated rows and repeated or null ids count as they
stand; an empty table gives an empty result; components without
variance are left out, so that fewer than asked for may come back; among equal
variances any orthonormal choice may come back, the same for all rows; further
columns of the input are ignored.  Vectors of different lengths, and entries of
2^42 or more, raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from math import ceil, sqrt
from pickle import dumps, loads

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hirelake.llm.common import settle
from hirelake.llm.registry import query, table

COMPONENTS = 8
SCALE = 1024
OFFSET = 100_000
# Entries that a stored chunk of vectors holds at most (one vector, however long).
CHUNK = 1 << 17
# Entries that one task passes over, where there are enough for all cores.
PART = 1 << 24
# Partial sums that the driver adds up itself; more are added on executors first.
FAN = 256
LIMIT = 1 << 52

# Steps of MINRES for a correction, and the share of its residual at which it ends earlier.
INNER = 6
INNER_GAIN = 0.02
# Rounds of Rayleigh-Ritz after which the method gives up with an error.
OUTER = 200

EPS = float(np.finfo(np.float64).eps)


# ---- the solver: small matrices on the driver, products anywhere ----


def _orthonormal(block: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """``block`` made orthonormal and orthogonal to the bases; what they span already is dropped."""
    kept = np.empty((len(block), 0))
    for column in block.T:
        before = np.linalg.norm(column)
        if not before:
            continue
        column = column / before
        for _ in range(3):
            for base in (*bases, kept):
                column = column - base @ (base.T @ column)
        left = np.linalg.norm(column)
        if left > 1e-10:
            column = column / left
            for base in (*bases, kept):
                column = column - base @ (base.T @ column)
            kept = np.column_stack([kept, column / np.linalg.norm(column)])
    return kept


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, gain: float) -> np.ndarray:
    """Approximate solutions of apply(x) = right for several right sides in step;
    ``apply`` is symmetric in each column.  A column rests once its residual has
    fallen by ``gain``."""
    beta = np.linalg.norm(right, axis=0)
    target = beta * gain
    solution = np.zeros_like(right)
    old, now = np.zeros_like(right), right / np.where(beta > 0, beta, 1)
    way_old, way = np.zeros_like(right), np.zeros_like(right)
    eta, beta = beta.copy(), np.zeros_like(beta)
    cos_old = cos = np.ones_like(eta)
    sin_old = sin = np.zeros_like(eta)
    for _ in range(steps):
        busy = np.abs(eta) > target
        if not busy.any():
            break
        image = np.zeros_like(now)
        image[:, busy] = apply(np.where(busy, now, 0))[:, busy]
        alpha = (now * image).sum(axis=0)
        image = image - alpha * now - beta * old
        beta_next = np.linalg.norm(image, axis=0)
        first = cos * alpha - cos_old * sin * beta
        length = np.hypot(first, beta_next)
        length = np.where(length > 0, length, 1)
        second, third = sin * alpha + cos_old * cos * beta, sin_old * beta
        cos_old, sin_old, cos, sin = cos, sin, first / length, beta_next / length
        way_old, way = way, (now - third * way_old - second * way) / length
        solution = np.where(busy, solution + cos * eta * way, solution)
        eta = np.where(busy, -sin * eta, eta)
        old, now = now, image / np.where(beta_next > 0, beta_next, 1)
        beta = beta_next
    return solution


@dataclass
class Solved:
    values: np.ndarray
    vectors: np.ndarray
    residual: float  # the largest, relative to the largest value
    products: int


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int) -> Solved:
    """The leading eigenpairs of a symmetric positive matrix known by its products with columns."""
    wanted = min(wanted, size)
    asked = 0

    def image(block: np.ndarray) -> np.ndarray:
        nonlocal asked
        asked += 1
        return product(block)

    most, kept = min(size, 6 * wanted), min(size, 2 * wanted)
    locked = np.empty((size, 0))
    rng = np.random.default_rng(size)
    basis = _orthonormal(rng.standard_normal((size, min(size, 2 * wanted))))
    images = image(basis)
    largest = 0.0
    for _ in range(OUTER):
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, images = basis @ turn, images @ turn
        largest = max(largest, abs(values[0])) if len(values) else largest
        exact = 16 * EPS * sqrt(size) * largest
        missing = min(wanted - locked.shape[1], len(values))
        rest = images[:, :missing] - basis[:, :missing] * values[:missing]
        rest -= locked @ (locked.T @ rest)
        size_of = np.linalg.norm(rest, axis=0)
        done = int(np.argmax(size_of > exact)) if (size_of > exact).any() else missing
        if done:
            locked = np.column_stack([locked, basis[:, :done]])
            basis, images, values, rest = basis[:, done:], images[:, done:], values[done:], rest[:, done:]
            missing -= done
        if locked.shape[1] == wanted:
            # Settle the result on fresh products of what was locked.
            locked = _orthonormal(locked)
            fresh = image(locked)
            small = locked.T @ fresh
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            vectors, fresh = locked @ turn, fresh @ turn
            worst = np.linalg.norm(fresh - vectors * values, axis=0).max()
            if worst <= 2 * exact:
                return Solved(values, vectors, worst / largest if largest else 0.0, asked)
            basis, images, locked = vectors, fresh, np.empty((size, 0))
            continue
        if basis.shape[1] + missing > most:
            basis, images = basis[:, :kept], images[:, :kept]
        ritz, shift = basis[:, :missing], values[:missing]
        known = np.column_stack([locked, ritz])

        def outside(block: np.ndarray, known: np.ndarray = known) -> np.ndarray:
            return block - known @ (known.T @ block)

        def shifted(block: np.ndarray, shift: np.ndarray = shift, outside=outside) -> np.ndarray:
            block = outside(block)
            return outside(image(block) - block * shift)

        step = minres(shifted, -outside(rest), INNER, INNER_GAIN)
        fresh = _orthonormal(step, locked, basis)
        if not fresh.shape[1]:
            fresh = _orthonormal(rng.standard_normal((size, missing)), locked, basis)
        if not fresh.shape[1]:
            # The basis spans all there is: only rounding is left in the images.
            images = image(basis)
            continue
        basis, images = np.column_stack([basis, fresh]), np.column_stack([images, image(fresh)])
    raise RuntimeError(f"{wanted - locked.shape[1]} of {wanted} components did not reach double precision in {OUTER} rounds")


# ---- the data: chunks of integer vectors, summed over partitions ----


def _chunks(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """Rows (ids, size, width, data): up to CHUNK entries, x as integers of ``width`` bytes."""
    kept = vectors.select(F.col(ident).alias("vec_id"), F.col(vector).alias("vector")).where(
        F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size("vector") > 0)
    )
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(kept.schema["vec_id"].dataType)),
            T.StructField("size", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("data", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy()
            # A run of vectors of one length at a time.
            edges = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                size = int(lengths[lo])
                step = max(1, CHUNK // size)
                for at in range(lo, hi, step):
                    part = batch.slice(at, min(step, hi - at))
                    scaled = np.floor(SCALE * np.asarray(part.column(1).flatten()).astype(np.float64))
                    if np.abs(scaled).max() >= LIMIT:
                        raise ValueError(f"an entry times {SCALE} is not below {LIMIT}")
                    x = scaled.astype(np.int64) + OFFSET
                    width = 4 if np.abs(x).max() < 1 << 31 else 8
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                    columns = [ids, pa.array([size], pa.int32()), pa.array([width], pa.int32())]
                    columns.append(pa.array([x.astype(f"<i{width}").tobytes()], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer rows of each chunk."""
    for batch in batches:
        for r in range(batch.num_rows):
            size, width = batch.column(1)[r].as_py(), batch.column(2)[r].as_py()
            data = np.frombuffer(batch.column(3)[r].as_buffer(), f"<i{width}")
            yield batch.column(0)[r].values, data.reshape(-1, size).astype(np.int64)


@dataclass
class _Sum:
    """A sum of arrays; what rounding loses of floating-point terms is carried along."""

    total: np.ndarray | int = 0
    lost: np.ndarray | int = 0

    def add(self, term: np.ndarray) -> None:
        new = self.total + term
        if new.dtype != object:
            back = new - self.total
            self.lost = self.lost + ((self.total - (new - back)) + (term - back))
        self.total = new

    def value(self) -> np.ndarray:
        return self.total + self.lost


def _total(chunks: DataFrame, parts: int, term: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | int:
    """The sum of ``term`` over all chunks: one partial sum a partition, added up in
    the order of the partitions, on executors while there are over FAN of them."""

    def summed(terms: Iterator[np.ndarray], slot: int) -> Iterator[pa.RecordBatch]:
        sums = _Sum()
        for one in terms:
            sums.add(one)
        if not isinstance(sums.total, int):
            yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int64()), "data": [dumps(sums.value())]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from summed((term(rows) for _, rows in _read(batches)), TaskContext.get().partitionId())

    def again(data: pa.Table) -> pa.Table:
        ordered = data.sort_by("slot")
        terms = (loads(d) for d in ordered["data"].to_pylist())
        return pa.Table.from_batches(summed(terms, ordered["slot"][0].as_py() // FAN))

    rows = chunks.mapInArrow(run, "slot long, data binary")
    while parts > FAN:
        rows = rows.groupBy(F.floor(F.col("slot") / FAN)).applyInArrow(again, "slot long, data binary")
        parts = ceil(parts / FAN)
    sums = _Sum()
    for row in sorted(rows.collect(), key=lambda r: r.slot):
        sums.add(loads(row.data))
    return sums.value()


def _exact_moments(rows: np.ndarray) -> np.ndarray:
    """Row (count, size) and per dimension (sum, sum of squares), as Python integers."""
    most = int(np.abs(rows).max())
    if most * most * len(rows) >= 1 << 62:
        rows = rows.astype(object)
    sums = np.stack([rows.sum(axis=0).astype(object), (rows * rows).sum(axis=0).astype(object)])
    return np.column_stack([np.array([[len(rows)], [0]], object), sums])


@dataclass(frozen=True)
class Whitening:
    """Centre and components of a fit list; pickled into the tasks that apply it."""

    count: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    products: int

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return _centred(rows, self.sums, self.count)

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return self.centred(rows) @ self.vectors / np.sqrt(self.values)

    def deviation(self, rows: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 as exact integers, per row."""
        shift, rest = _split(self.sums, self.count)
        y = rows - shift
        most = int(np.abs(y).max()) + 1
        if most * max(most, self.count) * rows.shape[1] >= 1 << 62:
            y, rest = y.astype(object), rest.astype(object)
        squares, across = (y * y).sum(axis=1).tolist(), (y * rest).sum(axis=1).tolist()
        own = sum(r * r for r in rest.tolist())
        return [self.count**2 * s - 2 * self.count * a + own for s, a in zip(squares, across, strict=True)]


def _split(sums: tuple[int, ...], count: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [divmod(s, count) for s in sums]
    return np.array([a for a, _ in parts], np.int64), np.array([b for _, b in parts], np.int64)


def _centred(rows: np.ndarray, sums: tuple[int, ...], count: int) -> np.ndarray:
    shift, rest = _split(sums, count)
    return (rows - shift).astype(np.float64) - rest / count


def _fit(chunks: DataFrame, parts: int, components: int) -> tuple[Whitening | None, DataFrame, int]:
    sizes = [r.size for r in chunks.select("size").distinct().limit(2).collect()]
    if not sizes:
        return None, chunks, parts
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} entries cannot be whitened together")
    moments = _total(chunks, parts, _exact_moments)
    count, size = int(moments[0, 0]), sizes[0]
    sums = tuple(int(s) for s in moments[0, 1:])
    trace = float(sum(Fraction(count * int(q) - s * s, count * count) for s, q in zip(sums, moments[1, 1:], strict=True)))
    # Small tables in many files would pay for many tasks in every pass.
    enough = max(chunks.sparkSession.sparkContext.defaultParallelism, ceil(count * size / PART))
    if enough < parts:
        chunks, parts = chunks.coalesce(enough), enough

    def product(block: np.ndarray) -> np.ndarray:
        def term(rows: np.ndarray) -> np.ndarray:
            z = _centred(rows, sums, count)
            return z.T @ (z @ block)

        return _total(chunks, parts, term) / count

    solved = jacobi_davidson(product, size, components)
    real = solved.values > size * EPS * max(solved.values[0], 0.0)
    vectors = solved.vectors[:, real]
    # The largest entry of a component is positive.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return (
        Whitening(count, sums, trace, solved.values[real], vectors, solved.residual, solved.products),
        chunks,
        parts,
    )


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, ident: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error,
    deviation_exact) for every vector and component.

    ``deviation`` is null where it does not fit a long (from some millions of
    vectors on); ``deviation_exact`` is a decimal of 38 digits.  The vectors are
    read once and kept as integers in the shared folder; the driver holds
    matrices of as many rows as a vector has entries, and nothing for each vector.
    """
    chunks = settle(_chunks(vectors, ident, vector))
    kind = chunks.schema["ids"].dataType.elementType
    schema = (
        T.StructType([T.StructField("vec_id", kind)])
        .add("component", T.IntegerType())
        .add("n", T.LongType())
        .add("deviation", T.LongType())
        .add("whitened", T.DoubleType())
        .add("explained", T.DoubleType())
        .add("identity_error", T.DoubleType())
        .add("deviation_exact", T.DecimalType(38, 0))
    )
    fitted, chunks, parts = _fit(chunks, chunks.rdd.getNumPartitions(), components)
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(fitted.values)

    def moments(rows: np.ndarray) -> np.ndarray:
        w = fitted.whitened(rows)
        return np.vstack([w.sum(axis=0), w.T @ w])

    sums = _total(chunks, parts, moments) / fitted.count
    error = float(np.abs(sums[1:] - np.outer(sums[0], sums[0]) - np.eye(k)).max())
    explained = fitted.values / fitted.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _read(batches):
            exact = fitted.deviation(rows)
            each = pa.array(np.repeat(np.arange(len(rows)), k))
            fits = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
            decimals = pa.array([Decimal(d) if d < 10**38 else None for d in exact], pa.decimal128(38, 0))
            columns = [
                ids.take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                pa.array(np.full(len(each), fitted.count, np.int64)),
                fits.take(each),
                pa.array(fitted.whitened(rows).ravel()),
                pa.array(np.tile(explained, len(rows))),
                pa.array(np.full(len(each), error)),
                decimals.take(each),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return chunks.mapInArrow(run, schema)


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on its eight leading components."""
    return whiten(table(spark, sf_dir, "embeddings"))
