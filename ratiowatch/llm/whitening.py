"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Vectors become whole numbers. One pass sums counts, sums and products without rounding; the
scatter n * sum(x x') - S S' is then a matrix of whole numbers. Tasks find its
characteristic polynomial modulo one prime each, Chinese remainders join them, and each
component's vector is the work of one task. A last pass projects every row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ratiowatch.llm import charpoly

#: An entry c becomes floor(STEPS * c) + ORIGIN.
STEPS, ORIGIN = 64, 1_000_000
#: Whole numbers stay within this size, so that they are longs whatever an entry is.
LARGEST = 1 << 62
LIMB_BITS, LIMBS = 32, 6
ROWS = 4096


@dataclass
class Whitening:
    """A fitted transform: of d dimensions, n vectors, and the components of positive variance in falling order."""

    dimensions: int
    n: int = 0
    sums: list[int] = field(default_factory=list)
    trace: int = 0
    #: Eigenvalues of the scatter over its trace, and the unit vectors as rows.
    explained: np.ndarray = field(default_factory=lambda: np.empty(0))
    vectors: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    #: Components that are returned though their variance is zero.
    flat: int = 0


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def _vectors(rows: DataFrame, vector_column: str, dimensions: int | None, *others: str) -> DataFrame:
    vector = F.col(vector_column).cast("array<double>")
    wanted = usable(vector) if dimensions is None else usable(vector) & (F.size(vector) == dimensions)
    return rows.where(wanted).select(*[F.col(c) for c in others], vector.alias("_vector"))


def _whole(column: pa.Array, dimensions: int) -> np.ndarray:
    """x - ORIGIN of all rows of a batch; scatter and centred values do not depend on the origin."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    steps = np.floor(np.clip(STEPS * flat, -float(LARGEST), float(LARGEST)))
    return np.clip(steps, -float(LARGEST), float(LARGEST - 512)).astype(np.int64)


def _products(y: np.ndarray) -> np.ndarray:
    """y' y without rounding, as Python numbers if longs are too small."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * len(y) < 1 << 53:
        return (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64).astype(object)
    if largest * largest * len(y) < 1 << 63:
        return (y.T @ y).astype(object)
    wide = y.astype(object)
    return wide.T @ wide


def _limbs(value: int) -> list[int]:
    """Digits of 32 bits, the last with the sign."""
    return [(value >> (LIMB_BITS * k)) & ((1 << LIMB_BITS) - 1) for k in range(LIMBS - 1)] + [value >> (LIMB_BITS * (LIMBS - 1))]


def scatter(rows: DataFrame, vector_column: str, dimensions: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and products of x - ORIGIN over all usable vectors, exact. Each task sends one row per pair of dimensions."""
    pairs = [(i, j) for i in range(dimensions) for j in range(i, dimensions)]

    def summed(batches):
        n, sums, products = 0, np.zeros(dimensions, object), np.zeros((dimensions, dimensions), object)
        for batch in batches:
            y = _whole(batch.column(0), dimensions)
            for first in range(0, len(y), ROWS):
                part = y[first:first + ROWS]
                products = products + _products(part)
                narrow = int(np.abs(part).max(initial=0)) * len(part) < 1 << 63
                sums = sums + (part if narrow else part.astype(object)).sum(axis=0).astype(object)
            n += len(y)
        if not n:
            return
        values = [n, *sums.tolist(), *(products[i, j] for i, j in pairs)]
        limbs = list(zip(*[_limbs(int(v)) for v in values]))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *[pa.array(c, pa.int64()) for c in limbs]],
                                         ["at", *[f"l{k}" for k in range(LIMBS)]])

    schema = "at int, " + ", ".join(f"l{k} long" for k in range(LIMBS))
    parts = _vectors(rows, vector_column, dimensions).mapInArrow(summed, schema)
    total = parts.groupBy("at").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()  # one row per pair
    value = {r["at"]: sum(r[f"l{k}"] << (LIMB_BITS * k) for k in range(LIMBS)) for r in total}
    n, sums = value.get(0, 0), [value.get(1 + i, 0) for i in range(dimensions)]
    products = [[0] * dimensions for _ in range(dimensions)]
    for at, (i, j) in enumerate(pairs):
        products[i][j] = products[j][i] = value.get(1 + dimensions + at, 0)
    return n, sums, products


def polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients of the characteristic polynomial, lowest power first; every prime is a row of a table."""
    size, trace = len(matrix), sum(matrix[k][k] for k in range(len(matrix)))
    primes = charpoly.primes_beyond(2 * charpoly.coefficient_bound(size, trace) + 1)
    held = spark.sparkContext.broadcast(matrix)  # dimensions x dimensions numbers

    def reduced(batches):
        for batch in batches:
            found = [charpoly.residue(np.array([[v % p for v in row] for row in held.value], np.int64), p).tolist() for p in batch["prime"]]
            yield pd.DataFrame({"prime": batch["prime"], "residues": found})

    table = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(min(len(primes), 32))
    rows = table.mapInPandas(reduced, "prime long, residues array<long>").collect()
    return charpoly.combine([(r["prime"], r["residues"]) for r in rows])


def fit(rows: DataFrame, vector_column: str = "embedding", components: int = 32) -> Whitening:
    """Fit on every usable vector of the table.

    Null vectors, vectors with null or non-finite entries and empty vectors take no part.
    The dimension is that of most usable vectors (of the largest, if equal); vectors of
    other lengths take no part. No usable vector gives a transform of no dimension. Repeated
    rows count each. If fewer than ``components`` directions have variance, the others are
    counted in ``flat``.
    """
    spark = rows.sparkSession
    vector = F.col(vector_column).cast("array<double>")
    sizes = rows.where(usable(vector)).groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not first:
        return Whitening(0)
    d = first[0]["d"]
    n, sums, products = scatter(rows, vector_column, d)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(matrix[k][k] for k in range(d))
    wanted = min(components, d)
    if not trace:
        return Whitening(d, n, sums, 0, flat=wanted)
    roots = charpoly.top_roots(polynomial(spark, matrix), trace, wanted)
    held = spark.sparkContext.broadcast(matrix)

    def solved(batches):
        for batch in batches:
            found = [charpoly.null_vectors(held.value, charpoly.Root(int(low), scale, times, gap), trace).ravel().tolist()
                     for low, scale, times, gap in zip(batch["low"], batch["scale"], batch["times"], batch["gap"])]
            yield pd.DataFrame({"number": batch["number"], "entries": found})

    table = spark.createDataFrame([(k, str(r.low), r.scale, r.times, r.gap_bits) for k, r in enumerate(roots)],
                                  "number int, low string, scale int, times int, gap int").repartition(max(1, len(roots)), "number")
    solutions = {r["number"]: r["entries"] for r in table.mapInPandas(solved, "number int, entries array<double>").collect()}
    vectors, explained, bits = [], [], 64 + charpoly.CLUSTER_BITS
    for k, root in enumerate(roots):
        vectors += np.array(solutions[k]).reshape(root.times, d).tolist()
        explained += [root.value(bits) / (trace << bits)] * root.times
    kept = min(wanted, len(vectors))
    return Whitening(d, n, sums, trace, np.array(explained[:kept]), np.array(vectors[:kept]).reshape(kept, d), wanted - kept)


def _centred(y: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """x - S / n as doubles, from whole numbers, and the deviation of each row."""
    base = [s // model.n for s in model.sums]
    rest = [s - b * model.n for s, b in zip(model.sums, base)]
    reach = max(int(np.abs(y).max(initial=0)), 1) + max(map(abs, base), default=0) + 1
    if (reach * model.n) ** 2 * model.dimensions < 1 << 62:
        moved = (y - np.array(base, np.int64)) * model.n - np.array(rest, np.int64)
        return moved / model.n, (moved * moved).sum(axis=1).tolist()
    wide = (y.astype(object) - np.array(base, object)) * model.n - np.array(rest, object)
    sums = [int(v) for v in (wide * wide).sum(axis=1)]
    return (wide / model.n).astype(np.float64), [v if v < 1 << 63 else None for v in sums]


def _scaled(model: Whitening) -> np.ndarray:
    """Vectors as columns over the square roots of the eigenvalues of the covariance; sums cancel the divisor n."""
    variance = model.explained * (model.trace / model.n / model.n)
    return (model.vectors / np.sqrt(variance)[:, None]).T


def identity_error(rows: DataFrame, model: Whitening, vector_column: str = "embedding") -> float | None:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, from the rows; null without components."""
    k = len(model.explained)
    if not k:
        return None
    held = rows.sparkSession.sparkContext.broadcast(model)

    def summed(batches):
        known, total, sums = held.value, np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            white = _centred(_whole(batch.column(0), known.dimensions), known)[0] @ _scaled(known)
            total += white.T @ white
            sums += white.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k), pa.int32()), pa.array([*total.ravel(), *sums])], ["at", "v"])

    parts = _vectors(rows, vector_column, model.dimensions).mapInArrow(summed, "at int, v double")
    value = {r["at"]: r["v"] for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect()}
    covariance = np.array([value[a] for a in range(k * k)]).reshape(k, k) / model.n
    means = np.array([value[k * k + a] for a in range(k)]) / model.n
    return float(np.abs(covariance - np.outer(means, means) - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per usable vector of the fitted dimension: vec_id, deviation and whitened (an array, one entry per component).

    ``deviation`` is the exact sum over dimensions of (n * x - S)^2, null if it is no long.
    Components without variance have a null entry. Ids may be null or repeat; other columns
    are ignored; a transform of no dimension gives no rows.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)

    def projected(batches):
        known = held.value
        for batch in batches:
            y = _whole(batch.column(1), known.dimensions)
            for first in range(0, len(y), ROWS):
                centred, deviations = _centred(y[first:first + ROWS], known)
                white = centred @ _scaled(known) if len(known.explained) else np.empty((len(centred), 0))
                lists = [[*row, *[None] * known.flat] for row in white.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:first + ROWS], pa.array(deviations, pa.int64()),
                                                  pa.array(lists, pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    table = rows.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).alias("_entries"))
    wanted = _vectors(table, "_entries", model.dimensions or -1, "vec_id")
    return wanted.mapInArrow(projected, "vec_id long, deviation long, whitened array<double>")


def whitened_components(rows: DataFrame, components: int = 32, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Fit and transform: one row per usable vector and component, numbered from 1 by falling variance.

    A component without variance has a null whitened value and explains 0, or null if no
    dimension varies. See ``fit`` and ``transform`` for nulls, other lengths and repeated rows.
    """
    model = fit(rows, vector_column, components)
    error = identity_error(rows, model, vector_column)
    none = F.lit(0.0 if model.trace else None).cast("double")
    shares = F.array(*[F.lit(float(e)) for e in model.explained], *[none] * model.flat).cast("array<double>")
    long = transform(rows, model, id_column, vector_column).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
