"""Whitening of embeddings with leading components found by spectrum slicing.

Entries become integers, so the sums and products Spark gathers are exact and do not depend on how rows
are dealt: one pass for the sums, one for the products of entries centred at the floor of their mean. What
reaches the driver is one matrix for each vector length, whatever the number of rows.

There, the number of negative pivots of LDL' (diagonal pivoting) of V - s counts the eigenvalues below s.
Such counts halve brackets until each leading eigenvalue stands alone in its own (or in a bracket of the width of
rounding, with its equals), Rayleigh quotient iteration converges inside the bracket, and two more counts just
beside the result certify its number.

Defined results: vectors that are null or hold a null or non-finite entry are left out, as are empty ones;
vectors of another length form a fit list of their own (lengths are taken to be few: each costs the driver a
matrix); a repeated row and a row without id count like any other; entries beyond 2^45 after scaling are held
at that bound; components whose eigenvalue is zero within rounding are not returned, so constant vectors, or a single one, give
no rows; a deviation beyond a long is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axlewatch.llm.base import stored

SCALE, OFFSET = 1024, 100_000
LARGEST = 2 ** 45       # squares of it, summed over 10^10 rows, fit 38 digits
EXACT = 2.0 ** 53       # whole numbers below are exact as doubles
PIVOT = (1 + math.sqrt(17)) / 8
EPS = float(np.finfo(np.float64).eps)


# ---------------------------------------------------------------- spectrum

def negative_pivots(matrix: np.ndarray) -> int:
    """The number of negative eigenvalues of a symmetric matrix, by the inertia of its LDL' form."""
    a, n, k, found = matrix.astype(np.float64), len(matrix), 0, 0
    while k < n:
        column = np.abs(a[k + 1:, k])
        most = column.max(initial=0.0)
        if most == 0.0:
            found += a[k, k] < 0
            k += 1
            continue
        size, r = 1, k + 1 + int(column.argmax())
        if abs(a[k, k]) < PIVOT * most:
            others = np.abs(a[k:, r])
            others[r - k] = 0.0
            widest = others.max()
            if abs(a[k, k]) * widest < PIVOT * most * most:
                size = 1 if abs(a[r, r]) >= PIVOT * widest else 2
                at = k + size - 1
                a[[at, r]] = a[[r, at]]
                a[:, [at, r]] = a[:, [r, at]]
        block, below = a[k:k + size, k:k + size], a[k + size:, k:k + size]
        if size == 1:
            found += block[0, 0] < 0
            a[k + 1:, k + 1:] -= np.outer(below[:, 0] / block[0, 0], below[:, 0])
        else:
            found += 1      # this pivot rule leaves one eigenvalue of either sign
            a[k + 2:, k + 2:] -= below @ np.linalg.solve(block, below.T)
        k += size
    return int(found)


def above(matrix: np.ndarray, bound: float) -> int:
    """How many eigenvalues lie above `bound`."""
    return len(matrix) - negative_pivots(matrix - bound * np.eye(len(matrix)))


def brackets(matrix: np.ndarray, count: int, floor: float) -> list[tuple[float, float]]:
    """For each of the `count` leading eigenvalues above `floor` a bracket that holds it, by halving alone."""
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + EPS) + floor
    known = {floor: above(matrix, floor), top: 0}
    out = []
    for number in range(1, min(count, known[floor]) + 1):
        low = max(s for s, c in known.items() if c >= number)
        high = min(s for s, c in known.items() if c < number)
        while high - low > 4 * EPS * top and (known[low] > number or known[high] < number - 1):
            middle = (low + high) / 2
            known[middle] = above(matrix, middle)
            low, high = (middle, high) if known[middle] >= number else (low, middle)
        out.append((low, high))
    return out


def eigenvector(matrix: np.ndarray, number: int, low: float, high: float, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """The eigenvalue inside the bracket and its unit vector, orthogonal to those found before it."""
    n, size = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    basis = np.array(found).reshape(len(found), n)
    q = np.random.default_rng(number).standard_normal(n)
    q -= basis.T @ (basis @ q)
    q /= np.linalg.norm(q)
    shift, best = (low + high) / 2, (np.inf, 0.0, q)
    for _ in range(100):
        try:
            step = np.linalg.solve(matrix - shift * np.eye(n), q)
        except np.linalg.LinAlgError:       # the shift is an eigenvalue to the last bit
            shift += 2 * EPS * size
            continue
        step -= basis.T @ (basis @ step)
        step /= np.linalg.norm(step)
        q = step - basis.T @ (basis @ step)
        q /= np.linalg.norm(q)
        value = float(q @ matrix @ q)
        residual = float(np.linalg.norm(matrix @ q - value * q))
        slack = 4 * EPS * size
        if low - slack <= value <= high + slack:
            if residual < best[0]:
                best = (residual, value, q)
            elif best[0] < 1e3 * EPS * size:
                break
            shift = value       # from here on the Rayleigh quotient
        elif high - low > slack:
            middle = (low + high) / 2       # it strayed to a neighbour: halve on, start in the middle
            low, high = (middle, high) if above(matrix, middle) >= number else (low, middle)
            shift = (low + high) / 2
    return best[1], best[2]


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit vectors as rows) of the largest `count` eigenvalues that are not zero within rounding."""
    size = float(np.abs(matrix).sum(axis=1).max())
    floor = 16 * len(matrix) * EPS * size
    values, vectors = [], []
    for number, (low, high) in enumerate(brackets(matrix, count, floor), 1):
        value, vector = eigenvector(matrix, number, low, high, vectors)
        near = max(64 * EPS * size, 4 * float(np.linalg.norm(matrix @ vector - value * vector)))
        if above(matrix, value - near) < number or above(matrix, value + near) >= number:
            raise ArithmeticError(f"eigenvalue {number} is not where its counts say")
        values.append(value)
        vectors.append(vector)
    return np.array(values), np.array(vectors).reshape(len(vectors), len(matrix))


# ---------------------------------------------------------------- fit

@dataclass
class Fit:
    """What one vector length needs: n, the sums, the eigenvalues over the trace, and the whitening directions."""

    n: int
    sums: list[int]
    explained: np.ndarray
    directions: np.ndarray      # unit vectors over the square root of their eigenvalue, one per row
    error: float = 0.0


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, int64 matrix) for each length among the batch's x."""
    x = batch.column(batch.schema.get_field_index("x"))
    sizes = np.diff(x.offsets.to_numpy())
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        part = x if len(at) == len(x) else x.take(pa.array(at))
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)


def products(left: np.ndarray) -> np.ndarray:
    """left' left, exact: as doubles in slices small enough, else with Python integers."""
    most = float(np.abs(left).max(initial=1)) ** 2
    if most * 16 >= EXACT:
        whole = left.astype(object)
        return whole.T @ whole
    rows, total = int(EXACT / most), 0
    for start in range(0, len(left), rows):
        part = left[start:start + rows].astype(np.float64)
        total = (part.T @ part).astype(np.int64).astype(object) + total
    return total


def totals(df: DataFrame, work: Callable[[int, np.ndarray], np.ndarray], kind: str) -> dict[int, dict[int, object]]:
    """For each vector length, the sums over all rows of what `work` (length, matrix) gives, by place."""
    arrow = pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64()
    turn = Decimal if kind.startswith("decimal") else float

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, matrix in by_length(batch):
                size = matrix.shape[1]
                sums[size] = work(size, matrix) + sums.get(size, 0)
        for size, flat in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), size), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()),
                 pa.array([turn(v) for v in flat.tolist()], arrow)], names=["size", "place", "value"])

    found = (df.select("x").mapInArrow(run, f"size int, place int, value {kind}")
             .groupBy("size", "place").agg(F.sum("value").alias("value")).collect())
    out: dict[int, dict[int, object]] = {}
    for row in found:
        out.setdefault(row["size"], {})[row["place"]] = row["value"]
    return out


def with_count(flat: np.ndarray, rows: int) -> np.ndarray:
    return np.append(flat, rows)


def fit_lengths(df: DataFrame, count: int) -> dict[int, Fit]:
    """A Fit for each vector length of x; the identity error is measured on the whitened rows themselves."""
    first = totals(df, lambda _, m: with_count(m.sum(axis=0, dtype=object), len(m)), "decimal(38,0)")
    sums = {size: [int(found[i]) for i in range(size)] for size, found in first.items()}
    rows = {size: int(found[size]) for size, found in first.items()}
    centres = {size: np.array([s // rows[size] for s in sums[size]]) for size in sums}
    upper = {size: np.triu_indices(size) for size in sums}
    second = totals(df, lambda size, m: products(m - centres[size])[upper[size]], "decimal(38,0)")
    fits = {}
    for size, found in second.items():
        n = rows[size]
        rest = [s - n * int(c) for s, c in zip(sums[size], centres[size])]
        covariance = np.zeros((size, size))
        for place, (i, j) in enumerate(zip(*upper[size])):
            # n^2 V in whole numbers, so V is right to the last bit
            covariance[i, j] = covariance[j, i] = (n * int(found[place]) - rest[i] * rest[j]) / (n * n)
        values, vectors = leading(covariance, count) if covariance.any() else (np.empty(0), np.empty((0, size)))
        fits[size] = Fit(n, sums[size], values / max(np.trace(covariance), 1e-300),
                         vectors / np.sqrt(values)[:, None])

    def moments(size: int, matrix: np.ndarray) -> np.ndarray:
        z = centred(fits[size], matrix)[0] @ fits[size].directions.T
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    for size, found in totals(df, moments, "double").items():
        k = len(fits[size].directions)
        flat = np.array([found[i] for i in range(k * k + k)]) / rows[size]
        square, mean = flat[:k * k].reshape(k, k), flat[k * k:]
        fits[size].error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return fits


def centred(fit: Fit, matrix: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """(x - S/n, the sum of (n x - S)^2 or None beyond a long)."""
    sums = np.array([float(s) for s in fit.sums])
    bound = (np.abs(matrix).astype(np.float64) * fit.n + np.abs(sums)).max(initial=0.0)
    away = (matrix * fit.n - np.array(fit.sums) if bound < 2.0 ** 62
            else matrix.astype(object) * fit.n - np.array(fit.sums, dtype=object))
    whole = away.astype(np.float64)
    if (whole ** 2).sum(axis=1).max(initial=0.0) < 2.0 ** 62:
        deviation = (away.astype(np.int64) ** 2).sum(axis=1).tolist()
    else:
        deviation = [d if (d := sum(int(v) ** 2 for v in row)) < 2 ** 63 else None for row in away]
    return whole / fit.n, deviation


# ---------------------------------------------------------------- the operator

def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    fine = F.forall("entries", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = F.transform("entries", lambda c: F.floor(F.greatest(
        F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), c * SCALE))).cast("long") + OFFSET)
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                           F.transform("embedding", lambda c: c.cast("double")).alias("entries"))
            .where(F.col("entries").isNotNull() & (F.size("entries") > 0) & fine)
            .select("vec_id", held.alias("x")))


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """Projections of each vector of (vec_id, embedding) on the leading components, each of variance one."""
    rows = stored(integer_vectors(vectors))
    fits = fit_lengths(rows, components)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for at, matrix in by_length(batch):
                fit = fits[matrix.shape[1]]
                k, rows = len(fit.directions), len(at)
                if not k:
                    continue
                values, deviation = centred(fit, matrix)
                each = np.repeat(at, k)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, fit.n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array((values @ fit.directions.T).ravel()), pa.array(np.tile(fit.explained, rows)),
                    pa.array(np.full(rows * k, fit.error))], names=[f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(run, schema)
