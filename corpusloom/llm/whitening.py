"""Operator 13: whitening of vectors by a compensated covariance and a divide-and-conquer eigen-solve.

Sums are pairs of doubles, a high and a low part: products are split without error, additions
keep what they round off (error-free transformations), so that a total has about 32 digits
whatever the order and number of its terms. Each task yields one pair of parts a sum, and parts
are merged in rounds of at most FAN tasks' rows, so that no task and not the driver sees more than
FAN of them. The driver holds one matrix of the vectors' dimensions.

The matrix is solved by LAPACK's divide and conquer over its tridiagonal form (numpy's eigh).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Units in 1.0, and components, of the query over the embeddings.
SCALE, COMPONENTS = 256, 4
#: Rows of partial sums that one task merges, and vectors whose products are held at once.
FAN, BLOCK = 64, 64


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and, exactly, what was rounded off."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded product and, exactly, what was rounded off; factors are split into halves of 26 bits."""

    def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = v * float(2**27 + 1)
        high = c - (c - v)
        return high, v - high

    p = a * b
    ah, al = halves(a)
    bh, bl = halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


Pair = tuple[np.ndarray, np.ndarray]


def add(a: Pair, b: Pair) -> Pair:
    """The sum of two pairs, of which the low part is at most half a unit of the high one's last place."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(terms: Pair) -> Pair:
    """The sum of the rows of terms, halving them."""
    high, low = terms
    while len(high) > 1:
        m = len(high) // 2
        h, lo = add((high[:m], low[:m]), (high[m : 2 * m], low[m : 2 * m]))
        high, low = np.concatenate([h, high[2 * m :]]), np.concatenate([lo, low[2 * m :]])
    return high[0], low[0]


def _matrix(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def totals(vectors: DataFrame, column: str, dims: int, terms: Callable[[np.ndarray], Pair], width: int) -> list[Fraction]:
    """Compensated sums of the width terms that each vector gives: terms maps a block of vectors to pairs."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, seen = (np.zeros(width), np.zeros(width)), False
        for b in batches:
            rows = _matrix(b, column, dims).astype(np.float64)
            for at in range(0, len(rows), BLOCK):
                have, seen = add(have, total(terms(rows[at : at + BLOCK]))), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([have[0]], pa.list_(pa.float64())), pa.array([have[1]], pa.list_(pa.float64()))], names=["high", "low"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, seen = (np.zeros(width), np.zeros(width)), False
        for b in batches:
            for high, low in zip(_matrix(b, "high", width), _matrix(b, "low", width), strict=True):
                have, seen = add(have, (high, low)), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([have[0]], pa.list_(pa.float64())), pa.array([have[1]], pa.list_(pa.float64()))], names=["high", "low"])

    schema = "high array<double>, low array<double>"
    parts, n = vectors.select(column).mapInArrow(partial, schema), max(1, vectors.rdd.getNumPartitions())
    while n > FAN:
        n = math.ceil(n / FAN)
        parts = parts.repartition(n).mapInArrow(merged, schema)
    rows = parts.collect()  # FAN at most
    return [sum((Fraction(r["high"][i]) + Fraction(r["low"][i]) for r in rows), Fraction(0)) for i in range(width)]


def halved(values: list[Fraction]) -> Pair:
    """High and low parts of exact numbers."""
    high = [float(v) for v in values]
    return np.array(high), np.array([float(v - Fraction(h)) for v, h in zip(values, high, strict=True)])


def covariance(vectors: DataFrame, column: str, dims: int, n: int, mean: list[Fraction]) -> list[list[Fraction]]:
    """The covariance matrix, divisor n, of vectors centred at mean before they are multiplied."""
    high, low = halved(mean)
    i, j = np.triu_indices(dims)

    def products(rows: np.ndarray) -> Pair:
        h, lo = two_sum(rows, -high)
        h, lo = two_sum(h, lo - low)
        p, e = two_product(h[:, i], h[:, j])
        return two_sum(p, e + (h[:, i] * lo[:, j] + lo[:, i] * h[:, j]))

    found = totals(vectors, column, dims, products, len(i))
    out = [[Fraction(0)] * dims for _ in range(dims)]
    for a, b, v in zip(i.tolist(), j.tolist(), found, strict=True):
        out[a][b] = out[b][a] = v / n
    return out


@dataclass
class Whitening:
    """n vectors of the fit and their sums; mean as high and low parts; unit components as rows, by falling eigenvalue; explained shares; the largest entry of whitened's covariance minus the identity."""

    n: int
    sums: list[int]
    mean: Pair
    components: np.ndarray
    values: np.ndarray
    explained: list[float]
    identity_error: float = 0.0

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Whitened rows; a component without variance gives NaN. Each row's result is its own, whatever rows stand beside it."""
        centred = (rows - self.mean[0]) - self.mean[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.nan)
            return np.stack([(centred * c).sum(1) for c in self.components], 1) / root


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors without null and non-finite entries, as floor(scale * entry); of the length that most of them have (the shorter of equally frequent ones), as others have no covariance with them.

    Entries must fit a long once scaled; larger ones raise an error.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    kept = rows.select("vec_id", v.alias("v")).where((F.size("v") > 0) & fine)
    sizes = kept.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    kept = kept.where(F.size("v") == (sizes[0]["d"] if sizes else 0))
    whole = lambda c: F.when(F.abs(c * float(scale)) < float(2**52), F.floor(c * float(scale))).otherwise(F.raise_error(F.lit("an entry is too large for exact sums")))
    return kept.select("vec_id", F.transform("v", lambda c: whole(c).cast("long")).alias("x"))


def fit(vectors: DataFrame, scratch: Scratch, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors x of vectors (vec_id, x); None without any."""
    distinct = scratch.cut(vectors.select("x").distinct())
    some = distinct.select(F.size("x").alias("d")).limit(1).collect()
    if not some:
        return None
    dims = some[0]["d"]
    row = distinct.agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")) for i in range(dims)]).alias("s")).first()
    n, sums = row["n"], [int(s) for s in row["s"]]
    mean = [Fraction(s, n) for s in sums]
    v = covariance(distinct, "x", dims, n, mean)
    matrix = np.array([[float(e) for e in r] for r in v])
    values, vectors_ = np.linalg.eigh(matrix)
    some = min(components, dims)
    values, units = values[::-1][:some].copy(), vectors_.T[::-1][:some].copy()
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    units *= np.sign(np.take_along_axis(units, np.abs(units).argmax(1)[:, None], 1))  # a component's largest entry is positive
    trace = sum((v[i][i] for i in range(dims)), Fraction(0))
    values[values <= dims * np.finfo(float).eps * max(values[0], 0.0)] = 0.0  # no variance but rounding
    out = Whitening(n, sums, halved(mean), units, values, [float(Fraction(e) / trace) if trace else 0.0 for e in values.tolist()])
    real = [c for c in range(some) if values[c] > 0]
    if real:
        out.identity_error = _identity_error(distinct, out, dims, real)
    return out


def _identity_error(distinct: DataFrame, w: Whitening, dims: int, real: list[int]) -> float:
    """From the whitened vectors themselves: their means, then their covariance, over the components that have variance."""

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = w.project(_matrix(b, "x", dims).astype(np.float64))[:, real]
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.list_(pa.float64()))], names=["w"])

    white, k = distinct.mapInArrow(whiten, "w array<double>"), len(real)
    sums = totals(white, "w", k, lambda rows: (rows, np.zeros_like(rows)), k)
    found = covariance(white, "w", k, w.n, [s / w.n for s in sums])
    return max(abs(float(found[a][b] - (a == b))) for a in range(k) for b in range(k))


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n * x - S)^2, exact; None where one does not fit a long."""
    if not len(rows):
        return []
    most = n * int(np.abs(rows).max()) + max(map(abs, sums))
    kind = np.int64 if rows.shape[1] * most * most < 2**63 else object
    away = rows.astype(kind) * n - np.array(sums, kind)
    return [int(d) if d < 2**63 else None for d in (away * away).sum(1)]


def whitened(vectors: DataFrame, w: Whitening) -> DataFrame:
    """(vec_id, component, deviation, whitened) of each row and component, from 1; whitened is null on a component without variance, deviation where it does not fit a long."""
    k, dims = w.components.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, "x", dims)
            out = w.project(x.astype(np.float64)).ravel()
            at = pa.array(np.repeat(np.arange(len(x)), k))
            away = pa.array(deviations(x, w.n, w.sums), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), away.take(at), pa.array(out, pa.float64(), mask=np.isnan(out))], names=["vec_id", "component", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, deviation long, whitened double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every remaining row and its first components."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    w = fit(vectors, Scratch(spark))
    if w is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.get(F.array(*[F.lit(e) for e in w.explained]), F.col("component") - 1)
    out = whitened(vectors, w)
    return out.select("vec_id", "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(w.identity_error).alias("identity_error"))
