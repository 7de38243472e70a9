"""Operator 11: k-means over integer vectors, exact, with Elkan's bounds.

Each vector carries an upper bound of the distance to its own centroid and a lower bound of that
to each centroid, in a table that every round reads and writes again. A round moves the bounds by
as much as the centroids moved, and computes a distance only where neither the lower bound nor
half the distance between the two centroids shows that a centroid is farther. Bounds are rounded
away from the truth and compared strictly, so that whatever is skipped is really farther: equally
near centroids are always computed, and the smaller number wins. All distances that decide are
integers.

Sums of clusters are kept from round to round: only vectors that changed their cluster are added
and subtracted, in integers, so that no round shuffles more than one row a cluster and task. The
driver holds the centroids, whose number and size are parameters, and nothing that grows with the
vectors. Rounds end early once no centroid moves, as further ones change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: What a query over the embeddings uses: components a vector has, units in 1.0, centroids, rounds, and the text before an id whose hash picks the first centroids.
COMPONENTS, SCALE, CLUSTERS, ROUNDS, SALT = 64, 1024, 8, 10, "3:"
#: Components beyond this raise an error, as squared distances would not fit a long.
MOST = 1 << 27


def integer_vectors(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors of exactly so many components, none null or non-finite, as floor(scale * component)."""
    v = F.col("embedding").cast("array<double>")
    kept = rows.select("vec_id", v.alias("v")).where((F.size("v") == components) & F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)))
    whole = lambda c: F.floor(c * float(scale))
    checked = lambda c: F.when(F.abs(whole(c)) <= MOST, whole(c)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")))
    return kept.select("vec_id", F.transform("v", lambda c: checked(c).cast("int")).alias("x"))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def above(squared: np.ndarray) -> np.ndarray:
    """At least the root; the two steps exceed the rounding of the conversion and of the root."""
    return np.nextafter(np.nextafter(np.sqrt(squared.astype(np.float64)), np.inf), np.inf)


def below(squared: np.ndarray) -> np.ndarray:
    """At most the root."""
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(squared.astype(np.float64)), -np.inf), -np.inf), 0.0)


def nearest(x: np.ndarray, centres: np.ndarray, half: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
    """Moves rows to their nearest centroid, in place; (squared distance to the own centroid or -1 where it was not needed, distances computed).

    half: half the distances between centroids, rounded down.
    """
    own, computed = np.full(len(x), -1, np.int64), 0
    for j in range(len(centres)):
        may = (cluster != j) & (upper >= lower[:, j]) & (upper >= half[cluster, j])
        stale = np.flatnonzero(may & (own < 0))
        if stale.size:
            own[stale] = squares(x[stale], centres[cluster[stale]])
            upper[stale], lower[stale, cluster[stale]] = above(own[stale]), below(own[stale])
            may &= (upper >= lower[:, j]) & (upper >= half[cluster, j])
        left = np.flatnonzero(may)
        if left.size:
            d = squares(x[left], centres[j])
            lower[left, j] = below(d)
            wins = (d < own[left]) | ((d == own[left]) & (j < cluster[left]))
            to = left[wins]
            cluster[to], own[to] = j, d[wins]
            upper[to] = above(own[to])
        computed += stale.size + left.size
    return own, computed


def _step(centres: np.ndarray, before: np.ndarray | None, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One assignment over batches of the table; before: the centroids that its bounds were taken from."""
    k, dims = centres.shape
    half = np.stack([below(squares(centres, c)) for c in centres]) / 2
    moved = None if before is None else above(squares(centres, before)) * (centres != before).any(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
            if moved is None:
                d = np.stack([squares(x, c) for c in centres], 1)
                was, cluster = np.full(len(x), -1, np.int32), d.argmin(1).astype(np.int32)
                own, computed = d.min(1), d.size
                upper, lower = above(own), below(d)
            else:
                was = b.column("cluster").to_numpy(zero_copy_only=False)
                cluster = was.copy()
                upper = np.nextafter(b.column("upper").to_numpy(zero_copy_only=False) + moved[was], np.inf)
                lower = b.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - moved
                lower = np.maximum(np.nextafter(lower, -np.inf), 0.0)
                own, computed = nearest(x, centres, half, cluster, upper, lower)
            if last:
                unknown = np.flatnonzero(own < 0)
                own[unknown] = squares(x[unknown], centres[cluster[unknown]])
            counts = np.zeros(len(x), np.int64)
            counts[:1] = computed
            lists = pa.ListArray.from_arrays(np.arange(0, len(x) * k + 1, k, dtype=np.int32), lower.ravel())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(cluster), pa.array(was), pa.array(upper), lists, pa.array(own), pa.array(counts)], names=["vec_id", "x", "cluster", "was", "upper", "lower", "distance", "computed"])

    return run


def _changes(k: int, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the vectors that changed their cluster: a row a cluster with what its sums gain, the number of vectors last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
            for column, sign in (("cluster", 1), ("was", -1)):
                of = b.column(column).to_numpy(zero_copy_only=False)
                for j in np.unique(of[of >= 0]):
                    mine = of == j
                    gain[j, :dims] += sign * x[mine].sum(0)
                    gain[j, dims] += sign * mine.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(list(gain), pa.list_(pa.int64()))], names=["c", "s"])

    return run


def clustered(vectors: DataFrame, scratch: Scratch, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT) -> tuple[DataFrame, list[list[int]]]:
    """Rows (vec_id, x, cluster, distance, computed) of vectors (vec_id, x), and the centroids.

    The first centroids are the k vectors with the smallest sha256 of salt and id, in that order
    (equal ids by their components; null ids after all others); there are fewer if there are fewer
    vectors, and no rows if there are none. computed sums up to the distances that the last
    assignment computed. Rows of repeated ids are vectors of their own.
    """
    state = scratch.cut(vectors.select("vec_id", "x"))
    kind = state.schema["vec_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = state.select("x", digest.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    if not first:
        return state.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("computed")), []
    centres = np.array([r["x"] for r in first], np.int64)
    k, dims = centres.shape
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    schema = f"vec_id {kind}, x array<int>, cluster int, was int, upper double, lower array<double>, distance long, computed long"
    before, n = None, 0
    while True:
        last = n == rounds or (before is not None and (centres == before).all())
        after = scratch.cut(state.mapInArrow(_step(centres, before, last), schema))
        scratch.drop(state)
        state, before, n = after, centres, n + 1
        if last:
            return state.select("vec_id", "x", "cluster", "distance", "computed"), centres.tolist()
        gains = state.where("cluster <> was").select("x", "cluster", "was").mapInArrow(_changes(k, dims), "c int, s array<long>").select("c", F.posexplode("s").alias("i", "v"))
        for r in gains.groupBy("c", "i").agg(F.sum("v").alias("v")).collect():  # the size of the centroids
            if r["i"] == dims:
                counts[r["c"]] += r["v"]
            else:
                sums[r["c"]][r["i"]] += r["v"]
        centres = np.array([[s // m for s in row] if m else old for row, m, old in zip(sums, counts, centres.tolist(), strict=True)], np.int64)


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept."""
    rows, centres = clustered(integer_vectors(table(spark, sf_dir, "embeddings")), Scratch(spark))
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a cluster
    of = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster")).cast(kind)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    inertias = [sums.get(j, 0) for j in range(len(centres))]
    return rows.select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", of(inertias, "long").alias("cluster_inertia"), F.lit(sum(inertias)).cast("long").alias("inertia"), of(hashes, "string").alias("centroid_sha256"))


def _oracle() -> str:
    parts = [f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({SCALE}.0::DOUBLE * c::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT sha256('{SALT}' || vec_id) AS h, x FROM kept ORDER BY h, x LIMIT {CLUSTERS}))"""]  # fmt: skip
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, x, cluster, distance FROM (
    SELECT k.vec_id, k.x, c.j AS cluster, list_sum(list_transform(list_zip(k.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM kept k, c{r} c)
  QUALIFY row_number() OVER (PARTITION BY vec_id, x ORDER BY distance, cluster) = 1)""")
        if r < ROUNDS:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT cluster, list(v ORDER BY i) AS x FROM (
      SELECT cluster, i, ((s - (((s % n) + n) % n)) // n)::BIGINT AS v FROM (
        SELECT cluster, i, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY cluster, i))
    GROUP BY cluster) m ON c.j = m.cluster)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(a.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.cluster = c.j"""  # fmt: skip


ORACLE = _oracle()
