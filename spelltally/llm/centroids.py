"""Centroid clustering of whole-number vectors, with a LAESA pivot table.

Lloyd's rounds assign every vector to its nearest centroid and move centroids to the means
of what they got. The vectors' distances to a few fixed pivots are computed and stored once.
By the triangle inequality, the difference between a vector's and a centroid's distance to a
pivot is a lower bound of the distance between them, so in every round most centroids are
passed over from the table alone; only the others get an exact distance, in whole numbers.

The pivots are the first centroids: in the first round the table decides everything.
Per round, a task sends one row per cluster, and the driver keeps centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spelltally.llm.common import quoted, stored

WIDTH, SCALE = 64, 64
CLUSTERS, ROUNDS, SEED = 16, 3, 1
# Whole numbers beyond this can't be squared and summed in 64 bits.
LARGEST = 1 << 26
# Square roots are off by less than this part of them.
ROOT_ERROR = 1e-12


def whole_vectors(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE, name: str = "embedding") -> DataFrame:
    """vec_id and ``v``, the floors of ``scale`` times each component, as doubles.

    Vectors of another length, and those with a null, NaN or infinite component, are left out.
    """
    x = quoted(name)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(F.coalesce((F.size(x) == width) & finite, F.lit(False)))
    return kept.select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def first_centroids(table: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in the order of these. Null ids hash as nothing."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = table.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    return np.array([row["v"] for row in rows], dtype=np.int64)


def squared(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``v`` to one point, exact."""
    apart = v - to
    return np.einsum("ij,ij->i", apart, apart)


def lower_bounds(roots: np.ndarray, centroid_roots: np.ndarray) -> np.ndarray:
    """For each vector and centroid, the largest difference of their distances to a pivot."""
    bounds = np.zeros((len(roots), len(centroid_roots)))
    for a, b in zip(roots.T, centroid_roots.T):
        apart = np.abs(a[:, None] - b) - ROOT_ERROR * (a[:, None] + b)
        np.maximum(bounds, apart, out=bounds)
    return bounds


def nearest(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its squared distance, and how many were computed."""
    if not len(v):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    between = np.stack([squared(centroids, p) for p in pivots], axis=1)
    bounds = lower_bounds(np.sqrt(to_pivots), np.sqrt(between))
    rows = np.arange(len(v))
    label = bounds.argmin(axis=1)
    best = np.einsum("ij,ij->i", v - centroids[label], v - centroids[label])
    computed = np.ones(len(v), dtype=np.int64)
    first = label.copy()
    bounds *= bounds * (1 - ROOT_ERROR)
    for number, centroid in enumerate(centroids):
        left = rows[(bounds[:, number] <= best) & (first != number)]
        if not len(left):
            continue
        distance = squared(v[left], centroid)
        computed[left] += 1
        better = (distance < best[left]) | ((distance == best[left]) & (number < label[left]))
        label[left[better]], best[left[better]] = number, distance[better]
    return label, best, computed


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, ``v`` and ``to_pivots``, the squared distance of each vector to each pivot."""
    width = pivots.shape[1]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            if ((v > LARGEST) | (v < -LARGEST)).any():
                raise ValueError(f"scaled components must lie within {LARGEST}")
            distances = np.stack([squared(v, p) for p in pivots], axis=1)
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(pivots))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(offsets, pa.array(distances.ravel()))],
                names=["vec_id", "v", "to_pivots"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(measured, f"vec_id {kind}, v array<long>, to_pivots array<long>")


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) and ``computed``, the number of exact distances it took."""
    width = centroids.shape[1]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, near = _matrix(batch.column("v"), width), _matrix(batch.column("to_pivots"), len(pivots))
            label, distance, computed = nearest(v, near, centroids, pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(label.astype(np.int32)), pa.array(distance), pa.array(computed.astype(np.int32))],
                names=["vec_id", "cluster", "distance", "computed"],
            )

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(labelled, f"vec_id {kind}, cluster int, distance long, computed int")


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of the mean of its vectors, component by component; empty ones stay."""
    width = centroids.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for batch in batches:
            v, near = _matrix(batch.column("v"), width), _matrix(batch.column("to_pivots"), len(pivots))
            label = nearest(v, near, centroids, pivots)[0]
            for cluster in np.unique(label):
                own = v[label == cluster]
                number[cluster] += len(own)
                total[cluster] += own.sum(axis=0)
        some = np.flatnonzero(number)
        offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(number[some]), pa.ListArray.from_arrays(offsets, pa.array(total[some].ravel()))],
            names=["cluster", "number", "total"],
        )

    per_task = table.select("v", "to_pivots").mapInArrow(sums, "cluster int, number long, total array<long>")
    rows = per_task.groupBy("cluster").agg(
        F.sum("number").alias("number"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(width))).alias("total")
    )
    new = centroids.copy()
    for row in rows.collect():  # one row per cluster
        new[row["cluster"]] = [x // row["number"] for x in row["total"]]
    return new


def fitted(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """Assignments (see ``assigned``) after the last round, stored, and the final centroids."""
    whole = whole_vectors(vectors, width, scale)
    pivots = first_centroids(whole, clusters, seed)
    if not len(pivots):
        kind = whole.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, computed int"), pivots
    table = stored(pivot_table(whole, pivots), "pivot-table")
    centroids = pivots
    for _ in range(rounds):
        centroids = moved(table, centroids, pivots)
    return stored(assigned(table, centroids, pivots), "clusters"), centroids


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, computed, cluster_inertia, inertia and centroid_sha256 per kept vector.

    ``distance`` is squared, ``inertia`` sums it over a cluster or over all. Vectors that are null,
    of another length, or with a null or non-finite component are left out; null ids stay, and
    repeated rows give repeated rows. With fewer vectors than ``clusters`` each starts one, an
    empty input gives an empty result. Ties go to the smaller cluster number. Other columns are
    not looked at. Scaled components beyond ``LARGEST`` raise an error.
    """
    rows, centroids = fitted(vectors, clusters, rounds, seed)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    sums = {row["cluster"]: row["s"] for row in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    known = [(number, sums[number], sum(sums.values()), digests[number]) for number in sums]
    facts = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per cluster.
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "computed", "cluster_inertia", "inertia", "centroid_sha256"
    )


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, scale: int = SCALE) -> str:
    """The same in SQL, one row per vector and component. Ids must be distinct."""

    def near(number: int) -> str:
        return f"""
apart{number} AS (
  SELECT e.vec_id, c.cluster, sum((e.x - c.x) * (e.x - c.x)) AS distance
  FROM e JOIN c{number} c ON e.i = c.i GROUP BY e.vec_id, c.cluster
), near{number} AS (
  SELECT vec_id, cluster, distance FROM apart{number}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1
)"""

    def move(number: int) -> str:
        return f"""
mean{number} AS (
  SELECT n.cluster, e.i, sum(e.x) AS total, count(*) AS number
  FROM near{number} n JOIN e ON n.vec_id = e.vec_id GROUP BY n.cluster, e.i
), c{number + 1} AS (
  SELECT c.cluster, c.i,
    CASE WHEN m.number IS NULL THEN c.x
    ELSE (m.total - ((m.total % m.number) + m.number) % m.number) // m.number END::BIGINT AS x
  FROM c{number} c LEFT JOIN mean{number} m ON c.cluster = m.cluster AND c.i = m.i
)"""

    steps = [step for number in range(rounds) for step in (near(number), move(number))]
    return f"""
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = {width}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), e AS (
  SELECT vec_id, i, floor({scale} * embedding[i]::DOUBLE)::BIGINT AS x
  FROM kept, range(1, {width + 1}) r(i)
), start AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster FROM kept
  QUALIFY cluster < {clusters}
), c0 AS (
  SELECT s.cluster, e.i, e.x FROM start s JOIN e ON s.vec_id = e.vec_id
), {",".join(steps)}, {near(rounds)}, digest AS (
  SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster
)
SELECT n.vec_id, n.cluster::INTEGER AS cluster, n.distance::BIGINT AS distance,
  sum(n.distance) OVER (PARTITION BY n.cluster)::BIGINT AS cluster_inertia,
  sum(n.distance) OVER ()::BIGINT AS inertia, d.centroid_sha256
FROM near{rounds} n JOIN digest d ON n.cluster = d.cluster
"""
