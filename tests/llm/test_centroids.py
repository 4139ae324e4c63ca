import hashlib

import numpy as np
import pytest

from spelltally.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, v string"


def plain(vectors, clusters, rounds, seed):
    """Lloyd's rounds with every distance computed, in Python's whole numbers."""
    kept = [
        (i, [int(np.floor(64 * float(x))) for x in e])
        for i, e in vectors
        if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)
    ]
    hashed = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in hashed[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for n, own in members.items():
            centres[n] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    of_cluster = {}
    for _, d, n in found:
        of_cluster[n] = of_cluster.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(
        ((-1 if i is None else i, n, d, of_cluster[n], sum(of_cluster.values()), digest[n]) for i, d, n in found), key=str
    )


def rows_of(frame):
    rows = frame.drop("computed").collect()
    return sorted(((-1 if r[0] is None else r[0], *r[1:]) for r in rows), key=str)


def blobs(number, centres, spread, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 64))
    return [(i, (middle[i % centres] + spread * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(number)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_rounds_against_plain_ones(spark, spread):
    vectors = blobs(400, 7, spread)
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    made = centroids.clustered(frame, clusters=9, rounds=3, seed=4)
    assert rows_of(made) == plain(vectors, 9, 3, 4)


def test_few_distances_where_clusters_lie_apart(spark):
    frame = spark.createDataFrame(blobs(2000, 7, 0.02), "vec_id long, embedding array<float>")
    computed = [row["computed"] for row in centroids.clustered(frame, clusters=16).collect()]
    assert min(computed) >= 1 and np.mean(computed) < 8


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(3)
    for scale in (3, 1 << 12, 1 << 24):
        v, c = (rng.integers(-scale, scale, size=(n, 64)) for n in (200, 6))
        pivots = rng.integers(-scale, scale, size=(4, 64))
        to, between = (np.stack([centroids.squared(x, p) for p in pivots], axis=1) for x in (v, c))
        bounds = centroids.lower_bounds(np.sqrt(to), np.sqrt(between))
        exact = np.stack([centroids.squared(v, x) for x in c], axis=1)
        assert (bounds <= np.sqrt(exact)).all()
        label, best, _ = centroids.nearest(v, to, c, pivots)
        assert (label == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()


def test_odd_vectors(spark):
    good = [0.5] * 64
    vectors = [
        (1, good), (1, good), (2, None), (3, []), (4, good[:63]), (5, good[:-1] + [None]), (6, good[:-1] + [float("nan")]),
        (7, good[:-1] + [float("-inf")]), (None, [-0.01] * 64), (9, good + [0.5]), (2**53 + 1, [-3.0] * 64), (11, [0.25] * 64),
    ]
    frame = spark.createDataFrame([(*v, "x", None, "z") for v in vectors], SCHEMA)
    made = centroids.clustered(frame, clusters=3)
    assert rows_of(made) == plain(vectors, 3, 3, 1)
    assert 2**53 + 1 in [row["vec_id"] for row in made.collect()]
    assert rows_of(centroids.clustered(frame, clusters=50)) == plain(vectors, 50, 3, 1)


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None, "x", "y", "z")], SCHEMA)
    for none in (frame, frame.limit(0)):
        made = centroids.clustered(none)
        assert made.count() == 0
        assert made.columns == ["vec_id", "cluster", "distance", "computed", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_too_large(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="must lie within"):
        centroids.clustered(frame)
