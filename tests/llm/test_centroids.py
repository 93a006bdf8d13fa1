"""Clustering held against a plain version in Python integers over all pairs."""

import hashlib
import math

import numpy as np
import pytest
from llm_helpers import SF_SMALL

from chunkwise.llm import centroids, queries


def plain_clusters(rows, k=40, rounds=5, dims=64):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(256 * float(x)) for x in v]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"2:{r[0]}"), r[1]))[:k]
    means = [v for _, v in first]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, m)) for m in means]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        placed = assign()
        for c in range(len(means)):
            own = [v for (_, v), (p, _) in zip(kept, placed) if p == c]
            if own:
                means[c] = [sum(col) // len(own) for col in zip(*own)]
    placed = assign()
    inertia = [sum(d for p, d in placed if p == c) for c in range(len(means))]
    return [(i, c, d, inertia[c], sum(inertia), sha(",".join(map(str, means[c])))) for (i, _), (c, d) in zip(kept, placed)]


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def as_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2), (5, 1)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = centroids.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(side**dims))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    rnd = np.random.default_rng(5)
    dropped = 0
    for _ in range(60):
        means = rnd.integers(-40, 40, (12, 4))
        v = rnd.integers(-3, 4, (20, 4)) + rnd.integers(-40, 40, 4)
        possible = centroids.candidates(v.min(axis=0)[None], v.max(axis=0)[None], means)[0]
        d = ((v[:, None] - means[None]) ** 2).sum(axis=2)
        assert possible[d.argmin(axis=1)].all()
        assert possible[np.unique(np.where(d == d.min(axis=1)[:, None])[1])].all()  # ties stay as well
        dropped += (~possible).sum()
    assert dropped > 300


@pytest.mark.parametrize("high", [50, 1 << 26])
def test_nearest_is_exact(high):
    rnd = np.random.default_rng(1)
    v, means = rnd.integers(-high, high, (30, 64)), rnd.integers(-high, high, (9, 64))
    best, d = centroids.nearest(v, means)
    for x, b, got in zip(v.tolist(), best, d):
        all_d = [sum((p - q) ** 2 for p, q in zip(x, m)) for m in means.tolist()]
        assert (all_d.index(min(all_d)), min(all_d)) == (b, got)


def test_query_equals_plain_version(spark):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, SF_SMALL, "embeddings").collect()]
    assert as_rows(queries.op12_centroid_clusters(spark, SF_SMALL)) == sorted(plain_clusters(rows), key=repr)


def write(spark, rows, path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, v string, distance string").write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def test_query_on_edges(spark, tmp_path):
    rnd = np.random.default_rng(3)
    some = rnd.normal(size=(70, 64)).astype("float32").tolist()
    vectors = [(i, v) for i, v in enumerate(some)] + [(5, some[9]), (5, some[9]), (None, some[3])]
    vectors += [(100 + i, some[0]) for i in range(30)]  # copies
    vectors += [(200, None), (201, some[1][:63]), (202, some[1] + [0.0]), (203, [None, *some[1][1:]]), (204, [float("nan"), *some[1][1:]]),
                (205, [float("inf"), *some[1][1:]]), (206, [])]
    got = as_rows(queries.op12_centroid_clusters(spark, write(spark, [(*v, "x", "y", "z") for v in vectors], tmp_path / "a")))
    assert got == sorted(plain_clusters(vectors), key=repr)
    few = [(i, v, "x", "y", "z") for i, v in enumerate(some[:7])]
    got = as_rows(queries.op12_centroid_clusters(spark, write(spark, few, tmp_path / "b")))
    assert got == sorted(plain_clusters([r[:2] for r in few]), key=repr) and {r[2] for r in got} == {0}
    assert queries.op12_centroid_clusters(spark, write(spark, [], tmp_path / "c")).count() == 0


def test_zone_maps_leave_out_centroids(spark):
    rnd = np.random.default_rng(2)
    middles = rnd.normal(size=(10, 64)) * 3
    rows = [(i, (middles[i % 10] + rnd.normal(size=64) * 0.2).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assigned, _ = centroids.cluster_vectors(df, k=40)
    assert assigned.agg({"candidates": "avg"}).first()[0] < 20
