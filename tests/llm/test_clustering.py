"""Operator 11."""

import hashlib
import math
import random

import numpy as np
import pytest

from quantloom.llm import clustering, queries


def plain(vectors, clusters=8, rounds=10, scale=1024):
    """By the letter, in integers of Python: rows (id, vector) -> rows (id, cluster, distance), and centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept)
    centres = [list(v) for *_, v in order[:clusters]]
    square = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((square(v, c), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _i, v in kept:
            groups[near(v)[1]].append(v)
        centres = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centres


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    hubs = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(11)]
    out = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(hubs)]) for i in range(150)]
    out += [(1000 + i, out[7][1]) for i in range(20)]  # copies
    out += [(3, out[3][1]), (None, out[5][1]), (None, out[6][1]), (2000, None), (2001, []), (2002, [1.0] * 63), (2003, [float("nan")] + [0.0] * 63), (2004, [float("inf")] + [0.0] * 63), (2005, [None] + [0.0] * 63), (2006, [0.0] * 64), (2007, [-3.0] * 64)]
    return out


def test_query_against_plain_version(spark, vectors, tmp_path):
    spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_block_norms(spark, str(tmp_path)).collect()
    rows, centres = plain(vectors)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r["cluster"], r.distance) for r in got), key=key) == sorted(rows, key=key)
    own = {k: sum(d for _, c, d in rows if c == k) for k in range(8)}
    assert all(r.cluster_inertia == own[r["cluster"]] and r.inertia == sum(own.values()) and r.centroid_sha256 == clustering.centroid_digest(centres[r["cluster"]]) for r in got)


def test_few_or_no_vectors(spark, vectors):
    few = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.distance) for r in clustering.cluster_vectors(few).collect()) == [(0, 0), (1, 0), (2, 0)]
    none = clustering.with_inertia(clustering.cluster_vectors(few.limit(0)))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "exact", "centroid", "cluster_inertia", "inertia"]
    with pytest.raises(ValueError):
        clustering.cluster_vectors(few, block=7)


@pytest.mark.parametrize("size", [1, 500, 1 << 22])
def test_screening_changes_nothing(size):
    rng = np.random.default_rng(6)
    spread = np.exp(rng.normal(size=(9, 1)) * 2) * size
    hubs = (rng.normal(size=(9, 64)) * spread).astype(np.int64).clip(-clustering.LARGEST, clustering.LARGEST)
    x = (hubs[rng.integers(0, 9, 700)] + rng.integers(-size, size + 1, (700, 64))).clip(-clustering.LARGEST, clustering.LARGEST)
    hubs[8] = hubs[2]  # a tie for every vector of one
    label, best, needed = clustering.nearest(x, clustering.block_norms(x), hubs)
    d = ((x[:, None, :] - hubs[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (label == d.argmin(axis=1)).all()
    assert needed < 0.7 * d.size  # most centroids are told by their norms
    assert (clustering.lower_bounds(clustering.block_norms(x), clustering.block_norms(hubs)) <= d).all()


def test_huge_values_are_held(spark):
    df = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in clustering.cluster_vectors(df, clusters=1, rounds=0).collect()}
    assert sorted(r.distance for r in got.values()) == [0, 64 * (2 * clustering.LARGEST) ** 2]
    assert {r.inertia for r in clustering.with_inertia(clustering.cluster_vectors(df, clusters=1, rounds=0)).collect()} == {64 * (2 * clustering.LARGEST) ** 2}
