import hashlib

import numpy as np
import pytest

from gleaner.llm import centroids


def brute(rows, k=40, rounds=5, dim=64):
    """Plain rounds over all centroids in Python's integers."""
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == dim and all(x is not None and np.isfinite(x) for x in vector):
            kept.append((vec_id, [int(np.floor(256 * float(x))) for x in vector]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(p) for _, p in order[:k]]

    def assign():
        out = []
        for _, p in kept:
            d = [sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centres)):
            own = [p for (_, p), (cluster, _) in zip(kept, found, strict=True) if cluster == c]
            if own:
                centres[c] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = assign()
    total = sum(d for _, d in found)
    hexes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(
        (str(v), c, d, sum(e for b, e in found if b == c), total, hexes[c]) for (v, _), (c, d) in zip(kept, found, strict=True))


def run(spark, rows, **settings):
    frame = spark.createDataFrame(
        [(v, None if e is None else list(e), 1, "x", 2) for v, e in rows], "vec_id long, embedding array<float>, cluster int, point string, n int")
    found = centroids.with_inertia(*centroids.clustered(frame.repartition(3), **settings))
    return sorted((str(r[0]), *r[1:]) for r in found.collect())


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(9, 64))
    raw = middle[rng.integers(0, 9, 240)] + 0.4 * rng.normal(size=(240, 64))
    rows = [(i, (r / np.linalg.norm(r)).astype(np.float32).tolist()) for i, r in enumerate(raw)]
    odd = [(500, None), (501, []), (502, [0.5] * 63), (503, [0.5] * 65), (504, [None] + [0.1] * 63),
           (505, [float("nan")] + [0.1] * 63), (506, [float("inf")] * 64), (None, [0.25] * 64), (None, [0.125] * 64), (7, rows[7][1])]
    return rows + odd + [(900 + i, [0.0625] * 64) for i in range(80)]


def test_rows_equal_plain_rounds(spark, vectors):
    assert run(spark, vectors) == brute(vectors)


def test_few_and_equal_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(50)]
    assert run(spark, same) == brute(same)
    few = [(i, [i / 8] * 32 + [-i / 4] * 32) for i in range(5)]
    assert run(spark, few) == brute(few)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [1.0])]) == []


def test_components_out_of_range_are_an_error(spark):
    with pytest.raises(Exception, match="component out of range"):
        run(spark, [(1, [1e30] * 64)])


def test_bounds_hold_and_filter(vectors):
    rng = np.random.default_rng(3)
    points = rng.integers(-300, 300, (400, 64))
    points[:200] = points[0] + rng.integers(-20, 20, (200, 64))
    simplex = centroids.spanned(points[:40], 12)
    apexes = simplex.apexes(points)
    true = centroids.squared(points, points).astype(float)
    lower = ((apexes[:, None] - apexes[None]) ** 2).sum(axis=2)
    upper = lower + 4 * np.outer(apexes[:, -1], apexes[:, -1])
    slack = centroids.SLACK * lower.max()
    assert (lower <= true + slack).all() and (true <= upper + slack).all()
    cluster, distance, compared = centroids.nearest(points, apexes, points[190:230], simplex.apexes(points[190:230]))
    exact = centroids.squared(points, points[190:230])
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert compared < exact.size
