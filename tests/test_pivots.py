import numpy as np
import pytest

from gleaner.config import RetrievalConfig
from gleaner.operators import vectors


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return out


def brute(qs, vs, k):
    out = {}
    for qid, sources, q in qs:
        scored = []
        for cid, source, v in vs:
            if any(v) and (sources is None or source in sources):
                scored.append((-round(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 6), cid))
        if scored:
            out[qid] = [(c, -s) for s, c in sorted(scored)[:k]]
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(30, 16))
    points = middle[rng.integers(0, 30, 4000)] + 0.05 * rng.normal(size=(4000, 16))
    vs = [(i, f"s{i % 5}", p.round(3).tolist()) for i, p in enumerate(points)]
    vs += [(9000 + i, "copies", middle[0].round(3).tolist()) for i in range(300)] + [(9900, "s1", [0.0] * 16), (9901, None, [1.0] * 16)]
    qs = [(i, ["s1", "copies"] if i % 4 == 0 else None, (middle[i % 30] + 0.05 * rng.normal(size=16)).tolist()) for i in range(40)]
    return qs + [(100, ["nowhere"], [1.0] * 16), (101, [], [1.0] * 16)], vs


@pytest.mark.parametrize("block", [16, 4096])
def test_lists_equal_brute_force_and_pairs_are_skipped(spark, clustered, block):
    qs, vs = clustered
    queries = spark.createDataFrame(qs, "query_id long, sources array<string>, vector array<double>")
    table = spark.createDataFrame(vs, "chunk_id long, source string, vector array<double>").repartition(4)
    if block > len(qs):
        table = vectors.pivoted(table)
    found, skipped = vectors.nearest_with_share(queries, table, 20, RetrievalConfig(query_block=block))
    want = brute([(q, s or None, v) for q, s, v in qs], vs, 20)
    got = lists(found)
    assert {q: [c for c, _ in rows] for q, rows in got.items()} == {q: [c for c, _ in rows] for q, rows in want.items()}
    assert all(abs(a - b) < 2e-6 for q in want for (_, a), (_, b) in zip(got[q], want[q], strict=True))
    print("skipped", skipped)
    assert skipped > 0.5


def test_no_vectors_and_no_direction(spark):
    schema = "chunk_id long, source string, vector array<double>"
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, vector array<double>")
    for rows in ([], [(1, "a", [0.0, 0.0])], [(1, "a", None)]):
        table = vectors.pivoted(spark.createDataFrame(rows, schema))
        assert vectors.nearest(queries, table).count() == 0
    one = vectors.pivoted(spark.createDataFrame([(7, "a", [2.0, 0.0]), (8, None, [0.0, 3.0])], schema))
    assert lists(vectors.nearest(queries, one)) == {1: [(7, 1.0), (8, 0.0)]}
