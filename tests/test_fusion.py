import random

import pytest
from pyspark.sql import functions as F

from gleaner.config import RetrievalConfig
from gleaner.operators import fusion

SCHEMA = "query_id string, chunk_id string, source string, text string, rank int, is_vector boolean"


def rows(vector, lexical, query="q", source=lambda t: t):
    out = [(query, f"v{i}", source(t), t, i + 1, True) for i, t in enumerate(vector)]
    return out + [(query, f"l{i}", source(t), t, i + 1, False) for i, t in enumerate(lexical)]


def fuse(spark, data):
    return fusion.reciprocal_rank_fusion(spark.createDataFrame(data, SCHEMA))


def test_scores(spark):
    got = {r.text: r.rrf for r in fuse(spark, rows("ABC", "CAD")).collect()}
    assert {t: round(s, 7) for t, s in got.items()} == {"A": 0.0325225, "C": 0.0322665, "B": 0.016129, "D": 0.015873}


def test_tie_prefers_the_vector_list(spark):
    assert [r.text for r in fuse(spark, rows("A", "B")).orderBy("position").collect()] == ["A", "B"]


def test_repeated_text_adds_up(spark):
    (r,) = fuse(spark, rows("", "AA")).collect()
    assert r.rrf == pytest.approx(1 / 61 + 1 / 62, abs=1e-9) and r.chunk_id == "l0"


def test_metadata_of_the_last_vector_row(spark):
    assert [r.chunk_id for r in fuse(spark, rows("AA", "A")).collect()] == ["v1"]


def loop_fusion(vector, lexical, source, cap, n):
    scores, meta = {}, {}
    for i, t in enumerate(vector):
        scores[t] = scores.get(t, 0) + 1 / (61 + i)
        meta[t] = f"v{i}"
    for i, t in enumerate(lexical):
        scores[t] = scores.get(t, 0) + 1 / (61 + i)
        meta.setdefault(t, f"l{i}")
    taken, out = {}, []
    for t in sorted(scores, key=lambda t: -round(scores[t], 10)):
        if taken.get(source(t), 0) < cap and len(out) < n:
            taken[source(t)] = taken.get(source(t), 0) + 1
            out.append((t, meta[t]))
    return out


def test_fusion_and_cap_equal_loop_on_random_lists(spark):
    rng = random.Random(3)
    data, expected = [], {}
    for q in range(60):
        pool = [f"t{i}" for i in range(rng.randint(1, 15))]
        vector = [rng.choice(pool) for _ in range(rng.randint(0, 20))]
        lexical = [rng.choice(pool) for _ in range(rng.randint(0, 20))]
        source = lambda t: f"s{int(t[1:]) % 3}"
        data += rows(vector, lexical, f"q{q}", source)
        expected[f"q{q}"] = loop_fusion(vector, lexical, source, 3, 10)
    got = {}
    for r in fusion.diverse_top(fuse(spark, data), F.lit(3), 10).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.text, r.chunk_id))
    assert got == {q: e for q, e in expected.items() if e}


def test_cap_is_off_with_sources(spark):
    df = spark.createDataFrame([(["a"],), (None,), ([],)], "s array<string>")
    got = [r[0] for r in df.select(fusion.cap_for(F.col("s"))).collect()]
    assert got == [10, 3, 3]
    assert RetrievalConfig().k_rerank == 10


def test_two_sources_leave_six(spark):
    data = rows([f"t{i}" for i in range(20)], [], source=lambda t: f"s{int(t[1:]) % 2}")
    assert fusion.diverse_top(fuse(spark, data), F.lit(3), 10).count() == 6


def test_rerank_is_stable(spark):
    data = [("q", "bleu rouge", t, p) for p, t in enumerate(["rien", "bleu", "rouge bleu", "rouge", "vert", "x"], 1)]
    df = spark.createDataFrame(data, "query_id string, question string, text string, position int")
    got = [(r.text, r.pair_score) for r in fusion.rerank(df, 5).orderBy("rank").collect()]
    assert got == [("rouge bleu", 1.0), ("bleu", 0.5), ("rouge", 0.5), ("rien", 0.0), ("vert", 0.0)]
