import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.config import RetrievalConfig
from gleaner.operators import lexical, maxscore, vectors

TEXTS = [
    (1, "a.txt", "Le stage dure quatre mois"),
    (2, "a.txt", "Le tutorat dure un an et le stage"),
    (3, "b.txt", "Le stage stage stage facultatif"),
    (4, "b.txt", "Programme des cours"),
    (5, "c.txt", "!"),
]


def corpus(spark):
    return spark.createDataFrame(TEXTS, "chunk_id long, source string, text string")


def loop_bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = {i: lexical_tokens(t) for i, _, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(t for ts in toks.values() for t in set(ts))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = eps * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    out = {}
    for i, ts in toks.items():
        tf = Counter(ts)
        s = sum(idf[q] * tf[q] * (k1 + 1) / (tf[q] + k1 * (1 - b + b * len(ts) / avg)) for q in lexical_tokens(query) if tf[q])
        if any(tf[q] for q in lexical_tokens(query)):
            out[i] = round(s, 6)
    return out


def lexical_tokens(t):
    return [w for w in t.lower().replace("!", "").split() if len(w) > 1]


QUERY = "le stage dure dure"


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(
        [("q1", QUERY, None), ("q2", "stage facultatif", ["b.txt"]), ("q3", "inconnu", None)],
        "query_id string, question string, sources array<string>",
    )


@pytest.fixture(scope="module")
def expected():
    return {
        "q1": loop_bm25(TEXTS, QUERY),
        "q2": {i: s for i, s in loop_bm25(TEXTS, "stage facultatif").items() if i in (3, 4)},
    }


def as_dict(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.chunk_id] = r.score
    return out


def test_scores_equal_loop(spark, queries, expected):
    assert as_dict(lexical.bm25_scores(queries, lexical.build_index(corpus(spark)))) == expected


def test_floor_of_frequent_terms(spark):
    terms = {r.term: r for r in lexical.build_index(corpus(spark)).terms.collect()}
    raw = [math.log(5 - r.df + 0.5) - math.log(r.df + 0.5) for r in terms.values()]
    assert terms["stage"].df == 3 and terms["stage"].idf == pytest.approx(0.25 * sum(raw) / len(raw))


@pytest.mark.parametrize("hot", [1, 2, 10])
def test_shuffled_and_salted_join_gives_the_same(spark, queries, expected, hot):
    cfg = RetrievalConfig(broadcast_bytes=0, hot_term_postings=hot)
    index = lexical.build_index(corpus(spark), cfg)
    assert as_dict(lexical.bm25_scores(queries, index, cfg)) == expected


def test_small_partition_target(spark, queries, expected):
    cfg = RetrievalConfig(partition_bytes=16)
    index = lexical.build_index(corpus(spark), cfg)
    assert index.tokens.rdd.getNumPartitions() > 4
    assert as_dict(lexical.bm25_scores(queries, index, cfg)) == expected


@pytest.mark.parametrize("limit", [0, 10**7])
def test_stored_index_gives_the_same(spark, queries, expected, tmp_path, limit):
    path = str(tmp_path / "index")
    lexical.save_index(lexical.build_index(corpus(spark)), path)
    cfg = RetrievalConfig(broadcast_bytes=limit, hot_term_postings=2)
    assert as_dict(lexical.bm25_scores(queries, lexical.load_index(spark, path), cfg)) == expected


def test_a_third_of_copies(spark):
    """Copies tie on the score, are cut by id and change nothing for the other chunks."""
    rows = [(i, "hot", "le stage dure quatre mois") for i in range(100)]
    rows += [(1000 + i, f"s{i}", f"le cours numero{i} dure un an") for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source string, text string").repartition(7)
    asked = spark.createDataFrame([("a", "stage"), ("b", "numero7")], "query_id string, question string")
    for cfg in (RetrievalConfig(), RetrievalConfig(broadcast_bytes=0, hot_term_postings=10)):
        got = maxscore.bm25_top_k(asked, lexical.build_index(chunks, cfg), cfg=cfg).orderBy("query_id", "rank").collect()
        # the second question matches one chunk; the first chunks by id fill its list
        assert [r.chunk_id for r in got] == [*range(20), 1007, *range(19)]
        assert len({r.score for r in got if r.query_id == "a"}) == 1


def test_few_terms_are_pushed_into_the_scan_of_stored_postings(spark, tmp_path):
    path = str(tmp_path / "index")
    lexical.save_index(lexical.build_index(corpus(spark)), path)
    one = spark.createDataFrame([("q", "tutorat cours")], "query_id string, question string")
    scores = lexical.bm25_scores(one, lexical.load_index(spark, path))
    assert "PushedFilters: [In(term, [cours,tutorat])" in scores._jdf.queryExecution().executedPlan().toString()
    assert as_dict(scores)["q"].keys() == {2, 4}


def test_top_k_breaks_ties_by_id(spark):
    rows = [("q", i, 1.0) for i in range(10)] + [("q", 10, 2.0)]
    got = lexical.top_k(spark.createDataFrame(rows, "query_id string, chunk_id int, score double"), 3)
    assert [(r.chunk_id, r.rank) for r in got.orderBy("rank").collect()] == [(10, 1), (0, 2), (1, 3)]


def test_scoring_shuffles_the_corpus_once(spark, queries):
    index = lexical.build_index(corpus(spark))
    plan = lexical.top_k(lexical.bm25_scores(queries, index), 20)._jdf.queryExecution().executedPlan().toString()
    on_chunk = [line for line in plan.splitlines() if "Exchange hashpartitioning(chunk_id" in line]
    assert len(on_chunk) == 1


def brute_nearest(qs, vs, k):
    out = {}
    for qid, sources, q in qs:
        scored = []
        for cid, source, v in vs:
            if sources is None or source in sources:
                scored.append((-round(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 6), cid))
        out[qid] = [c for _, c in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("block", [2, 4096])
@pytest.mark.parametrize("parts", [1, 5])
def test_nearest_equals_brute_force(spark, block, parts):
    rng = np.random.default_rng(7)
    vs = [(i, f"s{i % 3}", rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(300)]
    vs = [v for v in vs if any(v[2])] + [(1000 + i, "copy", [1.0, 1.0, 0.0, 0.0]) for i in range(150)]
    qs = [(f"q{i}", ["s1", "copy"] if i % 2 else None, rng.normal(size=4).tolist()) for i in range(7)]
    queries = spark.createDataFrame(qs, "query_id string, sources array<string>, vector array<double>")
    found = spark.createDataFrame(vs, "chunk_id long, source string, vector array<double>").repartition(parts)
    got = vectors.nearest(queries, found, 20, RetrievalConfig(query_block=block))
    lists = {}
    for r in got.orderBy("query_id", "rank").collect():
        lists.setdefault(r.query_id, []).append(r.chunk_id)
    assert lists == brute_nearest(qs, vs, 20)


def test_nearest_without_queries(spark):
    found = spark.createDataFrame([(1, "a", [1.0])], "chunk_id long, source string, vector array<double>")
    queries = spark.createDataFrame([], "query_id string, vector array<double>")
    assert vectors.nearest(queries, found).collect() == []


def test_dimension_check(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "chunk_id long, vector array<double>")
    assert vectors.checked_dimension(df, 2).count() == 1
    with pytest.raises(Exception, match="vector dimension: expected 3, found 2"):
        vectors.checked_dimension(df, 3).collect()


def test_hashed_vectors_have_unit_length(spark):
    index = lexical.build_index(corpus(spark))
    rows = vectors.hashed_vectors(index.tokens, ["chunk_id"], 16).collect()
    assert {r.chunk_id for r in rows} == {1, 2, 3, 4}
    assert all(len(r.vector) == 16 and abs(sum(x * x for x in r.vector) - 1) < 1e-12 for r in rows)


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_query_ids_of_any_type(spark, kind):
    queries = spark.range(3).select(F.col("id").cast(kind).alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    found = spark.range(9).select("id", F.lit("s").alias("source"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    got = vectors.nearest(queries, found.withColumnRenamed("id", "chunk_id"), 2)
    assert got.count() == 6 and got.schema["query_id"].dataType == queries.schema["query_id"].dataType
