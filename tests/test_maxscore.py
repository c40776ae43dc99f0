import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.config import RetrievalConfig
from gleaner.operators import lexical, maxscore
from gleaner.plans import registered

SF = "/root/testdata/sf0.1"


def lists(ranked):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in ranked.collect())


def whole(queries, index, k, cfg):
    """Every chunk that shares a term, scored."""
    return lists(lexical.top_k(lexical.bm25_scores(queries, index, cfg), k))


def words(rng, n):
    """Frequent and rare words, as in texts."""
    return " ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.3, n))


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"s{i % 4}", words(rng, int(rng.integers(1, 60)))) for i in range(700)]
    rows += [(1000 + i, "copies", "w1 w2 w3 w77 w78") for i in range(200)]
    rows += [(2000, None, None), (2001, "s1", ""), (2002, "s2", "w5 " * 3000)]
    return spark.createDataFrame(rows, "chunk_id long, source string, text string").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, words(rng, int(rng.integers(1, 12))), ["s1", "copies"] if i % 3 == 0 else None) for i in range(40)]
    rows += [(100, "w77 w78", None), (101, "unknown", None), (102, "", ["s1"]), (103, None, None), (104, "w399 w398 w1", ["nowhere"])]
    return spark.createDataFrame(rows, "query_id long, question string, sources array<string>")


@pytest.mark.parametrize(("k", "limit"), [(1, 10**8), (20, 0)])
def test_lists_equal_scoring_everything(chunks, queries, k, limit):
    cfg = RetrievalConfig(broadcast_bytes=limit, fill_zero=False, direct_pairs=0)
    index = lexical.build_index(chunks, cfg)
    assert lists(maxscore.bm25_top_k(queries, index, k, cfg)) == whole(queries, index, k, cfg)
    anywhere = queries.drop("sources").filter("query_id % 4 = 0")
    assert lists(maxscore.bm25_top_k(anywhere, index, k, cfg)) == whole(anywhere, index, k, cfg)


def test_stored_bounds_give_the_same(spark, chunks, queries, tmp_path):
    cfg = RetrievalConfig(fill_zero=False, direct_pairs=0)
    lexical.save_index(lexical.build_index(chunks), str(tmp_path))
    index = lexical.load_index(spark, str(tmp_path))
    assert index.bounds.count() > 400
    assert lists(maxscore.bm25_top_k(queries, index, 20, cfg)) == whole(queries, index, 20, cfg)


def test_negative_idf(spark, queries):
    """In a corpus of one word every idf is negative."""
    rows = [(i, "s1", "w1 " * (1 + i % 5)) for i in range(40)] + [(50, "s1", "w1 w77")]
    chunks = spark.createDataFrame(rows, "chunk_id long, source string, text string")
    cfg = RetrievalConfig(fill_zero=False, direct_pairs=0)
    index = lexical.build_index(chunks)
    assert index.terms.filter("idf < 0").count() == 1
    assert lists(maxscore.bm25_top_k(queries, index, 5, cfg)) == whole(queries, index, 5, cfg)


def test_empty_tables(spark, chunks, queries):
    none, cfg = spark.createDataFrame([], chunks.schema), RetrievalConfig(direct_pairs=-1)
    assert maxscore.bm25_top_k(queries, lexical.build_index(none), cfg=cfg).count() == 0
    assert maxscore.bm25_top_k(queries.limit(0), lexical.build_index(chunks), cfg=cfg).count() == 0


def test_fewer_than_a_tenth_of_the_pairs_are_scored(spark):
    asked, index = registered.questions(spark, SF), lexical.build_index(registered.documents(spark, SF))
    cfg = RetrievalConfig(fill_zero=False, direct_pairs=0)
    every = lexical.bm25_scores(asked, index, cfg)
    found = maxscore.search(asked, index, 20, cfg)
    n_every = every.count()
    n_whole = found.first.count() + found.last.count()
    print("pairs", n_every, found.candidates.count(), n_whole)
    assert n_whole * 10 < n_every
    assert lists(lexical.top_k(found.scored, 20)) == lists(lexical.top_k(every, 20))


def test_short_lists_only_are_filled(chunks, queries):
    index = lexical.build_index(chunks)
    full = queries.filter("query_id = 100").drop("sources")
    best = maxscore.bm25_top_k(full, index, 20, RetrievalConfig(fill_zero=False))
    assert lexical.zero_fill(full, best, index.tokens, 20) is None
    filled = maxscore.bm25_top_k(queries, index, 20, RetrievalConfig(direct_pairs=0))
    counts = {r.query_id: r["count"] for r in filled.groupBy("query_id").count().collect()}
    assert counts == {r.query_id: 20 for r in queries.collect() if r.query_id != 104}
    assert filled.filter(F.col("query_id") == 101).agg(F.max("score")).first()[0] == 0
