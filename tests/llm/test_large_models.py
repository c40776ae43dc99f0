import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_models import model_by_hand

from gleaner.llm import elias_fano, ngram_lm
from gleaner.llm.common import fold
from gleaner.llm.queries import op2_elias_fano_lm


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("n_tokens", [1 << 34, 1 << 45])
def test_unseen_words_of_a_large_corpus_have_a_score(order, n_tokens):
    block, n_words = ngram_lm.Block(["unheard of", "the unheard", ""], order), 1 << 31
    totals = [np.zeros(keys.size, np.uint64) for keys in block.keys]
    totals[0][block.at[0][3]] = 5  # "the"
    trie = ngram_lm.open_trie(ngram_lm.build_trie(block, totals, n_tokens, n_words), order)
    got = ngram_lm.text_scores(block, trie, totals)
    wanted = np.bincount(block.document, weights=np.log10((totals[0][block.at[0]] + 1.0) / (n_tokens + n_words + 1.0)))
    if order > 1:  # the context "the" was seen five times, never before "unheard"
        wanted[1] += np.log10(np.mean([1 - w * 5 / (5 + ngram_lm.DAMPING) for w in ngram_lm.WEIGHTS]))
    assert np.isfinite(got).all() and np.allclose(got, wanted, rtol=1e-4)


def test_small_probabilities_are_not_zero():
    p = np.array([2.0 ** -24, 6e-8, 5e-8, 2.0 ** -33, 3.1e-14, 2.0 ** -45, 2.0 ** -63.9, 2.0 ** -80])
    back = elias_fano.probability(elias_fano.quantised(p))
    assert np.allclose(back[:-1], p[:-1], rtol=9e-4) and (back > 0).all()
    assert elias_fano.probability(elias_fano.quantised(np.zeros(1)))[0] == 0
    assert (np.diff(elias_fano.probability(np.arange(elias_fano.ZERO + 1))) < 0).all()


def test_the_query_scores_with_trigrams(spark, docs_001):
    rows = [(r.doc_id, r.text) for r in docs_001.select("doc_id", "text").collect()]
    assert all(doc_id is not None for doc_id, _ in rows)
    wanted = {doc_id: x[4] for (doc_id, _), x in zip(rows, model_by_hand(rows, 3), strict=True)}
    got = op2_elias_fano_lm(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows) == len(wanted)
    assert all(math.isclose(r.score, wanted[r.doc_id], rel_tol=1e-3) for r in got)


def test_blocks_cross_no_shuffle_and_ask_only_for_shared_words(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 40)  # several blocks, some of held-out texts alone
    texts = ["a b c a b c", "A B C a b d", None, "", "own words of this text", "a b c own", "own words of this block", "z y x"] * 3
    rows = [(i if i % 9 else None, text) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    train = F.coalesce(fold(F.col("doc_id"), 7) != 2, F.lit(True))
    found = ngram_lm.scored(docs, train, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in found.collect())
    wanted = sorted((i is None, i or 0, x[0], x[1], x[3], x[4]) for (i, _), x in zip(rows, model_by_hand(rows, 3), strict=True))
    assert len(got) == len(wanted) and all(np.allclose(g, w, rtol=1e-3) for g, w in zip(got, wanted, strict=True))


def test_ngrams_of_a_blocks_own_words_are_settled():
    block = ngram_lm.Block(["a b rare c", "c d"], 3)
    shared = block.keys[0] != ngram_lm.Keys()[b"rare"]
    asked = [[block.at[level].tolist().index(g) for g in np.flatnonzero(there)] for level, there in enumerate(ngram_lm.unsettled(block, shared), 1)]
    # tokens: a b rare c END c d END
    assert [sorted(a) for a in asked] == [[0, 1, 4, 5, 6, 7], [0, 1, 5, 6, 7]]


def test_a_key_is_asked_for_in_about_six_bytes():
    draw = np.random.default_rng(1)
    keys = [np.unique(draw.integers(0, 1 << 64, 300_000, dtype=np.uint64)) for _ in range(2)]
    counts = [np.ones(k.size, np.uint32) for k in keys]
    asked = ngram_lm.ask(7, keys, counts, 5)
    assert asked.num_rows == 32 and asked.nbytes < 6.1 * sum(k.size for k in keys)
    back = [[], []]
    for row in asked.to_pylist():
        at = 0
        for level in back:
            part, at = elias_fano.unpack_sequence(row["keys"], at)
            level.append(part + (np.uint64(row["shard"]) << np.uint64(59)))
    assert all((np.concatenate(b) == k).all() for b, k in zip(back, keys, strict=True))
