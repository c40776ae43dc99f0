"""BM25 lists without scoring every chunk that shares a word with a question.

Postings are dealt into blocks by a hash of the chunk. For each term and block two numbers bound any part the term can
have in a score there: the most occurrences in one chunk and the shortest chunk. A question's list is found in steps:

1. *Threshold.* The question's rarest terms are scored first, over few postings. A multiple of k chunks that are best by them
   get whole scores; the list reaches the k-th best of these at least.
2. *Terms put aside.* In each block, terms are put aside from the most frequent on, as long as their bounds add up to
   no more than a share of the threshold. A chunk that holds only such terms can't be in the list, so its postings are
   never joined. A block may have no other terms.
3. *Candidates.* Postings of the other terms give partial scores; a chunk stays if its partial score and the bounds of
   the terms put aside reach the threshold.
4. *Whole scores.* The terms put aside are looked up for the candidates only, the rarer of them first, and the
   candidates are cut again in between.

The lists are those of scoring everything: bounds never fall below a part, and the slack exceeds what rounding moves.
A question with fewer than k first chunks has no threshold and is scored whole. Terms of negative idf, which a tiny
corpus may have, are bounded by zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import DEFAULT, RetrievalConfig
from gleaner.functions.sizes import fits, hinted
from gleaner.operators import lexical
from gleaner.sources.scratch import materialize

#: Postings that the first terms of a question hold at least, as a multiple of k; more where it names its sources.
FIRST_POSTINGS, FIRST_POSTINGS_FILTERED = 20, 200
#: Chunks best by the first terms that get whole scores, as a multiple of k.
FIRST_CHUNKS = 6
#: Shares of the threshold that the bounds of terms put aside may reach while postings are joined, then while candidates
#: are cut for the second time.
SHARES = (0.9, 0.4)
#: More than rounding to six places and the order of a sum can move a score.
SLACK = 4e-6


def impact(tf: Column, dl: Column, avgdl: float, cfg: RetrievalConfig) -> Column:
    """The part of a score besides the term's weight; grows with ``tf`` and falls with ``dl``."""
    k1, b = cfg.bm25_k1, cfg.bm25_b
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(max(avgdl, 1e-9))))


@dataclass(frozen=True)
class Search:
    """``scored(query_id, chunk_id, score)`` holds every list's first k. ``candidates`` have partial scores from joined
    postings; ``first`` and ``last`` are the pairs that were scored whole."""

    scored: DataFrame
    first: DataFrame
    candidates: DataFrame
    last: DataFrame


def _known(term_table: DataFrame, asked: DataFrame, few: list[str] | None, small: bool) -> DataFrame:
    """The rows of a term table that any question asks for; a short list of terms reaches the Parquet reader."""
    if few is not None:
        return term_table.filter(F.col("term").isin(few))
    return term_table.join(hinted(asked, small), "term", "left_semi")


def _allowed(pairs: DataFrame, filtered: bool) -> DataFrame:
    if not filtered:
        return pairs
    return pairs.filter(F.col("sources").isNull() | F.array_contains("sources", F.col("source")))


def _asked(queries: DataFrame, index: lexical.LexicalIndex, cfg: RetrievalConfig) -> tuple[DataFrame, DataFrame, bool]:
    """``postings`` with their block, ``(query_id, sources, block, term, weight, df, ub)`` of each block that holds an
    asked term, and whether the questions' terms are small."""
    meta = ("source",) if "sources" in queries.columns else ()
    wanted = lexical.query_terms(lexical.with_sources(queries))
    small = fits(wanted, cfg.broadcast_bytes)
    asked = wanted.select("term").distinct()
    few = [r["term"] for r in asked.limit(lexical.PUSHED_TERMS + 1).collect()] if small else []
    few = few if small and len(few) <= lexical.PUSHED_TERMS else None
    if index.postings is None:
        # Used several times, so written once: the postings of the asked terms only.
        postings = materialize(lexical.postings_of(index.tokens, meta, asked, small), "asked-postings")
    else:
        postings = _known(index.postings, asked, few, small)
    bounds = lexical.block_bounds(postings) if index.bounds is None else _known(index.bounds, asked, few, small)
    weights = _known(index.terms, asked, few, small).select("term", "df", "idf").join(hinted(wanted, small), "term").select(
        "query_id", "sources", "term", "df", (F.col("qtf") * F.col("idf")).alias("weight"))
    most = F.col("weight") * impact(F.col("max_tf"), F.col("min_dl"), index.avgdl, cfg)
    blocks = hinted(weights, small).join(bounds.drop("df"), "term").select(
        "query_id", "sources", "block", "term", "weight", "df", F.greatest(most, F.lit(0.0)).alias("ub"))
    return postings.withColumn("block", lexical.block_of(F.col("chunk_id"))), materialize(blocks, "bounds"), small


def search(queries: DataFrame, index: lexical.LexicalIndex, k: int, cfg: RetrievalConfig = DEFAULT) -> Search:
    """Tables written on the way are small, and Spark knows their sizes: it broadcasts them only below its own limit."""
    filtered = "sources" in queries.columns
    postings, blocks, small = _asked(queries, index, cfg)
    part = F.col("weight") * impact(F.col("tf"), F.col("dl"), index.avgdl, cfg)
    found = postings.select("chunk_id", "term", "tf", "dl")

    def looked_up(pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """``(query_id, chunk_id, score)``: parts of ``terms(query_id, block, term, weight)`` for given pairs."""
        # Pairs are few beside the postings, which would all be exchanged and sorted for them.
        missing = pairs.select("query_id", "chunk_id", "block").join(terms, ["query_id", "block"]).drop("block")
        missing = materialize(missing, "missing")
        missing = hinted(missing, fits(missing, cfg.broadcast_bytes))
        return found.join(missing, ["chunk_id", "term"]).select("query_id", "chunk_id", part.alias("score"))

    # 1. The rarest terms of a question, and the whole scores of the chunks that are best by them.
    terms = blocks.groupBy("query_id", "sources", "term", "weight", "df").agg(F.max("ub").alias("ub"))
    rarest = Window.partitionBy("query_id").orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    enough = F.when(F.col("sources").isNull(), FIRST_POSTINGS * k).otherwise(FIRST_POSTINGS_FILTERED * k)
    chosen = terms.withColumn("before", before).filter(F.col("before") < enough).select("query_id", "sources", "term", "weight")
    first = _allowed(postings.join(hinted(chosen, small), "term"), filtered).groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    first = lexical.top_k(first, FIRST_CHUNKS * k).select("query_id", "chunk_id", lexical.block_of(F.col("chunk_id")).alias("block"))
    whole = looked_up(first, blocks.select("query_id", "block", "term", "weight")).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))
    reached = lexical.top_k(whole, k).groupBy("query_id").agg((F.min("score") - SLACK).alias("least"), F.count(F.lit(1)).alias("n"))
    least = reached.filter(F.col("n") == k).select("query_id", "least")

    # 2. Level 0: joined; 1 and 2: put aside, the bounds of 2 adding up to the smaller share.
    most_frequent = Window.partitionBy("query_id", "block").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    levelled = blocks.join(hinted(least, small), "query_id", "left").withColumn("summed", F.sum("ub").over(most_frequent))
    within = [F.coalesce(F.col("summed") <= share * F.col("least"), F.lit(False)) for share in SHARES]
    levelled = levelled.withColumn("level", within[0].cast("int") + within[1].cast("int"))
    of_block = Window.partitionBy("query_id", "block")
    rests = {f"rest{i}": F.coalesce(F.max(F.when(F.col("level") > i, F.col("summed"))).over(of_block), F.lit(0.0)) for i in (0, 1)}
    levelled = materialize(levelled.withColumns(rests).drop("summed", "ub", "df"), "levels")
    aside = {i: levelled.filter(F.col("level") == i).select("query_id", "block", "term", "weight") for i in (1, 2)}

    # 3. and 4.
    pairs = _allowed(postings.join(levelled.filter("level = 0").drop("level"), ["term", "block"]), filtered)
    partial = pairs.groupBy("query_id", "chunk_id", "block", "least", "rest0", "rest1").agg(F.sum(part).alias("score"))

    def kept(pairs: DataFrame, rest: str) -> DataFrame:
        return pairs.filter(F.col("least").isNull() | (F.col("score") + F.col(rest) >= F.col("least")))

    candidates = materialize(kept(partial, "rest0"), "candidates")
    added = looked_up(candidates, aside[1]).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("more"))
    again = candidates.join(added, ["query_id", "chunk_id"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    last = materialize(kept(again, "rest1").select("query_id", "chunk_id", "block", "score"), "candidates")
    scored = last.select("query_id", "chunk_id", "score").unionByName(looked_up(last, aside[2])).groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("score"), cfg.score_places).alias("score"))
    return Search(scored, first, candidates, last)


def joined_postings(queries: DataFrame, index: lexical.LexicalIndex, cfg: RetrievalConfig = DEFAULT) -> int:
    """How many (question, posting) pairs scoring everything would join."""
    wanted = lexical.query_terms(lexical.with_sources(queries)).select("query_id", "term")
    return index.terms.join(wanted, "term").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]


def bm25_top_k(queries: DataFrame, index: lexical.LexicalIndex, k: int | None = None,
               cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """``(query_id, chunk_id, rank, score)``. With ``cfg.fill_zero``, chunks without any common term
    fill the list up in id order.

    Up to ``cfg.direct_pairs`` pairs of a question and a posting are scored outright, which takes fewer steps; the lists
    are the same either way."""
    k = k or cfg.k_retrieve
    if joined_postings(queries, index, cfg) <= cfg.direct_pairs:
        scored = lexical.bm25_scores(queries, index, cfg)
    else:
        scored = search(queries, index, k, cfg).scored
    best = lexical.top_k(scored, k).select("query_id", "chunk_id", "rank", "score")
    if not cfg.fill_zero:
        return best
    best = materialize(best, "ranked")
    fill = lexical.zero_fill(queries, best, index.tokens, k)
    if fill is None:
        return best
    both = best.select("query_id", "chunk_id", "score").unionByName(fill)
    return lexical.top_k(both, k).select("query_id", "chunk_id", "rank", "score")
