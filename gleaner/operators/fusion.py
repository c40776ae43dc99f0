"""Fusion of two ranked lists, diversity cap, pair reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import DEFAULT, RetrievalConfig
from gleaner.functions.text import or_unknown, tokenize
from gleaner.operators.models import Step, rule


def both_lists(vector_ranked: DataFrame, lexical_ranked: DataFrame) -> DataFrame:
    """The two ranked lists under each other: ``(query_id, chunk_id, rank, is_vector)``."""
    def tagged(ranked: DataFrame, is_vector: bool) -> DataFrame:
        return ranked.select("query_id", "chunk_id", "rank", F.lit(is_vector).alias("is_vector"))

    return tagged(vector_ranked, True).unionByName(tagged(lexical_ranked, False))


def reciprocal_rank_fusion(candidates: DataFrame, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """Folds ``(query_id, text, rank, is_vector, meta…)`` to one row per query and text.

    Equal texts add up. Metadata come from the last vector row of the text, or from its first
    lexical row when the vector list lacks it. ``position`` is the fused order.
    """
    keys = ("query_id", "text", "rank", "is_vector")
    meta = [c for c in candidates.columns if c not in keys]
    # One exchange by query serves the fold and every window behind it.
    rows = candidates.withColumn("meta", F.struct(*meta)).repartition("query_id")
    in_vector = F.when(F.col("is_vector"), F.col("rank"))
    in_lexical = F.when(~F.col("is_vector"), F.col("rank"))
    fused = rows.groupBy("query_id", "text").agg(
        F.round(F.sum(1.0 / (cfg.rrf_k + F.col("rank"))), 10).alias("rrf"),
        F.coalesce(F.max_by("meta", in_vector), F.min_by("meta", in_lexical)).alias("meta"),
        F.min(in_vector).alias("vector_rank"),
        F.min(in_lexical).alias("lexical_rank"),
    )
    order = Window.partitionBy("query_id").orderBy(
        F.desc("rrf"), F.asc_nulls_last("vector_rank"), F.asc("lexical_rank")
    )
    return fused.select("query_id", "text", "rrf", "meta.*", F.row_number().over(order).alias("position"))


def cap_for(sources: Column, cfg: RetrievalConfig = DEFAULT) -> Column:
    """Per-source cap: without effect where the query already names its sources."""
    return F.when(F.size(sources) > 0, cfg.k_rerank).otherwise(cfg.cap_per_source)


def diverse_top(fused: DataFrame, cap: Column, n: int) -> DataFrame:
    """In fused order, at most ``cap`` rows of a source, then the first ``n``; renumbers ``position``."""
    per_source = Window.partitionBy("query_id", or_unknown(F.col("source"))).orderBy("position")
    overall = Window.partitionBy("query_id").orderBy("position")
    return (
        fused.withColumn("nth_of_source", F.row_number().over(per_source))
        .filter(F.col("nth_of_source") <= cap)
        .withColumn("place", F.row_number().over(overall))
        .filter(F.col("place") <= n)
        .drop("nth_of_source", "position")
        .withColumnRenamed("place", "position")
    )


def coverage(question: Column, text: Column) -> Column:
    """Share of the distinct tokens of ``question`` found in ``text``."""
    asked = F.array_distinct(tokenize(question))
    found = F.size(F.array_intersect(asked, tokenize(text)))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.round(found / F.size(asked), 6))


rule_pair_score: Step = rule(lambda: coverage(F.col("question"), F.col("text")), "pair_score")


def rerank(candidates: DataFrame, n: int, score: Step = rule_pair_score) -> DataFrame:
    """Best ``n`` of each query by pair score, ties by incoming ``position``; adds ``rank``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("pair_score"), F.asc("position"))
    return (
        score(candidates).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    )
