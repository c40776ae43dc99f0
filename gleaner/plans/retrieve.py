"""Hybrid retrieval for many queries: two searches, fusion, cap, rerank."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import DEFAULT, RetrievalConfig
from gleaner.functions.sizes import hinted
from gleaner.functions.text import token_text
from gleaner.operators import fusion, lexical, maxscore, vectors
from gleaner.operators.models import Step
from gleaner.operators.prompts import HYDE_TEMPLATE, fill
from gleaner.sources.scratch import materialize, scratch_path


@dataclass(frozen=True)
class Corpus:
    """Chunks with both indexes. ``embeddings(chunk_id, source, vector)``; ``id_parts`` is set where
    the chunks are stored by id."""

    chunks: DataFrame
    lexical: lexical.LexicalIndex
    embeddings: DataFrame
    id_parts: int | None = None
    pivots: np.ndarray | None = None

    @property
    def vectors(self) -> DataFrame | vectors.PivotTable:
        """What a vector search reads: with pivots where the corpus was stored with them."""
        return self.embeddings if self.pivots is None else vectors.PivotTable(self.embeddings, self.pivots)


def build_corpus(chunks: DataFrame, embed: Step | None = None, cfg: RetrievalConfig = DEFAULT) -> Corpus:
    """Indexes ``chunks(chunk_id, source, text[, page])``. Without an embedder, hashed vectors are built."""
    if "page" not in chunks.columns:
        chunks = chunks.withColumn("page", F.lit(None).cast("int"))
    index = lexical.build_index(chunks, cfg)
    if embed is None:
        embeddings = vectors.hashed_vectors(lexical.tokenized(chunks), ["chunk_id", "source"], cfg.vector_dim)
    else:
        embeddings = embed(chunks.select("chunk_id", "source", "text")).select("chunk_id", "source", "vector")
    return Corpus(chunks, index, vectors.checked_dimension(embeddings, cfg.vector_dim))


def id_part(parts: int):
    return F.pmod(F.xxhash64("chunk_id"), F.lit(parts).cast("long")).cast("int")


def stored(spark: SparkSession, corpus: Corpus, cfg: RetrievalConfig = DEFAULT) -> Corpus:
    """The same corpus read back from scratch tables, for plans that search it several times.

    Chunks are kept in folders by a hash of their id; fetching the text of a few winners then opens
    the folders of those winners only.
    """
    path = scratch_path(spark, "index")
    lexical.save_index(corpus.lexical, path)
    index = lexical.load_index(spark, path)
    size = index.tokens.agg(F.coalesce(F.sum(F.octet_length("norm")), F.lit(0)).alias("n")).first()["n"]
    parts = min(max(1, -(-size // cfg.partition_bytes)), cfg.lookup_parts)
    columns = corpus.chunks.select("chunk_id", "source", "page", "text", id_part(parts).alias("id_part"))
    columns.hint("rebalance", F.col("id_part")).write.partitionBy("id_part").parquet(f"{path}/chunks")
    return replace(
        corpus,
        chunks=spark.read.parquet(f"{path}/chunks"),
        lexical=index,
        embeddings=materialize(corpus.embeddings, "embeddings"),
        id_parts=parts,
    )


def query_vectors(queries: DataFrame, hyde: Step | None = None, embed: Step | None = None,
                  cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """``(query_id, sources, vector)``. The vector side may search for a hypothetical answer; the
    lexical side always keeps the question."""
    asked = lexical.with_sources(queries)
    if hyde is None:
        asked = asked.withColumn("text", F.col("question"))
    else:
        asked = hyde(asked.withColumn("prompt", fill(HYDE_TEMPLATE, question=F.col("question"))))
        asked = asked.withColumn("text", F.coalesce("reply", "question"))
    if embed is not None:
        return embed(asked).select("query_id", "sources", "vector")
    tokens = asked.select("query_id", token_text(F.col("text")).alias("norm"))
    hashed = vectors.hashed_vectors(tokens, ["query_id"], cfg.vector_dim)
    return hashed.join(asked.select("query_id", "sources"), "query_id")


def with_text(ranked: DataFrame, corpus: Corpus, small: bool) -> DataFrame:
    """Adds source, page and text to ranked ids."""
    keys, columns = ["chunk_id"], ["chunk_id", "source", "page", "text"]
    if corpus.id_parts is not None:
        ranked = ranked.withColumn("id_part", id_part(corpus.id_parts))
        keys, columns = ["id_part", "chunk_id"], ["id_part", *columns]
    joined = corpus.chunks.select(*columns).join(hinted(ranked, small), keys)
    return joined.drop("id_part") if corpus.id_parts is not None else joined


def candidates(queries: DataFrame, corpus: Corpus, hyde: Step | None = None, embed: Step | None = None,
               cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """Both ranked lists with question and chunk columns; texts are fetched for the winners only."""
    queries = lexical.with_sources(queries)
    by_vector = vectors.nearest(query_vectors(queries, hyde, embed, cfg), corpus.vectors, cfg=cfg)
    by_term = maxscore.bm25_top_k(queries, corpus.lexical, cfg=cfg)
    ranked = fusion.both_lists(by_vector, by_term)
    # At most 2 k short rows per query: the bound follows from the number of queries.
    small = queries.count() * 2 * cfg.k_retrieve * 200 <= cfg.broadcast_bytes
    return with_text(ranked, corpus, small)


def fused(queries: DataFrame, corpus: Corpus, hyde: Step | None = None, embed: Step | None = None,
          cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    return fusion.reciprocal_rank_fusion(candidates(queries, corpus, hyde, embed, cfg), cfg)


def diverse(queries: DataFrame, corpus: Corpus, hyde: Step | None = None, embed: Step | None = None,
            cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """The fused candidates after the per-source cap, with their question."""
    asked = lexical.with_sources(queries).select("query_id", "question", "sources")
    rows = fused(queries, corpus, hyde, embed, cfg).join(asked, "query_id")
    return fusion.diverse_top(rows, fusion.cap_for(F.col("sources"), cfg), cfg.k_rerank)


def retrieve(queries: DataFrame, corpus: Corpus, hyde: Step | None = None, embed: Step | None = None,
             score: Step = fusion.rule_pair_score, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """``(query_id, question, rank, chunk_id, source, page, text, pair_score)``, best first.

    ``queries(query_id, question[, sources])``; queries without any candidate have no row.
    """
    best = fusion.rerank(diverse(queries, corpus, hyde, embed, cfg), cfg.k_final, score)
    return best.select("query_id", "question", "rank", "chunk_id", "source", "page", "text", "pair_score")
