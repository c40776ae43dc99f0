"""Settings shared by the retrieval plans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    # Fixed values of the retrieval cascade: 20 + 20 candidates, 10 fused, 5 kept.
    k_retrieve: int = 20
    k_rerank: int = 10
    k_final: int = 5
    rrf_k: int = 60
    cap_per_source: int = 3
    # Whether chunks without a common term fill up a short lexical list, in id order, so that it is complete.
    fill_zero: bool = True
    # Okapi BM25 constants.
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    # Decimal places kept before any ranking, so that summation order cannot move a rank.
    score_places: int = 6
    # Size of the stand-in hashed vectors.
    vector_dim: int = 64
    # A side is broadcast only when its measured size is below this.
    broadcast_bytes: int = 64 * 1024 * 1024
    # Target size of a shuffle partition, and of one part of a chunk table looked up by id.
    partition_bytes: int = 128 * 1024 * 1024
    # Token text of one partition of a corpus. Its words take some twenty times that while they are counted.
    token_bytes: int = 16 * 1024 * 1024
    # Most folders a chunk table is cut into for lookups by id; a folder holds as many files as needed.
    lookup_parts: int = 10_000
    # Terms with more postings than this are spread over several shuffle keys.
    hot_term_postings: int = 1_000_000
    # Pairs of a question and a posting up to which every chunk that shares a term is scored; beyond, bounds of scores
    # choose the chunks.
    direct_pairs: int = 50_000_000
    # Queries multiplied against the vectors in one pass.
    query_block: int = 4096
    # Retrievals of the bounded loop: the answer is forced once attempts exceed this.
    max_attempts: int = 2


DEFAULT = RetrievalConfig()
