"""Exact deduplication against a history, through minimal perfect hashes over its distinct digests.

The distinct digests of the history are dealt into buckets, as many as the larger of history and arrivals needs. Each
bucket becomes one index row: a minimal perfect hash (levels of bit arrays; a key's slot is the rank of its bit) whose
slots hold the full digest and the locator of the row that stays. Arriving texts are first grouped by digest, map side too, so a group of copies of
any size crosses the shuffle as one row for each task; each distinct digest is looked up in its bucket and counts as a
member only if all 32 bytes at its slot agree. Nonmembers form groups of their own.

Texts are equal when identical after replacing each run of ASCII white space by one space; null counts as empty.
Of a group the row of the history stays, else that with the smallest doc_id. A row without doc_id stays only if its
group has no id at all; of repeated rows (same id, same text) one stays. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import SPACE, texts, written

BUCKET_KEYS = 16_384
#: Bits of a level for each key that is left.
GAMMA = 2.0
#: Stands for a group of the history in which no row has an id.
NO_ID = -1 << 63
INDEX = "bucket int, n long, sizes array<long>, bits binary, digests binary, winners binary, counts binary"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with white space runs replaced, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n: one row for each id and digest, n rows of the table each."""
    return (
        texts(docs).select("doc_id", text_digest(F.col("text")).alias("digest"))
        .groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    )


def distinct(rows: DataFrame) -> DataFrame:
    """digest, winner (smallest doc_id), n."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.sum("n").alias("n"))


def positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a level puts keys, given as rows of four 64-bit words."""
    x = words[:, 0] + words[:, 1] * np.uint64(2 * level + 1) + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


def perfect_hash(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, all bits, and each key's slot, for distinct keys."""
    sizes, bits, slot = [], [], np.zeros(len(words), np.int64)
    left, ranked, level = np.arange(len(words)), 0, 0
    while left.size:
        size = max(64, int(GAMMA * left.size) | 1)
        at = positions(words[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        slot[left[placed]] = ranked + np.cumsum(alone)[at[placed]] - 1
        ranked += int(placed.sum())
        sizes.append(size)
        bits.append(alone)
        left, level = left[~placed], level + 1
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), slot


def slots(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key; any slot or -1 for keys that are no members."""
    slot, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    rank = np.cumsum(bits) - 1
    for level, size in enumerate(sizes):
        at = base + positions(words[left], level, size)
        here = bits[at]
        slot[left[here]] = rank[at[here]]
        left, base = left[~here], base + size
    return slot


def as_words(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8").reshape(-1, 4)


def bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


def n_buckets(n_keys: int) -> int:
    return max(1, -(-n_keys // BUCKET_KEYS))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket of ``history`` (digest, winner, n), whose digests are distinct."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(rows.digest), np.uint8).reshape(-1, 32)
        sizes, bits, slot = perfect_hash(as_words(raw.tobytes()))
        order = np.argsort(slot)
        winners = rows.winner.to_numpy(np.int64)
        return pd.DataFrame([{
            "bucket": int(rows.bucket.iloc[0]), "n": len(rows), "sizes": sizes, "bits": np.packbits(bits).tobytes(),
            "digests": raw[order].tobytes(), "winners": winners[order].tobytes(),
            "counts": rows.n.to_numpy(np.int64)[order].tobytes(),
        }])

    return history.withColumn("winner", F.coalesce("winner", F.lit(NO_ID))).withColumn("bucket", bucket(F.col("digest"), buckets)).groupBy("bucket").applyInPandas(build, INDEX)


def look_up(arriving: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """digest and n of ``arriving`` with ``member``, and for members the history's winner and count."""

    def search(rows: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = rows[["digest", "n"]].copy()
        member, winner, known = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        if len(rows) and len(shard):
            entry = shard.iloc[0]
            sizes = [int(s) for s in entry.sizes]
            bits = np.unpackbits(np.frombuffer(entry.bits, np.uint8), count=sum(sizes)).astype(bool)
            words, held = as_words(b"".join(rows.digest)), as_words(entry.digests)
            slot = slots(words, sizes, bits)
            member = (slot >= 0) & (held[np.maximum(slot, 0)] == words).all(axis=1)
            winner[member] = np.frombuffer(entry.winners, np.int64)[slot[member]]
            known[member] = np.frombuffer(entry.counts, np.int64)[slot[member]]
        out["member"], out["found"], out["known"] = member, winner, known
        return out

    keyed = arriving.select("digest", "n", bucket(F.col("digest"), buckets).alias("bucket"))
    found = keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        search, "digest binary, n long, member boolean, found long, known long")
    return found.withColumn("found", F.when(F.col("member"), F.nullif("found", F.lit(NO_ID))))


def groups(rows: DataFrame, historical: Column) -> DataFrame:
    """digest, keep_id, group_size: of ``rows`` (doc_id, digest, n), those for which ``historical`` holds form the index.

    Members take the winner of their slot, nonmembers group by digest; digests that only the history has follow."""
    history = written(distinct(rows.filter(historical)), "history")
    arriving = written(distinct(rows.filter(~historical)), "arriving")
    # both sides of a bucket go to one task
    buckets = n_buckets(max(history.count(), arriving.count()))
    index = written(build_index(history, buckets), "perfect-hash")
    found = written(look_up(arriving, index, buckets), "found")
    members = found.filter("member").select("digest", F.col("found").alias("keep_id"), (F.col("known") + F.col("n")).alias("group_size"))
    others = arriving.join(found.filter("not member").select("digest"), "digest", "left_semi")
    old = history.join(members.select("digest"), "digest", "left_anti")
    return members.unionByName(
        others.unionByName(old).select("digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size")))


def decided(docs: DataFrame, historical: Column | None = None) -> DataFrame:
    """doc_id, digest, n, keep_id, group_size, stays. Without ``historical``, ids up to about the median are the history."""
    rows = written(digests(docs), "digests")
    if historical is None:
        middle = rows.agg(F.percentile_approx("doc_id", 0.5).alias("middle")).first()["middle"]
        historical = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    found = groups(rows, historical)
    return rows.join(found, "digest").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def per_row(decisions: DataFrame) -> DataFrame:
    """One row for each row of the table; of repeated rows the first copy stays."""
    copies = decisions.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return copies.select(
        "doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
