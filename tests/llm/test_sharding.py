import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import sharding


def rows_of(found):
    return sorted((r.shard, r.slot, -(10**9) if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in sharding.digests(found).collect())


def check_law(rows, expected, shards):
    """Every row once, counts at most one apart, slots gapless."""
    assert Counter((d, s, c) for _, _, d, s, c in rows) == Counter(
        (-(10**9) if d is None else d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in expected)
    slots = defaultdict(list)
    for shard, slot, *_ in rows:
        slots[shard].append(slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())


def test_edge_rows(spark, edge, edge_rows):
    rows = rows_of(sharding.sharded(edge, pile_bytes=20_000))
    check_law(rows, [(r[0], r[1]) for r in edge_rows], sharding.SHARDS)
    back = sharding.sharded(edge, pile_bytes=20_000).select("record.*")
    assert back.columns == edge.columns
    assert sorted(map(repr, back.collect())) == sorted(map(repr, edge.collect()))


def test_order_does_not_depend_on_partitions(spark, docs_001):
    one = rows_of(sharding.sharded(docs_001.coalesce(1), pile_bytes=50_000))
    many = rows_of(sharding.sharded(docs_001.repartition(13, "n_chars"), pile_bytes=50_000))
    other = rows_of(sharding.sharded(docs_001, seed=5, pile_bytes=50_000))
    assert one == many and one != other
    check_law(one, [(r.doc_id, r.text) for r in docs_001.collect()], sharding.SHARDS)


def plain_shards(rows, shards, seed, piles):
    """The law by hand, from the keys that Spark gives: piles in order, each shuffled in place from the end."""
    by_pile = defaultdict(list)
    for r in rows:
        by_pile[r.pile].append((r.key, r.copy, r.doc_id))
    order = []
    for pile in range(piles):
        found = sorted(by_pile[pile])
        if found:
            rng = np.random.default_rng([seed, pile])
            draws = rng.integers(0, np.arange(len(found), 1, -1)).tolist()
            for i, j in zip(range(len(found) - 1, 0, -1), draws, strict=True):
                found[i], found[j] = found[j], found[i]
        order += [doc_id for _, _, doc_id in found]
    least, more = divmod(len(order), shards)
    out, at = {}, 0
    for shard in range(shards):
        for slot in range(least + (shard < more)):
            out[shard, slot] = order[at]
            at += 1
    return out


def test_equals_a_plain_shuffle(spark, docs_001):
    total = sum(len((r.text or "").encode()) + 8 for r in docs_001.collect())
    piles = -(-total // 40_000)
    rows = sharding.with_pile(sharding.numbered_copies(sharding.keyed(docs_001, sharding.SEED), 40_000), piles, sharding.SEED)
    rows = rows.select("pile", "key", "copy", "record.doc_id").collect()
    got = {(r.shard, r.slot): r.doc_id for r in sharding.digests(sharding.sharded(docs_001, pile_bytes=40_000)).collect()}
    assert got == plain_shards(rows, sharding.SHARDS, sharding.SEED, piles) and piles > 5


def test_many_equal_rows_are_scattered(spark):
    same = [(7, "the same text again and again")] * 3000
    rows = same + [(None, None)] * 500 + [(i, f"text {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check_law(rows_of(sharding.sharded(docs, pile_bytes=8_000)), rows, sharding.SHARDS)
    piles = sharding.with_pile(sharding.numbered_copies(sharding.keyed(docs, 1), 8_000), 16, 1).groupBy("pile").count()
    assert max(r["count"] for r in piles.collect()) < 400
    assert piles.agg(F.sum("count")).first()[0] == 4000


def test_empty_and_few(spark, nothing):
    assert sharding.sharded(nothing).count() == 0
    few = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    check_law(rows_of(sharding.sharded(few)), [(1, "a"), (2, None)], sharding.SHARDS)


def test_fisher_yates_is_uniform():
    counts = Counter(tuple(sharding.fisher_yates(4, np.random.default_rng(i))) for i in range(12_000))
    assert len(counts) == 24 and min(counts.values()) > 380 and max(counts.values()) < 620


@pytest.mark.parametrize("n", [0, 1, 23, 24, 25, 1000])
def test_shard_ranges(spark, n):
    shard, slot = sharding.shard_of(F.col("id"), n, 24)
    rows = spark.range(n).select(shard.alias("shard"), slot.alias("slot"), "id").orderBy("id").collect()
    counts = Counter(r.shard for r in rows)
    assert n == 0 or max(counts.values()) - min(counts[s] for s in range(24)) <= 1
    assert [(r.shard, r.slot) for r in rows] == sorted((r.shard, r.slot) for r in rows)
