"""SimHash near-duplicates: 64-bit fingerprints, linked by a self-join of their binary trie.

The join walks pairs of trie nodes together: each step goes one bit deeper, adds the bits in which the two paths
differ, and drops a pair whose sum exceeds the budget. A sorted array is the trie: a node is a range of it.

To deal the walk out, bits are cut into budget + 1 blocks. Two fingerprints within the budget agree in at least one
block, so each fingerprint enters one trie for each block, turned so that the block leads, and the walk starts at the
nodes behind that block with no error spent. Such a node with more fingerprints than ``NODE_FINGERPRINTS`` is cut the
same way again on its other bits; after the last cut a node has too few bits left to be large. So every part of the
walk is bounded, and no link is lost. Only distinct fingerprints are joined: a group of copies is one trie leaf. Each part
gives a spanning forest of its links, not all its pairs, and the forests meet in ``components``.

Defined results: a text without words (also null) has fingerprint zero, which links like any other; repeated rows have
equal fingerprints; a component is named by its smallest doc_id, null if it has none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import per_batch, small, texts, written
from gleaner.llm.components import components

WORDS = 3
SEED = 42
BUDGET = 2
NODE_FINGERPRINTS = 4096
#: For a budget of two: bits that lead after each cut; the rest is cut into three blocks again.
LEADS = (21, 35, 44, 50)


def fingerprint(text: str, words: int = WORDS) -> int:
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    sums = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        stop = min(n, start + (1 << 16))
        hashes = [xxhash.xxh64_intdigest(b" ".join(found[i:i + words]), SEED) for i in range(start, stop)]
        raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * sums > n, bitorder="little")
    return int(set_bits.view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the text), fingerprint of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("fingerprint", pa.int64())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(text) for text in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("digest"), pa.array(found, pa.int64())], schema=schema)

    rows = texts(docs).withColumn("digest", row_digest(F.col("text")))
    return per_batch(rows, step, "doc_id long, digest binary, fingerprint long")


def row_digest(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def walk(values: np.ndarray, lead: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the budget among sorted distinct ``values`` that agree in their first ``lead`` bits."""
    start = np.flatnonzero(np.r_[True, values[1:] >> np.uint64(64 - lead) != values[:-1] >> np.uint64(64 - lead)]) if values.size else np.zeros(0, np.int64)
    stop = np.r_[start[1:], values.size].astype(np.int64)
    several = stop - start > 1
    # A pair of nodes is (low, high) of each and the bits in which their paths differ.
    todo = [(lead, np.stack([start, stop, start, stop, np.zeros_like(start)])[:, several])]
    left, right = [], []
    while todo:
        depth, pairs = todo.pop()
        if pairs.shape[1] > 1 << 18:  # depth first over parts, so that memory stays bounded
            half = pairs.shape[1] // 2
            todo += [(depth, pairs[:, :half]), (depth, pairs[:, half:])]
            continue
        a, a_end, b, b_end, errors = pairs
        single = (a_end - a == 1) & (b_end - b == 1)
        at, to = a[single], b[single]
        near = (at != to) & (np.bitwise_count(values[at] ^ values[to]) <= budget)
        left.append(at[near])
        right.append(to[near])
        a, a_end, b, b_end, errors = pairs[:, ~single]
        if not a.size or depth == 64:
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        keep = ~np.uint64(0) << np.uint64(63 - depth)
        a_mid = np.searchsorted(values, values[a] & keep | bit)
        b_mid = np.searchsorted(values, values[b] & keep | bit)
        # values[a] may itself have the bit, then its node has no zero side
        a_mid = np.where(values[a] & bit != 0, a, a_mid)
        b_mid = np.where(values[b] & bit != 0, b, b_mid)
        same = a == b
        more = ~same & (errors < budget)
        cross = errors < budget
        children = np.concatenate([
            np.stack([a, a_mid, b, b_mid, errors]), np.stack([a_mid, a_end, b_mid, b_end, errors]),
            np.stack([a, a_mid, b_mid, b_end, errors + 1])[:, cross], np.stack([a_mid, a_end, b, b_mid, errors + 1])[:, more],
        ], axis=1)
        there = (children[1] > children[0]) & (children[3] > children[2])
        there &= ~((children[0] == children[2]) & (children[1] - children[0] == 1))
        if there.any():
            todo.append((depth + 1, children[:, there]))
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position that each position reaches."""
    root = np.arange(n)
    while left.size:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        for side in (left, right):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def part_links(path: np.ndarray, value: np.ndarray, fp: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a run of rows sorted by path and value, as a forest of fingerprints."""
    us, vs = [], []
    for one in np.unique(path):
        rows = path == one
        values, fps = value[rows], fp[rows]
        root = forest(len(values), *walk(values, lead))
        linked = np.flatnonzero(root != np.arange(len(values)))
        us.append(fps[linked])
        vs.append(fps[root[linked]])
    return np.concatenate(us), np.concatenate(vs)


def node_links(nodes: DataFrame, lead: int) -> DataFrame:
    """Edges (u, v) within the nodes of ``nodes`` (path, value, fp) at depth ``lead``. A node never leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - lead)

        def links(columns):
            u, v = part_links(*columns, lead)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held = None
        for batch in batches:
            new = [batch.column("path").to_numpy(), batch.column("value").to_numpy().view(np.uint64), batch.column("fp").to_numpy()]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            last = (held[0] == held[0][-1]) & (held[1] >> shift == held[1][-1] >> shift)
            whole = int(np.argmax(last))  # all but the last node, which may go on in the next batch
            if whole:
                yield links([x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if held is not None and held[0].size:
            yield links(held)

    # Signed longs sort like unsigned ones once the top bit is turned over.
    order = F.col("value").bitwiseXOR(F.lit(-1 << 63))
    dealt = nodes.repartition("path", node(lead)).sortWithinPartitions("path", order)
    return dealt.mapInArrow(run, "u long, v long")


def node(lead: int):
    return F.shiftrightunsigned("value", 64 - lead)


def turned(value, lead: int, next_lead: int):
    """The turns of the bits behind ``lead`` that bring each of three blocks to their front."""
    width, block = 64 - lead, next_lead - lead
    mask = (1 << width) - 1 if lead else -1
    top, low = value.bitwiseAND(F.lit(~mask if lead else 0)), value.bitwiseAND(F.lit(mask))
    out = []
    for by in (0, block, 2 * block):
        moved = low if not by else F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, width - by)).bitwiseAND(F.lit(mask))
        out.append(top.bitwiseOR(moved))
    return F.array(*out)


def links(fps: DataFrame, node_fingerprints: int = NODE_FINGERPRINTS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp): a spanning set of all pairs within the budget."""
    frame = fps.select("fp", F.lit(0).alias("path"), F.col("fp").alias("value"))
    edges, before = [], 0
    for level, lead in enumerate(LEADS):
        turns = frame.select("fp", "path", F.posexplode(turned(F.col("value"), before, lead)).alias("turn", "value"))
        frame = written(turns.select("fp", (F.col("path") * 3 + F.col("turn")).alias("path"), "value"), "trie")
        sizes = frame.groupBy("path", node(lead).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        large = written(sizes.filter(F.col("n") > node_fingerprints).select("path", "node"), "large-nodes")
        n_large = large.count() if level + 1 < len(LEADS) else 0
        if not n_large:
            edges.append(node_links(frame, lead))
            break
        keyed = frame.withColumn("node", node(lead))
        edges.append(node_links(keyed.join(small(large), ["path", "node"], "left_anti"), lead))
        frame = keyed.join(small(large), ["path", "node"], "left_semi").select("fp", "path", "value")
        before = lead
    out = edges[0]
    for more in edges[1:]:
        out = out.union(more)
    return out


def decided(docs: DataFrame) -> DataFrame:
    """doc_id, digest, fingerprint, root (smallest fingerprint of the component), component_id of every row."""
    rows = written(fingerprints(docs), "fingerprints")
    fps = written(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = components(links(fps.select("fp")))
    rooted = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(names, "root").select(F.col("fp").alias("fingerprint"), "root", "component_id")
    return rows.join(named, "fingerprint").select("doc_id", "digest", "fingerprint", "root", "component_id")


def keepers(decisions: DataFrame) -> DataFrame:
    """doc_id, digest, n of the one document of each component that stays: its smallest doc_id, then digest."""
    ids = decisions.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "n")).alias("k"))
    return first.select("k.doc_id", "k.digest", "k.n")
