import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import components, exact_dedup, line_dedup, simhash
from gleaner.llm.common import one_stays


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def partition(keys):
    found = defaultdict(set)
    for i, key in enumerate(keys):
        found[key].add(i)
    return sorted(map(sorted, found.values()))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_perfect_hash_places_every_key_once():
    raw = b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000))
    words = exact_dedup.as_words(raw)
    sizes, bits, slot = exact_dedup.perfect_hash(words)
    assert sorted(slot) == list(range(5000))
    assert (exact_dedup.slots(words, sizes, bits) == slot).all()
    others = exact_dedup.as_words(b"".join(hashlib.sha256(f"n{i}".encode()).digest() for i in range(500)))
    assert (exact_dedup.slots(others, sizes, bits) < 5000).all()


def expected_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    ids = defaultdict(list)
    for r, text in zip(rows, norm, strict=True):
        ids[text].append(r[0])
    out = []
    for r, text in zip(rows, norm, strict=True):
        known = [i for i in ids[text] if i is not None]
        out.append((r[0], min(known, default=None), len(ids[text]), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_exact_groups(edge, edge_rows):
    got = exact_dedup.per_row(exact_dedup.decided(edge)).collect()
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == sorted(map(str, expected_exact(edge_rows)))
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_history_wins_over_smaller_ids(spark):
    rows = spark.createDataFrame([(9, "a  b"), (1, "a b"), (2, "c"), (3, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.stays) for r in exact_dedup.decided(rows, F.col("doc_id") == 9).collect()}
    assert got == {9: (9, 2, True), 1: (9, 2, False), 2: (2, 2, True), 3: (2, 2, False)}


def test_several_buckets(spark, docs_001, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 16)
    rows = [(r.doc_id, r.text) for r in docs_001.collect()]
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.per_row(exact_dedup.decided(docs_001)).collect()}
    assert got == {i: rest for i, *rest in ((a, *b) for a, *b in expected_exact(rows))} or all(got[a] == tuple(b) for a, *b in expected_exact(rows))


def test_one_row_of_each_group_stays(edge):
    stays = exact_dedup.decided(edge).filter("stays").select("doc_id", "digest", "n")
    left = one_stays(edge, exact_dedup.text_digest(F.col("text")), stays)
    assert left.columns == edge.columns
    texts = [re.sub(r"\s+", " ", r.text or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == edge.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("t")).distinct().count()


@pytest.mark.parametrize("decide", [exact_dedup.decided, simhash.decided, line_dedup.decided])
def test_empty_table(nothing, decide):
    assert decide(nothing).count() == 0


def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected_simhash(rows):
    fps = [fingerprint_by_hand(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = union(len(rows), pairs)
    first = {}
    for r, x in zip(rows, root, strict=True):
        if r[0] is not None:
            first[x] = min(first.get(x, r[0]), r[0])
    return sorted(map(str, ((r[0], fp, first.get(x)) for r, fp, x in zip(rows, fps, root, strict=True))))


def test_simhash_against_brute_force(edge, edge_rows, docs_001):
    for docs, rows in ((edge, edge_rows), (docs_001, [(r.doc_id, r.text) for r in docs_001.collect()])):
        got = simhash.decided(docs).collect()
        assert sorted(str((r.doc_id, r.fingerprint % (1 << 64), r.component_id)) for r in got) == expected_simhash(rows)


def test_simhash_keepers(edge):
    left = one_stays(edge, simhash.row_digest(F.col("text")), simhash.keepers(simhash.decided(edge)))
    found = simhash.decided(edge)
    assert left.count() == found.select("root").distinct().count()


@pytest.mark.parametrize("most", [4096, 3])
def test_trie_join_over_large_nodes(spark, most):
    random = np.random.default_rng(5)
    base = random.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(random.integers(64))) ^ np.uint64(1 << int(random.integers(64))) for b in base for _ in range(12)]
    values = np.unique(np.concatenate([base, np.array(near, np.uint64), np.arange(40, dtype=np.uint64)]))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    got = union(len(values), [(at[r.u], at[r.v]) for r in simhash.links(fps, most).collect()])
    close = [(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[:i]) <= 2).tolist()]
    assert partition(got) == partition(union(len(values), close))


def shingle_set(norm):
    return {norm[i:i + line_dedup.SHINGLE] for i in range(max(1, len(norm) - line_dedup.SHINGLE + 1))}


def line_classes(rows):
    norms = sorted({norm for r in rows for line in (r[1] or "").split("\n")
                    if (norm := re.sub(r"[\x20\x09-\x0D]+", " ", line).lower().strip(" "))})
    sets = [shingle_set(n) for n in norms]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)
             if len(common := sets[i] & sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(common))]
    return dict(zip(norms, union(len(norms), pairs), strict=True))


def test_lines_against_brute_force(edge, edge_rows, docs_001):
    for docs, rows in ((edge, edge_rows), (docs_001, [(r.doc_id, r.text) for r in docs_001.collect()])):
        classes = line_classes(rows)
        got = line_dedup.decided(docs).collect()
        n_lines = sum(len((r[1]).split("\n")) for r in rows if r[1] is not None)
        blank = sum(not line.strip(" \t\n\r\x0b\x0c") for r in rows if r[1] is not None for line in r[1].split("\n"))
        assert len(got) == n_lines
        assert sum(r.kept for r in got) == len(set(classes.values())) + blank


def test_mixed_bands_lose_no_link(spark):
    stem = "this is a line of some length that many other lines resemble to a high degree and more "
    rows = [(i, stem * 2 + f"{i:04d} " + "tail words " * (i % 9)) for i in range(60)]
    got = line_dedup.decided(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.kept for r in got) == len(set(line_classes(rows).values()))


def test_cleaned_texts(spark):
    line = "a rather long line that is repeated almost word for word in two documents of this corpus"
    docs = spark.createDataFrame([(1, f"one\n\n{line}\nlast"), (2, f"{line}.\n\nnew"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.cleaned(docs, line_dedup.decided(docs)).collect()}
    assert got == {1: f"one\n\n{line}\nlast", 2: "\nnew", 3: None}


def test_lines_of_one_pattern_make_few_pairs(spark, monkeypatch):
    """Lines that share half their shingles meet in bands; only pairs near the threshold may become rows."""
    made, write = {}, line_dedup.written

    def counted(df, name):
        table = write(df, name)
        made[name] = table.count()
        return table

    monkeypatch.setattr(line_dedup, "written", counted)
    common = "the account of this chapter was settled in full on the "
    texts = [common + hashlib.sha256(str(i).encode()).hexdigest()[:40] for i in range(300)]
    texts += [t + "!" for t in texts[:20]]
    got = line_dedup.decided(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.keep_doc_id for r in got} == {i: i % 300 for i in range(320)}
    assert made["mixed-members"] > 300 and made["mixed-pairs"] < 3200


def test_bitmaps_bound_what_lines_differ_in(spark):
    rng = np.random.default_rng(5)
    lines = []
    for n in (1, 7, 8, 9, 40, 300, 2500):
        base = rng.choice(list("abcé😀中 "), n)
        for share in (0, 0.005, 0.02, 0.1):
            lines.append("".join(np.where(rng.random(n) < share, "z", base)))
    lines = sorted(set(lines))
    found = line_dedup.sketched(spark.createDataFrame(list(enumerate(lines)), "line_id long, norm string")).localCheckpoint()
    sizes = {r.line_id: r["size"] for r in found.collect()}
    assert sizes == {i: len(shingle_set(line)) for i, line in enumerate(lines)}
    a, b = found.alias("a"), found.alias("b")
    pairs = a.join(b, (F.col("a.line_id") < F.col("b.line_id")) & line_dedup.may_be_similar("a", "b", 0.8))
    kept = {(r[0], r[1]) for r in pairs.select("a.line_id", "b.line_id").collect()}
    sets = [shingle_set(line) for line in lines]
    alike = {(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert alike and alike <= kept and len(kept) < len(lines) * (len(lines) - 1) / 4


def test_near_copies_about_the_threshold_make_few_pairs(spark, monkeypatch):
    """Half the pairs of a large group are links; verifying a few members against the others finds its components."""
    made, write = defaultdict(int), line_dedup.written

    def counted(df, name):
        table = write(df, name)
        made[name] += table.count()
        return table

    monkeypatch.setattr(line_dedup, "written", counted)
    rng = np.random.default_rng(3)
    base, rows = rng.choice(list("abcdefghijklmnop"), 500), []
    for i in range(300):
        copy = base.copy()
        copy[rng.choice(500, 3 + i % 2, replace=False)] = "z"
        rows.append((i, "".join(copy)))
    got = line_dedup.decided(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.kept for r in got) == len(set(line_classes(rows).values()))
    assert made["mixed-members"] > 300 and made["common-shingles"] < 3000


def test_bitmaps_of_long_lines_tell_them_apart(spark):
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("abcdefghijklmnop"), 1200))
    lines = [base] + [base[:840] + "".join(rng.choice(list("abcdefghijklmnop"), 360)) for _ in range(20)]
    found = line_dedup.sketched(spark.createDataFrame(list(enumerate(lines)), "line_id long, norm string")).localCheckpoint()
    a, b = found.alias("a"), found.alias("b")
    assert a.join(b, (F.col("a.line_id") < F.col("b.line_id")) & line_dedup.may_be_similar("a", "b", 0.8)).count() == 0


def test_lines_of_several_bands_are_paired_once(spark):
    """Near copies share most of their bands; a pair of them is one row, in whichever band it is listed."""
    lines = ["the account of this chapter was settled in full on the " + c for c in ("first", "third", "fifth")]
    sketch = line_dedup.sketched(spark.createDataFrame(list(enumerate(lines)), "line_id long, norm string")).drop("norm")
    bands = spark.createDataFrame([(k, i, i) for k in (30, 10, 20) for i in range(3) if (k, i) != (10, 2)], "key long, line_id long, root long")
    keys = bands.groupBy("line_id").agg(F.collect_set("key").alias("keys"))
    members = bands.join(keys, "line_id").join(sketch, "line_id").localCheckpoint()
    got = sorted((r.u, r.v) for r in line_dedup.other_pairs(members, 0.5).collect())
    assert got == [(0, 1), (0, 2), (1, 2)]


def test_large_bands_lose_no_link(spark, monkeypatch):
    """Drawn members leave their band once they are verified; bands over LARGE draw again."""
    monkeypatch.setattr(line_dedup, "LARGE", 4)
    monkeypatch.setattr(line_dedup, "ROUNDS", 2)
    words = [hashlib.sha256(str(i).encode()).hexdigest()[:9] for i in range(40)]
    rows = [(i, " ".join(words[:i % 20] + ["other"] + words[i % 20 + 1:30 + i // 20])) for i in range(60)]
    got = line_dedup.decided(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = line_classes(rows)
    first = {}
    for i, text in rows:
        norm = text.lower()
        first.setdefault(classes[norm], i)
    assert {r.doc_id: r.keep_doc_id for r in got} == {i: first[classes[text]] for i, text in rows}
