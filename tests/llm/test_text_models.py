import hashlib
import math
import mmap
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import bpe, bpe_codec, elias_fano, ngram_lm, packing, quality_classifier, quality_rules
from gleaner.llm.common import fold
from gleaner.llm.queries import RANKS, VOCABULARY, op3_quality_classifier

PARTS = ["a", "b", "'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "\xa0", "é", "è", "ß", "1", "23", "%", "!", "#", "|", "中", "文",
         "　", " ", "\x1c", "\x85", "😀", "<|endoftext|>", "<|", "\x00", "don't", "I'LL", "​", "ǅ", "²", "ع", "é"]


def library_ids(text):
    return Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_bpe_equals_the_library(ranks, docs_001):
    library, own, draw = Tokenizer.from_file(VOCABULARY), bpe.encoder(VOCABULARY, ranks), random.Random(3)
    made = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(6000)]
    for text in [*made, *[r.text for r in docs_001.collect()], "x" * 5000, "ab" * 3000, " " * 500]:
        ids = own.encode(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False)


def test_every_cut_lies_between_bytes_that_no_token_joins():
    own = bpe.encoder(VOCABULARY)
    inside = {(t[i], t[i + 1]) for t in own.bytes_of.values() for i in range(len(t) - 1)}
    raw = "The birds' songs, 12 of them — naïve été 中文!! don't\n\n stop".encode()
    fragments = own.fragments(raw)
    assert b"".join(fragments) == raw and len(fragments) > 8
    assert all((a[-1], b[0]) not in inside for a, b in zip(fragments, fragments[1:], strict=False))


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    own = bpe.Encoder(VOCABULARY)
    text = "many different words make the memo start anew " * 3
    assert own.encode(text).tolist() == library_ids(text) and len(own.memo) <= 3


def test_codec_on_spark(spark, edge, edge_rows, nothing):
    got = {str((r.doc_id, r.ids_sha256)): r for r in bpe_codec.round_trip(edge, VOCABULARY).collect()}
    for doc_id, text, *_ in edge_rows:
        ids = library_ids(text or "")
        r = got[str((doc_id, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))]
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe_codec.round_trip(nothing, VOCABULARY).count() == 0
    back = bpe_codec.decoded(bpe_codec.encoded(edge, VOCABULARY), VOCABULARY)
    assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str((r[0], r[1] or "")) for r in edge_rows)


def check_packed(rows, texts, length):
    documents, sequences = {}, {}
    for r in rows:
        documents.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    wanted = Counter()
    for doc_id, text in texts:
        ids = np.append(np.array(library_ids(text), "<u4"), np.uint32(1)).astype("<u4")
        for start in range(0, ids.size, length):
            part = ids[start:start + length]
            wanted[str((doc_id, start, part.size, zlib.crc32(part.tobytes()), ids.size))] += 1
    assert Counter(str((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)) for r in rows) == wanted
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and found[0].padded_length == (at if at & (at - 1) == 0 else length)
    return sequences


def test_packing(spark, edge, edge_rows, nothing, docs_001):
    rows = packing.packed(packing.pieces(edge, VOCABULARY)).collect()
    check_packed(rows, [(r[0], r[1] or "") for r in edge_rows], packing.LENGTH)
    rows = packing.packed(packing.pieces(docs_001, VOCABULARY, RANKS)).collect()
    sequences = check_packed(rows, [(r.doc_id, r.text) for r in docs_001.collect()], packing.LENGTH)
    assert sum(r.length for r in rows) > 0.97 * packing.LENGTH * (len(sequences) - 2)
    assert packing.packed(packing.pieces(nothing, VOCABULARY)).count() == 0
    short = packing.packed(packing.pieces(docs_001, VOCABULARY, length=64), 64).collect()
    check_packed(short, [(r.doc_id, r.text) for r in docs_001.collect()], 64)


def test_salted_ranks_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 7)
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("start"), F.lit(5).alias("ids_crc32"), (F.col("id") % 3 % 2).alias("class"))
    got = packing.ranked(rows, "class", 334).groupBy("class").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(r.r == list(range(len(r.r))) for r in got)


def test_size_classes(spark):
    for length, exact in ((2048, 64), (64, 64), (1000, 64)):
        bounds = packing.class_lengths(length, exact)
        got = spark.range(1, length + 1).select("id", packing.size_class(F.col("id"), length, exact).alias("c")).collect()
        assert all(r.c == int(np.searchsorted(bounds, r.id)) for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_the_demand_near_the_bound(seed):
    draw = np.random.default_rng(seed)
    lengths = packing.class_lengths()
    rests = np.minimum(2048, 1 + draw.lognormal(5 + seed / 2, 1, 3000).astype(int))
    demand = np.bincount(np.searchsorted(lengths, rests), minlength=lengths.size)
    patterns = packing.plan(lengths, demand)
    assert (sum(p * n for p, n in patterns) == demand).all()
    assert all(p @ lengths <= 2048 for p, _ in patterns)
    assert sum(n for _, n in patterns) <= 1.03 * (demand @ lengths) / 2048 + 3
    assert packing.plan(lengths, np.zeros_like(demand)) == []


def test_knapsack_against_brute_force():
    draw = np.random.default_rng(2)
    for _ in range(30):
        lengths = np.unique(draw.integers(1, 12, 4))
        prices = draw.random(lengths.size)
        value, pattern = packing.priced(lengths, prices, 23)
        best = [0.0] * 24
        for room in range(1, 24):
            best[room] = max([best[room - 1]] + [best[room - n] + p for n, p in zip(lengths, prices, strict=True) if n <= room])
        assert math.isclose(value, best[23]) and math.isclose(pattern @ prices, value) and pattern @ lengths <= 23


def model_by_hand(rows, order):
    """Counts as dictionaries; every text's log10 probability, averaged over the weights."""
    counts, contexts, tokens = [Counter() for _ in range(order)], [Counter() for _ in range(order)], []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split() + [b"\n"]
        tokens.append(words)
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
            for n in range(order):
                padded = [b"\r"] * n + words
                for k in range(len(words)):
                    counts[n][tuple(padded[k:k + n + 1])] += 1
                    contexts[n][tuple(padded[k:k + n])] += 1
    total, distinct, out = sum(counts[0].values()), len(counts[0]), []
    for words in tokens:
        base, sums = 0.0, []
        for weight in ngram_lm.WEIGHTS:
            logs = 0.0
            for k, word in enumerate(words):
                p = (counts[0][(word,)] + 1) / (total + distinct + 1)
                for n in range(1, order):
                    gram = tuple(([b"\r"] * n + words)[k:k + n + 1])
                    if n > 1 and gram[1] == b"\r":
                        continue  # only one start symbol is ever a context
                    c = contexts[n][gram[:-1]]
                    share = weight * c / (c + ngram_lm.DAMPING)
                    p = share * (counts[n][gram] / c if c else 0) + (1 - share) * p
                logs += math.log10(p)
            sums.append(logs)
        base = sum(math.log10((counts[0][(w,)] + 1) / (total + distinct + 1)) for w in words)
        top = max(sums)
        out.append((len(words), sum(counts[0][(w,)] > 0 for w in words), total, base, top + math.log10(sum(10 ** (s - top) for s in sums) / len(sums))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_against_dictionaries(edge, edge_rows, docs_001, monkeypatch, order):
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 150_000)
    train = F.coalesce(fold(F.col("doc_id"), 7) != 2, F.lit(True))
    rows = [(r.doc_id, r.text) for r in docs_001.collect()]
    for docs, given in ((edge, edge_rows), (docs_001, rows)):
        got = sorted(ngram_lm.scored(docs, train, order).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
        wanted = sorted(zip([r[0] for r in given], model_by_hand([r[:2] for r in given], order), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1][0]))
        assert len(got) == len(wanted)
        for r, (doc_id, (n_tokens, n_known, total, base, score)) in zip(got, wanted, strict=True):
            assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (doc_id, n_tokens, n_known, total)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-3)


def test_language_model_without_rows(nothing):
    assert ngram_lm.scored(nothing, F.lit(True)).count() == 0


def test_language_model_without_training_rows(edge):
    assert {r.train_tokens for r in ngram_lm.scored(edge, F.lit(False)).collect()} == {0}


def test_elias_fano_in_a_memory_map(tmp_path):
    draw = np.random.default_rng(0)
    for values in (np.zeros(0), np.zeros(5), np.arange(100), np.sort(draw.integers(0, 1 << 62, 1000)), np.array([7])):
        values = values.astype(np.uint64)
        assert (elias_fano.unpack_sequence(elias_fano.pack_sequence(values))[0] == values).all()
    parents, ids = np.array([0, 0, 2, 2, 2]), np.array([3, 9, 0, 1, 4])
    path = tmp_path / "trie"
    path.write_bytes(elias_fano.pack_level(parents, ids, 4, np.arange(5)))
    with open(path, "rb") as file, mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as mapped:
        level, _ = elias_fano.unpack_level(mapped, 0)
        asked = np.array([(p, i) for p in range(4) for i in range(12)])
        wanted = [next((k for k in range(5) if (parents[k], ids[k]) == (p, i)), -1) for p, i in asked.tolist()]
        assert level.find(asked[:, 0], asked[:, 1]).tolist() == wanted
        level = None


def test_quantised_probabilities():
    p = np.array([1.0, 0.5, 1e-3, 1e-9, 0.0])
    assert np.allclose(elias_fano.probability(elias_fano.quantised(p)), p, rtol=3e-4)


def repeated_by_hand(words):
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)})


def test_rules_ledger(edge, edge_rows, nothing):
    got = quality_rules.ledger(edge).collect()
    assert len(got) == len(edge_rows) and quality_rules.ledger(nothing).count() == 0
    wanted = sorted(str((r[0], len((r[1] or "").encode().split()), repeated_by_hand((r[1] or "").encode().split()))) for r in edge_rows)
    assert sorted(str((r.doc_id, r.n_words, r.n_repeat_words)) for r in got) == wanted
    for r in got:
        assert bool(r.failures & 1) == (r.n_words < 20) and bool(r.failures & 2) == (100 * r.n_repeat_words > 30 * r.n_words)


def test_policies_and_ablation(edge):
    rows = quality_rules.ledger(edge)
    both = quality_rules.judged(rows, (quality_rules.BASE, quality_rules.STANDARD)).collect()
    assert all(r.kept_base_v1 for r in both if r.kept_standard_v1)
    table = {r.rule: r for r in quality_rules.ablation(rows, quality_rules.STANDARD).collect()}
    mask = quality_rules.STANDARD.mask
    for rule in quality_rules.RULES:
        assert table[rule.name].n_failed == sum(bool(r.failures >> rule.bit & 1) for r in both)
        assert table[rule.name].n_failed_alone == sum(r.failures & mask == 1 << rule.bit for r in both)
    kept = quality_rules.kept_rows(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in both if r.kept_standard_v1)


def test_repeated_words():
    draw = random.Random(1)
    for _ in range(300):
        words = [draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randint(0, 40))]
        assert quality_rules.repeated_words(words) == repeated_by_hand(words)


def test_classifier_on_held_out_rows(spark):
    got = op3_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = got.filter("held_out and quality is not null").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_classifier_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(1, 19)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(quality_classifier.labelled_rows(edge, labels, F.lit(True)))
    scores = quality_classifier.scores(edge, model).collect()
    assert len(scores) == edge.count() and all(0 <= r.score <= 1 for r in scores)
    empty = {r.score for r in scores if r.doc_id in (5, 6)}
    assert len(empty) == 1
    assert quality_classifier.scores(nothing, model).count() == 0
    kept = quality_classifier.kept_rows(edge, model, 0.3)
    assert kept.columns == edge.columns and kept.count() == sum(r.score >= 0.3 for r in scores)
    one_class = quality_classifier.fit(quality_classifier.labelled_rows(edge, labels.filter("quality = 1"), F.lit(True)))
    assert all(r.score > 0.9 for r in quality_classifier.scores(edge, one_class).collect())
    none = quality_classifier.fit(quality_classifier.labelled_rows(nothing, labels, F.lit(True)))
    assert {round(r.score, 6) for r in quality_classifier.scores(edge, none).collect()} == {0.5}


def test_vocabulary_path_is_a_parameter():
    assert VOCABULARY == public_tokenizers.path("byte_bpe_50k.json")
