import hashlib
import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import token_pairs
from gleaner.llm.queries import PIECES, RANKS, VOCABULARY


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def byte_of():
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows, libraries):
    """The contract token by token, with the libraries and dictionaries."""
    first, second = libraries
    names, docs = byte_of(), []
    for doc_id, text in rows:
        text = text or ""
        whole = (" " + text).encode()
        a = [(i, bytes(names[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in second.encode(text):
            piece = second.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append((doc_id, [], [], []))
            continue
        ends = []
        for side in (a, b):
            at, own = 0, []
            for i, raw in side:
                at += len(raw)
                own.append((at, i))
            ends.append(own)
        places = [dict(own) for own in ends]
        groups, links, left = [], [], [list(own) for own in ends]
        for end in sorted(set(places[0]) & set(places[1])):
            sides = []
            for own in left:
                n = sum(1 for _ in itertools.takewhile(lambda x, end=end: x[0] <= end, own))
                sides.append(",".join(str(i) for _, i in own[:n]))
                del own[:n]
            groups.append("|".join(sides))
            links.append((places[0][end], places[1][end]))
        docs.append((doc_id, [i for i, _ in a], [i for i, _ in b], (groups, links)))
    count = Counter(link for d in docs if d[3] for link in d[3][1])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for doc_id, a, b, found in docs:
        if not found:
            out.append((str(doc_id), 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = found
        out.append((str(doc_id), len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out), count, Counter(link for d in docs if d[3] for link in set(d[3][1]))


def run(docs):
    found, pairs = token_pairs.alignment(docs, VOCABULARY, RANKS, PIECES)
    rows = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    return sorted((str(r[0]), *r[1:]) for r in rows), pairs


ODD = [
    (100, "a ▁ b"), (101, "<|endoftext|> and </s> <unk> <s>"), (102, "café naïve 中文 \U0001f600 ́x"), (103, " 　  x\t\n\r y  "),
    (104, " leading"), (105, "a\x00b\x7f"), (106, "don't I'LL we've 's 't"), (107, "x" * 5000), (108, " "), (109, "\n"),
    (110, "12345 67,890.12"), (111, "՘'s ẞﬁ"), (112, "﻿bom"),
]


def test_edge_rows_equal_brute_force(spark, edge_rows, libraries):
    # The long rows of the fixture are shortened for the brute force only.
    rows = [(r[0], r[1] if r[1] is None else r[1][:4000], 1, 2, "x") for r in edge_rows]
    rows += [(*r, 1, 2, "x") for r in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, n_a int, planes string").repartition(3)
    got, pairs = run(docs)
    want, count, documents = brute([r[:2] for r in rows], libraries)
    assert got == want
    found = {(r.pair >> token_pairs.PAIR_BITS, r.pair & (1 << token_pairs.PAIR_BITS) - 1): r for r in pairs.collect()}
    assert {k: r.n_links for k, r in found.items()} == count
    assert {k: r.n_docs for k, r in found.items()} == documents


def test_whole_table_in_small_blocks(spark, docs_001, libraries, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs_001.filter(F.length("text") < 3000).collect()]
    monkeypatch.setattr(token_pairs, "PART", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got, pairs = run(docs)
    assert got == brute(rows, libraries)[0]
    assert pairs.agg(F.max("n_blocks")).first()[0] > 2


def test_empty_table(spark, nothing):
    got, pairs = run(nothing)
    assert got == [] and pairs.count() == 0


def test_words_equal_whole_texts(libraries):
    """Texts of odd white space, signs and scripts: the same alignment word by word as all at once."""
    rng = np.random.default_rng(2)
    signs = list(" \n\t\r.,'aZéß中😀\u00a0\u200b\u3000ﬁ１Ⅳ0-<") + [" the", " of ", "in", " don't", "'s ", "  ", " x", " y", "z ", "▁"]
    odds = np.r_[np.ones(len(signs) - 1), 0.05]
    texts = ["".join(rng.choice(signs, rng.integers(0, 30), p=odds / odds.sum())) for _ in range(4000)]
    first, second = token_pairs.byte_tokenizer(VOCABULARY, RANKS), token_pairs.piece_tokenizer(PIECES)
    runs = token_pairs.pc.match_substring_regex(token_pairs.pa.array(texts), token_pairs.RUNS).to_pylist()
    assert 300 < runs.count(False) < 3900
    one, other = token_pairs.links_of(token_pairs.pa.array(texts), first, second), token_pairs.of_texts(token_pairs.pa.array(texts), first, second)
    assert one.digests == other.digests and "" in one.digests
    for name in ("n_a", "n_b", "n_links"):
        assert (getattr(one, name) == getattr(other, name)).all()
    assert sorted(zip(one.texts.tolist(), one.pairs.tolist())) == sorted(zip(other.texts.tolist(), other.pairs.tolist()))
    for text, n_a, n_b in zip(texts, one.n_a, one.n_b, strict=True):
        if n_a:
            assert n_a == len(libraries[0].encode(" " + text, add_special_tokens=False).ids) and n_b == len(libraries[1].encode(text))


def test_blocks_of_bytes(spark, docs_001, libraries, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs_001.filter(F.length("text") < 3000).limit(60).collect()]
    ids, texts = (token_pairs.pa.array(c) for c in zip(*rows, strict=True))
    args = token_pairs.byte_tokenizer(VOCABULARY, RANKS), token_pairs.piece_tokenizer(PIECES)
    whole = token_pairs.block_rows(0, ids, texts, *args)
    monkeypatch.setattr(token_pairs, "BLOCK_BYTES", 500)  # longer texts are aligned one by one
    again = token_pairs.block_rows(0, ids, texts, *args)
    assert whole.equals(again)


def test_bitmaps_round_trip_and_merge():
    rng = np.random.default_rng(0)
    for n in (1, 3, 200, 5000, 60_000):
        numbers = np.unique(rng.integers(0, token_pairs.BLOCK_DOCS, n))
        other = np.unique(rng.integers(0, 3000, n))
        for each in (numbers, other):
            bitmap = token_pairs.packed(each)
            assert (token_pairs.unpacked(bitmap) == each).all() and token_pairs.popcount(bitmap) == each.size
        both = token_pairs.merged([token_pairs.packed(numbers), token_pairs.packed(other), b"a"])
        assert (token_pairs.unpacked(both) == np.union1d(numbers, other)).all()


def test_planes_hold_multiplicities():
    links = [(5, 0)] * 3 + [(5, 2)] + [(9, 1)] * 4 + [(9, 2)]
    planes = dict(token_pairs.planes_of(np.array([p for p, _ in links]), np.array([d for _, d in links])))
    assert [token_pairs.unpacked(b).tolist() for b in planes[5]] == [[0, 2], [0]]
    assert [token_pairs.unpacked(b).tolist() for b in planes[9]] == [[2], [], [1]]
