"""Alignment of two tokenizers over one corpus by inverted pair bitmaps.

Both tokenizers cut the same bytes. Where a token of each ends at one byte, the two are linked, and the tokens between
two such places form a group. A task takes a block of documents, aligns their distinct words once, deals the alignments
back to the documents by arrays, and inverts the links: for each id pair it writes planes of bitmaps over the block's documents. Plane i
holds the documents whose number of links of the pair has bit i set, so the planes' union is the documents that hold the
pair, and their counts, weighed by powers of two, are its links. A bitmap is a sorted array of 16-bit numbers, or packed
bits where that is smaller.

Counts of a pair are popcounts of its planes in each block, added up on Spark. Blocks are disjoint, so document counts add
up too, and ``merged`` ORs planes that hold parts of one block. The highest count of each id of the second tokenizer
follows from them. Scores go back through the postings: each pair's count is joined to its bitmaps, and one group for each
block adds it to the documents whose bits are set. Only pairs and bitmaps are shuffled, never texts or single links. A
pair of many blocks is joined in parts of at most ``PART`` of them.

Blocks hold at most ``BLOCK_DOCS`` documents and about ``BLOCK_BYTES`` of text, so that all work in a task is bounded but
for a single long text, whose distinct pairs can't exceed its tokens. A longer block changes no result.

Defined results: a null or empty text has no tokens, and neither has a text that one of the tokenizers doesn't give back
(space and text), such as one that holds U+2581: zeros, and the empty string in place of the digest. Strings of special
tokens are plain text. Repeated rows count each; null ids are kept; an empty table gives no rows. Other columns are
ignored, whatever their names. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.bpe import PLAIN_PATTERN, WHITE, encoder
from gleaner.llm.common import slices, small, texts, written

BLOCK_DOCS = 1 << 16
BLOCK_BYTES = 8 << 20
#: Blocks of one pair that are joined in one part.
PART = 4096
#: A pair of ids is ``a << PAIR_BITS | b``.
PAIR_BITS = 20

#: White space at an end, runs of it that hold a space and more, and the sign that pieces use for a space.
RUNS = rf"\A[{WHITE}]|[{WHITE}]\z|[{WHITE}] | [{WHITE}]|▁"

DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Tokenizer:
    """Ids of whole texts as an array, and the bytes that each id stands for.

    ``encode`` takes texts that follow one another with a space between them: a long text may be given in parts, where
    neither tokenizer merges over such a space."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], table: list[bytes]) -> None:
        self.encode, self.table = encode, table
        self.lengths = np.array([len(raw) for raw in table], np.int64)

    def ids(self, parts: list[str], raw: bytes) -> np.ndarray | None:
        """Ids of a text in parts whose tokens join to ``raw``; None if they don't."""
        ids = list(chain.from_iterable(self.encode(parts)))
        return np.array(ids, np.int64) if b"".join(map(self.table.__getitem__, ids)) == raw else None


@lru_cache(maxsize=2)
def byte_tokenizer(path: str, ranks: str) -> Tokenizer:
    """The byte-level vocabulary, given space and text, with special strings as plain text."""
    with open(ranks, "rb") as file:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    library = tiktoken.Encoding("pairs", pat_str=PLAIN_PATTERN, mergeable_ranks=merges, special_tokens={})
    return Tokenizer(lambda parts: [library.encode_ordinary(" " + part) for part in parts], encoder(path, ranks).table)


@lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> Tokenizer:
    """The sentence pieces, which put a space before a text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Tokenizer(lambda parts: model.encode(parts, num_threads=1), table)


@lru_cache(maxsize=2)
def decimals(first: int, second: int) -> pa.Array:
    """The decimal ids of both sides, each followed by what comes behind it: a comma inside a side of a group, a bar
    after the first side, a semicolon after the group. Four tables in a row."""
    return pa.array([f"{i}{mark}" for n, marks in ((first, ",|"), (second, ",;")) for mark in marks for i in range(n)])


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two ascending lists of ends, with the same last end, at which both have the same end."""
    at = np.searchsorted(b, a)
    same = b[at] == a
    return np.flatnonzero(same), at[same]


def marked_ids(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, first: Tokenizer, second: Tokenizer) -> pa.Array:
    """The parts of ``a1,a2|b1;a3|b2,b3;`` in order, from the ids of both sides and the last place of each group in them."""
    n, m = len(first.table), len(second.table)
    mark_a, mark_b = a.copy(), b + 2 * n
    mark_a[last_a] += n
    mark_b[last_b] += m
    # Before a token lie the earlier ones of its side, and the other side of all groups that come first.
    place_a, place_b = np.arange(a.size), np.arange(b.size)
    order = np.empty(a.size + b.size, np.int64)
    order[place_a + np.r_[0, last_b + 1][np.searchsorted(last_a, place_a)]] = mark_a
    order[place_b + (last_a + 1)[np.searchsorted(last_b, place_b)]] = mark_b
    return decimals(n, m).take(pa.array(order))


def aligned(parts: list[str], first: Tokenizer, second: Tokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids of both sides and the places of the last token of each group, for a text in parts between single spaces;
    None for a text without tokens."""
    if parts == [""]:
        return None
    raw = "".join(f" {part}" for part in parts).encode()
    a = first.ids(parts, raw)
    b = second.ids(parts, raw) if a is not None else None
    if b is None:
        return None
    return a, b, *shared_ends(np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b]))


def concatenated(parts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all strings in a row, and where each begins and the last ends."""
    offsets = np.frombuffer(parts.buffers()[1], "<i4", len(parts) + 1, 4 * parts.offset)
    return memoryview(parts.buffers()[2] or b""), offsets


@dataclass
class Links:
    """Per text the tokens on both sides, the links and the digest of the groups; and all links as (pair, text)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    pairs: np.ndarray
    texts: np.ndarray


def of_words(texts: pa.Array, first: Tokenizer, second: Tokenizer) -> Links | None:
    """The links of texts whose words lie between single spaces.

    Both tokenizers end a token before a space between two other characters, so the alignment of a text is that of its
    words, one after another. The distinct words are aligned once, as the words of one text, and dealt back by arrays.
    None if a word isn't given back."""
    lists = pc.split_pattern(texts, pattern=" ")
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy()
    spelled = words.to_pylist()
    # Pieces are merged through a queue of the whole text, which is slow for a long one.
    found = aligned([" ".join(spelled[i:i + 128]) for i in range(0, len(spelled), 128)], first, second)
    if found is None:
        return None
    a, b, last_a, last_b = found
    ends_a, ends_b = np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b])
    ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
    at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    if (ends_a[at_a] != ends).any() or (ends_b[at_b] != ends).any():
        raise ValueError("a token of the vocabularies reaches over a space")
    last = np.searchsorted(last_a, at_a)  # the last group of each word
    counts = [np.diff(x, prepend=-1)[at] for x in (at_a, at_b, last)]
    borders = lists.offsets.to_numpy().astype(np.int64)
    n_a, n_b, n_links = (np.diff(np.r_[0, np.cumsum(c)][borders]) for c in counts)

    # Links of each occurrence of a word: a range of the links of the distinct words.
    repeats = counts[2]
    starts = (last + 1 - np.diff(last, prepend=-1))[at]
    inside = np.arange(repeats.sum()) - np.repeat(np.cumsum(repeats) - repeats, repeats)
    pairs = (a[last_a] << PAIR_BITS | b[last_b])[np.repeat(starts, repeats) + inside]

    data, offsets = concatenated(marked_ids(a, b, last_a, last_b, first, second))
    cuts = offsets[np.r_[0, at_a + at_b + 2]].astype("<i4")
    of_word = pa.StringArray.from_buffers(len(words), pa.py_buffer(cuts.tobytes()), pa.py_buffer(data))
    groups, edges = concatenated(pc.binary_join(pa.ListArray.from_arrays(lists.offsets, of_word.take(coded.indices)), ""))
    digests = [hashlib.sha256(groups[i:j - 1]).hexdigest() for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return Links(n_a, n_b, n_links, digests, pairs, np.repeat(np.arange(len(texts)), n_links))


def of_texts(texts: pa.Array, first: Tokenizer, second: Tokenizer) -> Links:
    """The links of any texts, each aligned at once."""
    rows, pairs = [], [np.zeros(0, np.int64)]
    for text in texts.to_pylist():
        found = aligned([text], first, second)
        if found is None:
            rows.append((0, 0, 0, ""))
            continue
        a, b, last_a, last_b = found
        groups, edges = concatenated(marked_ids(a, b, last_a, last_b, first, second))
        rows.append((a.size, b.size, last_a.size, hashlib.sha256(groups[edges[0]:edges[-1] - 1]).hexdigest()))
        pairs.append(a[last_a] << PAIR_BITS | b[last_b])
    n_a, n_b, n_links = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    return Links(n_a, n_b, n_links, [r[3] for r in rows], np.concatenate(pairs), np.repeat(np.arange(len(rows)), n_links))


def links_of(texts: pa.Array, first: Tokenizer, second: Tokenizer) -> Links:
    """The links of a block of texts: by words where a text has single spaces only, which hardly ever leaves any."""
    simple = ~pc.match_substring_regex(texts, RUNS).to_numpy(zero_copy_only=False)
    simple &= (pc.binary_length(texts).to_numpy() > 0) & (pc.binary_length(texts).to_numpy() <= BLOCK_BYTES)
    by_words = of_words(texts.filter(pa.array(simple)), first, second) if simple.any() else None
    if by_words is None:
        return of_texts(texts, first, second)
    if simple.all():
        return by_words
    others = of_texts(texts.filter(pa.array(~simple)), first, second)
    where = [np.flatnonzero(simple), np.flatnonzero(~simple)]
    order = np.argsort(np.concatenate(where))

    def both(name: str) -> np.ndarray:
        return np.concatenate([getattr(by_words, name), getattr(others, name)])

    digests = by_words.digests + others.digests
    return Links(both("n_a")[order], both("n_b")[order], both("n_links")[order], [digests[i] for i in order.tolist()],
                 both("pairs"), np.concatenate([where[0][by_words.texts], where[1][others.texts]]))


# Bitmaps over the documents of a block: array containers begin with b"a", packed bits with b"b".


def packed(numbers: np.ndarray) -> bytes:
    """The bitmap of ascending numbers below ``BLOCK_DOCS``, in the smaller of two forms."""
    if 16 * numbers.size <= int(numbers[-1]) + 1:
        return b"a" + numbers.astype("<u2").tobytes()
    bits = np.zeros(int(numbers[-1]) + 1, np.uint8)
    bits[numbers] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def unpacked(bitmap: bytes) -> np.ndarray:
    """The ascending numbers of a bitmap."""
    if bitmap[:1] == b"a":
        return np.frombuffer(bitmap, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1), bitorder="little"))


def popcount(bitmap: bytes) -> int:
    if bitmap[:1] == b"a":
        return (len(bitmap) - 1) // 2
    return int(np.bitwise_count(np.frombuffer(bitmap, np.uint8, offset=1)).sum())


def merged(bitmaps: list[bytes]) -> bytes:
    """The OR of bitmaps."""
    if len(bitmaps) == 1:
        return bitmaps[0]
    bits = np.zeros(BLOCK_DOCS, bool)
    for bitmap in bitmaps:
        bits[unpacked(bitmap)] = True
    return packed(np.flatnonzero(bits))


def planes_of(pairs: np.ndarray, ordinals: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Each pair with its planes, from links given as pair and document."""
    key, times = np.unique(pairs << 16 | ordinals, return_counts=True)
    pair, ordinal = key >> 16, key & 0xFFFF
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if pair.size else np.zeros(0, np.int64)
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), pair.size], strict=True):
        own, documents = times[start:end], ordinal[start:end]
        planes = []
        for plane in range(int(own.max()).bit_length()):
            there = documents[(own >> plane & 1) == 1]
            planes.append(packed(there) if there.size else b"a")
        yield int(pair[start]), planes


def block_rows(number: int, doc_ids: pa.Array, texts: pa.Array, first: Tokenizer, second: Tokenizer) -> pa.RecordBatch:
    """A block: rows of its documents (with ordinal), then rows of its pairs (with planes)."""
    found = links_of(texts, first, second)
    postings = list(planes_of(found.pairs, found.texts))
    n, m = len(texts), len(postings)

    def documents(values, kind=None) -> pa.Array:
        return pa.concat_arrays([pa.array(values, kind or pa.int64()), pa.nulls(m, kind or pa.int64())])

    columns = {
        "inverted": pa.array(np.arange(n + m) >= n), "block": pa.array(np.full(n + m, number)),
        "ordinal": documents(np.arange(n, dtype=np.int32), pa.int32()), "doc_id": documents(doc_ids.cast(pa.int64())),
        "n_a": documents(found.n_a), "n_b": documents(found.n_b), "n_groups": documents(found.n_links),
        "n_links": documents(found.n_links), "groups_sha256": documents(found.digests, pa.string()),
        "pair": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([p for p, _ in postings], pa.int64())]),
        "planes": pa.array([*[None] * n, *(planes for _, planes in postings)], pa.list_(pa.binary())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def inverted(docs: DataFrame, path: str, ranks: str, pieces: str) -> DataFrame:
    """Rows of documents and rows of inverted pairs of every block, told apart by ``inverted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = byte_tokenizer(path, ranks), piece_tokenizer(pieces)
        number = TaskContext.get().partitionId() << 32
        for part in (part for batch in batches for part in slices(batch, BLOCK_BYTES)):
            for start in range(0, part.num_rows, BLOCK_DOCS):
                own = part.slice(start, BLOCK_DOCS)
                yield block_rows(number, own.column("doc_id"), own.column("text"), first, second)
                number += 1

    return texts(docs).mapInArrow(run, f"inverted boolean, block long, ordinal int, {DOCS}, pair long, planes array<binary>")


def pair_counts(postings: DataFrame) -> DataFrame:
    """pair, n_docs, n_links, n_blocks: popcounts of the planes and of their union, added up over blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = batch.column("planes").to_pylist()
            links = [sum(popcount(bitmap) << i for i, bitmap in enumerate(own)) for own in planes]
            docs = [popcount(merged(own)) for own in planes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("pair"), pa.array(docs, pa.int64()), pa.array(links, pa.int64())], names=["pair", "n_docs", "n_links"])

    each = postings.select("pair", "planes").mapInArrow(run, "pair long, n_docs long, n_links long")
    return each.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"), F.count(F.lit(1)).alias("n_blocks"))


def with_best(counts: DataFrame) -> DataFrame:
    """Adds ``best``: no other pair of the same id of the second tokenizer has more links."""
    second = F.col("pair").bitwiseAND(F.lit((1 << PAIR_BITS) - 1))
    highest = counts.groupBy(second.alias("b")).agg(F.max("n_links").alias("highest"))
    joined = counts.withColumn("b", second).join(highest, "b")
    return joined.select("pair", "n_docs", "n_links", "n_blocks", (F.col("n_links") == F.col("highest")).alias("best"))


def scored(documents: DataFrame, postings: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents with ``n_best`` and ``count_sum``, added up from the postings of their block."""
    parts = F.ceil(F.col("n_blocks") / F.lit(PART)).cast("int")
    facts = counts.select("pair", "n_links", "best", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = postings.join(small(counts.select("pair", parts.alias("parts")).filter("parts > 1")), "pair", "left").withColumn(
        "part", F.pmod(F.xxhash64("block"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int"))
    n_facts = counts.agg(F.coalesce(F.sum(parts), F.lit(0)).alias("n")).first()["n"]
    weighed = dealt.join(small(facts, n_facts, 32), ["pair", "part"]).select(
        F.col("block").alias("home"), "planes", F.col("n_links").alias("count"), "best")

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        best, total = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
        for planes, count, is_best in zip(*(found.column(c).to_pylist() for c in ("planes", "count", "best")), strict=True):
            for i, bitmap in enumerate(planes):
                numbers = unpacked(bitmap)  # ascending, each once
                total[numbers] += count << i
                if is_best:
                    best[numbers] += 1 << i
        at = own.column("ordinal").to_numpy()
        return own.drop_columns(["block", "ordinal"]).append_column("n_best", pa.array(best[at])).append_column("count_sum", pa.array(total[at]))

    return documents.groupBy("block").cogroup(weighed.groupBy("home")).applyInArrow(score, f"{DOCS}, n_best long, count_sum long")


def alignment(docs: DataFrame, path: str, ranks: str, pieces: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their groups and scores, and the table of pairs (pair, n_docs, n_links, n_blocks, best)."""
    rows = written(inverted(docs, path, ranks, pieces), "pair-bitmaps")
    documents = rows.filter("not inverted").select("block", "ordinal", *(f.split()[0] for f in DOCS.split(", ")))
    postings = rows.filter("inverted").select("block", "pair", "planes")
    counts = written(pair_counts(postings), "pair-counts")
    counts = written(with_best(counts), "pairs")
    return scored(documents, postings, counts), counts
