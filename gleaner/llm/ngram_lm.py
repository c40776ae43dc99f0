"""An n-gram language model whose every part is bounded: counts by shard of keys, one compact trie for each block.

Documents are cut into blocks of about ``BLOCK_BYTES`` where they lie, and a block is stored once, as the sorted keys of
its words and a word number for each token, in a table bucketed by block: no text is shuffled. A block counts its n-grams
and sends each shard of the key space its sorted keys as an Elias-Fano sequence; a shard adds up all blocks and answers
each with the totals, in the order asked. Words are asked for first, and the answer also tells which of them other blocks
hold. An n-gram with a word that no other block holds is in no other block either: its total is the block's own count, and
only the others are asked for. With the totals a block builds the part of the model that it needs, an Elias-Fano trie of its n-grams: monotone pointers, ids
relative to the context, quantised conditional probabilities. Its texts are scored through this trie: context nodes are
found level by level, each by a successor search within the range of its parent. So counts cover the whole corpus, but
no task, nor the driver, ever holds its vocabulary or the model, and nothing is broadcast.

An n-gram of a longer order is named relative to its context: by the place of its last word among the successors of
the context without its first word. This needs a suffix-closed trie, which counts of one corpus give.

Probabilities: the unigram is add-one over the training vocabulary and one unknown word. Order n interpolates the
relative frequency r with order n - 1, with weight w * c / (c + ``DAMPING``) for a context of count c. The weight w is
not fitted but averaged over: a text's probability is the mean of its probabilities under each of ``WEIGHTS``.

Tokens: A-Z lower-cased, cut at ASCII white space, then one end, also a token. Contexts of a text's first word have a
start symbol, which is no token. Keys are 64-bit hashes. Defined results: a null text is empty and has one token, the
end; repeated rows count and are scored each; without training rows every count is zero. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bucketed, slices, texts, total_bytes, written
from gleaner.llm.elias_fano import ZERO, Level, pack_level, pack_sequence, probability, quantised, unpack_level, unpack_sequence

BLOCK_BYTES = 6 << 20
WEIGHTS = (0.0, 0.05, 0.2, 0.5, 0.8, 0.95)
DAMPING = 2.0
END, START = b"\n", b"\r"  # no word holds white space
MEMO = 500_000


class Keys(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = key = xxhash.xxh64_intdigest(word)
        return key


def joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their context and last word."""
    x = (context * np.uint64(0x9E3779B97F4A7C15)) ^ (word + np.uint64(0xD1B54A32D192ED03))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def tokenised(text: bytes, keys: Keys) -> np.ndarray:
    """Keys of a text's tokens."""
    words = text.lower().split()
    words.append(END)
    return np.fromiter(map(keys.__getitem__, words), np.uint64, len(words))


def numbered(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of each token's key among them, and the number of tokens of each text."""
    words, token = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_inverse=True)
    return words, token.astype(np.int32), np.array([part.size for part in parts], np.int64)


class Block:
    """The n-grams of some texts: for each order the sorted distinct keys and which of them ends at each token."""

    def __init__(self, found: list[str], order: int) -> None:
        keys = Keys()
        self.fill(*numbered([tokenised(text.encode("utf-8", "surrogatepass"), keys) for text in found]), order)

    @classmethod
    def stored(cls, row: dict, order: int) -> Block:
        block = cls.__new__(cls)
        sizes = np.array(row["sizes"], np.int64)
        block.fill(unpack_sequence(row["words"])[0], restored(row["tokens"], np.int32, int(sizes.sum())), sizes, order)
        return block

    def fill(self, words: np.ndarray, token: np.ndarray, sizes: np.ndarray, order: int) -> None:
        keys = Keys()
        self.end, self.start, self.sizes = keys[END], keys[START], sizes
        self.document = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)
        self.first = np.zeros(token.size, bool)
        self.first[np.cumsum(sizes) - sizes] = True
        self.keys, self.at = [words], [token]
        # the key of the n tokens that end at a token, starts filled in
        own = key = words[token]
        for n in range(1, order):
            # the n tokens before this one, then this one
            previous = np.r_[np.uint64(self.start), key[:-1]] if key.size else key
            previous[self.first] = padded(self.start, n)
            key = joined(previous, own)
            distinct, at = np.unique(key, return_inverse=True)
            self.keys.append(distinct)
            self.at.append(at.astype(np.int32))

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        weight = train[self.document]
        return [np.bincount(at, weights=weight, minlength=keys.size).astype(np.uint32) for keys, at in zip(self.keys, self.at, strict=True)]


def padded(start: int, n: int) -> np.uint64:
    """The key of n start symbols."""
    key = np.array([start], np.uint64)
    for _ in range(n - 1):
        key = joined(key, np.array([start], np.uint64))
    return key[0]


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that zero bytes compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(values.size, values.itemsize).T).tobytes()


def unplaned(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def squeezed(values: np.ndarray) -> bytes:
    return pa.compress(planes(values), codec="zstd", asbytes=True)


def restored(raw: bytes, kind, n: int) -> np.ndarray:
    return unplaned(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True) if n else b"", kind)


def stored_blocks(rows: DataFrame, n_buckets: int) -> DataFrame:
    """block, doc_ids, trained, sizes (tokens), words (their sorted keys), tokens (a word each): the texts in blocks."""
    most = BLOCK_BYTES

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys = TaskContext.get().partitionId() << 32, Keys()
        ids, trained, parts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            words, token, sizes = numbered(parts)
            return pa.RecordBatch.from_pylist([{
                "block": number, "doc_ids": ids, "trained": trained, "sizes": sizes.tolist(), "words": pack_sequence(words), "tokens": squeezed(token),
            }], schema=BLOCK_ARROW)

        for batch in batches:
            for part in slices(batch, 4 << 20):
                columns = part.column("doc_id").to_pylist(), part.column("train").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()
                for doc_id, train, text in zip(*columns, strict=True):
                    ids.append(doc_id)
                    trained.append(train)
                    parts.append(tokenised(text, keys))
                    size += len(text) + 1
                    if size >= most:
                        yield block()
                        number, ids, trained, parts, size = number + 1, [], [], [], 0
        if ids:
            yield block()

    found = rows.select(F.col("doc_id").cast("long"), "text", "train").mapInArrow(
        store, "block long, doc_ids array<long>, trained array<boolean>, sizes array<long>, words binary, tokens binary")
    return bucketed(found, "ngram-blocks", "block", n_buckets)


BLOCK_ARROW = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("trained", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())),
    ("words", pa.binary()), ("tokens", pa.binary())])
QUESTION_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int64()), ("totals", pa.binary()), ("n_distinct", pa.int64()), ("n_tokens", pa.int64())])
QUESTION, ANSWER = "shard int, block long, keys binary, counts binary", "shard int, block long, totals binary, n_distinct long, n_tokens long"


def edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard of the key space begins in sorted keys, and their end."""
    starts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.r_[0, np.searchsorted(keys, starts), keys.size]


def ask(number: int, keys: list[np.ndarray], counts: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """What a block asks of every shard for which it has keys: those of each level, and its training counts."""
    cuts, out = [edges(k, bits) for k in keys], []
    for shard in range(1 << bits):
        parts = [slice(cut[shard], cut[shard + 1]) for cut in cuts]
        if any(part.stop > part.start for part in parts):
            base = np.uint64(shard << (64 - bits))
            out.append({
                "shard": shard, "block": number, "keys": b"".join(pack_sequence(k[part] - base) for k, part in zip(keys, parts, strict=True)),
                "counts": squeezed(np.concatenate([c[part] for c, part in zip(counts, parts, strict=True)]))})
    return pa.RecordBatch.from_pylist(out, schema=QUESTION_ARROW)


def answered(questions: DataFrame, levels: int, shared: bool = False) -> DataFrame:
    """shard, block, totals in the order asked, and n_distinct and n_tokens of the shard's first level. With ``shared``
    totals are doubled, and one is added where several blocks ask."""

    def answer(rows: pa.Table) -> pa.Table:
        keys = [[] for _ in range(levels)]
        counts = [[] for _ in range(levels)]
        for raw, given in zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist(), strict=True):
            at = 0
            for level in keys:
                sequence, at = unpack_sequence(raw, at)
                level.append(sequence)
            cut = np.cumsum([level[-1].size for level in keys])
            for level, part in zip(counts, np.split(restored(given, np.uint32, int(cut[-1])), cut[:-1]), strict=True):
                level.append(part)
        totals, known = [], (0, 0)
        for k, (asked, own) in enumerate(zip(keys, counts, strict=True)):
            distinct, at = np.unique(np.concatenate(asked), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate(own), minlength=distinct.size).astype(np.uint64)
            told = total << np.uint64(1) | (np.bincount(at, minlength=distinct.size) > 1).astype(np.uint64) if shared else total
            totals.append(np.split(told[at], np.cumsum([part.size for part in asked])[:-1]))
            known = known if k else (int((total > 0).sum()), int(total.sum()))
        n = rows.num_rows
        packed = [squeezed(np.concatenate(parts)) for parts in zip(*totals, strict=True)]
        return pa.table([rows.column("shard"), rows.column("block"), packed, [known[0]] * n, [known[1]] * n], schema=ANSWER_ARROW)

    return questions.groupBy("shard").applyInArrow(answer, ANSWER)


def received(answers: pa.Table, keys: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The totals of the keys that a block asked for, by level."""
    cuts = [edges(k, bits) for k in keys]
    totals = [np.zeros(k.size, np.uint64) for k in keys]
    for shard, raw in zip(answers.column("shard").to_pylist(), answers.column("totals").to_pylist(), strict=True):
        ends = np.cumsum([cut[shard + 1] - cut[shard] for cut in cuts])
        for total, cut, part in zip(totals, cuts, np.split(restored(raw, np.uint64, int(ends[-1])), ends[:-1]), strict=True):
            total[cut[shard]:cut[shard + 1]] = part
    return totals


def unsettled(block: Block, shared: np.ndarray) -> list[np.ndarray]:
    """For each level from 2 on, which n-grams other blocks may hold: those of words that are all ``shared``."""
    alone = ~shared[block.at[0]]
    out, hit = [], alone
    for level in range(1, len(block.keys)):
        before = np.r_[False, hit[:-1]] if hit.size else hit
        before[block.first] = False
        hit = alone | before
        there = np.ones(block.keys[level].size, bool)
        there[block.at[level][hit]] = False
        out.append(there)
    return out


def build_trie(block: Block, totals: list[np.ndarray], n_tokens: int, n_words: int) -> bytes:
    """The levels of a block's n-grams. Level 1 is the vocabulary, with add-one probabilities; its last node is the
    start symbol, a context only. A node of level n hangs below the node of its context, and its code is the relative
    frequency of its last word there. N-grams without a training count are left out from level 2 on."""
    n = block.keys[0].size
    unigram = (totals[0] + 1.0) / (n_tokens + n_words + 1.0)
    out = pack_level(np.zeros(n + 1, np.int64), np.arange(n + 1), 1, np.append(quantised(unigram), ZERO))
    token, starts = block.at[0].astype(np.int64), block.first
    ends = float(totals[0][np.searchsorted(block.keys[0], np.uint64(block.end))]) if n else 0.0
    # The node in which the context of each token ends, level by level; -1 where it has none.
    node = np.r_[n, token[:-1]] if token.size else token
    node = np.where(starts, n, node)
    context_count = np.append(totals[0], ends)
    suffix_level: tuple[np.ndarray, np.ndarray] | None = None
    for level in range(1, len(block.keys)):
        seen = np.zeros(block.keys[level].size, np.int64)
        seen[block.at[level][::-1]] = np.arange(token.size)[::-1]  # where an n-gram is first
        grams = np.flatnonzero((totals[level] > 0) & (node[seen] >= 0))
        seen = seen[grams]
        word = token[seen]
        if suffix_level is not None:  # the place among the successors of the shorter context
            pointers, of_token = suffix_level
            shorter = of_token[seen]
            word = shorter - pointers[shorter]
        order = np.argsort(node[seen] << 32 | word, kind="stable")
        grams, seen, word = grams[order], seen[order], word[order]
        parent = node[seen]
        count = totals[level][grams].astype(float)
        out += pack_level(parent, word, context_count.size, quantised(count / np.maximum(context_count[parent], count)))
        here = np.full(block.keys[level].size, -1, np.int64)
        here[grams] = np.arange(grams.size)
        own = here[block.at[level]]
        begin = np.searchsorted(parent, np.arange(context_count.size + 1))
        suffix_level = (begin[parent], own)
        context_count = count
        node = np.r_[-1, own[:-1]] if own.size else own
        node = np.where(starts, -1, node)
    return out


def open_trie(buffer, order: int) -> list[Level]:
    levels, at = [], 0
    for _ in range(order):
        level, at = unpack_level(buffer, at)
        levels.append(level)
    return levels


def text_scores(block: Block, trie: list[Level], totals: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text of the block under the trie's model."""
    token, starts = block.at[0].astype(np.int64), block.first
    n = block.keys[0].size
    unigram, orders = probability(trie[0].codes[token]), []
    node = np.where(starts, n, np.r_[n, token[:-1]] if token.size else token)
    ends = float(totals[0][np.searchsorted(block.keys[0], np.uint64(block.end))]) if n else 0.0
    count = np.append(totals[0], ends).astype(float)
    shorter_node, shorter = None, None
    for level in range(1, len(trie)):
        known = node >= 0
        ids = token.copy()
        if shorter is not None:
            known &= shorter >= 0
            ids = shorter - trie[level - 1].pointers[np.maximum(shorter_node, 0)].astype(np.int64)
        own = np.full(token.size, -1, np.int64)
        # equal questions are asked once
        pair, back = distinct_pairs(node[known], ids[known])
        own[known] = trie[level].find(pair[0], pair[1])[back]
        r = np.where(own >= 0, probability(trie[level].codes[np.maximum(own, 0)]) if trie[level].codes.size else 0.0, 0.0)
        c = np.where(node >= 0, count[np.maximum(node, 0)] if count.size else 0.0, 0.0)
        orders.append((r, c / (c + DAMPING)))
        # counts of this level's nodes, for the next one's contexts
        grams = np.zeros(trie[level].codes.size)
        there = own >= 0
        grams[own[there]] = totals[level][block.at[level][there]]
        shorter_node, shorter, count = node, own, grams
        node = np.where(starts, -1, np.r_[-1, own[:-1]] if own.size else own)
    sums = np.zeros((len(WEIGHTS), block.sizes.size))
    for i, weight in enumerate(WEIGHTS):
        p = unigram
        for r, trust in orders:
            share = weight * trust
            p = share * r + (1 - share) * p
        sums[i] = np.bincount(block.document, weights=np.log10(p), minlength=block.sizes.size)
    top = sums.max(axis=0)
    return top + np.log10(np.mean(10.0 ** (sums - top), axis=0))


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of small non-negative integers, sorted, and where each pair is."""
    both, back = np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)
    return np.stack([both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)]).astype(np.int64), back


def scored(docs: DataFrame, train: Column, order: int = 2) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score (add-one unigram), score of every row."""
    rows = texts(docs, F.coalesce(train, F.lit(False)).alias("train"))
    n_blocks = max(1, -(-total_bytes(rows) // BLOCK_BYTES))
    # A shard of n-grams answers about two blocks' worth of keys. Words are fewer.
    bits = max(0, (n_blocks - 1).bit_length() - 1)
    word_bits = max(0, bits - 3)
    # Fewer buckets than shuffle partitions would make Spark shuffle the blocks after all.
    blocks = stored_blocks(rows, min(max(n_blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 100_000))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in each(batch)):
            block = Block.stored(row, 1)
            yield ask(row["block"], block.keys, block.counts(np.array(row["trained"], bool)), word_bits)

    def words_known(row: dict, answers: pa.Table) -> tuple[Block, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """A block, its training counts, the totals of its words, and which longer n-grams it asks for."""
        block = Block.stored(row, order)
        counts = block.counts(np.array(row["trained"], bool))
        told = received(answers, block.keys[:1], word_bits)[0]
        return block, counts, [told >> np.uint64(1)], unsettled(block, told & np.uint64(1) > 0)

    def ask_longer(found: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in each(found):
            block, counts, _, there = words_known(row, answers)
            out.append(ask(row["block"], [k[t] for k, t in zip(block.keys[1:], there, strict=True)], [c[t] for c, t in zip(counts[1:], there, strict=True)], bits))
        return pa.Table.from_batches(out, QUESTION_ARROW)

    answers = written(answered(blocks.mapInArrow(ask_words, QUESTION), 1, shared=True), "ngram-words")
    shards = answers.groupBy("shard").agg(F.max("n_distinct").alias("v"), F.max("n_tokens").alias("n"))
    size = shards.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_words, n_tokens = size["v"], size["n"]
    answers = answers.select("block", "shard", "totals")
    every = answers.withColumn("longer", F.lit(False))
    if order > 1:
        longer = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask_longer, QUESTION)
        longer = written(answered(longer, order - 1), "ngram-totals").select("block", "shard", "totals")
        every = every.union(longer.withColumn("longer", F.lit(True)))

    def score(found: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in each(found):
            is_longer = answers.column("longer")
            block, counts, by_level, there = words_known(row, answers.filter(pc.invert(is_longer)))
            asked = [k[t] for k, t in zip(block.keys[1:], there, strict=True)]
            if asked:
                for own, t, total in zip(counts[1:], there, received(answers.filter(is_longer), asked, bits), strict=True):
                    by_level.append(own.astype(np.uint64))
                    by_level[-1][t] = total
            trie = open_trie(memoryview(build_trie(block, by_level, n_tokens, n_words)), order)
            c = by_level[0][block.at[0]].astype(float)
            n = block.sizes.size
            out.append(pa.table([
                pa.array(row["doc_ids"], pa.int64()), pa.array(row["trained"], pa.bool_()), block.sizes,
                np.bincount(block.document, weights=c > 0, minlength=n).astype(np.int64), np.full(n, n_tokens, np.int64),
                np.bincount(block.document, weights=np.log10((c + 1) / (n_tokens + n_words + 1)), minlength=n),
                text_scores(block, trie, by_level),
            ], schema=SCORE_ARROW))
        return pa.concat_tables(out) if out else SCORE_ARROW.empty_table()

    return blocks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(
        score, "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


SCORE_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64())])


def each(found: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    """Stored blocks one at a time."""
    for i in range(found.num_rows):
        yield found.slice(i, 1).to_pylist()[0]
