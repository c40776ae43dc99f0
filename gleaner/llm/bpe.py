"""Byte-level BPE by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can't be merged over: where a text has it, a cut is certain.
A table of all 65,536 pairs marks such places at once for a whole text; the fragments between them are encoded
independently, each distinct fragment once for each task while a bounded memo holds it, and their ids are concatenated.

A cut must also leave the pre-tokenizer's pattern alone, so a place is used only if it lies between characters, the
character before it is no white space (the pattern looks ahead behind white space) and none of the apostrophes that
may open a contraction follows. Strings of special tokens are taken out first, as the tokenizers library does.

Defined results: a null text is empty; an empty text has no ids and decodes to the empty text; texts are whole and of
any length (a fragment without a forced cut is merged in n log n steps).
"""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
import tiktoken
from tokenizers import pre_tokenizers

#: White space of the pattern below, as Unicode defines it.
WHITE = r"\x09-\x0d\x20\x85\xa0  -     　"
#: The pre-tokenizer's pattern of byte-level vocabularies, with the white space class spelled out.
PLAIN_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
PATTERN = regex.compile(PLAIN_PATTERN)
PRE_TOKENIZER = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
#: Fragments that a worker keeps, of at most ``LONGEST`` bytes each.
MEMO = 600_000
LONGEST = 64
#: Rank of a pair that isn't merged.
NONE = (1 << 62, -1)


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in plain}
    names |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return names


class Fragments(dict):
    """Ids of fragments, as packed 32-bit integers; forgets everything when it holds ``MEMO`` of them."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, fragment: bytes) -> bytes:
        ids = np.array(self.encode(fragment), "<i4").tobytes()
        if len(fragment) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[fragment] = ids
        return ids


class Encoder:
    """``fragment_ids`` may encode the text of a fragment in place of this class's own merges."""

    def __init__(self, path: str, fragment_ids=None) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        names, vocab = byte_names(), model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = {i: bytes(names[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.first = [vocab.get(c) for c, _ in sorted(names.items(), key=lambda x: x[1])]
        self.merges = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.cuts = self.cut_table(t for i, t in self.bytes_of.items() if i not in self.special.values())
        self.around = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memo = Fragments(fragment_ids and (lambda raw: fragment_ids(raw.decode())) or self.encode_fragment)
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.decimal = [str(i) for i in range(len(self.table))]

    @staticmethod
    def cut_table(tokens) -> np.ndarray:
        """For each byte pair 1: cut between; 2: cut if the first byte ends a two-byte letter; 0: don't."""
        inside = np.zeros((256, 256), bool)
        for token in tokens:
            raw = np.frombuffer(token, np.uint8)
            inside[raw[:-1], raw[1:]] = True
        table = (~inside).astype(np.uint8)
        table[:, 0x80:0xC0] = 0
        table[:, ord("'")] = 0
        table[:0x21] = table[0xC0:] = 0
        table[0x7F:0xC0] *= 2
        return table.reshape(-1)

    def fragments(self, raw: bytes) -> list[bytes]:
        data = np.frombuffer(raw, np.uint8)
        if data.size < 2:
            return [raw] if raw else []
        kind = self.cuts[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        at = np.flatnonzero(kind)
        unsure = kind[at] == 2
        if unsure.any():
            # Two-byte characters from U+00C0 on hold no white space; of others the last byte doesn't tell.
            lead = data[np.maximum(at - 1, 0)]
            at = at[~unsure | (at > 0) & (lead >= 0xC3) & (lead < 0xE0)]
        ends = (at + 1).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], [*ends, len(raw)], strict=True)]

    def encode_fragment(self, fragment: bytes) -> list[int]:
        if fragment.isalpha() or fragment[:1] == b" " and fragment[1:].isalpha():
            return self.merged(fragment)  # one word of ASCII letters
        text = fragment.decode()
        # Which code points are letters or numbers depends on the Unicode of the library, so it cuts all but ASCII.
        words = PATTERN.findall(text) if fragment.isascii() else (text[i:j] for _, (i, j) in PRE_TOKENIZER.pre_tokenize_str(text))
        return list(chain.from_iterable(self.merged(word.encode()) for word in words))

    def merged(self, word: bytes) -> list[int]:
        """Merge the pair of the lowest rank, leftmost first, until none is left."""
        ids, merges = [self.first[b] for b in word], self.merges
        n = len(ids)
        if n <= LONGEST:
            ranks = [merges.get(pair, NONE)[0] for pair in zip(ids, ids[1:], strict=False)]
            while ranks and (least := min(ranks)) != NONE[0]:
                i = ranks.index(least)
                ids[i:i + 2] = [merges[ids[i], ids[i + 1]][1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = merges.get((ids[i - 1], ids[i]), NONE)[0]
                if i < len(ranks):
                    ranks[i] = merges.get((ids[i], ids[i + 1]), NONE)[0]
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(merge[0], i) for i in range(n - 1) if (merge := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] is None or j >= n:
                continue
            merge = merges.get((ids[i], ids[j]))
            if merge is None or merge[0] != rank:  # one of the two has changed since
                continue
            ids[i], ids[j] = merge[1], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if merge := merges.get((ids[i], ids[k])):
                    heapq.heappush(queue, (merge[0], i))
            if (h := before[i]) >= 0 and (merge := merges.get((ids[h], ids[i]))):
                heapq.heappush(queue, (merge[0], h))
        return [i for i in ids if i is not None]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as 32-bit integers."""
        if self.around is None or not any(token in text for token in self.special):
            return np.frombuffer(b"".join(map(self.memo.__getitem__, self.fragments(text.encode()))), "<i4")
        packed: list[bytes] = []
        for part in self.around.split(text):
            if part in self.special:
                packed.append(np.array([self.special[part]], "<i4").tobytes())
            elif part:
                packed += map(self.memo.__getitem__, self.fragments(part.encode()))
        return np.frombuffer(b"".join(packed), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def as_decimal(self, ids: np.ndarray) -> str:
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None = None) -> Encoder:
    """One encoder for each worker process. ``ranks``: the same vocabulary as ranks, for a library to encode fragments."""
    if ranks is None:
        return Encoder(path)
    with open(ranks, "rb") as file:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    library = tiktoken.Encoding("fragments", pat_str=PLAIN_PATTERN, mergeable_ranks=table, special_tokens={})
    return Encoder(path, library.encode_ordinary)
