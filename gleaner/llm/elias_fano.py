"""Elias-Fano sequences and an n-gram trie built on them.

A monotone sequence of n values below u is stored as its low log2(u / n) bits each, and its high parts as unary gaps in
one bit vector: about two bits a value more than the low bits. A trie is one byte string, read from any buffer, also
from a memory map: its sequences are decoded to arrays when it is opened, its codes are read in place.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np


def pack_sequence(values: np.ndarray) -> bytes:
    """Header (n, low bits, bytes of high part), high part, low part."""
    values = values.astype(np.uint64)
    n = values.size
    top = int(values[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
    high = (values >> np.uint64(low)).astype(np.int64)
    gaps = np.zeros(n + (int(high[-1]) if n else 0) + 1, bool)
    gaps[high + np.arange(n)] = True
    ones = np.packbits(gaps)
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low]
    return struct.pack("<QQQ", n, low, ones.size) + ones.tobytes() + np.packbits(bits.reshape(-1)).tobytes()


def unpack_sequence(buffer, at: int = 0) -> tuple[np.ndarray, int]:
    """The values, and where the next part begins."""
    n, low, size = struct.unpack_from("<QQQ", buffer, at)
    at += 24
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(buffer, np.uint8, size, at)))[:n]
    at += size
    values = (ones - np.arange(n)).astype(np.uint64) << np.uint64(low)
    n_low = -(-n * low // 8)
    if low and n:
        bits = np.unpackbits(np.frombuffer(buffer, np.uint8, n_low, at), count=n * low).reshape(n, low)
        wide = np.zeros((n, 64), np.uint8)
        wide[:, :low] = bits
        values |= np.packbits(wide, axis=1, bitorder="little").view("<u8").reshape(-1)
    return values, at + n_low


#: Codes of a probability: FINE for each halving down to 2^-KNEE, COARSE for each further one, down to 2^-64, and the
#: code of probability zero. So a logarithm errs by 2^-12 halvings or by a share of 5e-5, whichever is more.
FINE, COARSE, KNEE = 2048, 409, 24
ZERO = 65535


def quantised(probability: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        halvings = -np.log2(probability)
    code = np.round(np.minimum(halvings, KNEE) * FINE + np.maximum(halvings - KNEE, 0) * COARSE)
    return np.where(probability > 0, np.minimum(code, ZERO - 1), ZERO).astype("<u2")


def probability(code: np.ndarray) -> np.ndarray:
    steps = code.astype(np.float64)
    halvings = np.minimum(steps / FINE, KNEE) + np.maximum(steps - KNEE * FINE, 0) / COARSE
    return np.where(code == ZERO, 0.0, np.exp2(-halvings))


@dataclass(frozen=True)
class Level:
    """Nodes of one order: ``pointers`` cut them by parent; ``sums`` are their ids, made monotone over all parents."""

    pointers: np.ndarray
    sums: np.ndarray
    codes: np.ndarray

    def base(self, parent: np.ndarray) -> np.ndarray:
        """What the ids below a parent are raised by: the last sum before its range."""
        first = self.pointers[parent].astype(np.int64)
        return np.where(first > 0, self.sums[np.maximum(first - 1, 0)], 0)

    def find(self, parent: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The nodes of ``ids`` below ``parent``, or -1: the successor of the raised id, if it is equal and in range."""
        if not self.sums.size:
            return np.full(parent.size, -1, np.int64)
        first, stop = self.pointers[parent].astype(np.int64), self.pointers[parent + 1].astype(np.int64)
        target = self.base(parent) + ids.astype(np.uint64) + np.uint64(1)
        at = np.searchsorted(self.sums, target)
        hit = (at >= first) & (at < stop) & (self.sums[np.minimum(at, self.sums.size - 1)] == target)
        return np.where(hit, at, -1)


def pack_level(parents: np.ndarray, ids: np.ndarray, n_parents: int, codes: np.ndarray) -> bytes:
    """Of nodes sorted by (parent, id). Ids are raised by one, so that sums grow strictly."""
    pointers = np.searchsorted(parents, np.arange(n_parents + 1))
    raised = ids.astype(np.uint64) + np.uint64(1)
    last = raised[np.maximum(pointers[1:] - 1, 0)] * (pointers[1:] > pointers[:-1]) if ids.size else np.zeros(n_parents, np.uint64)
    before = np.r_[np.uint64(0), np.cumsum(last.astype(np.uint64))[:-1]] if n_parents else np.zeros(0, np.uint64)
    sums = raised + before[parents] if ids.size else raised
    return pack_sequence(pointers) + pack_sequence(sums) + struct.pack("<Q", codes.size) + codes.astype("<u2").tobytes()


def unpack_level(buffer, at: int) -> tuple[Level, int]:
    pointers, at = unpack_sequence(buffer, at)
    sums, at = unpack_sequence(buffer, at)
    n = struct.unpack_from("<Q", buffer, at)[0]
    return Level(pointers, sums, np.frombuffer(buffer, "<u2", n, at + 8)), at + 8 + 2 * n
