"""Packing token sequences as a cutting-stock problem, by column generation.

A document's ids are cut into full sequences and one rest. Rests are binned by length; a pattern says how many rests
of each class one sequence holds. The linear program over patterns starts from one pattern for each class; a knapsack
by dynamic programming prices new patterns from the duals, until none can pay. Patterns are rounded down to whole
sequences, and what remains of the histogram is packed first-fit decreasing. Rests are then ranked within their class,
on Spark, and a rank names its pattern, the copy of the pattern and the place in it.

The program sees only the histogram, which has at most ``len(CLASSES)`` entries whatever the input; documents never
leave Spark. Ranks come from counts of (class, salt), so a class that holds most rests is counted and numbered in parts.

Classes are exact up to 64 tokens and then 64 for each doubling, so at most 1/64 of a rest's length is padding.

Defined results: a null text is empty and has one id, the end; repeated rows are packed each on its own; an empty
table gives no pieces. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.bpe import encoder
from gleaner.llm.common import per_batch, small, texts, written

LENGTH = 2048
END = 1
#: Rests that one part of a class holds about when ranks are given.
PART = 4_096


def class_lengths(length: int = LENGTH, exact: int = 64) -> np.ndarray:
    """The largest length of each class, ascending; the last is ``length``."""
    sizes, step, at = list(range(1, min(exact, length) + 1)), 1, exact
    while at < length:
        sizes += range(at + step, min(2 * at, length) + 1, step)
        at, step = 2 * at, 2 * step
    return np.array(sorted({*sizes, length}), np.int64)


def size_class(rest, length: int = LENGTH, exact: int = 64):
    """Index of the class of a column of lengths: exact below, then counted from the start of the doubling."""
    out, base, at, step = F.when(rest <= exact, rest - 1), exact, exact, 1
    while at < length:
        end = min(2 * at, length)
        out = out.when(rest <= end, base + F.ceil((rest - at) / F.lit(step)) - 1)
        base, at, step = base + -(-(end - at) // step), 2 * at, 2 * step
    return out.cast("int")


def pieces(docs: DataFrame, path: str, ranks: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every id of a document, its end included, in one piece."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, rows = encoder(path, ranks), []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.append(own.encode(text), np.int32(END)).astype("<u4")
            for start in range(0, ids.size, length):
                part = ids[start:start + length]
                rows.append((doc_id, start, part.size, zlib.crc32(part.tobytes()), ids.size))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return per_batch(texts(docs), step, ", ".join(f"{n} long" for n in names))


def priced(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest price that fits the capacity, for ascending lengths: an unbounded knapsack."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], item[room] = best[room - 1], -1
        k = fitting[room]
        if k:
            value = best[room - lengths[:k]] + prices[:k]
            i = int(value.argmax())
            if value[i] > best[room] + 1e-12:
                best[room], item[room] = value[i], i
    pattern, room = np.zeros(lengths.size, np.int64), capacity
    while room > 0:
        if item[room] < 0:
            room -= 1
        else:
            pattern[item[room]] += 1
            room -= lengths[item[room]]
    return float(best[capacity]), pattern


def relaxed(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 4e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, for the linear program within ``gap`` of its optimum.

    The prices given to the knapsack lie between the duals and the best dual bound so far, which starts at the share
    of the capacity that a length takes: plain duals swing, and need many times as many patterns."""
    each = capacity // lengths
    patterns, inverse = np.diag(each), np.diag(1.0 / each)
    used = demand / each
    centre = lengths / capacity
    bound = float(demand @ centre)
    waiting = [pattern for pattern, _ in first_fit(lengths, demand.astype(np.int64), capacity)]
    trust = 0.9
    while used.sum() > (1 + gap) * bound:
        duals = inverse.sum(axis=0)
        if waiting:
            pattern = waiting.pop()
        else:
            prices = trust * centre + (1 - trust) * duals
            value, pattern = priced(lengths, prices, capacity)
            if demand @ prices / max(value, 1) > bound:
                bound, centre = float(demand @ prices / max(value, 1)), prices / max(value, 1)
            if pattern @ duals <= 1 + 1e-7:
                if trust < 1e-3:
                    break  # priced at the duals themselves, no pattern pays
                trust *= 0.5
                continue
            trust = min(0.9, 1.5 * trust + 1e-3)
        if pattern @ duals <= 1 + 1e-7:
            continue
        enter = inverse @ pattern
        ratio = np.full(used.size, np.inf)
        can = enter > 1e-9
        ratio[can] = np.maximum(used[can], 0) / enter[can]
        out = int(ratio.argmin())
        used = used - ratio[out] * enter
        used[out] = ratio[out]
        inverse[out] /= enter[out]
        others = np.arange(used.size) != out
        inverse[others] -= np.outer(enter[others], inverse[out])
        patterns[out] = pattern
    return patterns, np.maximum(used, 0)


def first_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """First-fit decreasing of ``left[i]`` rests of ``lengths[i]``: whole sequences filled greedily, equal ones at once."""
    left, out = left.copy(), []
    while left.any():
        pattern, room = np.zeros_like(left), capacity
        for i in np.flatnonzero(left)[::-1]:
            k = min(int(left[i]), room // int(lengths[i]))
            pattern[i], room = k, room - k * int(lengths[i])
            if not room:
                break
        uses = pattern > 0
        times = int((left[uses] // pattern[uses]).min())
        left -= times * pattern
        out.append((pattern, times))
    return out


def plan(lengths: np.ndarray, demand: np.ndarray, capacity: int = LENGTH) -> list[tuple[np.ndarray, int]]:
    """Patterns over the classes and how many sequences follow each; together they hold at least the demand."""
    there = demand > 0
    if not there.any():
        return []
    few, wanted = lengths[there], demand[there]
    patterns, used = relaxed(few, wanted.astype(float), capacity)
    out, left = [], wanted.copy()
    for pattern, times in zip(patterns, np.floor(used + 1e-9).astype(np.int64), strict=True):
        taken = np.minimum(pattern, left // max(times, 1)) if times else pattern  # rounding never takes too much
        if times and taken.any():
            out.append((taken, int(times)))
            left = left - times * taken
    out += first_fit(few, left, capacity)
    full = []
    for pattern, times in out:
        row = np.zeros(lengths.size, np.int64)
        row[there] = pattern
        full.append((row, times))
    return full


def slot_table(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, ranks, rests a sequence, first sequence): which ranks of a class a pattern takes."""
    rows, sequence, taken = [], 0, None
    for pattern, times in patterns:
        taken = np.zeros_like(pattern) if taken is None else taken
        for c in np.flatnonzero(pattern):
            a = int(pattern[c])
            rows.append((int(c), int(taken[c]), a * times, a, sequence))
            taken[c] += a * times
        sequence += times
    return rows


def ranked(rows: DataFrame, key: str, n_largest: int) -> DataFrame:
    """``rank`` from 0 of each row within its key: numbered within (key, salt), moved by the counts of earlier salts."""
    salts = max(1, -(-n_largest // PART))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy(key, "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    moved = written(counts.select(key, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "rank-offsets")
    inside = Window.partitionBy(key, "salt").orderBy("doc_id", "start", "ids_crc32")
    numbered = salted.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(small(moved), [key, "salt"]).withColumn("rank", F.col("before") + F.col("inside")).drop("salt", "before", "inside")


def packed(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """``found`` (pieces of at most ``length`` ids) with sequence_id, offset and padded_length, the sequence's length:
    ``length``, or the ids it holds where they are a power of two."""
    spark = found.sparkSession
    found = written(found, "pieces")
    lengths = class_lengths(length)
    classed = found.withColumn("class", size_class(F.col("length"), length))
    histogram = {r["class"]: r["n"] for r in classed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    demand = np.array([histogram.get(c, 0) for c in range(lengths.size)], np.int64)
    slots = spark.createDataFrame(
        slot_table(plan(lengths, demand, length)), "class int, first_rank long, ranks long, each long, first_sequence long")
    numbered = ranked(classed, "class", int(demand.max(initial=0)))
    at = numbered.join(F.broadcast(slots), "class").filter("rank >= first_rank and rank < first_rank + ranks")
    within = F.col("rank") - F.col("first_rank")
    placed = at.withColumns({"sequence_id": F.expr("first_sequence + (rank - first_rank) div each"), "place": within % F.col("each")})
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "place")
    whole = Window.partitionBy("sequence_id")
    summed = placed.withColumns({
        "offset": F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"),
        "total": F.sum("length").over(whole)})
    power = F.col("total").bitwiseAND(F.col("total") - 1) == 0
    return summed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
        F.when(power, F.col("total")).otherwise(F.lit(length)).cast("long").alias("padded_length"))
