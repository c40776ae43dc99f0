"""Hashed stand-in vectors and exact nearest-neighbour search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.config import DEFAULT, RetrievalConfig
from gleaner.functions.words import coded, slices
from gleaner.operators.lexical import top_k, with_sources
from gleaner.sources.scratch import materialize, scratch_path

# Vectors that others are placed by, and the sample they are chosen from.
PIVOTS = 64
PIVOT_SAMPLE = 4096
# Vectors of one cell that are met or skipped together.
TILE = 256


def term_bucket(term: str, dim: int) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim


def _counted(dim: int, key: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of ``(key, norm)``, rows of one key side by side, to batches of ``(key, vector)``."""

    def rows(keys: list[tuple], counts: np.ndarray, types: list[pa.DataType]) -> pa.RecordBatch:
        some = np.flatnonzero(counts.any(axis=1))
        counts = counts[some].astype(np.float64)
        unit = counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        columns = [pa.array([keys[i][n] for i in some], t) for n, t in enumerate(types)]
        vector = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dim, pa.int32()), pa.array(unit.reshape(-1)))
        return pa.RecordBatch.from_arrays([*columns, vector], names=[*key, "vector"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = None, []  # the last key and its counts, which the next slice may add to
        for batch in batches:
            types = [batch.schema.field(c).type for c in key]
            for part in slices(batch, "norm"):
                row, word, terms = coded(part.column("norm"))
                bucket = np.array([term_bucket(t, dim) for t in terms], np.int64)
                counts = np.bincount(row * dim + bucket[word], minlength=part.num_rows * dim).reshape(-1, dim)
                keys = list(zip(*(part.column(c).to_pylist() for c in key)))
                if held is not None:
                    keys, counts = [held[0], *keys], np.vstack([held[1], counts])
                starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
                summed = np.add.reduceat(counts, starts, axis=0)
                held = keys[starts[-1]], summed[-1:]
                yield rows([keys[i] for i in starts[:-1]], summed[:-1], types)
        if held is not None:
            yield rows([held[0]], held[1], types)

    return count


def hashed_vectors(tokens: DataFrame, key: list[str], dim: int = DEFAULT.vector_dim, unique: bool = False) -> DataFrame:
    """``(key, vector)``: unit-length hashed term counts. Rows without a token have no vector.

    Rows of one key are brought side by side and add up while they pass by; where keys are known to be ``unique``, the
    work is narrow.
    """
    told = tokens.select(*key, "norm")
    if not unique:
        told = told.repartition(*key).sortWithinPartitions(*key)
    fields = [*(told.schema[c] for c in key), T.StructField("vector", T.ArrayType(T.DoubleType()))]
    return told.mapInArrow(_counted(dim, key), T.StructType(fields))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def checked_dimension(vectors: DataFrame, dim: int) -> DataFrame:
    """Fails the job on the first vector of another size, instead of ranking nonsense."""
    size = F.size("vector")
    message = F.concat(F.lit(f"vector dimension: expected {dim}, found "), size.cast("string"))
    return vectors.withColumn(
        "vector", F.when(size == dim, F.col("vector")).otherwise(F.raise_error(message))
    )


# Score of a pair that may not be found, below every scaled cosine.
EXCLUDED = -(10**12)


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """The first k entries of every query by descending score, then id."""
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.array([], int)
    position = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = position < k
    return query[keep], score[keep], ids[keep]


def _allowed_sources(rows: list) -> tuple[dict, np.ndarray]:
    """Numbers of the sources that queries name, and which of them (rows; the last: any other) each query may see."""
    names = sorted({s for r in rows for s in r["sources"] or [] if s is not None})
    number = {s: i for i, s in enumerate(names)}
    allowed = np.zeros((len(names) + 1, len(rows)), bool)
    for i, r in enumerate(rows):
        if r["sources"] is None:
            allowed[:, i] = True
        else:
            allowed[[number[s] for s in r["sources"] if s is not None], i] = True
    return number, allowed


def _multiply_block(vectors: DataFrame, rows: list, id_type, k: int, cfg: RetrievalConfig) -> DataFrame:
    """Scores one bounded block of queries against every vector in one pass, each task keeping its own best k.

    Cosines are kept as whole numbers of the last decimal place.
    """
    query_ids = [r["query_id"] for r in rows]
    matrix = np.array([r["vector"] for r in rows], dtype=np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    number, allowed = _allowed_sources(rows)
    restricted = any(r["sources"] is not None for r in rows)
    unit, tile = 10**cfg.score_places, 256
    arrow_id = to_arrow_type(id_type)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.array([], dtype=np.int64)
        best = (none, none, np.array([], dtype=object))
        floor = np.full(len(matrix), EXCLUDED)  # the k-th best score so far, per query
        chunk_type = None
        for batch in batches:
            chunk_type = batch.schema.field("chunk_id").type
            batch = batch.filter(batch.column("vector").is_valid())
            n = batch.num_rows
            if n == 0:
                continue
            ids = np.array(batch.column("chunk_id").to_pylist(), dtype=object)
            order = np.argsort(ids)
            ids = ids[order]
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            data = flat.astype(np.float64).reshape(n, -1)[order]
            length = np.linalg.norm(data, axis=1, keepdims=True)
            data /= np.where(length > 0, length, 1.0)
            # A zero vector has no direction and is never found.
            nowhere = length[:, 0] == 0
            code = np.array([number.get(s, len(number)) for s in batch.column("source").to_pylist()])[order] if restricted else None
            found = [best]
            for lo in range(0, len(matrix), tile):
                score = np.rint(data @ matrix[lo : lo + tile].T * unit).astype(np.int64)
                score[nowhere] = EXCLUDED
                if restricted:
                    score[~allowed[code, lo : lo + tile]] = EXCLUDED
                if n > k:
                    # Score and place in id order in one number: no ties, so the cut is exact even
                    # where many copies share a score.
                    single = score * n + np.arange(n - 1, -1, -1)[:, None]
                    row = np.argpartition(single, n - k, axis=0)[n - k :]
                else:
                    row = np.repeat(np.arange(n)[:, None], score.shape[1], axis=1)
                col = np.broadcast_to(np.arange(row.shape[1]), row.shape)
                value = score[row, col]
                keep = (value > EXCLUDED) & (value >= floor[col + lo])
                found.append((col[keep] + lo, value[keep], ids[row[keep]]))
            best = _best(*(np.concatenate(part) for part in zip(*found)), k)
            counts = np.bincount(best[0], minlength=len(matrix))
            lowest = np.full(len(matrix), np.iinfo(np.int64).max)
            np.minimum.at(lowest, best[0], best[1])
            floor = np.where(counts >= k, lowest, EXCLUDED)
        if chunk_type is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([query_ids[q] for q in best[0]], type=arrow_id),
                    pa.array(list(best[2]), type=chunk_type),
                    pa.array(best[1] / unit, type=pa.float64()),
                ],
                names=["query_id", "chunk_id", "score"],
            )

    schema = T.StructType(
        [
            T.StructField("query_id", id_type),
            T.StructField("chunk_id", vectors.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return vectors.select("chunk_id", "source", "vector").mapInArrow(search, schema)


@dataclass(frozen=True)
class PivotTable:
    """``rows(chunk_id, source, vector, cell, radius)``: each vector with the nearest of ``pivots`` and its distance to
    it, both of unit length; sorted by them, so that neighbours lie together."""

    rows: DataFrame
    pivots: np.ndarray


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1.0)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def choose_pivots(vectors: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """``n`` vectors far from each other, out of a sample of ``sample`` by the hash of their ids. The choice decides how
    much a search may skip, never what it finds."""
    some = vectors.select("chunk_id", "vector").filter(F.exists("vector", lambda v: v != 0))
    rows = some.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    points = _unit(np.array([r["vector"] for r in rows], np.float64))
    chosen, nearest_one = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(n, len(points)) and nearest_one.max() > 1e-6:
        chosen.append(int(nearest_one.argmax()))
        nearest_one = np.minimum(nearest_one, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def placed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The vectors that have a direction with their cells, sorted. A vector without one is never found."""
    rows = vectors.select("chunk_id", "source", F.col("vector").cast("array<double>").alias("vector")).filter(
        F.exists("vector", lambda v: v != 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = _distances(_unit(_matrix(batch.column("vector"), batch.num_rows)), pivots)
                cell = away.argmin(axis=1)
                columns = [*batch.columns, pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cell", "radius"])

    fields = [*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())]
    # Written first: the range exchange samples its input, and would multiply every vector with the pivots twice.
    found = materialize(rows.mapInArrow(place, T.StructType(fields)), "placed")
    return found.repartitionByRange("cell", "radius", "chunk_id").sortWithinPartitions("cell", "radius", "chunk_id")


def pivoted(vectors: DataFrame, n: int = PIVOTS) -> PivotTable:
    """A pivot table of the vectors, written."""
    pivots = choose_pivots(vectors, n)
    return PivotTable(materialize(placed(vectors, pivots), "pivoted"), pivots)


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * points @ others.T, 0))


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Row ranges of a sorted batch with one cell each, of ``TILE`` rows at most."""
    cell = batch.column("cell").to_numpy()
    edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        for low in range(start, end, TILE):
            yield low, min(low + TILE, end)


class _Best:
    """The k best chunks of each query so far, and the score of the last of them."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        none = np.array([], dtype=np.int64)
        self.n, self.k, self.found, self.waiting, self.size = n, k, (none, none, np.array([], dtype=object)), [], 0
        self.start = self.floor = floor

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((query, score, ids))
        self.size += len(query)
        if self.size > 4 * self.n * self.k + 100_000:
            self.settle()

    def settle(self) -> None:
        self.found = _best(*(np.concatenate(part) for part in zip(self.found, *self.waiting, strict=True)), self.k)
        self.waiting, self.size = [], 0
        counts = np.bincount(self.found[0], minlength=self.n)
        lowest = np.full(self.n, np.iinfo(np.int64).max)
        np.minimum.at(lowest, self.found[0], self.found[1])
        self.floor = np.maximum(self.start, np.where(counts >= self.k, lowest, EXCLUDED))


def _search_block(table: PivotTable, rows: list, id_type, k: int, cfg: RetrievalConfig, floors: dict | None = None) -> DataFrame:
    """Scores one bounded block of queries, each task keeping its own best k; cosines are whole numbers of the last
    decimal place. Without ``floors`` a query meets the cell of its nearest pivot only; with them it meets every tile
    whose distances to its pivot leave room for a vector as near as its floor says.

    For a tile with radii from r to R around pivot p, a vector is at least max(d - R, r - d) from a query at distance d
    of p. ``pairs`` and ``met`` count the (query, vector) pairs of a task and those that were multiplied.
    """
    query_ids = [r["query_id"] for r in rows]
    queries = _unit(np.array([r["vector"] for r in rows], dtype=np.float64))
    number, allowed = _allowed_sources(rows)
    restricted = any(r["sources"] is not None for r in rows)
    unit, arrow_id, pivots = 10**cfg.score_places, to_arrow_type(id_type), table.pivots
    first = floors is None
    least = np.array([EXCLUDED if first else floors.get(q, EXCLUDED) for q in query_ids])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(pivots):  # no vector has a direction
            return
        away = _distances(queries, pivots)
        own_cell = away.argmin(axis=1)
        best, chunk_type, pairs, met = _Best(len(queries), k, least), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk_type = batch.schema.field("chunk_id").type
            ids = np.array(batch.column("chunk_id").to_pylist(), dtype=object)
            data = _unit(_matrix(batch.column("vector"), batch.num_rows))
            cell, radius = batch.column("cell").to_numpy(), batch.column("radius").to_numpy()
            code = np.array([number.get(s, len(number)) for s in batch.column("source").to_pylist()]) if restricted else None
            for low, high in _cells(batch):
                pairs += (high - low) * len(queries)
                at = cell[low]
                if first:
                    wanted = np.flatnonzero(own_cell == at)
                else:
                    gap = np.maximum(np.maximum(away[:, at] - radius[low:high].max(), radius[low:high].min() - away[:, at]), 0)
                    # The highest score at that distance, with room for rounding.
                    wanted = np.flatnonzero((1 - gap * gap / 2) * unit + 2 >= best.floor)
                if not len(wanted):
                    continue
                met += (high - low) * len(wanted)
                score = np.rint(data[low:high] @ queries[wanted].T * unit).astype(np.int64)
                keep = score >= best.floor[wanted]
                if restricted:
                    keep &= allowed[code[low:high]][:, wanted]
                row, column = np.nonzero(keep)
                best.add(wanted[column], score[row, column], ids[low:high][row])
            best.settle()
        if chunk_type is not None:
            query, score, chunk = best.found
            n = len(query)
            yield pa.RecordBatch.from_arrays([
                pa.array([*(query_ids[q] for q in query), None], type=arrow_id), pa.array([*chunk, None], type=chunk_type),
                pa.array(np.r_[score / unit, np.nan]), pa.array([*[None] * n, pairs], pa.int64()), pa.array([*[None] * n, met], pa.int64()),
            ], names=["query_id", "chunk_id", "score", "pairs", "met"])

    schema = T.StructType([
        T.StructField("query_id", id_type), T.StructField("chunk_id", table.rows.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType()), T.StructField("pairs", T.LongType()), T.StructField("met", T.LongType()),
    ])
    return table.rows.mapInArrow(search, schema)


def nearest(queries: DataFrame, vectors: DataFrame | PivotTable, k: int | None = None,
            cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """``(query_id, chunk_id, rank, score)``: the k most similar vectors by cosine, exactly."""
    return nearest_with_share(queries, vectors, k, cfg)[0]


def nearest_with_share(queries: DataFrame, vectors: DataFrame | PivotTable, k: int | None = None,
                       cfg: RetrievalConfig = DEFAULT) -> tuple[DataFrame, float]:
    """``nearest``, and the share of the (query, vector) pairs that bounds left out.

    A block of queries meets a plain table in one pass, which is less than building a pivot table would take. More
    queries are dealt into blocks of about half of ``query_block``, by a hash of their id, and the table is given
    pivots once. One block after the other is read by the driver, sent to the tasks as a matrix, and its results are
    written before the next is read, so the driver holds one block however many there are. With pivots a block takes
    two passes: the first looks into one cell for each query and gives the score that its k-th result reaches at least,
    the second skips tiles by that.
    """
    k = k or cfg.k_retrieve
    spark = queries.sparkSession
    queries = with_sources(queries).select("query_id", "sources", "vector").filter(F.exists("vector", lambda v: v != 0))
    id_type = queries.schema["query_id"].dataType
    head = queries.limit(cfg.query_block + 1).collect()
    if not head:
        source = vectors.rows if isinstance(vectors, PivotTable) else vectors
        return queries.limit(0).select(
            "query_id", F.lit(None).cast(source.schema["chunk_id"].dataType).alias("chunk_id"),
            F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("score")), 0.0
    if len(head) <= cfg.query_block:
        if not isinstance(vectors, PivotTable):
            found = _multiply_block(vectors, head, id_type, k, cfg)
            return top_k(found, k).select("query_id", "chunk_id", "rank", "score"), 0.0
        blocks = iter([head])
    else:
        del head
        queries = materialize(queries, "queries")
        parts = 2 * (-(-queries.count() // cfg.query_block))
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts).cast("long"))
        blocks = (queries.filter(part == b).collect() for b in range(parts))
    table = vectors if isinstance(vectors, PivotTable) else pivoted(vectors)
    path, schema, pairs, met, unit = scratch_path(spark, "nearest"), None, 0, 0, 10**cfg.score_places
    for rows in filter(None, blocks):
        near = _search_block(table, rows, id_type, k, cfg).filter("chunk_id is not null")
        seen = top_k(near, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        floors = {r["query_id"]: round(r["least"] * unit) for r in seen.filter(F.col("n") == k).collect()}
        found = materialize(_search_block(table, rows, id_type, k, cfg, floors), "found")
        counts = found.agg(F.sum("pairs").alias("pairs"), F.sum("met").alias("met")).first()
        pairs, met = pairs + (counts["pairs"] or 0), met + (counts["met"] or 0)
        ranked = top_k(found.filter("chunk_id is not null"), k).select("query_id", "chunk_id", "rank", "score")
        schema = ranked.schema
        ranked.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path), 1 - met / max(pairs, 1)
