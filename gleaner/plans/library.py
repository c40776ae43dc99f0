"""A durable corpus that grows: chunks, postings, term statistics and vectors in segments.

Adding chunks tokenises, embeds and writes the new ones only. Statistics are kept so that they add up over segments:
chunks and tokens in the version, per term the number of chunks, and per block of chunks the bounds of its scores. Opening a version sums the vocabulary and reads the other tables as they are; nothing is tokenised or embedded
again. Compaction merges segments of one size class, so their number grows with the logarithm of the corpus.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import DEFAULT, RetrievalConfig
from gleaner.operators import lexical, vectors
from gleaner.operators.batch import pending
from gleaner.operators.models import Step
from gleaner.plans.retrieve import Corpus, id_part
from gleaner.sources import segments
from gleaner.sources.scratch import materialize
from gleaner.sources.segments import Segment, Version

#: Folders that chunks of a segment are kept in by a hash of their id, for lookups of a few winners.
ID_PARTS = 16
#: The pivots' table of a corpus, a row for each.
PIVOTS = "n int, pivot array<double>"
#: Segments of one size class that are merged, and the factor between classes.
FAN = 4


def _schemas(id_type: str) -> dict[str, str]:
    return {
        "chunks": f"chunk_id {id_type}, source string, page int, text string, id_part int",
        "postings": f"chunk_id {id_type}, source string, dl int, term string, tf bigint",
        "terms": "term string, df bigint",
        "bounds": "term string, block int, df bigint, max_tf bigint, min_dl int",
        "embeddings": f"chunk_id {id_type}, source string, vector array<double>, cell int, radius double",
    }


def _tables(spark: SparkSession, root: str, version: Version) -> dict[str, DataFrame]:
    schemas = _schemas(version.settings["id_type"])
    return {name: segments.read_table(spark, root, version, name, schema) for name, schema in schemas.items()}


def _write_chunks(rows: DataFrame, folder: str) -> None:
    rows.hint("rebalance", F.col("id_part")).write.partitionBy("id_part").parquet(f"{folder}/chunks")


def _write_postings(rows: DataFrame, folder: str) -> None:
    """Sorted by (term, chunk): a lookup of a few terms skips the other files and row groups by their statistics."""
    rows.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.parquet(f"{folder}/postings")


def _pivots(spark: SparkSession, root: str, version: Version) -> np.ndarray | None:
    if "pivots" not in version.settings:
        return None
    rows = spark.read.schema(PIVOTS).parquet(f"{root}/segments/{version.settings['pivots']}/pivots").collect()
    return np.array([r["pivot"] for r in sorted(rows, key=lambda r: r["n"])], np.float64).reshape(len(rows), -1)


def _checked(version: Version, wanted: dict) -> None:
    for name, value in wanted.items():
        if version.settings.get(name, value) != value:
            raise ValueError(f"{name} of the stored corpus is {version.settings[name]}, not {value}")


def add_chunks(chunks: DataFrame, root: str, embed: Step | None = None, embedder: str = "hashed",
               cfg: RetrievalConfig = DEFAULT) -> Version:
    """Adds the ``chunks(chunk_id, source, text[, page])`` whose id isn't stored yet, as one segment.

    A rerun adds nothing. ``embedder`` names the vectors' origin; a corpus holds vectors of one origin and size.
    """
    spark = chunks.sparkSession
    if "page" not in chunks.columns:
        chunks = chunks.withColumn("page", F.lit(None).cast("int"))
    id_type = chunks.schema["chunk_id"].dataType.simpleString()
    settings = {"id_type": id_type, "vector_dim": cfg.vector_dim, "embedder": embedder}

    def build(base: Version) -> Version | None:
        _checked(base, settings)
        parts = base.settings.get("id_parts", ID_PARTS)
        fresh = chunks.select("chunk_id", "source", "page", "text").dropDuplicates(["chunk_id"])
        if base.segments:
            fresh = pending(fresh, _tables(spark, root, base)["chunks"], "chunk_id")
        name, folder = segments.new_segment(root)
        _write_chunks(fresh.withColumn("id_part", id_part(parts)), folder)
        rows = spark.read.schema(_schemas(id_type)["chunks"]).parquet(f"{folder}/chunks")
        n_chunks = rows.count()
        if n_chunks == 0:
            return None
        tokens = lexical.tokenized(rows)
        n_tokens = tokens.agg(F.sum("dl").alias("n")).first()["n"]
        placed = lexical.by_chunk(tokens, n_tokens, cfg)
        _write_postings(lexical.postings_of(placed).select("chunk_id", "source", "dl", "term", "tf"), folder)
        postings = spark.read.schema(_schemas(id_type)["postings"]).parquet(f"{folder}/postings")
        lexical.write_bounds(lexical.block_bounds(postings), f"{folder}/bounds")
        bounds = spark.read.schema(_schemas(id_type)["bounds"]).parquet(f"{folder}/bounds")
        bounds.groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{folder}/terms")
        found = vectors.hashed_vectors(tokens, ["chunk_id", "source"], cfg.vector_dim, unique=True) if embed is None else embed(
            rows.select("chunk_id", "source", "text"))
        found = found.select("chunk_id", "source", F.col("vector").cast("array<double>").alias("vector"))
        found = materialize(vectors.checked_dimension(found, cfg.vector_dim), "embedded")
        pivots = _pivots(spark, root, base)
        if pivots is None:
            # All segments are placed by the pivots of the first, so that one search covers them.
            pivots = vectors.choose_pivots(found)
            spark.createDataFrame([(i, p) for i, p in enumerate(pivots.tolist())], PIVOTS).write.parquet(f"{folder}/pivots")
        vectors.placed(found, pivots).write.parquet(f"{folder}/embeddings")
        kept = {**settings, "id_parts": parts, "pivots": base.settings.get("pivots", name)}
        return Version(base.number + 1, (*base.segments, Segment(name, n_chunks, n_tokens)), kept)

    return segments.change(spark, root, build)


def open_corpus(spark: SparkSession, root: str, number: int | None = None, cfg: RetrievalConfig = DEFAULT) -> Corpus:
    """The corpus of a version, by default the last, ready to be searched."""
    version = segments.read_version(spark, root, number)
    if not version.segments:
        raise ValueError(f"no corpus of that version under {root}")
    _checked(version, {"vector_dim": cfg.vector_dim})
    tables = _tables(spark, root, version)
    counts = tables["terms"].groupBy("term").agg(F.sum("df").alias("df"))
    # A reader of one version sums its vocabulary once, however many searches follow.
    terms = lexical.with_idf(materialize(counts, "vocabulary"), version.n_chunks, cfg)
    tokens = lexical.tokenized(tables["chunks"])
    # Bounds of several segments may name a term and block more than once.
    bounds = lexical.summed_bounds(tables["bounds"]) if len(version.segments) > 1 else tables["bounds"]
    index = lexical.LexicalIndex(tokens, terms, version.n_tokens / version.n_chunks, tables["postings"], bounds)
    return Corpus(tables["chunks"], index, tables["embeddings"], version.settings["id_parts"],
                  _pivots(spark, root, version))


def size_class(segment: Segment) -> int:
    return int(math.log(max(segment.n_chunks, 1), FAN))


def to_merge(version: Version, fan: int = FAN) -> tuple[Segment, ...]:
    """Segments of the smallest size class that holds ``fan`` of them or more."""
    classes: dict[int, list[Segment]] = {}
    for segment in version.segments:
        classes.setdefault(size_class(segment), []).append(segment)
    return next((tuple(found) for _, found in sorted(classes.items()) if len(found) >= fan), ())


def merge_segments(spark: SparkSession, root: str, version: Version, chosen: tuple[Segment, ...]) -> Version:
    """Rewrites the chosen segments of a version as one and commits that, unless they are no longer all there.

    Segments added meanwhile stay; earlier versions keep reading the old ones."""
    tables = _tables(spark, root, replace(version, segments=chosen))
    name, folder = segments.new_segment(root)
    _write_chunks(tables["chunks"], folder)
    _write_postings(tables["postings"], folder)
    tables["terms"].groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{folder}/terms")
    lexical.write_bounds(lexical.summed_bounds(tables["bounds"]), f"{folder}/bounds")
    sorted_again = tables["embeddings"].repartitionByRange("cell", "radius", "chunk_id").sortWithinPartitions("cell", "radius", "chunk_id")
    sorted_again.write.parquet(f"{folder}/embeddings")
    merged = Segment(name, sum(s.n_chunks for s in chosen), sum(s.n_tokens for s in chosen))

    def build(base: Version) -> Version | None:
        if not set(chosen) <= set(base.segments):
            return None
        others = tuple(s for s in base.segments if s not in chosen)
        return Version(base.number + 1, (*others, merged), base.settings)

    return segments.change(spark, root, build)


def compact(spark: SparkSession, root: str, fan: int = FAN) -> Version:
    """Merges size classes until none holds ``fan`` segments."""
    version = segments.read_version(spark, root)
    while chosen := to_merge(version, fan):
        version = merge_segments(spark, root, version, chosen)
    return version
