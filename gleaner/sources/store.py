"""The chunk store: Parquet, one folder per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.batch import pending

# A large source is written as many files, not as one.
ROWS_PER_FILE = 1_000_000


def _by_source(chunks: DataFrame) -> DataFrame:
    """One row per content id, gathered by source for writing. Rebalancing splits a dominant source over several
    tasks and joins small ones, so neither one huge task nor a file per task and source results."""
    return chunks.dropDuplicates(["chunk_id"]).withColumn("source_key", F.coalesce("source", F.lit("?"))).hint(
        "rebalance", F.col("source_key")
    )


def _writer(chunks: DataFrame, mode: str):
    return (
        _by_source(chunks).write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("source_key")
    )


def write_store(chunks: DataFrame, path: str) -> None:
    """Replaces the sources present in ``chunks`` and leaves the others, so a repeated run with the
    same input adds nothing. The source stays a column next to the folder key."""
    _writer(chunks, "overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_store(chunks: DataFrame, path: str) -> None:
    """Adds the chunks whose content id is not stored yet."""
    known = read_store(chunks.sparkSession, path, "chunk_id")
    _writer(pending(chunks, known, "chunk_id"), "append").parquet(path)


def read_store(spark: SparkSession, path: str, *columns: str, sources: list[str] | None = None) -> DataFrame:
    """Chosen columns of the store; named sources prune the other folders."""
    stored = spark.read.parquet(path)
    if sources:
        stored = stored.filter(F.col("source_key").isin(sources))
    return stored.select(*columns) if columns else stored.drop("source_key")


def source_listing(chunks: DataFrame) -> DataFrame:
    return chunks.select("source").distinct().orderBy("source")
