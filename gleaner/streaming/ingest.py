"""Incremental ingest: new page files become chunks as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.batch import pending
from gleaner.operators.chunking import split_pages
from gleaner.sources.pages import spread


def ingest_stream(spark: SparkSession, pages_path: str, schema: str, store_path: str, checkpoint: str,
                  prepare: Callable[[DataFrame], DataFrame] = lambda pages: pages,
                  chunk: Callable[[DataFrame], DataFrame] = split_pages,
                  key: str = "chunk_id", files_per_batch: int = 1000, keep_keys: bool = True) -> StreamingQuery:
    """Starts a stream over Parquet page files that ends when all present files are read.

    Each batch overwrites its own folder, so a repeated batch changes nothing; rows already stored by an earlier batch
    are left out by key. With ``keep_keys`` Spark's state store holds the keys, so a batch looks up its own keys and
    reads nothing that was stored; the default store keeps them in memory, a session with the RocksDB provider
    (``spark.sql.streaming.stateStore.providerClass``) on disk. A ``chunk`` that needs window functions or an action,
    such as one with a model step, can't run inside a stream: without ``keep_keys`` each batch is chunked as a plain
    table and compared with the keys of the store. A checkpoint belongs to one of the two.
    """
    pages = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pages_path)
    )

    def written(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{store_path}/batch_id={batch_id}")

    def compared(batch: DataFrame, batch_id: int) -> None:
        fresh = chunk(prepare(spread(batch)))
        if batch_id > 0:
            stored = batch.sparkSession.read.parquet(store_path)
            fresh = pending(fresh, stored.filter(stored.batch_id < batch_id), key)
        written(fresh.dropDuplicates([key]), batch_id)

    if keep_keys:
        started = chunk(prepare(pages)).dropDuplicates([key]).writeStream.foreachBatch(written)
    else:
        started = pages.writeStream.foreachBatch(compared)
    return started.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
