"""Helpers that the operators share: inputs, folds, arrow batches, scratch tables, checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its rows, measured, take no more than this.
BROADCAST_BYTES = 16 << 20
#: Python's ``bytes.split()`` cuts at exactly these six characters.
SPACE = r"[\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or where that is unset a folder in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """Write ``df`` to the shared folder in ``n`` buckets of ``key``, so that grouping by it moves no row of the table."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(n, key).option("path", path).saveAsTable(table, format="parquet")
    return spark.table(table)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of a table that may have any other columns."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a row without an id is in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def small(df: DataFrame, rows: int | None = None, width: int = 24) -> DataFrame:
    """Broadcast hint if the rows of a table of fixed ``width`` fit; otherwise Spark shuffles the join and
    splits skewed keys. ``df`` is counted, so it should be a written table."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * width <= BROADCAST_BYTES else df


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def per_batch(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` of a function of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield step(part)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch of about ``most`` bytes, so that Python objects of one range stay bounded."""
    n = batch.num_rows
    step = n if not n or batch.nbytes <= most else max(1, int(n * most / batch.nbytes))
    for start in range(0, n, max(step, 1)):
        yield batch.slice(start, step)


def spread(df: DataFrame, *keys: str) -> Column:
    """A hash of a row's values for dealing rows out evenly."""
    return F.xxhash64(*(keys or df.columns))


def one_stays(docs: DataFrame, digest: Column, stays: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, digest) is in ``stays`` (doc_id, digest, n); of n > 1 such rows one.

    A null id equals a null id. Both sides are shuffled unless Spark finds one small, so the cost follows the input."""
    keyed = docs.withColumns({"__digest": digest, "__id": F.col("doc_id")})
    on = ["__id", "__digest"]
    several = stays.filter("n > 1")
    n_several = several.count()
    single = stays.filter("n = 1") if n_several else stays

    def match(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        named = right.select(F.col("doc_id").alias("__rid"), F.col("digest").alias("__rdigest"))
        same = left["__id"].eqNullSafe(named["__rid"]) & (left["__digest"] == named["__rdigest"])
        return left.join(named, same, how)

    out = match(keyed, single, "left_semi")
    if n_several:
        out = out.unionByName(match(keyed, several, "left_semi").dropDuplicates(on))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
