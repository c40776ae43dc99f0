"""Sharding by a two-pass external shuffle: one random order of all rows, cut into shards of equal row counts.

The first pass scatters rows uniformly into piles by a seeded hash of their whole content; the number of piles follows
from the measured bytes, so that a pile fits the memory of a task. The second pass takes one pile at a time, puts its
rows into an order that doesn't depend on the partitioning, shuffles them by Fisher and Yates from a generator seeded
with the pile's number, and writes them. Piles follow one another, so a row's place in the whole order is the count of
rows in earlier piles plus its place in the pile; shards are equal ranges of that order, and at most one row apart.

Texts are shuffled once and written once, as ``shard=K`` folders of Parquet files. The counts of piles come from a scan
before, which is possible because a row's pile depends on its content and number alone. Rows that are equal in every
column would share one pile, and a pile of copies could outgrow memory: of rows whose copies take more than a quarter of
a pile, the copies are counted with map-side combine, numbered from the count, and scattered by number as well.
Neither the order nor the shards depend on how the input is partitioned or on lost executors.

Defined results: a null text has no bytes; rows without a text or an id are rows like any other; repeated rows are each
placed; an empty table gives no rows. All columns are carried inside the struct ``record``, so their names can't clash.
Columns of map type can't be hashed or grouped and aren't supported. A row larger than a pile is a pile by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import BROADCAST_BYTES, scratch_path, small, written

SHARDS = 24
SEED = 11
#: Bytes of texts in a pile, about; a task holds a pile twice.
PILE_BYTES = 32 << 20
#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """record, size and the seeded 64-bit key of a row's whole content."""
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # A null leaves a hash as it is, so whether a column is null is hashed as well.
    key = F.xxhash64(F.lit(seed), *columns, *[c.isNull() for c in columns])
    return docs.select(record.alias("record"), size_of(F.col("text")).alias("size"), key.alias("key"))


def numbered_copies(rows: DataFrame, pile_bytes: int) -> DataFrame:
    """Adds ``copy``: 0, or for rows whose copies take over a quarter of a pile the number of the copy."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    heavy = written(counts.filter((F.col("n") > 1) & (F.col("n") * F.col("size") > pile_bytes // 4)).select("key"), "heavy-rows")
    n_heavy = heavy.count()
    if not n_heavy:
        return rows.withColumn("copy", F.lit(0).cast("long"))
    # Each takes a quarter of a pile at least, so there are at most four for each pile.
    heavy = F.broadcast(heavy) if n_heavy * 16 <= BROADCAST_BYTES else heavy
    copies = rows.join(heavy, "key", "left_semi").groupBy("record", "size", "key").agg(F.count(F.lit(1)).alias("n"))
    spread = copies.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    alone = rows.join(heavy, "key", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    return alone.unionByName(spread.select(*alone.columns))


def with_pile(rows: DataFrame, piles: int, seed: int) -> DataFrame:
    return rows.withColumn("pile", F.pmod(F.xxhash64(F.lit(seed), "key", "copy"), F.lit(piles)).cast("int"))


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of n places."""
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist(), strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shuffled_piles(rows: DataFrame, seed: int) -> DataFrame:
    """``record`` and ``position``: each pile in shuffled order, its rows numbered from ``start``, the place of the pile."""

    def shuffle(pile: pa.Table) -> pa.Table:
        key, copy = (pile.column(name).to_numpy() for name in ("key", "copy"))
        # Rows of one key and copy are equal, so their order doesn't matter.
        at = np.lexsort((copy, key))[fisher_yates(pile.num_rows, np.random.default_rng([seed, pile.column("pile")[0].as_py()]))]
        positions = pa.array(pile.column("start")[0].as_py() + np.arange(pile.num_rows), pa.int64())
        return pile.select(["record"]).take(pa.array(at)).append_column("position", positions)

    return rows.groupBy("pile").applyInArrow(shuffle, T.StructType([rows.schema["record"], T.StructField("position", T.LongType())]))


def shard_of(position: Column, n: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a position in an order of n rows: the first n % shards shards hold one row more."""
    least, more = divmod(n, shards)
    border = more * (least + 1)
    wide, narrow = F.lit(least + 1).cast("long"), F.lit(max(least, 1)).cast("long")
    past = position - border
    first = position < border
    shard = F.when(first, F.floor(position / wide)).otherwise(more + F.floor(past / narrow))
    return shard.cast("int"), F.when(first, position % wide).otherwise(past % narrow).cast("long")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, pile_bytes: int = PILE_BYTES) -> None:
    """Writes all rows of ``docs`` (with a column ``text``) under ``path`` as folders ``shard=K``, each row a ``record``
    with its ``slot`` in the shard."""
    rows = numbered_copies(keyed(docs, seed), pile_bytes)
    total = docs.agg(F.coalesce(F.sum(size_of(F.col("text"))), F.lit(0)).alias("bytes")).first()["bytes"]
    rows = with_pile(rows, max(1, -(-total // pile_bytes)), seed)
    # One row for each pile: a few thousand for each TB.
    before = Window.orderBy("pile").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(rows.groupBy("pile").agg(F.count(F.lit(1)).alias("n")), "pile-counts")
    starts = counts.select("pile", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    starts = written(starts, "pile-starts")
    shard, slot = shard_of(F.col("position"), n, shards)
    # Where the starts aren't small, the join is partitioned by pile, which is the scatter that the second pass needs.
    placed = shuffled_piles(rows.join(small(starts), "pile"), seed).select("record", slot.alias("slot"), shard.alias("shard"))
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """record, slot, shard of shards written from a table with the columns of ``like``."""
    return spark.read.schema(T.StructType().add("record", like.schema).add("slot", T.LongType()).add("shard", T.IntegerType())).parquet(path)


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, pile_bytes: int = PILE_BYTES) -> DataFrame:
    """``docs`` written as shards in the shared folder, read back: record, slot, shard."""
    path = scratch_path(docs.sparkSession, "shards")
    write_shards(docs, path, shards, seed, pile_bytes)
    return read_shards(docs.sparkSession, path, docs)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of shards read back."""
    text = F.col("record.text")
    return found.select(
        F.col("record.doc_id").alias("doc_id"), size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
