"""Steps over Arrow batches and partitions whose memory is bounded."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.config import DEFAULT
from gleaner.functions import words
from gleaner.operators import chunking, lexical, maxscore, vectors


def test_slices_hold_every_row_and_few_bytes():
    texts = ["ab", None, "c" * 50, "", "de", "f" * 9, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    cut = [p.column("t").to_pylist() for p in words.slices(batch, "t", 10)]
    assert [t for part in cut for t in part] == texts
    assert all(len(part) == 1 or sum(len(t or "") for t in part) <= 10 for part in cut)


def test_coded_words_of_empty_and_missing_texts():
    row, word, terms = words.coded(pa.array(["ab cd ab", "", None, "cd"]))
    assert row.tolist() == [0, 0, 0, 3] and [terms[i] for i in word] == ["ab", "cd", "ab", "cd"]


def test_rows_of_one_key_share_a_vector_across_slices(spark, monkeypatch):
    rows = [(None, "s", "ab"), (1, "s", "ab cd"), (1, "s", "ab"), (1, "t", "ab"), (2, "s", ""), (3, "s", None), (None, "s", "ab")]
    tokens = spark.createDataFrame(rows * 3, "chunk_id long, source string, norm string")
    found = vectors.hashed_vectors(tokens, ["chunk_id", "source"], 8).collect()
    expected = {}
    for key, norm in (((r[0], r[1]), r[2]) for r in rows * 3):
        for term in (norm or "").split():
            expected.setdefault(key, np.zeros(8))[vectors.term_bucket(term, 8)] += 1
    assert len(found) == len(expected)
    for r in found:
        n = expected[r.chunk_id, r.source]
        assert r.vector == (n / np.sqrt((n * n).sum())).tolist()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1]), pa.array(["ab", "ab", "cd"])], names=["k", "norm"])
    monkeypatch.setattr(words.slices, "__defaults__", (2,))
    counted = [p for p in vectors._counted(8, ["k"])(iter([batch, batch])) if p.num_rows]
    assert sum(p.num_rows for p in counted) == 1


def test_token_partitions_follow_the_token_text(spark):
    tokens = lexical.tokenized(spark.range(2000).select(
        F.col("id").alias("chunk_id"), F.lit("s").alias("source"), F.repeat(F.lit("mot "), 20).alias("text")))
    placed = lexical.by_chunk(tokens, 40_000, replace(DEFAULT, token_bytes=16_000))
    sizes = [sum(1 for _ in rows) for rows in placed.rdd.glom().collect()]
    assert len(sizes) == 20 and max(sizes) < 200


def test_each_task_passes_on_k_rows_of_a_query(spark):
    rows = spark.range(4000).select(F.lit("q").alias("query_id"), "id", F.hash("id").cast("double").alias("score"))
    scored = rows.withColumnRenamed("id", "chunk_id").repartition(2)
    best = lexical.top_k(scored, 5)
    dealt = scored.withColumn("p", F.spark_partition_id())
    assert dealt.select("p").distinct().count() == 2
    expected = scored.orderBy(F.desc("score"), "chunk_id").limit(5).collect()
    assert [r.chunk_id for r in best.orderBy("rank").collect()] == [r.chunk_id for r in expected]
    assert "xxhash64" not in best._jdf.queryExecution().executedPlan().toString()


def test_lookups_of_few_pairs_exchange_no_postings(spark):
    rows = [(i, "s", " ".join(f"w{j}" for j in range(40) if (i * 7 + j) % (j + 2) == 0) + " alle") for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source string, text string")
    asked = spark.createDataFrame([("q", "w1 w2 w3 w9 alle"), ("r", "w30 w5 alle")], "query_id string, question string")
    index = lexical.build_index(chunks)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = maxscore.search(asked, index, 3)
        plan = found.first._jdf.queryExecution().executedPlan().toString()
        plan += found.scored._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "hashpartitioning(chunk_id" not in "".join(x for x in plan.splitlines() if ", term" in x)


def test_size_split_of_a_batch_in_slices(spark, monkeypatch):
    texts = ["wort " * n for n in (10, 300, 900, 3)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").coalesce(1)
    monkeypatch.setattr(words.slices, "__defaults__", (2000,))
    cut = df.select("id", chunking.size_split(F.col("t")).alias("s"))
    # No pandas UDF (200), which turns a whole batch into Python strings.
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and ", 200" not in plan.split("ArrowEvalPython")[1].splitlines()[0]
    got = {r.id: r.s for r in cut.collect()}
    assert all(got[i] == chunking.split_one(t) for i, t in enumerate(texts) if t)
