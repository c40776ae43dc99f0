"""Resumable runs: what is left to do, result rows, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import or_unknown


def pending(items: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Items whose key is not among the finished ones.

    Finished keys are made distinct first, on the partitioning the join needs anyway, so a key that
    was stored many times does not pile up in one task.
    """
    keys = [key] if isinstance(key, str) else key
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def page_key(source: Column, page: Column, text: Column) -> Column:
    """Identity of a page by content, so that a resumed ingest survives reordering."""
    return F.sha2(F.concat_ws("\u0001", or_unknown(source), or_unknown(page), text), 256)


def unseen_pages(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages not yet ingested, against ``stored(page_key)``."""
    keyed = pages.withColumn("page_key", page_key(F.col("source"), F.col("page"), F.col("text")))
    return pending(keyed, stored, "page_key")


def progress(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One row: total, done, to do."""
    marked = items.select(key).join(
        done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left"
    )
    return marked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_done").isNotNull()).alias("done"),
        F.count_if(F.col("_done").isNull()).alias("to_do"),
    )


def result_rows(questions: DataFrame, answers: DataFrame, pool: DataFrame, seconds: float) -> DataFrame:
    """Result records: one nested row per question with at most five chunks.

    ``questions(id, question, reponse_attendue)``, ``answers(query_id, answer, sources, attempts,
    sufficient)``, ``pool(query_id, rank, source, page, text)``. ``seconds`` is the time of the batch.
    """
    chunks = (
        pool.groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", or_unknown(F.col("source")).alias("source"),
                                                  "page", F.col("text").alias("content")))).alias("rows"))
        .select(
            F.col("query_id").alias("id"),
            F.transform("rows", lambda r: F.struct(r["source"].alias("source"), r["page"].alias("page"),
                                                   r["content"].alias("content"))).alias("chunks"),
        )
    )
    log = F.concat_ws(
        "; ",
        F.concat(F.lit("sources="), F.coalesce(F.array_join("sources", ","), F.lit("*"))),
        F.concat(F.lit("attempts="), F.col("attempts").cast("string")),
        F.concat(F.lit("sufficient="), F.col("sufficient").cast("string")),
    )
    told = answers.select(F.col("query_id").alias("id"), F.col("answer").alias("reponse_llm"), log.alias("logs"))
    return (
        questions.select("id", "question", "reponse_attendue")
        .join(told, "id")
        .join(chunks, "id", "left")
        .select(
            "id", "question", "reponse_attendue", "reponse_llm",
            F.round(F.lit(float(seconds)), 1).alias("duree_secondes"), "logs",
            F.coalesce("chunks", F.array().cast("array<struct<source:string,page:int,content:string>>"))
            .alias("chunks"),
        )
    )
