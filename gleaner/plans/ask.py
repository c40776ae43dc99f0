"""Grounded answers: retrieval, prompt, model, refusal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.models import Step, problem
from gleaner.operators.prompts import ANSWER_TEMPLATE, REFUSAL, assemble_context, fill


def first_passage_answer(df: DataFrame) -> DataFrame:
    """Stand-in for a generator: the best passage itself."""
    return df.withColumn("reply", F.col("best_passage"))


def answer(queries: DataFrame, retrieved: DataFrame, generate: Step = first_passage_answer,
           template: str = ANSWER_TEMPLATE) -> DataFrame:
    """``(query_id, question, prompt, answer, n_passages, failed)`` for every query.

    Queries without a passage get the fixed refusal and cost no model call. Where the model failed to the last try,
    the answer is NULL and ``failed`` says why.
    """
    asked = queries.select("query_id", "question").join(assemble_context(retrieved), "query_id", "left")
    asked = asked.withColumn("n_passages", F.coalesce("n_passages", F.lit(0)))
    # The context goes in last, so marks inside a passage stay as they are.
    prompt = fill(template, question=F.col("question"), context=F.col("context"))
    found = generate(asked.filter("n_passages > 0").withColumn("prompt", prompt))
    answered = found.withColumn("failed", problem(found, "answer")).select(
        "query_id", "question", "prompt", F.col("reply").alias("answer"), "n_passages", "failed")
    refused = asked.filter("n_passages = 0").select(
        "query_id", "question", F.lit(None).cast("string").alias("prompt"),
        F.lit(REFUSAL).alias("answer"), "n_passages", F.lit(None).cast("string").alias("failed"),
    )
    return answered.unionByName(refused)
