"""Scoring of a finished run with the five measures, and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import metrics
from gleaner.operators.models import Step
from gleaner.operators.prompts import PASSAGE_BREAK, REGENERATE_TEMPLATE, fill
from gleaner.operators.vectors import cosine
from gleaner.sources.scratch import materialize


def rule_regenerate(df: DataFrame) -> DataFrame:
    """Stand-in: the sentences of the answer take the place of regenerated questions."""
    return df.withColumn("reply", F.col("response"))


def _vectors(texts: DataFrame, key: list[str], text: str, embed: Step | None) -> DataFrame:
    if embed is None:
        return metrics.text_vectors(texts, key, text)
    return embed(texts.select(*key, F.col(text).alias("text"))).select(*key, "vector")


def evaluate(results: DataFrame, judge: Step | None = None, regenerate: Step = rule_regenerate,
             embed: Step | None = None) -> tuple[DataFrame, DataFrame]:
    """``(scores, skipped)`` of result records: id, question and the five measures.

    Samples are written once, so the run behind ``results`` is not computed again per measure.
    """
    samples, skipped = metrics.eval_samples(results)
    samples = materialize(samples, "samples")
    told = samples.select("id", "response", "reference", "user_input", "retrieved_contexts",
                          F.array_join("retrieved_contexts", PASSAGE_BREAK).alias("context"))
    of_answer = metrics.statements(told, "response")
    of_reference = metrics.statements(told, "reference")

    faithfulness = metrics.verdict_share(metrics.verdicts(of_answer, told, "context", judge), "faithfulness")
    recall = metrics.verdict_share(metrics.verdicts(of_reference, told, "context", judge), "context_recall")
    passages = told.select(
        "id", F.col("reference").alias("statement"), F.posexplode("retrieved_contexts").alias("pos", "evidence")
    )
    precision = metrics.context_precision(
        metrics.judged(passages, judge or metrics.rule_judge).select("id", (F.col("pos") + 1).alias("rank"), "verdict")
    )
    asked = regenerate(told.withColumn("prompt", fill(REGENERATE_TEMPLATE, answer=F.col("response"))))
    relevancy = metrics.answer_relevancy(
        _vectors(told, ["id"], "user_input", embed),
        _vectors(metrics.statements(asked, "reply"), ["id", "statement_no"], "statement", embed),
    )
    right = _vectors(told, ["id"], "response", embed).withColumnRenamed("vector", "other")
    alike = _vectors(told, ["id"], "reference", embed).join(right, "id").select(
        "id", cosine(F.col("vector"), F.col("other")).alias("similarity")
    )
    correctness = metrics.answer_correctness(
        metrics.verdicts(of_answer, told, "reference", judge),
        metrics.verdicts(of_reference, told, "response", judge), alike,
    ).select("id", "answer_correctness")
    return metrics.score_table(samples, faithfulness, relevancy, precision, recall, correctness), skipped
