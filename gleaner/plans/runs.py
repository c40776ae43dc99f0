"""Whole runs: a resumable question batch, and replies to chats."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.config import DEFAULT, RetrievalConfig
from gleaner.operators.batch import pending, result_rows
from gleaner.operators.prompts import last_message, reply_envelope
from gleaner.plans.agent import AgentSteps, ask_in_rounds
from gleaner.plans.retrieve import Corpus
from gleaner.sources.records import append_results, read_results
from gleaner.sources.scratch import materialize


def open_questions(questions: DataFrame, results_path: str) -> DataFrame:
    """Questions without a record in the results folder; all of them where there is no folder yet."""
    try:
        done = read_results(questions.sparkSession, results_path).select("id")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return questions
    return pending(questions, done, "id")


def run_pending(questions: DataFrame, corpus: Corpus, results_path: str, steps: AgentSteps = AgentSteps(),
                cfg: RetrievalConfig = DEFAULT) -> int:
    """Answers the open ``questions(id, question, reponse_attendue)`` and appends their records.

    Returns how many were answered. An interrupted batch leaves no record and is asked again, and so is a question
    whose model call failed to the last try, in any step; its reason is appended to ``<results_path>-failed``.
    """
    todo = materialize(open_questions(questions, results_path), "todo")
    count = todo.count()
    if count == 0:
        return 0
    start = time.monotonic()
    asked = todo.select(F.col("id").alias("query_id"), "question")
    answers, pool = ask_in_rounds(asked, corpus, steps, cfg)
    answers = materialize(answers, "answers")
    failed = answers.filter("answer is null").select(F.col("query_id").alias("id"), "failed")
    if not failed.isEmpty():
        failed.write.mode("append").json(f"{results_path.rstrip('/')}-failed")
    answers = answers.filter("answer is not null")
    count = answers.count()
    if count == 0:
        return 0
    append_results(result_rows(todo, answers, pool, time.monotonic() - start), results_path)
    return count


def reply_to_chats(chat: DataFrame, corpus: Corpus, model: str, reply_id: str, created: int,
                   steps: AgentSteps = AgentSteps(), cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """``(conv_id, body)``: the newest message of each ``chat(conv_id, turn, role, text)`` answered. A chat whose model
    calls failed has a NULL body."""
    asked = last_message(chat).select(F.col("conv_id").alias("query_id"), "question")
    answers, _ = ask_in_rounds(asked, corpus, steps, cfg)
    body = reply_envelope(F.col("answer"), model, reply_id, F.lit(created))
    return answers.select(F.col("query_id").alias("conv_id"), F.when(F.col("answer").isNotNull(), body).alias("body"))
