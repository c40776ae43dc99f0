"""Outside models as plan steps: language models, embedders, pair scorers.

A *step* takes a DataFrame and returns it with one more column. Callers inject Python clients;
the ``rule_*`` steps elsewhere are deterministic stand-ins made of Spark expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.batch import pending

Step = Callable[[DataFrame], DataFrame]


def rule(expression: Callable[[], Column], out: str = "reply") -> Step:
    return lambda df: df.withColumn(out, expression())


def attempt(call: Callable[[str], str], prompt: str, retries: int) -> tuple[str | None, str | None]:
    """``retries`` guarded tries and a last one; the error text takes the place of a failed task."""
    problem = None
    for _ in range(retries + 1):
        try:
            return call(prompt), None
        except Exception as e:  # noqa: BLE001 - a client may raise anything
            problem = f"{type(e).__name__}: {e}"
    return None, problem


def model_step(open_client: Callable[[], Callable[[str], str]], retries: int = 3,
               prompt: str = "prompt", out: str = "reply") -> Step:
    """Sends ``prompt`` to a client opened once per task; adds ``out`` and ``<out>_error``."""

    @F.pandas_udf("reply string, error string")
    def invoke(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = open_client()
        for prompts in batches:
            yield pd.DataFrame([attempt(call, p, retries) for p in prompts], columns=["reply", "error"])

    def step(df: DataFrame) -> DataFrame:
        answered = df.withColumn("_answer", invoke(F.col(prompt)))
        return (
            answered.withColumn(out, F.col("_answer.reply"))
            .withColumn(f"{out}_error", F.col("_answer.error"))
            .drop("_answer")
        )

    return step


def problem(df: DataFrame, stage: str, out: str = "reply") -> Column:
    """Why ``stage`` gave no reply, NULL where it gave one."""
    told = F.col(f"{out}_error") if f"{out}_error" in df.columns else F.lit(None).cast("string")
    return F.when(F.col(out).isNull(), F.concat(F.lit(f"{stage}: "), F.coalesce(told, F.lit("no reply"))))


def recorded_step(step: Step, path: str, prompt: str = "prompt", out: str = "reply") -> Step:
    """``step`` behind a ledger of calls under ``path``: ``(digest, reply, error, at)``, one row for each call.

    Equal prompts are paid once, in a run and in later ones; a prompt whose call failed is asked again by the next run,
    and its error stays in the ledger. The ledger is written before the replies are used, so a run that ends early
    resumes behind its last finished step. A NULL prompt gets no call and no reply.
    """
    schema = "digest string, reply string, error string, at timestamp"

    def run(df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        keyed = df.withColumn("_digest", F.sha2(F.col(prompt), 256))
        asked = keyed.select(F.col("_digest").alias("digest"), prompt).filter("digest is not null").dropDuplicates(["digest"])
        spark.createDataFrame([], schema).write.mode("append").parquet(path)
        answered = spark.read.schema(schema).parquet(path).filter("reply is not null")
        told = step(pending(asked, answered, "digest"))
        error = F.col(f"{out}_error") if f"{out}_error" in told.columns else F.lit(None).cast("string")
        told.select("digest", F.col(out).alias("reply"), error.alias("error"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)
        ledger = spark.read.schema(schema).parquet(path)
        # Calls of one prompt combine before their exchange; a reply beats any error, else the last error is told.
        last = ledger.groupBy(F.col("digest").alias("_digest")).agg(
            F.max("reply").alias(out), F.max_by("error", "at").alias(f"{out}_error"))
        found = keyed.join(last, "_digest", "left").drop("_digest")
        return found.withColumn(f"{out}_error", F.when(F.col(out).isNull(), F.col(f"{out}_error")))

    return run


def embed_step(open_embedder: Callable[[], Callable[[list[str]], list[list[float]]]],
               lot: int = 50, text: str = "text", out: str = "vector") -> Step:
    """Embeds ``text`` in lots of ``lot`` with an embedder opened once per task."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = open_embedder()
        for texts in batches:
            rows: list = []
            for lo in range(0, len(texts), lot):
                rows.extend(run(list(texts.iloc[lo : lo + lot])))
            yield pd.Series(rows)

    return lambda df: df.withColumn(out, embed(F.col(text)))


def pair_step(open_scorer: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Step:
    """Scores (question, text) pairs jointly; adds ``pair_score``."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = open_scorer()
        for questions, texts in batches:
            yield pd.Series(run(list(zip(questions, texts))), dtype="float64")

    return lambda df: df.withColumn("pair_score", score("question", "text"))
