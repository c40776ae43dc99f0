"""Bounded retrieve, grade, rewrite rounds over all open questions at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import DEFAULT, RetrievalConfig
from gleaner.functions.replies import chosen_sources, grade_verdict, is_sufficient, names_in_text
from gleaner.functions.text import strip, tokenize
from gleaner.operators.fusion import coverage, rerank, rule_pair_score
from gleaner.operators.models import Step, problem
from gleaner.operators.prompts import (
    GRADE_TEMPLATE,
    REWRITE_TEMPLATE,
    SOURCE_TEMPLATE,
    assemble_context,
    fill,
)
from gleaner.plans.ask import answer, first_passage_answer
from gleaner.plans.retrieve import Corpus, retrieve
from gleaner.sources.scratch import materialize

# Share of the question's tokens the passages must hold before the stand-in grade says yes.
ENOUGH = 0.8


def rule_grade(df: DataFrame) -> DataFrame:
    enough = coverage(F.col("question"), F.col("passages")) >= ENOUGH
    missing = F.array_join(
        F.array_except(tokenize(F.col("question")), tokenize(F.col("passages"))), " "
    )
    return df.withColumn("reply", F.when(enough, "OUI").otherwise(F.concat(F.lit("NON — "), missing)))


def rule_rewrite(df: DataFrame) -> DataFrame:
    """Searches for what the verdict found missing."""
    return df.withColumn("reply", F.regexp_replace("verdict", r"^NON\s*—\s*", ""))


@dataclass(frozen=True)
class AgentSteps:
    """Model steps of the loop; ``choose`` is left out to pick sources named in the question."""

    choose: Step | None = None
    hyde: Step | None = None
    embed: Step | None = None
    score: Step = rule_pair_score
    grade: Step = rule_grade
    rewrite: Step = rule_rewrite
    generate: Step = first_passage_answer


def source_names(chunks: DataFrame) -> DataFrame:
    """Sorted distinct sources with the needle a reply is searched for."""
    return chunks.select(F.col("source").alias("name")).filter("name is not null").distinct().withColumn(
        "needle", F.col("name")
    )


def identify_sources(questions: DataFrame, names: DataFrame, choose: Step | None = None) -> DataFrame:
    """Adds ``sources``, and ``failed`` where the choice got no reply. Stand-in: the names whose stem occurs in the question."""
    if choose is None:
        stems = names.select("name", F.regexp_replace("name", r"(?<=.)\.[^.]*$", "").alias("needle"))
        return names_in_text(questions, "query_id", "question", stems, "sources").withColumn("failed", F.lit(None).cast("string"))
    listing = names.agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("all")).scalar()
    asked = questions.withColumn("prompt", fill(SOURCE_TEMPLATE, sources=listing, question=F.col("question")))
    told = choose(asked)
    told = told.withColumn("failed", problem(told, "sources"))
    return chosen_sources(told, "query_id", "reply", names).select(*questions.columns, "sources", "failed")


def merge_pool(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Old passages in their order, then the new ones whose text is not yet there; ``position``."""
    if old is None:
        return new.withColumn("position", F.col("rank"))
    fresh = new.join(old.select("query_id", "text"), ["query_id", "text"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("is_new", "rank")
    both = old.withColumn("is_new", F.lit(0)).unionByName(fresh.withColumn("is_new", F.lit(1)))
    return both.withColumn("position", F.row_number().over(order)).drop("is_new")


def trim_pool(pool: DataFrame, n: int, score: Step = rule_pair_score) -> DataFrame:
    """Pools above ``n`` are reranked on the original question; smaller ones keep their order."""
    sized = pool.drop("rank", "pair_score").withColumn(
        "pool_size", F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    )
    large = rerank(sized.filter(F.col("pool_size") > n), n, score)
    small = sized.filter(F.col("pool_size") <= n).withColumn("rank", F.col("position"))
    kept = ["query_id", "question", "rank", "chunk_id", "source", "page", "text"]
    return large.select(*kept).unionByName(small.select(*kept))


def graded(state: DataFrame, grade: Step) -> DataFrame:
    """Adds ``sufficient``, ``verdict`` and ``failed``. Only questions with passages cost a call."""
    prompt = fill(GRADE_TEMPLATE, question=F.col("question"), context=F.col("passages"))
    told = grade(state.filter("n_passages > 0").withColumn("prompt", prompt))
    told = told.withColumn("failed", problem(told, "grade")).select(*state.columns, "reply", "failed")
    none = F.lit(None).cast("string")
    both = told.unionByName(state.filter("n_passages = 0").withColumns({"reply": none, "failed": none}))
    return both.withColumns({
        "sufficient": is_sufficient(F.col("reply"), F.col("n_passages")),
        "verdict": grade_verdict(F.col("reply"), F.col("n_passages"))}).drop("reply", "passages", "n_passages")


def run_rounds(questions: DataFrame, corpus: Corpus, steps: AgentSteps = AgentSteps(),
               cfg: RetrievalConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``(state, pool)``: at most three rounds; finished questions leave the loop.

    A question whose source choice, grade or rewrite got no reply leaves it too, with the reason in ``failed``: it is
    not answered from what the step might have said. Every round ends in a written table, so a lost executor never
    replays earlier rounds. ``corpus`` is searched up to three times: pass a ``stored`` one.
    """
    kept = ["query_id", "question", "current_query", "sources", "attempts", "sufficient", "verdict", "failed"]
    open_ = identify_sources(questions.select("query_id", "question"), source_names(corpus.chunks), steps.choose)
    open_ = materialize(
        open_.withColumn("current_query", F.col("question")).withColumn("attempts", F.lit(0)), "open"
    )
    unsaid = {"sufficient": F.lit(None).cast("boolean"), "verdict": F.lit(None).cast("string")}
    done_state, done_pool = [open_.filter("failed is not null").withColumns(unsaid).select(*kept)], []
    open_, pool = open_.filter("failed is null").drop("failed"), None
    for _ in range(cfg.max_attempts + 1):
        asked = open_.select("query_id", F.col("current_query").alias("question"), "sources")
        found = retrieve(asked, corpus, steps.hyde, steps.embed, steps.score, cfg)
        found = found.drop("question", "pair_score").join(open_.select("query_id", "question"), "query_id")
        pool = materialize(trim_pool(merge_pool(pool, found), cfg.k_final, steps.score), "pool")
        context = assemble_context(pool).select("query_id", "passages", "n_passages")
        state = open_.join(context, "query_id", "left").withColumns({
            "attempts": F.col("attempts") + 1, "n_passages": F.coalesce("n_passages", F.lit(0))})
        state = materialize(graded(state, steps.grade).select(*kept), "state")
        finished = F.col("failed").isNotNull() | F.col("sufficient") | (F.col("attempts") > cfg.max_attempts)
        done_state.append(state.filter(finished))
        done_pool.append(pool.join(state.filter(finished).select("query_id"), "query_id", "left_semi"))
        rest = state.filter(~finished)
        if rest.isEmpty():
            break
        prompt = fill(REWRITE_TEMPLATE, question=F.col("question"), query=F.col("current_query"),
                      verdict=F.col("verdict"))
        told = steps.rewrite(rest.drop("failed").withColumn("prompt", prompt))
        told = told.withColumn("failed", problem(told, "rewrite"))
        query = F.coalesce(strip(F.col("reply")), F.col("current_query"))
        told = materialize(told.withColumn("current_query", query).select(*kept), "open")
        done_state.append(told.filter("failed is not null"))
        open_ = told.filter("failed is null").select("query_id", "question", "sources", "current_query", "attempts")
        pool = pool.join(open_.select("query_id"), "query_id", "left_semi")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, done_state), reduce(DataFrame.unionByName, done_pool)


def ask_in_rounds(questions: DataFrame, corpus: Corpus, steps: AgentSteps = AgentSteps(),
                  cfg: RetrievalConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``(answers, pool)``: answers carry sources, attempts, sufficiency and the last verdict.

    Where a step got no reply the answer is NULL and ``failed`` says which and why; no answer is generated after a
    failed step."""
    state, pool = run_rounds(questions, corpus, steps, cfg)
    summary = state.select("query_id", "current_query", "sources", "attempts", "sufficient", "verdict", F.col("failed").alias("stopped"))
    told = questions.select("query_id", "question").join(summary, "query_id")
    answers = answer(told.filter("stopped is null").select("query_id", "question"), pool, steps.generate)
    out = answers.withColumnRenamed("failed", "unanswered").join(summary.filter("stopped is null"), "query_id")
    none = {"prompt": F.lit(None).cast("string"), "answer": F.lit(None).cast("string"), "n_passages": F.lit(None).cast(answers.schema["n_passages"].dataType)}
    stopped = told.filter("stopped is not null").withColumns({**none, "unanswered": F.lit(None).cast("string")})
    both = out.unionByName(stopped)
    return both.withColumn("failed", F.coalesce("stopped", "unanswered")).drop("stopped", "unanswered"), pool
