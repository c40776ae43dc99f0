import pytest
from pyspark.sql import functions as F

from gleaner.operators import models
from gleaner.plans import agent, retrieve, runs
from gleaner.sources.records import read_results

CHUNKS = [
    (1, "ens.txt", "la formation dure trois ans avec un stage obligatoire"),
    (2, "sorbonne.txt", "le stage de master dure quatre mois minimum"),
]
QUESTIONS = [("good", "stage de master", "x"), ("bad", "zebre de la formation", "y")]


@pytest.fixture(scope="module")
def corpus(spark):
    return retrieve.stored(spark, retrieve.build_corpus(spark.createDataFrame(CHUNKS, "chunk_id long, source string, text string")))


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "id string, question string, reponse_attendue string")


def client(reply, down="zebre", log=None):
    """A model that breaks on prompts with ``down`` and notes every call."""

    def open_client():
        def call(prompt):
            if log:
                with open(log, "a") as file:
                    file.write(prompt.replace("\n", " ")[-60:] + "\n")
            if down in prompt:
                raise ValueError("down")
            return reply

        return call

    return models.model_step(open_client, retries=0)


def steps_with(stage):
    """Steps of which one breaks."""
    if stage == "rewrite":
        return agent.AgentSteps(grade=lambda df: df.withColumn("reply", F.lit("non")), rewrite=client("stage"))
    name, reply = {"sources": ("choose", "tous"), "grade": ("grade", "oui"), "answer": ("generate", "fine")}[stage]
    return agent.AgentSteps(**{name: client(reply)})


@pytest.mark.parametrize("stage", ["sources", "grade", "rewrite", "answer"])
def test_a_failing_step_leaves_the_question_pending(spark, corpus, questions, tmp_path, stage):
    path = str(tmp_path / "results")
    assert runs.run_pending(questions, corpus, path, steps_with(stage)) == 1
    assert [r.id for r in read_results(spark, path).collect()] == ["good"]
    assert [(r.id, r.failed) for r in spark.read.json(f"{path}-failed").collect()] == [("bad", f"{stage}: ValueError: down")]
    assert [r.id for r in runs.open_questions(questions, path).collect()] == ["bad"]


def test_no_model_call_without_passages(spark, questions, tmp_path):
    empty = retrieve.build_corpus(spark.createDataFrame([], "chunk_id long, source string, text string"))
    log = str(tmp_path / "calls")
    steps = agent.AgentSteps(grade=client("oui", log=log), rewrite=lambda df: df.withColumn("reply", F.lit("again")), generate=client("x", log=log))
    asked = questions.select(F.col("id").alias("query_id"), "question")
    rows = agent.ask_in_rounds(asked, empty, steps)[0].collect()
    assert {(r.attempts, r.sufficient, r.verdict) for r in rows} == {(3, False, "NON — aucun extrait récupéré")}
    assert not (tmp_path / "calls").exists()


def test_equal_prompts_are_paid_once_and_runs_resume(spark, tmp_path):
    log, ledger = str(tmp_path / "calls"), str(tmp_path / "ledger")
    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "zebre"), (5, "zebre"), (6, None)], "id int, prompt string")

    def ask(down):
        found = models.recorded_step(client("fine", down, log), ledger)(prompts).collect()
        return {r.id: (r.reply, r.reply_error) for r in found}

    def calls():
        return sorted(open(log).read().split())

    first = ask("zebre")
    fine, down = ("fine", None), (None, "ValueError: down")
    assert first == {1: fine, 2: fine, 3: fine, 4: down, 5: down, 6: (None, None)}
    assert calls() == ["a", "b", "zebre"]
    assert ask("nothing") == {i: fine for i in range(1, 6)} | {6: (None, None)}
    assert calls() == ["a", "b", "zebre", "zebre"]
    ask("nothing")
    assert calls() == ["a", "b", "zebre", "zebre"]
    assert spark.read.parquet(ledger).filter("error is not null").count() == 1
