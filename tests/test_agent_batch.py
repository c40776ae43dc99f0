import json

import pytest
from pyspark.sql import functions as F

from gleaner.config import RetrievalConfig
from gleaner.operators import batch, models
from gleaner.plans import agent, retrieve, runs
from gleaner.sources.records import read_results

CHUNKS = [
    (1, "ens.txt", "la formation dure trois ans avec un stage obligatoire"),
    (2, "ens.txt", "le tutorat accompagne chaque eleve pendant la formation"),
    (3, "sorbonne.txt", "le stage de master dure quatre mois minimum"),
    (4, "sorbonne.txt", "les cours communs valident trente credits"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, source string, text string")
    return retrieve.stored(spark, retrieve.build_corpus(chunks))


def ask(spark, *questions):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions)], "query_id string, question string")


def test_rounds_stop_when_sufficient(spark, corpus):
    answers, pool = agent.ask_in_rounds(ask(spark, "stage de master"), corpus)
    (r,) = answers.collect()
    assert (r.attempts, r.sufficient, r.sources, r.verdict) == (1, True, None, "OUI")
    assert r.answer == CHUNKS[2][2]
    assert 0 < pool.count() <= 5


def test_never_sufficient_means_three_retrievals(spark, corpus):
    answers, _ = agent.ask_in_rounds(ask(spark, "stage zebre", "stage de master"), corpus)
    got = {r.query_id: r for r in answers.collect()}
    assert got["q0"].attempts == 3 and got["q0"].sufficient is False and got["q0"].current_query == "zebre"
    assert got["q0"].answer != "" and got["q1"].attempts == 1


def test_source_named_in_the_question(spark, corpus):
    answers, pool = agent.ask_in_rounds(ask(spark, "stage a Sorbonne master"), corpus)
    assert answers.first().sources == ["sorbonne.txt"]
    assert {r.source for r in pool.collect()} == {"sorbonne.txt"}


def test_injected_steps(spark, corpus):
    steps = agent.AgentSteps(
        choose=lambda df: df.withColumn("reply", F.lit("ENS.txt")),
        grade=lambda df: df.withColumn("reply", F.lit("non")),
        rewrite=lambda df: df.withColumn("reply", F.concat(F.lit(" try "), F.col("attempts"))),
        hyde=lambda df: df.withColumn("reply", F.lit("tutorat")),
        generate=lambda df: df.withColumn("reply", F.lit("done")),
    )
    answers, pool = agent.ask_in_rounds(ask(spark, "stage"), corpus, steps)
    r = answers.first()
    assert (r.sources, r.attempts, r.current_query, r.answer) == (["ens.txt"], 3, "try 2", "done")
    assert {p.source for p in pool.collect()} == {"ens.txt"}


def test_text_lookup_reads_only_the_folders_of_the_winners(spark, corpus):
    small = RetrievalConfig(partition_bytes=40)
    split = retrieve.stored(spark, corpus, small)
    assert split.id_parts > 1
    ranked = spark.createDataFrame([("q", 3, 1)], "query_id string, chunk_id long, rank int").filter("rank <= 5")
    found = retrieve.with_text(ranked, split, True)
    assert [r.text for r in found.collect()] == [CHUNKS[2][2]]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def pool_rows(spark, *rows):
    return spark.createDataFrame(
        [("q", "question", rank, rank, "s", None, text) for rank, text in rows],
        "query_id string, question string, rank int, chunk_id int, source string, page int, text string",
    )


def test_pool_keeps_old_order_and_drops_known_texts(spark):
    pool = agent.merge_pool(pool_rows(spark, (1, "x"), (2, "y")), pool_rows(spark, (1, "y"), (2, "z")))
    assert [r.text for r in pool.orderBy("position").collect()] == ["x", "y", "z"]


def test_pool_is_reranked_only_above_the_limit(spark):
    pool = agent.merge_pool(None, pool_rows(spark, (1, "a"), (2, "question")))
    assert [r.text for r in agent.trim_pool(pool, 2).orderBy("rank").collect()] == ["a", "question"]
    assert [r.text for r in agent.trim_pool(pool, 1).orderBy("rank").collect()] == ["question"]


def test_pending_and_progress(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    done = spark.createDataFrame([(2,), (2,), (9,)], "id int")
    assert sorted(r.id for r in batch.pending(items, done, "id").collect()) == [1, 3]
    assert batch.progress(items, done, "id").first() == (3, 1, 2)


def test_unseen_pages_go_by_content(spark):
    schema = "source string, page int, text string"
    stored = spark.createDataFrame([("a", 1, "x"), ("b", None, "y")], schema)
    pages = spark.createDataFrame([("b", None, "y"), ("a", 1, "x changed"), ("a", 2, "x")], schema)
    key = batch.page_key(F.col("source"), F.col("page"), F.col("text")).alias("page_key")
    fresh = batch.unseen_pages(pages, stored.select(key)).select("source", "page", "text").collect()
    assert sorted(map(tuple, fresh)) == [("a", 1, "x changed"), ("a", 2, "x")]


def test_batch_resumes(spark, corpus, tmp_path):
    path = str(tmp_path / "results")
    rows = [("a", "stage de master", "quatre mois"), ("b", "zebre", "?")]
    questions = spark.createDataFrame(rows, "id string, question string, reponse_attendue string")
    assert runs.run_pending(questions.filter("id = 'a'"), corpus, path) == 1
    assert runs.run_pending(questions, corpus, path) == 1
    assert runs.run_pending(questions, corpus, path) == 0
    got = {r.id: r for r in read_results(spark, path).collect()}
    assert got["a"].reponse_llm == CHUNKS[2][2] and got["a"].logs == "sources=*; attempts=1; sufficient=true"
    assert got["a"].duree_secondes > 0 and got["a"].chunks[0].source == "sorbonne.txt"
    assert got["b"].logs == "sources=*; attempts=3; sufficient=false"


def test_a_failed_question_stays_pending(spark, corpus, tmp_path):
    def client():
        def call(prompt):
            if "zebre" in prompt:
                raise ValueError("down")
            return "fine"

        return call

    path = str(tmp_path / "failed")
    rows = [("a", "stage de master", "x"), ("b", "zebre", "y")]
    questions = spark.createDataFrame(rows, "id string, question string, reponse_attendue string")
    steps = agent.AgentSteps(generate=models.model_step(client, retries=0))
    assert runs.run_pending(questions, corpus, path, steps) == 1
    assert [r.id for r in read_results(spark, path).collect()] == ["a"]
    assert runs.run_pending(questions, corpus, path) == 1


def test_chat_replies(spark, corpus):
    chat = spark.createDataFrame(
        [(1, 0, "user", "bonjour"), (1, 1, "user", "stage de master")], "conv_id long, turn long, role string, text string"
    )
    r = runs.reply_to_chats(chat, corpus, "m", "id-1", 5).first()
    body = json.loads(r.body)
    assert r.conv_id == 1 and body["choices"][0]["message"]["content"] == CHUNKS[2][2] and body["created"] == 5
