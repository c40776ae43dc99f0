import math

import pytest
from pyspark.sql import functions as F

from gleaner.operators import lexical, metrics
from gleaner.plans import evaluate


@pytest.mark.parametrize("verdicts, expected", [([1, 0, 1], 0.833333), ([0, 0], 0.0), ([1], 1.0), ([0, 1], 0.5)])
def test_context_precision(spark, verdicts, expected):
    rows = [("q", i, v) for i, v in enumerate(verdicts, 1)]
    df = spark.createDataFrame(rows, "id string, rank int, verdict int")
    assert metrics.context_precision(df).first().context_precision == expected


def test_samples_skip_empty(spark):
    schema = ("id string, question string, reponse_llm string, reponse_attendue string, "
              "chunks array<struct<source:string,page:int,content:string>>")
    rows = [("a", "q", "r", "x", [("s", 2, "c"), ("s", 3, " \n"), (None, None, "d")]), ("b", "q", "r", "x", [("s", 1, "")]),
            ("c", "q", "r", "x", None)]
    samples, skipped = metrics.eval_samples(spark.createDataFrame(rows, schema))
    (s,) = samples.collect()
    assert s.retrieved_contexts == ["[Source : s — p.2]\nc", "[Source : ? — p.?]\nd"]
    assert sorted(r.id for r in skipped.collect()) == ["b", "c"]


def test_report_ignores_nan_and_absent_columns(spark):
    rows = [(1, 1.0, 0.2), (1, math.nan, 0.4), (2, 0.5, None)]
    scores = spark.createDataFrame(rows, "niveau int, faithfulness double, answer_correctness double")
    got = {r.niveau: r for r in metrics.report(scores).collect()}
    assert (got[None].n, got[None].faithfulness, got[None].answer_correctness) == (3, 0.75, 0.3)
    assert (got["1"].n, got["1"].faithfulness) == (2, 1.0) and got["2"].answer_correctness is None
    assert "context_recall" not in metrics.report(scores).columns


def test_bar(spark):
    df = spark.createDataFrame([(0.75,), (None,)], "m double")
    assert [r[0] for r in df.select(metrics.bar(F.col("m"))).collect()] == ["█" * 15, None]


def test_metadata(spark):
    meta = spark.createDataFrame([("a", 2, "s", None)], "id string, niveau int, source string, difficulte_rag string")
    got = {r.id: r for r in metrics.with_metadata(spark.createDataFrame([("a",), ("z",)], "id string"), meta).collect()}
    assert (got["a"].niveau, got["a"].source, got["a"].difficulte_rag) == ("2", "s", "")
    assert (got["z"].niveau, got["z"].source, got["z"].difficulte_rag) == ("", "", "")


def test_faithfulness_and_correctness(spark):
    answer = spark.createDataFrame([("a", "Le stage dure quatre mois. Il est au Japon.")], "id string, answer string")
    ref = spark.createDataFrame([("a", "Le stage dure quatre mois. Un rapport est rendu.")], "id string, reference string")
    of_answer = metrics.verdicts(metrics.statements(answer, "answer"), ref, "reference")
    assert [(r.statement_no, r.verdict) for r in of_answer.orderBy("statement_no").collect()] == [(0, 1), (1, 0)]
    assert metrics.verdict_share(of_answer, "faithfulness").first().faithfulness == 0.5
    of_ref = metrics.verdicts(metrics.statements(ref, "reference"), answer, "answer")
    alike = spark.createDataFrame([("a", 0.8)], "id string, similarity double")
    r = metrics.answer_correctness(of_answer, of_ref, alike).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 1) and r.answer_correctness == pytest.approx(0.75 * 0.5 + 0.25 * 0.8)


def test_rule_judge_equals_token_join(spark):
    told = metrics.statements(
        spark.createDataFrame([("a", "Un deux trois. Quatre cinq! Deux, deux"), ("b", "Seul"), ("c", "Sans preuve")],
                              "id string, t string"), "t")
    ev = spark.createDataFrame([("a", "un deux trois cinq"), ("b", "!")], "id string, e string")
    key = lambda df: sorted((r.id, r.statement_no, r.statement, r.verdict) for r in df.collect())
    expected = [("a", 0, "Un deux trois", 1), ("a", 1, "Quatre cinq", 0), ("a", 2, "Deux, deux", 1), ("b", 0, "Seul", 0)]
    assert key(metrics.verdicts(told, ev, "e")) == expected
    assert key(metrics.verdicts(told, ev, "e", metrics.rule_judge)) == expected


def test_evaluate_a_run(spark):
    schema = ("id string, question string, reponse_llm string, reponse_attendue string, "
              "chunks array<struct<source:string,page:int,content:string>>")
    rows = [
        ("a", "duree du stage", "Le stage dure quatre mois.", "Le stage dure quatre mois.",
         [("s", 1, "Le stage dure quatre mois en tout"), ("s", 2, "autre chose")]),
        ("b", "q", "r", "x", []),
    ]
    scores, skipped = evaluate.evaluate(spark.createDataFrame(rows, schema))
    (r,) = scores.collect()
    assert (r.id, r.question, r.faithfulness, r.context_recall, r.context_precision, r.answer_correctness) == (
        "a", "duree du stage", 1.0, 1.0, 1.0, 1.0)
    assert 0 < r.answer_relevancy < 1 and [s.id for s in skipped.collect()] == ["b"]
    harsh, _ = evaluate.evaluate(
        spark.createDataFrame(rows, schema), judge=lambda df: df.withColumn("reply", F.lit("note : 0,2")))
    assert harsh.first().faithfulness == 0.0 and harsh.first().context_precision == 0.0


def test_relevancy_of_the_same_text_is_one(spark):
    texts = spark.createDataFrame([("a", 0, "quatre mois de stage"), ("b", 0, "autre chose")], "id string, statement_no int, t string")
    q = metrics.text_vectors(texts.filter("id = 'a'"), ["id"], "t")
    told = metrics.text_vectors(texts, ["id", "statement_no"], "t")
    assert [(r.id, r.answer_relevancy) for r in metrics.answer_relevancy(q, told).collect()] == [("a", 1.0)]


def test_token_recall(spark):
    df = spark.createDataFrame([("a", "un deux trois quatre", "deux quatre cinq"), ("b", "!", "x")], "id string, r string, c string")
    got = {r.id: r.context_recall for r in metrics.token_recall(df, "r", "c").collect()}
    assert got == {"a": 0.5, "b": 0.0}


def test_planted_passages_and_recall(spark):
    chunks = spark.createDataFrame(
        [(1, "s", "avant les mots, cherchés ici après"), (2, "s", "mots cherchés les ici"), (3, "s", "xmots cherchés icix")],
        "chunk_id long, source string, text string",
    )
    index = lexical.build_index(chunks)
    passages = spark.createDataFrame(
        [("q1", "mots cherches ici"), ("q2", "mots"), ("q3", "les absent"), ("q4", "")], "query_id string, norm string"
    )
    gold = metrics.planted_passages(passages, index.tokens, index.terms)
    assert sorted((r.query_id, r.chunk_id) for r in gold.collect()) == [("q1", 1), ("q2", 1), ("q2", 2)]
    ranked = spark.createDataFrame([("q1", 1, 6), ("q2", 2, 5)], "query_id string, chunk_id long, rank int")
    assert metrics.recall_at(ranked, gold, 5).first() == (2, 0.5)


def test_profile_and_refusals(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "niveau int, source string")
    got = {(r.niveau, r.source): r.n for r in metrics.profile(df, "niveau", "source").collect()}
    assert got[(None, None)] == 3 and got[(1, None)] == 2 and got[(None, "a")] == 2 and got[(2, "a")] == 1
    told = spark.createDataFrame([(" " + metrics.REFUSAL + "\n",), ("x",)], "answer string")
    assert metrics.refusal_rate(told).first() == (2, 0.5)
