import json

from pyspark.sql import functions as F

from gleaner.operators import metrics, models, prompts
from gleaner.plans import ask


def test_fill_does_not_scan_inserted_text(spark):
    df = spark.createDataFrame([("q {context}", "c {question}")], "q string, c string")
    got = df.select(prompts.fill("C={context} Q={question} {other}", question=F.col("q"), context=F.col("c")).alias("p"))
    assert got.first().p == "C=c {question} Q=q {context} {other}"


def test_context_order_and_unknown_source(spark):
    rows = [("q", 2, None, "second"), ("q", 1, "a.txt", "first")]
    got = prompts.assemble_context(spark.createDataFrame(rows, "query_id string, rank int, source string, text string")).first()
    assert got.context == "Source : a.txt\nfirst\n\n---\n\nSource : ?\nsecond"
    assert got.passages == "first\n\n---\n\nsecond" and got.n_passages == 2


def test_answer_refuses_without_passages(spark):
    queries = spark.createDataFrame([("q1", "x"), ("q2", "y")], "query_id string, question string")
    found = spark.createDataFrame([("q1", 1, "a", "text {question}")], "query_id string, rank int, source string, text string")
    got = {r.query_id: r for r in ask.answer(queries, found, template="{context}|{question}").collect()}
    assert got["q1"].answer == "text {question}" and got["q1"].prompt == "Source : a\ntext {question}|x"
    assert got["q2"].answer == prompts.REFUSAL and got["q2"].n_passages == 0


def test_last_message(spark):
    chat = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert prompts.last_message(chat).first().question == "a"
    assert prompts.last_message(chat, "user").first().question == "u"


def test_envelope(spark):
    df = spark.createDataFrame([('é "x"',)], "a string")
    got = json.loads(df.select(prompts.reply_envelope(F.col("a"), "m", "id-1", F.lit(7))).first()[0])
    assert got == {
        "id": "id-1", "object": "chat.completion", "created": 7, "model": "m",
        "choices": [{"index": 0, "message": {"role": "assistant", "content": 'é "x"'}, "finish_reason": "stop"}],
    }
    listing = json.loads(prompts.model_listing(spark, "m", "me").first().listing)
    assert listing == {"object": "list", "data": [{"id": "m", "object": "model", "owned_by": "me"}]}


def test_template_file(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\n{question}\n", encoding="utf-8")
    assert prompts.read_template(spark, str(tmp_path / "t.txt")) == "a\n{question}\n"


def test_model_retries_then_reports(spark):
    def client():
        seen = {}

        def call(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "never" or (prompt == "third" and seen[prompt] < 3):
                raise ValueError("down")
            return f"{prompt}:{seen[prompt]}"

        return call

    df = spark.createDataFrame([("ok",), ("third",), ("never",)], "prompt string")
    got = {r.prompt: (r.reply, r.reply_error) for r in models.model_step(client)(df).collect()}
    assert got == {"ok": ("ok:1", None), "third": ("third:3", None), "never": (None, "ValueError: down")}


def test_embedder_gets_lots(spark):
    def embedder():
        return lambda texts: [[float(len(texts)), float(len(t))] for t in texts]

    df = spark.createDataFrame([("a" * i,) for i in range(7)], "text string").coalesce(1)
    got = [r.vector for r in models.embed_step(embedder, lot=3)(df).collect()]
    assert got == [[3, 0], [3, 1], [3, 2], [3, 3], [3, 4], [3, 5], [1, 6]]


def test_pair_scorer(spark):
    def scorer():
        return lambda pairs: [float(len(q) * len(t)) for q, t in pairs]

    df = spark.createDataFrame([("ab", "xyz")], "question string, text string")
    assert models.pair_step(scorer)(df).first().pair_score == 6.0


def test_an_answer_is_the_whole_first_passage(spark):
    text = "part one\n\n---\n\npart two"
    queries = spark.createDataFrame([("q", "x")], "query_id string, question string")
    rows = [("q", 2, "b", "other"), ("q", 1, "a", text)]
    found = spark.createDataFrame(rows, "query_id string, rank int, source string, text string")
    assert ask.answer(queries, found).first().answer == text


def test_a_failed_answer_is_null(spark):
    def failing():
        def call(prompt):
            raise ValueError("down")

        return call

    queries = spark.createDataFrame([("q", "x")], "query_id string, question string")
    found = spark.createDataFrame([("q", 1, "a", "t")], "query_id string, rank int, source string, text string")
    assert ask.answer(queries, found, models.model_step(failing, retries=0)).first().answer is None


def test_a_failed_judge_stays_out_of_the_mean(spark):
    def judge():
        def call(prompt):
            if "bad" in prompt:
                raise ValueError("down")
            return "1"

        return call

    told = spark.createDataFrame([(1, 0, "good"), (1, 1, "bad")], "id int, statement_no int, statement string")
    evidence = spark.createDataFrame([(1, "e")], "id int, context string")
    got = metrics.verdicts(told, evidence, "context", models.model_step(judge, retries=0))
    assert {r.statement: r.verdict for r in got.collect()} == {"good": 1, "bad": None}
    assert metrics.verdict_share(got, "share").first().share == 1.0
