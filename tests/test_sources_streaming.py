import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import chunking
from gleaner.sources import pages, records, scratch, store
from gleaner.streaming.ingest import ingest_stream


def test_read_folder(spark, tmp_path, caplog):
    (tmp_path / "b.TXT").write_text("deuxième\nligne", encoding="utf-8")
    (tmp_path / "a+b doc.txt").write_text("premier", encoding="utf-8")
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    rows = [{"source": "guide.pdf", "page": 2, "text": "dâ\u0080\u0099accord"}, {"page": 3, "text": "sans nom"},
            {"source": "guide.pdf", "page": 4, "text": " \n"}]
    (tmp_path / "pages.jsonl").write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")
    got = sorted((r.source, r.page or 0, r.text) for r in pages.read_folder(spark, str(tmp_path)).collect())
    assert got == [
        ("a+b doc.txt", 0, "premier"), ("b.TXT", 0, "deuxième\nligne"), ("guide.pdf", 2, "d’accord"),
        ("pages.jsonl", 3, "sans nom"),
    ]
    assert "'pdf'" in caplog.text


def test_empty_folder(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"")
    assert pages.read_folder(spark, str(tmp_path)).count() == 0


def test_html(spark):
    html = ("<html><head><title>no</title></head><body><nav><ul><li>no</li></ul></nav><script>x('<p>')</script>"
            "<h1 class='t'>A &amp; B</h1><p>one\n two</p><h2>C</h2><ul><li>x<li>y</ul>"
            "<table><tr><td>1</td><td>2</td></tr></table></body></html>")
    df = spark.createDataFrame([(3, "https://a.example.org/x?y", html)], "page_id long, url string, html string")
    r = pages.from_html(df).first()
    assert (r.source, r.page) == ("a.example.org", 3)
    assert r.text == "# A & B\n\none two\n\n## C\n\n- x\n- y\n\n|1|2|"


QUESTIONS = [
    {"id": "a", "niveau": 1, "source": "s", "question": "q [1]?", "reponse_attendue": "r", "contexte_source": "c", "type": "t"},
    {"id": "b", "niveau": 2, "source": "s", "question": "é", "reponse_attendue": "r", "contexte_source": "c", "type": "t"},
]


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps(QUESTIONS, indent=2, ensure_ascii=False), encoding="utf-8")
    plain = records.read_questions(spark, str(tmp_path / "q.json")).orderBy("id").collect()
    talk = "Bonjour [voici]\n\n" + json.dumps(QUESTIONS, indent=2, ensure_ascii=False) + "\n\nfin [ok]"
    (tmp_path / "talk.txt").write_text(talk, encoding="utf-8")
    inside = records.questions_in_text(spark, str(tmp_path / "talk.txt")).orderBy("id").collect()
    assert plain == inside and [r.question for r in plain] == ["q [1]?", "é"]


def test_results(spark, tmp_path):
    rec = {"id": "a", "question": "q", "reponse_attendue": "r", "reponse_llm": "é", "duree_secondes": 1.5, "logs": "",
           "chunks": [{"source": "s", "page": 3, "content": "x"}, {"source": "s", "page": "?", "content": "y"}]}
    (tmp_path / "r.json").write_text(json.dumps([rec], indent=2), encoding="utf-8")
    rows = records.read_results(spark, str(tmp_path / "r.json"), multi_line=True)
    assert [(c.page, c.content) for c in rows.first().chunks] == [(3, "x"), (None, "y")]
    out = str(tmp_path / "out")
    records.append_results(rows, out)
    records.append_results(rows, out)
    again = records.read_results(spark, out).collect()
    assert len(again) == 2 and again[0] == rows.first()


def test_scores_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y"\nz', [1, 2], 0.5)], "id string, t string, l array<int>, s double")
    records.write_scores(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert tuple(back.first()) == ("a", 'x "y"\nz', "[1,2]", "0.5")


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("1", "a.txt", "x"), ("2", "b.txt", "y"), ("3", None, "z")]
    df = spark.createDataFrame(rows, "chunk_id string, source string, text string")
    store.write_store(df.union(df), path)
    store.write_store(df, path)
    assert sorted(map(tuple, store.read_store(spark, path).collect()), key=str) == sorted(rows, key=str)
    store.write_store(spark.createDataFrame([("4", "b.txt", "new")], df.schema), path)
    store.append_store(spark.createDataFrame([("1", "a.txt", "x"), ("5", "a.txt", "w")], df.schema), path)
    assert {r.chunk_id for r in store.read_store(spark, path, "chunk_id").collect()} == {"1", "3", "4", "5"}
    only = store.read_store(spark, path, "chunk_id", "source", sources=["a.txt"])
    assert {r.chunk_id for r in only.collect()} == {"1", "5"}
    assert "PartitionFilters: [isnotnull(source_key" in only._jdf.queryExecution().executedPlan().toString()
    assert [r.source for r in store.source_listing(df.filter("source is not null")).collect()] == ["a.txt", "b.txt"]


@pytest.mark.parametrize("keep_keys", [True, False])
def test_stream_is_incremental_and_idempotent(spark, tmp_path, keep_keys):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    schema = "source string, page int, text string"
    first = spark.createDataFrame([("a.txt", 1, "# T\n" + "mot " * 400)], schema)
    first.write.parquet(f"{inbox}/1")

    def run():
        ingest_stream(spark, f"{inbox}/*", schema, out, state, keep_keys=keep_keys).awaitTermination()
        return spark.read.parquet(out)

    one = run().select("chunk_id").collect()
    again = spark.createDataFrame([("a.txt", 1, "# T\n" + "mot " * 400), ("b.txt", None, "autre texte " * 5)], schema)
    again.write.parquet(f"{inbox}/2")
    two = run()
    assert {r.chunk_id for r in one} < {r.chunk_id for r in two.collect()}
    assert two.count() == two.select("chunk_id").distinct().count() == len(one) + 1
    assert run().count() == two.count()
    whole = chunking.split_pages(first.unionByName(again)).select("chunk_id").distinct()
    assert {r.chunk_id for r in whole.collect()} == {r.chunk_id for r in two.collect()}


def test_a_batch_reads_nothing_that_was_stored(spark, tmp_path):
    """The keys are in the state: stored rows may even be moved away."""
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    schema = "source string, page int, text string"
    for i, text in enumerate(("un texte assez long pour rester " * 3, "un autre texte assez long ici " * 3)):
        rows = [("a.txt", 1, "un texte assez long pour rester " * 3), ("a.txt", 2 + i, text)]
        spark.createDataFrame(rows, schema).write.parquet(f"{inbox}/{i}")
        path = f"{out}-{i}"
        ingest_stream(spark, f"{inbox}/*", schema, path, state).awaitTermination()
        assert sorted(r.page for r in spark.read.parquet(path).collect()) == ([1, 2], [3])[i]


class FakeSession:
    """A session whose settings can be chosen; the real one fixes them at start."""

    def __init__(self, named):
        self.conf = {"spark.sql.warehouse.dir": "hdfs://x/warehouse/"} | ({"spark.checkpoint.dir": named} if named else {})
        self.sparkContext = self

    def getCheckpointDir(self):
        return None


def test_scratch_follows_the_session():
    assert scratch.scratch_root(FakeSession("hdfs://x/shared/")) == "hdfs://x/shared"
    assert scratch.scratch_root(FakeSession(None)) == "hdfs://x/warehouse/scratch"


def test_materialize(spark):
    kept = scratch.materialize(spark.range(3).withColumn("x", F.col("id") * 2), "t")
    assert scratch.scratch_root(spark).split(":")[-1] in kept.inputFiles()[0]
    assert sorted(r.x for r in kept.collect()) == [0, 2, 4]
