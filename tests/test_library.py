import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gleaner.config import RetrievalConfig
from gleaner.operators import lexical, maxscore, vectors
from gleaner.plans import library, retrieve
from gleaner.sources import segments


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def chunks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs.select(F.col("doc_id").alias("chunk_id"), "source", "text").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    return bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@pytest.fixture(scope="module")
def grown(spark, chunks, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("library"))
    for part in range(3):
        library.add_chunks(chunks.filter(F.col("chunk_id") % 3 == part), root)
    return root


def test_growth_equals_one_build(spark, chunks, asked, grown):
    fresh, held = retrieve.build_corpus(chunks), library.open_corpus(spark, grown)
    assert held.lexical.avgdl == pytest.approx(fresh.lexical.avgdl)
    terms = lambda c: rows_of(c.lexical.terms.select("term", "df", F.round("idf", 9).alias("idf")))
    assert terms(held) == terms(fresh)
    assert rows_of(maxscore.bm25_top_k(asked, held.lexical)) == rows_of(maxscore.bm25_top_k(asked, fresh.lexical))
    near = lambda c: rows_of(vectors.nearest(retrieve.query_vectors(asked), c.vectors))
    assert near(held) == near(fresh)
    best = lambda c: rows_of(retrieve.retrieve(asked, c))
    assert best(held) == best(fresh)


def test_a_rerun_adds_nothing(spark, chunks, grown):
    before = segments.read_version(spark, grown)
    assert library.add_chunks(chunks, grown) == before
    assert library.add_chunks(chunks.limit(0), grown) == before
    assert before.n_chunks == chunks.count() and len(before.segments) == 3


def test_earlier_versions_stay_readable(spark, chunks, grown):
    first = library.open_corpus(spark, grown, 1)
    assert rows_of(first.chunks.select("chunk_id")) == rows_of(chunks.filter("chunk_id % 3 = 0").select("chunk_id"))


def test_another_session_reads_it(spark, asked, grown):
    later = spark.newSession()
    question = later.createDataFrame(asked.collect(), asked.schema)
    here = rows_of(maxscore.bm25_top_k(asked, library.open_corpus(spark, grown).lexical))
    assert rows_of(maxscore.bm25_top_k(question, library.open_corpus(later, grown).lexical)) == here


def test_torn_writes_are_invisible(spark, chunks, tmp_path):
    root = str(tmp_path)
    library.add_chunks(chunks.limit(20), root)
    version = segments.read_version(spark, root)
    chunks.write.parquet(f"{root}/segments/torn/chunks")
    (tmp_path / "versions" / "_half").write_text('{"number": 2, "segm')
    assert segments.read_version(spark, root) == version
    assert segments.unreferenced(spark, root) == ["torn"]
    assert library.open_corpus(spark, root).chunks.count() == 20


def test_a_version_is_never_replaced(spark, chunks, tmp_path):
    root = str(tmp_path)
    made = library.add_chunks(chunks.limit(5), root)
    other = replace(made, segments=())
    assert not segments.commit(spark, root, other)
    assert segments.read_version(spark, root) == made
    assert json.loads((tmp_path / "versions" / "000000000001.json").read_text())["number"] == 1


def test_a_lost_race_builds_on_the_winner(spark, chunks, tmp_path, monkeypatch):
    root, once = str(tmp_path), []
    commit = segments.commit

    def raced(spark, root, version):
        if not once:
            once.append(1)
            library.add_chunks(chunks.filter("chunk_id < 60"), root)
        return commit(spark, root, version)

    monkeypatch.setattr(segments, "commit", raced)
    made = library.add_chunks(chunks.filter("chunk_id < 100"), root)
    assert made.number == 2 and [s.n_chunks for s in made.segments] == [60, 40]


def test_compaction_keeps_results(spark, asked, grown, chunks, tmp_path):
    root = str(tmp_path)
    for part in range(5):
        library.add_chunks(chunks.filter(F.col("chunk_id") % 5 == part), root)
    before = rows_of(maxscore.bm25_top_k(asked, library.open_corpus(spark, root).lexical))
    made = library.compact(spark, root, fan=4)
    assert len(made.segments) < 5 and made.n_chunks == chunks.count()
    held = library.open_corpus(spark, root)
    assert rows_of(maxscore.bm25_top_k(asked, held.lexical)) == before
    assert held.lexical.bounds.groupBy("term", "block").count().filter("count > 1").count() == 0
    assert library.compact(spark, root, fan=4) == made


def test_size_classes():
    def of(*sizes):
        return segments.Version(1, tuple(segments.Segment(str(i), n, n) for i, n in enumerate(sizes)))

    assert library.to_merge(of(10, 10, 10, 500)) == ()
    assert [s.n_chunks for s in library.to_merge(of(500, 9, 8, 500, 7, 9, 500, 500))] == [9, 8, 7, 9]


def test_settings_must_agree(spark, chunks, grown):
    with pytest.raises(ValueError, match="embedder"):
        library.add_chunks(chunks, grown, embedder="other")
    with pytest.raises(ValueError, match="vector_dim"):
        library.open_corpus(spark, grown, cfg=RetrievalConfig(vector_dim=8))
    with pytest.raises(ValueError, match="no corpus"):
        library.open_corpus(spark, f"{grown}/none")
