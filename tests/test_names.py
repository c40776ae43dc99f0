import numpy as np
import pytest

from gleaner.functions import replies


@pytest.mark.parametrize("limit", [0, 10**9])
def test_many_names_equal_contains(spark, monkeypatch, limit):
    """Names that overlap, share needles, differ in case or are empty, in long replies."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(replies, "AUTOMATON_BYTES", limit)
    parts = ["ens", "sor", "bonne", "é", "2024", "-", " ", "rapport"]
    names = {"".join(rng.choice(parts, rng.integers(1, 6))) + f".{i % 7}" for i in range(1500)} | {"ENS.pdf", "ens.PDF", "a", "ab", "abc"}
    texts = ["".join(rng.choice([*parts, "abc", ".1", ".2", "x", "ENS.pdf"], rng.integers(0, 60))) for _ in range(60)] + ["", None, "Ab"]
    table = spark.createDataFrame([(n, n) for n in names], "name string, needle string")
    asked = spark.createDataFrame(list(enumerate(texts)), "id int, reply string").repartition(3)
    assert len(names) > replies.INLINE_NAMES
    got = {r.id: r.names for r in replies.names_in_text(asked, "id", "reply", table).collect()}
    for i, text in enumerate(texts):
        want = sorted(n for n in names if text is not None and n.lower() in text.lower())
        assert got[i] == (want or None)


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).selectExpr("concat('source-', id, '.pdf') AS name", "concat('source-', id, '.pdf') AS needle")
    asked = spark.range(200).selectExpr("id", "concat(repeat('texte long sans nom ', 2000), 'Source-', id * 400, '.PDF fin') AS reply")
    rows = replies.names_in_text(asked, "id", "reply", names).collect()
    assert {r.id: r.names for r in rows} == {i: [f"source-{400 * i}.pdf"] for i in range(200)}
