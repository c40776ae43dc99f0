import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from gleaner.functions import replies, text


def value(spark, s, fn):
    return spark.createDataFrame([(s,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]


def python_tokens(s):
    s = re.sub("[·•]", "", s.lower())
    s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    return re.findall(r"\b\w{2,}\b", s)


@pytest.mark.parametrize(
    "s, expected",
    [
        ("Étudiant·e·s à l'ENS (L3) : 9 ECTS", ["etudiantes", "ens", "l3", "ects"]),
        ("", []),
        ("à 9 l", []),
        ("été ΆΛΦΑ Йод tiếng_Việt", ["ete", "αλφα", "иод", "tieng_viet"]),
        ("가 나다", ["가", "나다"]),
    ],
)
def test_tokens(spark, s, expected):
    assert value(spark, s, text.tokenize) == expected


def test_tokens_equal_python_on_documents(documents):
    rows = documents.select("text", text.tokenize(F.col("text")).alias("t"), text.token_text(F.col("text")).alias("n")).collect()
    assert all(r.t == python_tokens(r.text) for r in rows)
    assert all(r.n.split() == r.t for r in rows)


@pytest.mark.parametrize(
    "s, expected",
    [
        ("Ã\u0089cole dâ\u0080\u0099Ã©tÃ©", "École d’été"),
        ("dâ€™Ã©tÃ©", "d’été"),
        ("école", "école"),
        ("abc Ã", "abc Ã"),
        ("日本", "日本"),
        ("plain", "plain"),
        (None, None),
    ],
)
def test_encoding_repair(spark, s, expected):
    assert value(spark, s, text.repair_encoding) == expected


def test_strip_and_blank(spark):
    assert value(spark, "  \t x y \n", text.strip) == "x y"
    assert value(spark, "  \n", text.is_blank) is True
    assert value(spark, " .", text.is_blank) is False


def test_one_line(spark):
    assert value(spark, "a\nb" + "c" * 200, text.one_line) == "a b" + "c" * 127


@pytest.mark.parametrize(
    "s, expected",
    [("0,8", 0.8), ("Score: 0.7", 0.7), ("8/10", 0.0), ("1.5", 1.0), ("-3", 0.0), ("", 0.0), ("0.8.", 0.0),
     ("x 1e-1 0.9", 0.1)],
)
def test_judge_number(spark, s, expected):
    assert value(spark, s, replies.judge_number) == expected


@pytest.mark.parametrize(
    "reply, n, expected", [(" Oui.", 3, True), ("NON — rien", 3, False), ("Ouistiti", 1, True), ("oui", 0, False), (None, 2, False)]
)
def test_grade(spark, reply, n, expected):
    row = spark.createDataFrame([(reply, n)], "r string, n int").select(
        replies.is_sufficient(F.col("r"), F.col("n")).alias("s"), replies.grade_verdict(F.col("r"), F.col("n")).alias("v")
    ).first()
    assert row.s is expected
    if n == 0:
        assert row.v == "NON — aucun extrait récupéré"


def test_source_choice(spark, monkeypatch):
    names = spark.createDataFrame([("ENS.pdf", "ENS.pdf"), ("SORBONNE.pdf", "SORBONNE.pdf")], "name string, needle string")
    rows = [(1, "sorbonne.PDF"), (2, "ENS.pdf, tous"), (3, "Autre.pdf"), (4, "ens.pdf et SORBONNE.pdf"), (5, None)]
    df = spark.createDataFrame(rows, "id int, reply string")
    expected = {1: ["SORBONNE.pdf"], 2: None, 3: None, 4: ["ENS.pdf", "SORBONNE.pdf"], 5: None}
    inline = {r.id: r.sources for r in replies.chosen_sources(df, "id", "reply", names).collect()}
    monkeypatch.setattr(replies, "INLINE_NAMES", 1)
    joined = {r.id: r.sources for r in replies.chosen_sources(df, "id", "reply", names).collect()}
    assert inline == expected == joined
