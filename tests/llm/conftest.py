import pytest

#: Extra columns whose names the operators use inside.
EXTRA = "digest string, n long, line_no int, fp long, root string, block int, tokens long, score string, kept string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
WORDS = "the quick brown fox jumps over a lazy dog while many small birds sing in old trees near water".split()


def prose(n, shift=0):
    return " ".join(WORDS[(i * 7 + i // 17 * 5 + shift) % len(WORDS)] for i in range(n))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2, 3, "r", 4, 5, "s", "k")


@pytest.fixture(scope="session")
def edge_rows():
    long = " ".join(f"{w}{i % 97}" for i, w in enumerate(WORDS * 3000))
    return [
        row(1, prose(60)), row(2, prose(60)), row(3, "  " + prose(60).replace(" ", " \t\n ", 3)), row(4, prose(60).upper()),
        row(5, ""), row(6, None), row(7, " \n\t \r\n"), row(8, None, None, None), row(None, "a text without an id"),
        row(None, None, None, None), row(10, prose(80, 3)), row(10, prose(80, 3)), row(10, prose(80, 3)), row(11, long),
        row(12, long + " more"), row(13, "one"), row(14, "# * $ % & | < > " * 9), row(15, prose(40) + "\n" + prose(40) + "\n\n" + prose(40)),
        row(16, "é中文😀 ‘x’ don't I'LL\x00<|endoftext|> tail"), row(17, prose(60) + " end"), row(-5, prose(60)), row(18, "x" * 3000),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs_001(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
