import pytest
from pyspark.sql import functions as F

from gleaner.operators import chunking as c
from gleaner.operators import models


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "text string").select(fn(F.col("text")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a\n\nb ... 3\nc", True),
        ("\n".join(["x . . . 1"] * 3 + ["y"] * 7), False),
        ("\n \n", False),
        ("", False),
        ("a ... 1\r\nb ... 2 c", True),
    ],
)
def test_contents_page(spark, text, expected):
    assert one(spark, text, c.is_contents_page) is expected


def paths(spark, text, **kw):
    return [(r.body, r.h1, r.h2, r.h3) for r in one(spark, text, lambda t: c.sections(t, **kw))]


def test_sections_follow_heading_levels(spark):
    assert paths(spark, "x\n# A\nt\n## B\nu\n# C") == [
        ("x", None, None, None),
        ("# A\nt", "A", None, None),
        ("## B\nu", "A", "B", None),
        ("# C", "C", None, None),
    ]


def test_headings_inside_a_fence_do_not_count(spark):
    text = "# A\n```\n# not\n## neither\n```\n### D\nend\n#### deep\n#tag"
    assert paths(spark, text) == [
        ("# A\n```\n# not\n## neither\n```", "A", None, None),
        ("### D\nend\n#### deep\n#tag", "A", None, "D"),
    ]


def test_compact_sections(spark):
    assert paths(spark, "# A\n\n  one  \ntwo\n\n\nthree\n", compact=True) == [
        ("# A  \none\ntwo  \nthree", "A", None, None)
    ]


def merged(spark, bodies, size):
    parts = F.transform(
        F.array(*[F.lit(b) for b in bodies]),
        lambda b: F.struct(b.alias("body"), b.alias("h1"), F.lit(None).cast("string").alias("h2"),
                           F.lit(None).cast("string").alias("h3")),
    )
    return spark.range(1).select(c.merge_small(parts, size).alias("r")).first()["r"]


def test_merge_small(spark):
    got = merged(spark, ["aaaa", "bbbb", "cccccccccccc", "dd"], 10)
    assert [r.body for r in got] == ["aaaa\n\nbbbb", "cccccccccccc\n\ndd"]
    assert [r.h1 for r in got] == ["aaaa", "cccccccccccc"]
    assert [r.body for r in merged(spark, ["aa"], 10)] == ["aa"]


def merge_loop(bodies, size):
    out, held = [], None
    for b in bodies:
        held = b if held is None else held + "\n\n" + b
        if len(held) >= size:
            out, held = [*out, held], None
    if held is not None:
        out = [*out[:-1], out[-1] + "\n\n" + held] if out else [held]
    return out


def test_merge_equals_loop_on_documents(documents):
    none = F.lit(None).cast("string")
    parts = F.transform(
        F.split("text", "\n"),
        lambda b: F.struct(b.alias("body"), none.alias("h1"), none.alias("h2"), none.alias("h3")),
    )
    rows = documents.select("text", F.transform(c.merge_small(parts, 400), lambda p: p["body"]).alias("m")).collect()
    assert all(r.m == merge_loop(r.text.split("\n"), 400) for r in rows)


def naive_split(text, size, overlap, seps):
    """Brute force on strings: list pieces, pack, carry whole pieces back."""
    sep = next((s for s in seps if s == "" or s in text), "")
    finer = seps[seps.index(sep) + 1 :]
    pieces = list(text) if sep == "" else [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    out, run = [], []

    def pack():
        cur = []
        for p in run:
            if sum(map(len, cur)) + len(p) > size:
                if cur:
                    out.append("".join(cur))
                while cur and (sum(map(len, cur)) > overlap or sum(map(len, cur)) + len(p) > size):
                    cur = cur[1:]
            cur = [*cur, p]
        if cur:
            out.append("".join(cur))
        run.clear()

    for p in (p for p in pieces if p):
        if len(p) < size:
            run.append(p)
        else:
            pack()
            out.extend(naive_split(p, size, overlap, finer) if finer else [p])
    pack()
    return out


def planted(text, i):
    marks = ["\n## ", "\n### ", "\n\n", "\n|", "\n", " "]
    words = text.split(" ")
    return "".join(w + (marks[(i + n // 7) % 6] if n % 7 == 0 else " ") for n, w in enumerate(words))


@pytest.mark.parametrize("size, overlap", [(1000, 200), (60, 15), (7, 3)])
def test_size_split_equals_brute_force(documents, size, overlap):
    texts = [planted(r.text, i) for i, r in enumerate(documents.limit(80).collect())] + ["", " ", "x" * 2500]
    for t in texts:
        t = t[:4000]
        expected = [p.strip() for p in naive_split(t, size, overlap, list(c.SEPARATORS))]
        assert c.split_one(t, size, overlap) == [p for p in expected if p]


def test_size_split_column(documents):
    rows = documents.select("text", c.size_split(F.col("text")).alias("s")).collect()
    assert all(r.s == c.split_one(r.text) for r in rows)
    assert max(len(p) for r in rows for p in r.s) <= 1000


def test_windows(spark):
    got = one(spark, "0123456789abcdef", lambda t: c.windows(t, 10, 4))
    assert [(w.start, w.text) for w in got] == [(1, "0123456789"), (7, "6789abcdef")]


def test_minimum_content(spark):
    df = spark.createDataFrame([(" " + "a" * 29 + " ",), ("b" * 30,)], "text string")
    assert [r.text[0] for r in c.with_content(df).collect()] == ["b"]


def test_context_line(spark):
    df = spark.createDataFrame([("s", "p", "b", "  L1 \nL2"), ("s", "p", "b", " \n ")], "source string, page_text string, body string, r string")
    got = c.contextualize(df, lambda d: d.withColumn("reply", F.col("r"))).select("text").collect()
    assert [r.text for r in got] == ["L1\n\nb", "b"]


def test_pages_to_chunks(spark):
    pages = spark.createDataFrame(
        [
            ("a.txt", 1, "# T\n" + "word " * 300 + "\n## U\nshort"),
            ("a.txt", 2, "x ... 1\ny ... 2"),
            ("a.txt", 3, " \n"),
            ("b.txt", None, "tiny"),
        ],
        "source string, page int, text string",
    )
    rows = c.split_pages(pages).collect()
    assert {r.page for r in rows} == {1}
    assert all(r.text.startswith("a.txt > T\n\n") and len(r.body) <= 1000 for r in rows)
    assert len({r.chunk_id for r in rows}) == len(rows) == 2
    again = {r.chunk_id for r in c.split_pages(pages.repartition(3)).collect()}
    assert again == {r.chunk_id for r in rows}


def test_a_fence_closes_with_its_own_mark_only(spark):
    text = "# A\n```\n~~~\n# not\n```\ntext\n## B\n```x```\n## C\n~~~\n## not\n~~~\n"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(c.sections(F.col("t"))).alias("s")).select("s.*").collect()
    assert [(r.h1, r.h2) for r in got] == [("A", None), ("A", "B"), ("A", "C")]
    assert "# not" in got[0].body and "## not" in got[2].body


def test_chunk_ids_do_not_depend_on_the_model(spark):
    pages = spark.createDataFrame([("s", 1, "# Head\n" + "some words of a page " * 90)], "source string, page int, text string")
    other = c.split_pages(pages, lambda df: df.withColumn("reply", F.lit("another line")))
    ids = {r.chunk_id for r in c.split_pages(pages).collect()}
    assert ids == {r.chunk_id for r in other.collect()} and len(ids) > 1


def test_a_page_with_a_failed_context_line_stays_pending(spark):
    def client():
        def call(prompt):
            if "poison" in prompt:
                raise ValueError("down")
            return "line"

        return call

    pages = [("s", 1, "a good page with enough words to be kept " * 40), ("s", 2, "poison " + "words of the second page here " * 60)]
    chunks = c.split_pages(spark.createDataFrame(pages, "source string, page int, text string"), models.model_step(client, retries=0))
    assert {r.page for r in chunks.collect()} == {1}
