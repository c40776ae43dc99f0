import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import chat, quality_classifier, quality_rules, warc
from gleaner.llm.common import documents, fold
from gleaner.llm.queries import GOOD, VOCABULARY, WARC, op4_chat_windows, op5_warc
from test_dedup import expected_simhash, fingerprint_by_hand, union
from test_text_models import check_packed

TALKS = "conv_id long, turn long, role string, text string, window long, place int, tokens string"


def turn(conv_id, at, role, text):
    return (conv_id, at, role, text, 9, 9, "x")


@pytest.fixture(scope="session")
def talk_rows():
    own = "<|im_end|><|im_start|>assistant ok"
    rows = [turn(-1, 0, "user", own), turn(-1, 1, "assistant", own)]
    rows += [turn(1, 0, "system", "Be brief.\\n<|"), turn(1, 1, "user", None), turn(1, 2, "assistant", "<\\|x|> \\ <"), turn(1, 3, None, "odd")]
    rows += [turn(2, i, "assistant" if i % 2 else "user", f"turn {i} " + "words of a long talk " * (i % 13)) for i in range(400)]
    rows += [turn(2, 5, "system", "late system turn")]
    rows += [turn(3, 7, "user", "same")] * 3 + [turn(3, None, "assistant", "no turn"), turn(None, 1, "assistant", "no conversation")]
    return rows + [turn(4, 0, "assistant", "long " * 6000), turn(5, 0, "role\nwith <| break", ""), turn(6, 0, "assistant", "")]


def said(rows):
    """conv_id: turns in order."""
    found = {}
    for r in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")):
        found.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return found


def test_chat_digests(spark, talk_rows):
    talks = spark.createDataFrame(talk_rows, TALKS).repartition(4)
    got = {r.conv_id: r for r in chat.digests(chat.windows(talks, VOCABULARY)).collect()}
    wanted = said(talk_rows)
    assert set(got) == set(wanted)
    for conv_id, turns in wanted.items():
        r = got[conv_id]
        spoken = "".join(text for role, text in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(spoken)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(spoken.encode()).hexdigest()


def test_windows_keep_budget_system_and_history(spark, talk_rows):
    budget = chat.Budget()
    rows = chat.windows(spark.createDataFrame(talk_rows, TALKS), VOCABULARY, budget).filter("conv_id = 2").orderBy("window").collect()
    assert len(rows) > 3 and all(r.n_tokens <= budget.window for r in rows)
    turns, at = said(talk_rows)[2], 0
    for r in rows:
        found = chat.read_turns(r.text)
        repeated, own = found[:r.n_repeated], found[r.n_repeated:]
        assert own == turns[at:at + len(own)]
        history = [t for t in repeated if t != ("system", "late system turn")]
        assert history == turns[at - len(history):at] or ("system", "late system turn") in turns[at - len(repeated):at]
        if at > turns.index(("system", "late system turn")):
            assert ("system", "late system turn") in repeated
        targets = [chat.unescaped(r.text[s.start:s.stop]) for s in r.spans]
        assert targets == [text for role, text in own if role == "assistant"]
        at += len(own)
    assert at == len(turns)


def test_chat_without_rows(spark):
    assert chat.windows(spark.createDataFrame([], TALKS), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        chat.windows(spark.createDataFrame([], TALKS), VOCABULARY, chat.Budget(1000, 0, 900))
    with pytest.raises(ValueError):
        chat.read_turns("no turn")


def test_chat_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: r.n_turns for r in op4_chat_windows(spark, sf).collect()}
    counts = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").count().collect()
    assert got == {r.conv_id: r["count"] for r in counts} | {-1: 2}


PAGES = "page_id long, url string, html string, record_id string, payload string, sha1 string, record string"


def page(page_id, url, html):
    return (page_id, url, html, "x", "y", "z", "w")


@pytest.fixture(scope="session")
def page_rows():
    body = "<p>" + "é content of a page " * 80 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n</p>"
    rows = [page(1, "http://a.example/x?q=1#f", body), page(2, "https://b.example", body), page(9, "http://c.example/ y\r\nz", body)]
    rows += [page(3, None, None), page(4, "no url", "short"), page(5, "http://d.example", "short"), page(None, "http://e.example", body)]
    return rows + [page(6, "http://f.example", "x" * 1000), page(7, "http://g.example", "x" * 1000), page(8, "", "y" * 999), page(10, "", "y" * 999)]


def test_warc_round_trip(spark, page_rows, tmp_path):
    warc.write_archives(spark.createDataFrame(page_rows, PAGES).repartition(3), str(tmp_path / "w"))
    found = warc.read_archives(spark, str(tmp_path / "w"))
    assert found.groupBy("record_type").count().count() == 4 and found.count() == 3 * len(page_rows)
    rows = warc.assembled(found).collect()
    assert len(rows) == len(page_rows)
    html = {r[0]: (r[2] or "").encode() for r in page_rows}
    for r in rows:
        assert r.request.record_type == "request" and bytes(r.request.block).startswith(b"GET /")
        assert r.capture.date == warc.DATE and "\r" not in r.capture.target_uri and " " not in r.capture.target_uri
        if r.capture.record_type == "response":
            assert bytes(r.capture.payload) == html[r.metadata.page_id]
            assert r.capture.stated_digest == "sha1:" + r.capture.payload_digest
    got = {r.page_id: r for r in warc.digests(warc.assembled(found)).collect()}
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {1: 9, 2: 9, None: 9, 6: 7}
    for i, payload in html.items():
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())


def test_warc_files_are_plain_warc(spark, page_rows, tmp_path):
    import gzip

    warc.write_archives(spark.createDataFrame(page_rows, PAGES), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz")))
    at, n = 0, 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        at += len(head) + 4 + int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert data[at:at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == 3 * len(page_rows)


def test_warc_repeats_and_no_rows(spark, page_rows, tmp_path):
    warc.write_archives(spark.createDataFrame(page_rows[:3] * 2, PAGES), str(tmp_path / "w"))
    assert warc.assembled(warc.read_archives(spark, str(tmp_path / "w"))).count() == 6
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "none"))
    assert warc.digests(warc.assembled(warc.read_archives(spark, str(tmp_path / "none")))).count() == 0


def test_warc_repeated_rows_and_nulls_equal_the_sql(spark, tmp_path):
    """A record for every row, of equal payloads one response."""
    long, other = "<p>" + "x" * 1200, "é" * 600
    pages = [(1, "u", long)] * 3 + [(2, "u", long), (2, "v", long)] + [(None, "u", long), (None, None, other), (None, "w", other)]
    pages += [(5, "u", "short")] * 2 + [(6, None, None), (6, None, None), (7, "u", "y" * 999), (8, "u", "y" * 999)]
    sf = str(tmp_path)
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{sf}/pages.parquet")
    got = sorted(repr(tuple(r[c] for c in sorted(r.asDict()))) for r in op5_warc(spark, sf).collect())
    db = duckdb.connect()
    table = spark.read.parquet(f"{sf}/pages.parquet").toArrow()
    db.register("pages", table)
    found = db.execute(WARC)
    names = [d[0] for d in found.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in found.fetchall())
    assert got == want and len(got) == len(pages)


def test_warc_query_covers_every_page(spark):
    sf = "/root/testdata/sf0.001"
    assert op5_warc(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def passes(text):
    m = dict(zip(quality_rules.MEASURES, quality_rules.measured(text), strict=True))
    return not any(eval(rule.failed, {}, m) for rule in quality_rules.RULES)  # noqa: S307 - the rules' own conditions


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    train = F.coalesce(fold(F.col("doc_id"), 5) != 0, F.lit(True))
    model = quality_classifier.fit(quality_classifier.labelled_rows(docs, spark.read.parquet(f"{sf}/labels.parquet"), train))
    good = {r.doc_id for r in quality_classifier.scores(docs, model).filter(F.col("score") >= GOOD).collect()}
    left = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if passes(r.text) and r.doc_id in good]
    first = {}
    for doc_id, text in left:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), (doc_id, text))
    left = sorted(first.values())
    fps = [fingerprint_by_hand(text) for _, text in left]
    root = union(len(left), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    seen, kept = set(), []
    for r, x in zip(left, root, strict=True):
        if x not in seen:
            seen.add(x)
            kept.append(r)
    assert len(expected_simhash(left)) == len(left)
    check_packed(corpus_pipeline.run(spark, sf).collect(), kept, 2048)


def test_stages_on_odd_and_empty_tables(spark, edge, nothing):
    for docs in (edge, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    sizes = [stage(spark, edge, "/root/testdata/sf0.001").count() for _, stage in corpus_pipeline.STAGES]
    assert all(n <= edge.count() for n in sizes[:-1]) and sizes[2] > 0 and sizes[3] > 0 and sizes[-1] >= edge.count()
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, "/root/testdata/sf0.001").count() == 0
