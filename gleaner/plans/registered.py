"""The registered queries: every operator over the whole given tables.

``documents`` plays the chunks, ``benchmark`` the questions, ``labels`` the judgements,
``conversations`` the chats, ``pages`` the structured pages.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import DEFAULT
from gleaner.functions import replies, text
from gleaner.operators import batch, chunking, fusion, lexical, maxscore, metrics, prompts, vectors
from gleaner.plans import agent, ask, evaluate, library, retrieve
from gleaner.sources import pages as page_sources
from gleaner.sources import records, store
from gleaner.sources.scratch import scratch_path
from gleaner.streaming.ingest import ingest_stream

TOP = DEFAULT.k_final


TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return page_sources.spread(rows) if name in TEXT_TABLES else rows


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text")


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def document_pages(spark, sf_dir) -> DataFrame:
    return page_sources.from_documents(table(spark, sf_dir, "documents"))


def html_pages(spark, sf_dir) -> DataFrame:
    return page_sources.from_html(table(spark, sf_dir, "pages"))


# Text functions and page rules


def tokenize_counts(spark, sf_dir):
    words = text.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_terms"),
        F.array_join(words, " ").alias("tokens"),
    )


def encoding_repair(spark, sf_dir):
    broken = F.decode(F.encode(F.col("text"), "UTF-8"), "ISO-8859-1")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", broken.alias("broken"))
    return docs.select(
        "doc_id", (F.col("broken") != F.col("text")).alias("was_broken"),
        text.repair_encoding(F.col("broken")).alias("repaired"),
        text.repair_encoding(F.col("text")).alias("untouched"),
    )


def display_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.or_unknown(F.col("source")).alias("source"), text.one_line(F.col("text")).alias("line")
    )


def page_markdown(spark, sf_dir):
    return html_pages(spark, sf_dir)


def contents_pages(spark, sf_dir):
    """Contents text derived from each page: its navigation entries with dot leaders, then its text."""
    nav = F.regexp_extract("html", r"(?is)<nav\b[^>]*>(.*?)</nav>", 1)
    entries = F.regexp_replace(nav, r"(?i)<li\b[^>]*>", "\n")
    entries = F.regexp_replace(entries, r"(?i)</li>", " . . . . 1")
    entries = F.regexp_replace(entries, r"<[^>]*>", "")
    whole = F.concat(entries, F.lit("\n"), page_sources.html_to_markdown(F.col("html")))
    return table(spark, sf_dir, "pages").select(
        "page_id", chunking.is_contents_page(whole).alias("is_contents")
    )


def header_sections(spark, sf_dir):
    cut = html_pages(spark, sf_dir).select(
        "source", "page", F.posexplode(chunking.sections(F.col("text"))).alias("section_no", "s")
    )
    return cut.select("source", "page", "section_no", "s.body", "s.h1", "s.h2", "s.h3")


def merge_small(spark, sf_dir):
    none = F.lit(None).cast("string")
    parts = F.transform(
        F.split("text", "\n"),
        lambda b: F.struct(b.alias("body"), none.alias("h1"), none.alias("h2"), none.alias("h3")),
    )
    merged = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(chunking.merge_small(parts)).alias("part_no", "part")
    )
    return merged.select("doc_id", "part_no", "part.body")


def chunk_windows(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(chunking.windows(F.col("text"))).alias("w")
    )
    return chunking.with_content(cut.select("doc_id", "w.start", "w.text"))


def chunk_recursive(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(chunking.size_split(F.col("text"))).alias("chunk_no", "text")
    )


def context_prefix(spark, sf_dir):
    cut = html_pages(spark, sf_dir).select(
        "source", "page", F.col("text").alias("page_text"),
        F.posexplode(chunking.sections(F.col("text"))).alias("section_no", "s"),
    ).select("source", "page", "page_text", "section_no", "s.body", "s.h1", "s.h2", "s.h3")
    return chunking.contextualize(cut).select("source", "page", "section_no", "context_line", "text")


def page_chunks(spark, sf_dir):
    return chunking.split_pages(html_pages(spark, sf_dir))


def document_chunks(spark, sf_dir):
    return chunking.split_pages(document_pages(spark, sf_dir))


# Lexical and vector search


def term_idf(spark, sf_dir):
    terms = lexical.build_index(documents(spark, sf_dir)).terms
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25(spark, sf_dir, k=DEFAULT.k_retrieve):
    return maxscore.bm25_top_k(questions(spark, sf_dir), lexical.build_index(documents(spark, sf_dir)), k)


def bm25_top20(spark, sf_dir):
    return bm25(spark, sf_dir)


def bm25_bounded(spark, sf_dir):
    """The same lists by bounds of scores, which other rows use for larger work only."""
    cfg = replace(DEFAULT, direct_pairs=0)
    return maxscore.bm25_top_k(questions(spark, sf_dir), lexical.build_index(documents(spark, sf_dir)), cfg=cfg)


def bm25_by_source(spark, sf_dir):
    """Each question may only look into the source of the document that carries its number."""
    docs = documents(spark, sf_dir)
    own = docs.select(F.col("chunk_id").alias("query_id"), F.array("source").alias("sources"))
    asked = questions(spark, sf_dir).join(own, "query_id", "left")
    return maxscore.bm25_top_k(asked, lexical.build_index(docs))


def bm25_filled(spark, sf_dir):
    """Questions made of one source name, which no document holds, next to the real ones: short lists
    are filled with unmatched documents."""
    docs = documents(spark, sf_dir)
    names = docs.select("source").distinct().select(
        F.col("source").alias("query_id"), F.col("source").alias("question"), F.array("source").alias("sources")
    )
    asked = names.unionByName(
        questions(spark, sf_dir).select(F.col("query_id").cast("string"), "question",
                                        F.lit(None).cast("array<string>").alias("sources"))
    )
    cfg = replace(DEFAULT, fill_zero=True)
    return maxscore.bm25_top_k(asked, lexical.build_index(docs, cfg), cfg=cfg)


def embedded(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("source"),
        F.col("embedding").alias("vector"),
    )


def embedded_questions(spark, sf_dir) -> DataFrame:
    """Every question with the vector of the same number: a synthetic pairing."""
    items = questions(spark, sf_dir).select("query_id")
    own = embedded(spark, sf_dir).select(F.col("chunk_id").alias("query_id"), "source", "vector")
    return items.join(own, "query_id")


def vector_top20(spark, sf_dir):
    found = vectors.checked_dimension(embedded(spark, sf_dir), 64)
    return vectors.nearest(embedded_questions(spark, sf_dir).drop("source"), found)


def vector_pivoted(spark, sf_dir):
    """The same lists from a pivot table, which skips vectors by the triangle inequality."""
    return vectors.nearest(embedded_questions(spark, sf_dir).drop("source"), vectors.pivoted(embedded(spark, sf_dir)))


def vector_filtered(spark, sf_dir):
    asked = embedded_questions(spark, sf_dir).select("query_id", F.array("source").alias("sources"), "vector")
    return vectors.nearest(asked, embedded(spark, sf_dir))


def document_vectors(spark, sf_dir) -> DataFrame:
    return vectors.hashed_vectors(lexical.tokenized(documents(spark, sf_dir)), ["chunk_id", "source"])


def hashed_vectors(spark, sf_dir):
    weights = document_vectors(spark, sf_dir).select("chunk_id", F.posexplode("vector").alias("bucket", "w"))
    return weights.filter("w > 0").select("chunk_id", "bucket", F.round("w", 6).alias("weight"))


def corpus_reopened(spark, sf_dir):
    """Vectors stored with the corpus, searched in another session."""
    root = scratch_path(spark, "library")
    library.add_chunks(documents(spark, sf_dir), root)
    later = spark.newSession()
    held = library.open_corpus(later, root)
    return vectors.nearest(retrieve.query_vectors(questions(later, sf_dir)), held.vectors)


def corpus_grown(spark, sf_dir):
    """Half the documents, then the other half, then all again, merged to one segment: as if added at once."""
    docs, root = documents(spark, sf_dir), scratch_path(spark, "library")
    half = F.pmod(F.xxhash64("chunk_id"), F.lit(2))
    for part in (docs.filter(half == 0), docs.filter(half == 1), docs):
        library.add_chunks(part, root)
    library.compact(spark, root, fan=2)
    cfg = replace(DEFAULT, direct_pairs=0)
    return maxscore.bm25_top_k(questions(spark, sf_dir), library.open_corpus(spark, root).lexical, cfg=cfg)


def corpus(spark, sf_dir) -> retrieve.Corpus:
    return retrieve.build_corpus(documents(spark, sf_dir))


def hashed_top20(spark, sf_dir):
    asked = retrieve.query_vectors(questions(spark, sf_dir))
    return vectors.nearest(asked, document_vectors(spark, sf_dir))


# Fusion, rerank, prompts


def rrf_fusion(spark, sf_dir):
    rows = retrieve.fused(questions(spark, sf_dir), corpus(spark, sf_dir))
    return rows.select("query_id", "position", "chunk_id", "source", "rrf", "text")


def rrf_diverse_top10(spark, sf_dir):
    rows = retrieve.diverse(questions(spark, sf_dir), corpus(spark, sf_dir))
    return rows.select("query_id", "position", "chunk_id", "source", "rrf")


def rerank_top5(spark, sf_dir):
    rows = retrieve.retrieve(questions(spark, sf_dir), corpus(spark, sf_dir))
    return rows.select("query_id", "rank", "chunk_id", "source", "pair_score", "text")


def lexical_passages(spark, sf_dir, k=TOP) -> DataFrame:
    """The first BM25 results of every question with their text."""
    best = bm25(spark, sf_dir, k)
    asked = questions(spark, sf_dir)
    return (
        documents(spark, sf_dir).join(F.broadcast(best) if asked.count() <= 100_000 else best, "chunk_id")
        .join(asked, "query_id")
        .withColumn("page", F.lit(None).cast("int"))
    )


def context_assembly(spark, sf_dir):
    context = prompts.assemble_context(lexical_passages(spark, sf_dir))
    filled = context.join(questions(spark, sf_dir), "query_id").withColumn(
        "prompt", prompts.fill("{context}\n\nQUESTION : {question}", question=F.col("question"),
                               context=F.col("context"))
    )
    return filled.select("query_id", "prompt", "passages", "n_passages")


def grounded_answers(spark, sf_dir):
    asked = questions(spark, sf_dir)
    found = retrieve.retrieve(asked, corpus(spark, sf_dir))
    return ask.answer(asked, found).select("query_id", "answer", "n_passages")


def refused_answers(spark, sf_dir):
    """Answers to the questions, and to source names, which no document holds: those find no passage and are refused."""
    docs = documents(spark, sf_dir)
    named = docs.select(F.col("source").alias("query_id"), F.col("source").alias("question")).distinct()
    asked = questions(spark, sf_dir).withColumn("query_id", F.col("query_id").cast("string")).unionByName(named)
    best = maxscore.bm25_top_k(asked, lexical.build_index(docs), TOP, replace(DEFAULT, fill_zero=False))
    told = docs.join(best, "chunk_id")
    return ask.answer(asked, told).select("query_id", "answer", "n_passages")


def chat_last_turn(spark, sf_dir):
    return prompts.last_message(table(spark, sf_dir, "conversations"))


def chat_last_user(spark, sf_dir):
    return prompts.last_message(table(spark, sf_dir, "conversations"), role="user")


def chat_envelope(spark, sf_dir):
    last = prompts.last_message(table(spark, sf_dir, "conversations"))
    body = prompts.reply_envelope(F.col("question"), "gleaner-agentic", "chatcmpl-gleaner", F.col("turn"))
    return last.select("conv_id", body.alias("body"))


def source_replies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    told = docs.select("doc_id", F.concat(F.lit("Voir "), F.upper("source"), F.lit(" : "), "text").alias("reply"))
    parsed = replies.chosen_sources(told, "doc_id", "reply", agent.source_names(docs))
    return parsed.select("doc_id", F.array_join("sources", ",").alias("sources"))


def grade_replies(spark, sf_dir):
    reply = F.concat(F.when(F.col("role") == "assistant", "  Oui. ").otherwise("NON — "), F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", replies.is_sufficient(reply, F.col("turn")).alias("sufficient"),
        replies.grade_verdict(reply, F.col("turn")).alias("verdict"),
    )


def judge_numbers(spark, sf_dir):
    written = F.replace(F.col("value").cast("decimal(18,4)").cast("string"), F.lit("."), F.lit(","))
    reply = F.concat(F.lit("Score "), F.col("event_type"), F.lit(" : "), written)
    return table(spark, sf_dir, "events").select("event_id", replies.judge_number(reply).alias("score"))


# Rounds and batches


def pool_merge(spark, sf_dir):
    """A second search joins the pool of the first; pools above five are reranked."""
    both = corpus(spark, sf_dir)
    asked = questions(spark, sf_dir)
    old = lexical.top_k(lexical.bm25_scores(asked, both.lexical), TOP)
    new = vectors.nearest(retrieve.query_vectors(asked), both.embeddings, TOP)

    def told(ranked):
        return both.chunks.join(ranked, "chunk_id").join(asked, "query_id").select(
            "query_id", "question", "rank", "chunk_id", "source", "page", "text"
        )

    pool = agent.trim_pool(agent.merge_pool(told(old), told(new)), TOP)
    return pool.select("query_id", "rank", "chunk_id", "source")


def agent_rounds(spark, sf_dir):
    stored = retrieve.stored(spark, corpus(spark, sf_dir))
    answers, _ = agent.ask_in_rounds(questions(spark, sf_dir), stored)
    return answers.select(
        "query_id", "current_query", F.array_join("sources", ",").alias("sources"), "attempts", "sufficient",
        "verdict", "answer", "n_passages",
    )


def pending_items(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return batch.pending(docs, table(spark, sf_dir, "labels"), "doc_id")


def progress_counts(spark, sf_dir):
    return batch.progress(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def ingest_resume(spark, sf_dir):
    """Pages whose content is not among the labelled documents, as if those were ingested before."""
    docs = table(spark, sf_dir, "documents")
    done = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    key = batch.page_key(F.col("source"), F.col("page"), F.col("text")).alias("page_key")
    stored = page_sources.from_documents(done).select(key)
    pages = docs.select("doc_id", "source", F.lit(None).cast("int").alias("page"), "text")
    return batch.unseen_pages(pages, stored).select("doc_id", "source", F.length("text").alias("n_chars"))


def result_records(spark, sf_dir):
    """Result rows of a lexical run, written as JSON and read back."""
    best = lexical_passages(spark, sf_dir)
    asked = questions(spark, sf_dir).select(
        F.col("query_id").cast("string").alias("id"), "question", F.col("question").alias("reponse_attendue")
    )
    told = best.withColumn("query_id", F.col("query_id").cast("string"))
    answers = told.filter("rank = 1").select(
        "query_id", F.col("text").alias("answer"), F.lit(None).cast("array<string>").alias("sources"),
        F.lit(1).alias("attempts"), F.lit(True).alias("sufficient"),
    )
    path = scratch_path(spark, "results")
    records.append_results(batch.result_rows(asked, answers, told, 1.26), path)
    back = records.read_results(spark, path)
    return back.select(
        "id", "question", "reponse_llm", "duree_secondes", "logs", F.posexplode("chunks").alias("n", "c")
    ).select("id", "question", "reponse_llm", "duree_secondes", "logs", "n", "c.source", "c.page", "c.content")


def store_scan(spark, sf_dir):
    """Chunks written by source and scanned without their text; writing twice adds nothing."""
    path = scratch_path(spark, "store")
    store.write_store(documents(spark, sf_dir), path)
    store.append_store(documents(spark, sf_dir), path)
    return store.read_store(spark, path, "chunk_id", "source")


def source_listing(spark, sf_dir):
    return store.source_listing(table(spark, sf_dir, "documents"))


def stream_windows(spark, sf_dir):
    """Incremental ingest of the documents file, cut into character windows."""
    def cut(docs):
        wide = docs.select("doc_id", F.explode(chunking.windows(F.col("text"))).alias("w"))
        rows = chunking.with_content(wide.select("doc_id", "w.start", "w.text"))
        return rows.withColumn("chunk_id", chunking.chunk_id("doc_id", "start", "text"))

    out = scratch_path(spark, "stream")
    schema = table(spark, sf_dir, "documents").schema
    # A glob serves both layouts of a table: one file, or a folder of part files.
    stream = ingest_stream(spark, f"{sf_dir}/documents.parquet*", schema, out, f"{out}-state", chunk=cut)
    stream.awaitTermination()
    return spark.read.parquet(out).select("doc_id", "start", "text")


# Evaluation


def gold(spark, sf_dir, index: lexical.LexicalIndex) -> DataFrame:
    passages = questions(spark, sf_dir).select("query_id", text.token_text(F.col("question")).alias("norm"))
    return metrics.planted_passages(passages, index.tokens, index.terms)


def planted_passages(spark, sf_dir):
    return gold(spark, sf_dir, lexical.build_index(documents(spark, sf_dir)))


def recall_at_5(spark, sf_dir):
    index = lexical.build_index(documents(spark, sf_dir))
    ranked = maxscore.bm25_top_k(questions(spark, sf_dir), index, TOP)
    return metrics.recall_at(ranked, gold(spark, sf_dir, index), TOP)


def eval_samples(spark, sf_dir):
    samples, _ = metrics.eval_samples(run_results(spark, sf_dir))
    return samples.select(
        "id", "user_input", "response", F.array_join("retrieved_contexts", "\n|\n").alias("contexts"), "reference"
    )


def judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """``(id, reference)`` and ``(id, context, answer)`` of a lexical run."""
    told = lexical_passages(spark, sf_dir)
    context = ask.first_passage_answer(prompts.assemble_context(told)).select(
        F.col("query_id").alias("id"), F.col("passages").alias("context"), F.col("reply").alias("answer")
    )
    wanted = questions(spark, sf_dir).select(F.col("query_id").alias("id"), F.col("question").alias("reference"))
    return wanted, context


def claims(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The sentences of each answer, and the passages besides the one it was taken from."""
    told = lexical_passages(spark, sf_dir)
    answers = ask.first_passage_answer(prompts.assemble_context(told)).select(F.col("query_id").alias("id"), F.col("reply").alias("answer"))
    others = prompts.assemble_context(told.filter("rank > 1")).select(F.col("query_id").alias("id"), F.col("passages").alias("context"))
    return metrics.statements(answers, "answer"), others


def faithfulness(spark, sf_dir):
    """Share of an answer's sentences that the other passages support."""
    told, others = claims(spark, sf_dir)
    return metrics.verdict_share(metrics.verdicts(told, others, "context"), "faithfulness")


def claim_verdicts(spark, sf_dir):
    told, others = claims(spark, sf_dir)
    return metrics.verdicts(told, others, "context")


def token_recall(spark, sf_dir):
    wanted, context = judged(spark, sf_dir)
    return metrics.token_recall(wanted.join(context, "id"), "reference", "context", "token_recall")


def answer_relevancy(spark, sf_dir):
    """Regenerated questions are played by the sentences of the answer."""
    wanted, context = judged(spark, sf_dir)
    asked = metrics.text_vectors(wanted, ["id"], "reference")
    told = metrics.text_vectors(metrics.statements(context, "answer"), ["id", "statement_no"], "statement")
    return metrics.answer_relevancy(asked, told)


def context_precision(spark, sf_dir):
    """A retrieved document is relevant when it is labelled as good."""
    good = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("quality").alias("verdict"))
    ranked = bm25(spark, sf_dir, TOP).join(good, "chunk_id", "left").select(
        F.col("query_id").alias("id"), "rank", F.coalesce("verdict", F.lit(0)).alias("verdict")
    )
    return metrics.context_precision(ranked)


def answer_correctness(spark, sf_dir):
    wanted, context = judged(spark, sf_dir)
    of_answer = metrics.verdicts(metrics.statements(context, "answer"), wanted, "reference")
    of_reference = metrics.verdicts(metrics.statements(wanted, "reference"), context, "answer")
    left = metrics.text_vectors(wanted, ["id"], "reference")
    right = metrics.text_vectors(context, ["id"], "answer").withColumnRenamed("vector", "other")
    alike = left.join(right, "id").select(
        "id", vectors.cosine(F.col("vector"), F.col("other")).alias("similarity")
    )
    return metrics.answer_correctness(of_answer, of_reference, alike)


def run_results(spark, sf_dir) -> DataFrame:
    """Result records of a lexical run: the answer is the best passage, the question its reference."""
    told = lexical_passages(spark, sf_dir)
    rows = told.groupBy(F.col("query_id").alias("id"), "question").agg(
        F.array_sort(F.collect_list(F.struct("rank", "source", "page", F.col("text").alias("content")))).alias("chunks")
    )
    return rows.select(
        "id", "question", F.get("chunks", F.lit(0))["content"].alias("reponse_llm"),
        F.col("question").alias("reponse_attendue"), "chunks",
    )


def score_table(spark, sf_dir):
    """All five measures of a run, joined by id."""
    scores, _ = evaluate.evaluate(run_results(spark, sf_dir))
    return scores.drop("question")


def labelled_scores(spark, sf_dir) -> DataFrame:
    """Score rows out of the labels: level is the language, NaN where a document is toxic."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    toxic = F.col("toxic") == 1
    return rows.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("niveau"),
        F.col("quality").cast("double").alias("faithfulness"),
        F.when(toxic, F.lit(float("nan"))).otherwise(F.col("quality") * 0.5 + 0.25).alias("answer_correctness"),
    )


def metric_report(spark, sf_dir):
    told = metrics.report(labelled_scores(spark, sf_dir))
    return told.withColumn("bar", metrics.bar(F.col("faithfulness")))


def score_metadata(spark, sf_dir):
    """Documents as score rows; only the labelled ones have a metadata row."""
    meta = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("niveau"),
        F.concat(F.lit("s"), "toxic").alias("source"), F.lit(None).cast("string").alias("difficulte_rag"),
    )
    scores = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return metrics.with_metadata(scores, meta)


def scores_csv(spark, sf_dir):
    """The same rows, written as CSV and read back."""
    path = scratch_path(spark, "scores")
    records.write_scores(score_metadata(spark, sf_dir), path)
    schema = "id long, n_chars long, niveau string, source string, difficulte_rag string"
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
    # No value is NULL here; by default an empty text would be read as one.
    return rows.option("nullValue", "\\N").csv(path)


def gold_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.profile(rows, "lang", "source", "quality")


def refusal_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    told = F.when(F.col("quality") == 0, F.concat(F.lit(" "), F.lit(prompts.REFUSAL), F.lit("\n"))).otherwise(F.col("text"))
    return metrics.refusal_rate(rows.select(told.alias("answer")))


REGISTERED = (
    tokenize_counts, encoding_repair, display_lines, page_markdown, contents_pages, header_sections, merge_small,
    chunk_windows, chunk_recursive, context_prefix, page_chunks, document_chunks, term_idf, bm25_top20,
    bm25_bounded, bm25_by_source, bm25_filled, vector_top20, vector_pivoted, vector_filtered, hashed_vectors, hashed_top20, corpus_reopened, corpus_grown, rrf_fusion,
    rrf_diverse_top10, rerank_top5, context_assembly, grounded_answers, refused_answers, chat_last_turn, chat_last_user,
    chat_envelope, source_replies, grade_replies, judge_numbers, pool_merge, agent_rounds, pending_items,
    progress_counts, ingest_resume, result_records, store_scan, source_listing, stream_windows,
    planted_passages, recall_at_5, eval_samples, claim_verdicts, faithfulness, token_recall,
    answer_relevancy, context_precision, answer_correctness, score_table, metric_report, score_metadata, scores_csv, gold_profile,
    refusal_rate,
)
