"""Answer and retrieval quality as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import DEFAULT
from gleaner.functions.replies import judge_number
from gleaner.functions.sizes import fits, hinted
from gleaner.functions.text import is_blank, or_unknown, sentences, split_tokens, strip, token_text, tokenize
from gleaner.operators.models import Step
from gleaner.operators.prompts import JUDGE_TEMPLATE, REFUSAL, fill
from gleaner.operators.vectors import cosine, hashed_vectors

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness")
# Share of a statement's tokens that must be present before the stand-in judge calls it supported.
SUPPORTED = 0.8
PLACES = 6


def eval_samples(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(samples, skipped)``: contexts with their source and page; records without any are skipped.

    Each record holds a handful of chunks in an array.
    """
    # The line that names source and page above each context.
    told = F.transform(
        F.filter("chunks", lambda c: ~is_blank(F.coalesce(c["content"], F.lit("")))),
        lambda c: F.concat(
            F.lit("[Source : "), or_unknown(c["source"]), F.lit(" — p."), or_unknown(c["page"]),
            F.lit("]\n"), c["content"],
        ),
    )
    built = results.select(
        "id", F.col("question").alias("user_input"), F.col("reponse_llm").alias("response"),
        F.coalesce(told, F.array().cast("array<string>")).alias("retrieved_contexts"),
        F.col("reponse_attendue").alias("reference"),
    )
    return built.filter(F.size("retrieved_contexts") > 0), built.filter(
        F.size("retrieved_contexts") == 0
    ).select("id")


def statements(texts: DataFrame, text: str) -> DataFrame:
    """``(id, statement_no, statement)``: the sentences of each text that hold a token."""
    return texts.select("id", F.posexplode(sentences(F.col(text))).alias("statement_no", "statement")).filter(
        F.size(tokenize(F.col("statement"))) > 0
    )


def supported(statement: Column, evidence: Column) -> Column:
    """Stand-in verdict, 0 or 1: enough of the statement's tokens occur in the evidence."""
    asked = F.array_distinct(tokenize(statement))
    found = F.size(F.array_intersect(asked, tokenize(evidence)))
    return (found / F.size(asked) >= SUPPORTED).cast("int")


def rule_judge(df: DataFrame) -> DataFrame:
    return df.withColumn("reply", supported(F.col("statement"), F.col("evidence")).cast("string"))


def judged(pairs: DataFrame, judge: Step = rule_judge, template: str = JUDGE_TEMPLATE) -> DataFrame:
    """Adds ``verdict`` to ``pairs(statement, evidence, …)``: 1 where the judge's number is at least
    one half, NULL where the judge failed, so that it stays out of every mean."""
    prompt = fill(template, statement=F.col("statement"), evidence=F.col("evidence"))
    told = judge(pairs.withColumn("prompt", prompt))
    return told.withColumn("verdict", F.when(F.col("reply").isNotNull(), (judge_number(F.col("reply")) >= 0.5).cast("int")))


def verdicts(told: DataFrame, evidence: DataFrame, column: str, judge: Step | None = None) -> DataFrame:
    """``(id, statement_no, statement, verdict)`` against the evidence text of the same id.

    Without a judge, statements and evidence meet as (id, token) rows, so the evidence is tokenised
    once and not per statement.
    """
    if judge is not None:
        pairs = told.join(evidence.select("id", F.col(column).alias("evidence")), "id")
        return judged(pairs, judge).select("id", "statement_no", "statement", "verdict")
    asked = told.join(evidence.select("id").distinct(), "id", "left_semi").select(
        "id", "statement_no", "statement",
        F.explode(F.array_distinct(tokenize(F.col("statement")))).alias("term"),
    )
    held = evidence.select("id", F.explode(F.array_distinct(tokenize(F.col(column)))).alias("term"))
    hits = asked.join(held.withColumn("hit", F.lit(1)), ["id", "term"], "left")
    share = F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))
    return hits.groupBy("id", "statement_no", "statement").agg((share >= SUPPORTED).cast("int").alias("verdict"))


def verdict_share(judged: DataFrame, out: str) -> DataFrame:
    """Share of positive verdicts per id: faithfulness over the answer's claims, context recall over
    the reference's statements."""
    return judged.groupBy("id").agg(F.round(F.avg("verdict"), PLACES).alias(out))


def token_recall(pairs: DataFrame, reference: str, context: str, out: str = "context_recall") -> DataFrame:
    """Share of the reference's distinct tokens found in the context."""
    wanted = F.array_distinct(tokenize(F.col(reference)))
    found = F.size(F.array_intersect(wanted, tokenize(F.col(context))))
    return pairs.select(
        "id", F.when(F.size(wanted) == 0, 0.0).otherwise(F.round(found / F.size(wanted), PLACES)).alias(out)
    )


def context_precision(ranked: DataFrame) -> DataFrame:
    """Mean of precision@rank over the relevant ranks, from ``(id, rank, verdict)``."""
    so_far = Window.partitionBy("id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at_rank = ranked.withColumn("precision", F.sum("verdict").over(so_far) / F.col("rank"))
    relevant = F.sum("verdict")
    return at_rank.groupBy("id").agg(
        F.when(relevant == 0, 0.0)
        .otherwise(F.round(F.sum(F.col("precision") * F.col("verdict")) / relevant, PLACES))
        .alias("context_precision")
    )


def text_vectors(texts: DataFrame, key: list[str], text: str, dim: int = DEFAULT.vector_dim) -> DataFrame:
    tokens = texts.select(*key, token_text(F.col(text)).alias("norm"))
    return hashed_vectors(tokens, key, dim)


def answer_relevancy(questions: DataFrame, regenerated: DataFrame) -> DataFrame:
    """Mean similarity of ``questions(id, vector)`` and ``regenerated(id, statement_no, vector)``."""
    pairs = regenerated.select("id", F.col("vector").alias("other")).join(questions, "id")
    return pairs.groupBy("id").agg(
        F.round(F.avg(cosine(F.col("vector"), F.col("other"))), PLACES).alias("answer_relevancy")
    )


def answer_correctness(answer_judged: DataFrame, reference_judged: DataFrame, similarity: DataFrame,
                       weights: tuple[float, float] = (0.75, 0.25)) -> DataFrame:
    """Weighted statement F1 and similarity.

    ``answer_judged``: answer statements against the reference; ``reference_judged``: reference
    statements against the answer; ``similarity(id, similarity)``.
    """
    hits = answer_judged.groupBy("id").agg(
        F.count_if(F.col("verdict") == 1).alias("tp"), F.count_if(F.col("verdict") == 0).alias("fp")
    )
    missed = reference_judged.groupBy("id").agg(F.count_if(F.col("verdict") == 0).alias("fn"))
    tp, fp, fn = (F.coalesce(c, F.lit(0)) for c in ("tp", "fp", "fn"))
    f1 = F.when(tp + fp + fn == 0, 0.0).otherwise(tp / (tp + 0.5 * (fp + fn)))
    both = weights[0] + weights[1]
    score = (weights[0] * f1 + weights[1] * F.coalesce("similarity", F.lit(0.0))) / both
    return (
        hits.join(missed, "id", "full").join(similarity, "id", "left")
        .select("id", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
                F.round(score, PLACES).alias("answer_correctness"))
    )


def score_table(samples: DataFrame, *measures: DataFrame) -> DataFrame:
    """One row per sample with every measure, joined by id; a measure without a row stays NULL."""
    scores = samples.select("id", F.col("user_input").alias("question"))
    for measure in measures:
        scores = scores.join(measure, "id", "left")
    return scores


def with_metadata(scores: DataFrame, questions: DataFrame) -> DataFrame:
    """Looks up level, source and difficulty by id; missing ones are empty strings."""
    meta = questions.select("id", "niveau", "source", "difficulte_rag")
    meta = hinted(meta, fits(meta, DEFAULT.broadcast_bytes))
    return scores.join(meta, "id", "left").withColumns(
        {
            "source": F.coalesce("source", F.lit("")),
            "difficulte_rag": F.coalesce("difficulte_rag", F.lit("")),
            "niveau": F.coalesce(F.col("niveau").cast("string"), F.lit("")),
        }
    )


def bar(mean: Column) -> Column:
    return F.repeat(F.lit("█"), F.floor(mean * 20).cast("int"))


def report(scores: DataFrame, level: str = "niveau", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Row count and mean of every present metric, per level and in total (NULL level).

    NaN counts as missing. Sums and counts combine before the exchange, so a dominant level is safe.
    """
    present = [m for m in metrics if m in scores.columns]
    clean = [F.when(~F.isnan(m), F.col(m)).alias(m) for m in present]
    means = [F.round(F.avg(m), PLACES).alias(m) for m in present]
    return (
        scores.select(F.col(level).cast("string").alias(level), *clean)
        .rollup(level)
        .agg(F.grouping(level).cast("int").alias("is_total"), F.count(F.lit(1)).alias("n"), *means)
    )


def profile(questions: DataFrame, *levels: str) -> DataFrame:
    """Row counts for every combination of the given columns."""
    return questions.cube(*levels).agg(
        F.grouping_id().cast("int").alias("grouping"), F.count(F.lit(1)).alias("n")
    )


def refusal_rate(answers: DataFrame, answer: str = "answer") -> DataFrame:
    refused = (strip(F.col(answer)) == REFUSAL).cast("int")
    return answers.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(refused), PLACES).alias("refusal_rate"))


def planted_passages(passages: DataFrame, tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, chunk_id)``: chunks whose token sequence contains the whole sequence of a passage.

    ``passages(query_id, norm)``, ``tokens(chunk_id, norm)``, ``terms(term, df)``. Only chunks that
    hold the passage's rarest term are compared, found by an equi-join on that term.
    """
    wanted = passages.select(
        "query_id", "norm", F.explode(F.array_distinct(split_tokens(F.col("norm")))).alias("term")
    )
    asked = wanted.select("term").distinct()
    known = terms.select("term", "df").join(hinted(asked, fits(asked, DEFAULT.broadcast_bytes)), "term")
    # A passage with a term the corpus lacks has no match; the left join keeps that term as rarest.
    rarest = (
        wanted.join(known, "term", "left")
        .groupBy("query_id")
        .agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    )
    anchors = passages.join(rarest, "query_id").select(
        "query_id", "term", F.concat(F.lit(" "), "norm", F.lit(" ")).alias("needle")
    )
    anchors = hinted(anchors, fits(anchors, DEFAULT.broadcast_bytes))
    # Ids first; the token text is fetched for the candidates by a join on the shared partitioning.
    holders = tokens.select(
        "chunk_id", F.explode(F.array_distinct(split_tokens(F.col("norm")))).alias("term")
    ).join(anchors, "term")
    hay = tokens.select("chunk_id", F.concat(F.lit(" "), "norm", F.lit(" ")).alias("hay"))
    found = holders.select("chunk_id", "query_id", "needle").join(hay, "chunk_id")
    # coalesce keeps the optimizer from testing the token text for NULL below the exchange.
    held = F.coalesce(F.contains("hay", "needle"), F.lit(False))
    return found.filter(held).select("query_id", "chunk_id")


def recall_at(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """One row: share of the queries with gold chunks that have one of them among their first k."""
    hits = ranked.filter(F.col("rank") <= k).join(gold, ["query_id", "chunk_id"], "left_semi")
    asked = gold.select("query_id").distinct()
    marked = asked.join(hits.select("query_id").distinct().withColumn("hit", F.lit(1)), "query_id", "left")
    return marked.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.coalesce("hit", F.lit(0))), PLACES).alias("recall"),
    )
