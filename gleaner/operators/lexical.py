"""BM25 index tables and scoring for many queries in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.config import DEFAULT, RetrievalConfig
from gleaner.functions.sizes import fits, hinted
from gleaner.functions.text import split_tokens, token_text, tokenize
from gleaner.sources.scratch import materialize


# Rough size of a token in a row, used for partition counts only.
BYTES_PER_TOKEN = 8
# Up to this many query terms are pushed into the scan of stored postings.
PUSHED_TERMS = 1000
# Parts of the tasks whose best rows are ranked together before a query's final rank.
TOP_PARTS = 32
# Parts that chunks are dealt into for bounds of scores.
BLOCKS = 16


@dataclass(frozen=True)
class LexicalIndex:
    """``tokens(chunk_id, source, dl, norm)``, ``terms(term, df, idf)`` and the mean length.

    ``norm`` is the blank-joined token text. Fresh ``tokens`` are hash-partitioned on ``chunk_id``,
    so every grouping on ``chunk_id`` is local. ``postings(chunk_id, source, dl, term, tf)`` is
    present once the index was written, and ``bounds`` (see ``maxscore``) with it.
    """

    tokens: DataFrame
    terms: DataFrame
    avgdl: float
    postings: DataFrame | None = None
    bounds: DataFrame | None = None


def tokenized(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, source, dl, norm)`` of each chunk; narrow."""
    return chunks.select("chunk_id", "source", token_text(F.col("text")).alias("norm")).withColumn(
        "dl", token_count(F.col("norm"))
    )


def term_counts(chunks: DataFrame) -> DataFrame:
    """``(term, df, dl_part)``: chunks holding the term. ``dl_part`` adds up to the corpus length,
    since each chunk hands its length to its first term."""
    words = chunks.select(tokenize(F.col("text")).alias("words"))
    return (
        words.select(F.size("words").alias("dl"), F.posexplode(F.array_distinct("words")).alias("pos", "term"))
        .groupBy("term")
        .agg(
            F.count(F.lit(1)).alias("df"),
            F.sum(F.when(F.col("pos") == 0, F.col("dl")).otherwise(0)).alias("dl_part"),
        )
    )


def term_statistics(chunks: DataFrame, n_chunks: int, cfg: RetrievalConfig = DEFAULT):
    """``terms(term, df, idf)`` and the mean chunk length.

    A negative idf becomes epsilon times the mean raw idf over all terms. The vocabulary is written
    once: the mean and every later lookup read it back instead of tokenising the corpus again.
    """
    counts = materialize(term_counts(chunks), "terms")
    length = counts.agg(F.sum("dl_part").alias("length")).first()["length"]
    return with_idf(counts.drop("dl_part"), n_chunks, cfg), (length or 0) / max(n_chunks, 1)


def with_idf(counts: DataFrame, n_chunks: int, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """Adds ``idf`` to a written vocabulary ``counts(term, df, ...)``."""
    raw = F.log(F.lit(n_chunks) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    floor = cfg.bm25_epsilon * (counts.agg(F.avg(raw).alias("mean_idf")).first()["mean_idf"] or 0.0)
    return counts.withColumn("idf", F.when(raw < 0, F.lit(floor)).otherwise(raw))


def block_of(chunk_id: Column) -> Column:
    return F.pmod(F.xxhash64(chunk_id), F.lit(BLOCKS)).cast("int")


def block_bounds(postings: DataFrame) -> DataFrame:
    """``(term, block, df, max_tf, min_dl)`` of ``postings(chunk_id, dl, term, tf)``: what bounds a term's part of any
    score in a block. Over disjoint sets of chunks the columns add up, by sum, max and min."""
    return postings.groupBy("term", block_of(F.col("chunk_id")).alias("block")).agg(
        F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


def summed_bounds(bounds: DataFrame) -> DataFrame:
    return bounds.groupBy("term", "block").agg(
        F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))


def write_bounds(bounds: DataFrame, path: str) -> None:
    """Sorted by term, so that a search of a few terms skips the other files and row groups."""
    bounds.repartitionByRange("term").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(path)


def build_index(chunks: DataFrame, cfg: RetrievalConfig = DEFAULT) -> LexicalIndex:
    """Index over ``chunks(chunk_id, source, text)``; statistics always cover the whole corpus."""
    tokens = tokenized(chunks)
    n_chunks = chunks.count()
    terms, avgdl = term_statistics(chunks, n_chunks, cfg)
    return LexicalIndex(by_chunk(tokens, n_chunks * avgdl, cfg), terms, avgdl)


def token_count(norm: Column) -> Column:
    blanks = F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))
    return F.when(norm == "", 0).otherwise(blanks + 1)


def by_chunk(tokens: DataFrame, n_tokens: float, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """Hash-partitions on ``chunk_id``. The corpus length is known by then and sets the number of partitions: they hold
    ``cfg.token_bytes`` of token text, since counting a partition's words takes many times its text. A number that is
    named is not lowered by AQE, which goes by compressed bytes. Lengths are counted behind the exchange, so that lexical
    and vector plans ask for the same one."""
    cores = tokens.sparkSession.sparkContext.defaultParallelism
    needed = -(-int(n_tokens * BYTES_PER_TOKEN) // min(cfg.token_bytes, cfg.partition_bytes))
    spread = tokens.drop("dl").repartition(max(needed, cores), "chunk_id")
    return spread.withColumn("dl", token_count(F.col("norm")))


def postings_of(tokens: DataFrame, meta: tuple[str, ...] = ("source",), only: DataFrame | None = None,
                small: bool = True) -> DataFrame:
    """Term frequency per chunk; local where ``tokens`` is partitioned on ``chunk_id``. With ``only``,
    a table of terms, ``small`` or not, the others are dropped before counting."""
    keys = ("chunk_id", *meta, "dl")
    occurrences = tokens.select(*keys, F.explode(split_tokens(F.col("norm"))).alias("term"))
    if only is not None:
        occurrences = occurrences.join(hinted(only, small), "term", "left_semi")
    return occurrences.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def save_index(index: LexicalIndex, path: str) -> None:
    """Write the index. Postings are range-partitioned on (term, chunk_id): a lookup of a few terms
    skips the other files by their statistics, and a frequent term spans several files."""
    index.tokens.write.mode("overwrite").parquet(f"{path}/tokens")
    index.terms.withColumn("avgdl", F.lit(index.avgdl)).write.mode("overwrite").parquet(f"{path}/terms")
    (
        postings_of(index.tokens)
        .repartitionByRange("term", "chunk_id")
        .sortWithinPartitions("term", "chunk_id")
        .write.mode("overwrite")
        .parquet(f"{path}/postings")
    )
    write_bounds(block_bounds(index.tokens.sparkSession.read.parquet(f"{path}/postings")), f"{path}/bounds")


def load_index(spark: SparkSession, path: str) -> LexicalIndex:
    terms = spark.read.parquet(f"{path}/terms")
    first = terms.select("avgdl").first()
    return LexicalIndex(
        spark.read.parquet(f"{path}/tokens"),
        terms.drop("avgdl"),
        first["avgdl"] if first else 0.0,
        spark.read.parquet(f"{path}/postings"),
        spark.read.parquet(f"{path}/bounds"),
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, sources, term, qtf)``: a repeated query word counts again."""
    return (
        queries.select("query_id", "sources", F.explode(tokenize(F.col("question"))).alias("term"))
        .groupBy("query_id", "sources", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def with_sources(queries: DataFrame) -> DataFrame:
    """Adds the optional per-query source filter; NULL or empty means everywhere."""
    if "sources" not in queries.columns:
        return queries.withColumn("sources", F.lit(None).cast("array<string>"))
    return queries.withColumn("sources", F.when(F.size("sources") > 0, F.col("sources")))


def _salted(weights: DataFrame, postings: DataFrame, terms: DataFrame, cfg: RetrievalConfig):
    """Adds a join salt: a frequent term is cut into parts by chunk, its query rows repeated per part."""
    parts = F.ceil(F.col("df") / F.lit(cfg.hot_term_postings)).cast("int")
    hot = terms.filter(F.col("df") > cfg.hot_term_postings).select("term", parts.alias("parts"))
    hot = hinted(hot, fits(hot, cfg.broadcast_bytes))
    weights = weights.join(hot, "term", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    )
    postings = postings.join(hot, "term", "left").withColumn(
        "salt",
        F.pmod(F.xxhash64("chunk_id"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int"),
    )
    return weights.drop("parts"), postings.drop("parts")


def bm25_scores(queries: DataFrame, index: LexicalIndex, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """``(query_id, chunk_id, score)`` of every chunk sharing a term with the query."""
    filtered = "sources" in queries.columns
    # Without a filter the source stays out of the token exchange.
    meta = ("source",) if filtered else ()
    wanted = query_terms(with_sources(queries))
    small = fits(wanted, cfg.broadcast_bytes)
    weights = index.terms.join(hinted(wanted, small), "term").select(
        "query_id", "sources", "term", (F.col("qtf") * F.col("idf")).alias("weight")
    )
    asked = wanted.select("term").distinct()
    if index.postings is None:
        postings = postings_of(index.tokens, meta, asked if small else None)
    elif small:
        few = [r["term"] for r in asked.limit(PUSHED_TERMS + 1).collect()]
        # A short list reaches the Parquet reader, which skips the row groups of other terms.
        postings = (
            index.postings.filter(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS
            else index.postings.join(F.broadcast(asked), "term", "left_semi")
        )
    else:
        postings = index.postings
    keys = ["term"]
    if not small:
        weights, postings = _salted(weights, postings, index.terms, cfg)
        keys = ["term", "salt"]
    k1, b = cfg.bm25_k1, cfg.bm25_b
    norm = k1 * (1 - b + b * F.col("dl") / F.lit(max(index.avgdl, 1e-9)))
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    pairs = postings.join(hinted(weights, small), keys)
    if filtered:
        pairs = pairs.filter(F.col("sources").isNull() | F.array_contains("sources", F.col("source")))
    return (
        pairs.groupBy("chunk_id", "query_id")
        .agg(F.round(F.sum(part), cfg.score_places).alias("score"))
    )


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per query, ties by chunk id. Spark keeps k rows per query and task before an exchange; a first round
    within ``TOP_PARTS`` groups of tasks bounds what the task of one query sorts, however many tasks there are."""
    best = (F.desc("score"), F.asc("chunk_id"))
    part = F.pmod(F.spark_partition_id(), F.lit(TOP_PARTS))
    first = Window.partitionBy("query_id", "_part").orderBy(*best)
    dealt = scored.withColumn("_part", part).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    order = Window.partitionBy("query_id").orderBy(*best)
    return dealt.drop("_part").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def zero_fill(queries: DataFrame, scored: DataFrame, chunks: DataFrame, k: int) -> DataFrame | None:
    """Unmatched chunks with score 0 for the queries that match fewer than ``k`` chunks; None where there is none.

    The first chunks by id are enough: with fewer than k matches, at least as many of the first k
    allowed chunks as are needed are unmatched. So a query meets k rows per allowed source at most.
    """
    asked = with_sources(queries).select("query_id", "sources")
    counts = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("matches"))
    short = asked.join(counts, "query_id", "left").filter(F.coalesce("matches", F.lit(0)) < k)
    short = materialize(short.select("query_id", "sources"), "short")
    kinds = {r["named"] for r in short.select(F.col("sources").isNotNull().alias("named")).distinct().collect()}
    fresh = []
    if False in kinds:
        anywhere = [r["chunk_id"] for r in chunks.select("chunk_id").orderBy("chunk_id").limit(k).collect()]
        id_type = chunks.schema["chunk_id"].dataType
        ids = F.array(*[F.lit(c).cast(id_type) for c in anywhere]).cast(T.ArrayType(id_type))
        fresh.append(short.filter("sources is null").select("query_id", F.explode(ids).alias("chunk_id")))
    if True in kinds:
        named = short.select("query_id", F.explode("sources").alias("source")).distinct()
        of_source = Window.partitionBy("source").orderBy("chunk_id")
        first = chunks.select("chunk_id", "source").withColumn("n", F.row_number().over(of_source)).filter(F.col("n") <= k)
        fresh.append(named.join(first, "source").select("query_id", "chunk_id"))
    if not fresh:
        return None
    found = fresh[0] if len(fresh) == 1 else fresh[0].unionByName(fresh[1])
    return found.join(scored.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
