"""From raw documents to packed training sequences: rules, classifier, exact and near duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; all but the last return
the columns of ``documents``. The result of a stage is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import exact_dedup, packing, quality_classifier, quality_rules, simhash
from gleaner.llm.common import documents, fold, one_stays, written
from gleaner.llm.queries import GOOD, RANKS, VOCABULARY


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the standard policy."""
    return quality_rules.kept_rows(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores ``GOOD`` or better. It learns from the labelled rows of the whole table,
    as the rules have already taken most bad examples out of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    train = F.coalesce(fold(F.col("doc_id"), 5) != 0, F.lit(True))
    model = quality_classifier.fit(quality_classifier.labelled_rows(documents(spark, sf_dir), labels, train))
    return quality_classifier.kept_rows(docs, model, GOOD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    stays = exact_dedup.decided(docs).filter("stays").select("doc_id", "digest", "n")
    return one_stays(docs, exact_dedup.text_digest(F.col("text")), written(stays, "stays"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_stays(docs, simhash.row_digest(F.col("text")), written(simhash.keepers(simhash.decided(docs)), "stays"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return packing.packed(packing.pieces(docs, VOCABULARY, RANKS))


STAGES = [("rules", rules), ("quality", quality), ("exact", exact), ("near", near), ("packing", packed)]

#: Trained scores, fingerprints, token ids and packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
