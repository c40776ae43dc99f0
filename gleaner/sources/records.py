"""Questions, results and score tables in their file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names of the question and result files.
QUESTION_SCHEMA = (
    "id string, niveau int, source string, question string, reponse_attendue string, "
    "contexte_source string, type string, difficulte_rag string"
)
# A page may be a number or "?"; it is read as text and turned into a nullable number.
_RESULT_FILE_SCHEMA = (
    "id string, question string, reponse_attendue string, reponse_llm string, duree_secondes double, "
    "logs string, chunks array<struct<source:string,page:string,content:string>>"
)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of questions."""
    return spark.read.schema(QUESTION_SCHEMA).option("multiLine", True).json(path)


def questions_in_text(spark: SparkSession, path: str) -> DataFrame:
    """The JSON list that stands inside a longer text, from its first ``[`` at a line start to the
    last ``]`` at a line end."""
    found = F.regexp_extract("value", r"(?ms)^(\[\s*\{.*\}\s*\])\s*$", 1)
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.from_json(found, f"array<struct<{_nested(QUESTION_SCHEMA)}>>")).alias("q"))
        .select("q.*")
    )


def _nested(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split() for part in ddl.split(",")))


def read_results(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Result records; ``multi_line`` for one JSON list per file, otherwise one record per line."""
    rows = spark.read.schema(_RESULT_FILE_SCHEMA).option("multiLine", multi_line).json(path)
    return rows.withColumn(
        "chunks",
        F.transform(
            "chunks",
            lambda c: F.struct(c["source"].alias("source"), c["page"].try_cast("int").alias("page"),
                               c["content"].alias("content")),
        ),
    )


def append_results(results: DataFrame, path: str) -> None:
    """Adds a finished batch; a failed one leaves nothing behind."""
    results.write.mode("append").json(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON text."""
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
        else F.col(f.name)
        for f in scores.schema.fields
    ]
    scores.select(*flat).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option(
        "escape", '"'
    ).csv(path)
