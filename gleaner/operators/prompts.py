"""Prompt assembly and the shape of chat replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import or_unknown

# Separator and heading of the passages in a prompt, and the refusal sentence.
PASSAGE_BREAK = "\n\n---\n\n"
SOURCE_HEAD = "Source : "
REFUSAL = "Je ne trouve pas cette information dans les documents fournis."

# Default templates; callers may read their own from a file.
ANSWER_TEMPLATE = (
    "Réponds à la question en t'appuyant seulement sur le contexte, et cite tes sources. "
    f'Si le contexte n\'y répond pas, écris exactement : "{REFUSAL}"\n\n'
    "CONTEXTE :\n{context}\n\nQUESTION : {question}\n\nRÉPONSE :"
)
HYDE_TEMPLATE = "Rédige deux ou trois phrases de brochure qui répondraient à : {question}"
SOURCE_TEMPLATE = (
    "Documents disponibles : {sources}\nQuestion : {question}\n"
    "Donne les noms de fichiers utiles, séparés par des virgules, ou TOUS."
)
GRADE_TEMPLATE = (
    "Question :\n{question}\n\nExtraits :\n{context}\n\n"
    "Les extraits suffisent-ils ? Réponds OUI, ou NON — suivi de ce qui manque."
)
REWRITE_TEMPLATE = (
    "Question : {question}\nRequête déjà essayée : {query}\nCe qui manque : {verdict}\n"
    "Propose une nouvelle requête de recherche, seule."
)
JUDGE_TEMPLATE = (
    "Texte de référence :\n{evidence}\n\nAffirmation :\n{statement}\n\n"
    "Note de 0 à 1 : l'affirmation est-elle appuyée par le texte ? Réponds par un nombre."
)
REGENERATE_TEMPLATE = "Écris les questions, une par ligne, auxquelles ce texte répond :\n{answer}"
CONTEXT_TEMPLATE = (
    "Fichier : {source}\nPage :\n{page}\n\nPassage :\n{chunk}\n\n"
    "Situe ce passage en une phrase courte."
)


def read_template(spark, path: str) -> str:
    """One whole text file."""
    return spark.read.text(path, wholetext=True).first()["value"]


def fill(template: str, **values: Column) -> Column:
    """Puts columns into ``{name}`` marks. The template is cut once on the driver, so inserted text
    is never scanned for marks again."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{%s}" % n), n) for n in values if "{%s}" % n in rest]
        if not found:
            parts.append(F.lit(rest))
            break
        at, name = min(found)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def assemble_context(ranked: DataFrame) -> DataFrame:
    """``(query_id, context, passages, best_passage, n_passages)`` from at most a handful of ranked rows per query.

    ``context`` names the source of each passage; ``passages`` is the same without sources; ``best_passage`` is the
    first one whole, whatever separators its text holds.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", or_unknown(F.col("source")).alias("source"), "text")))
    with_source = F.transform(
        "rows", lambda r: F.concat(F.lit(SOURCE_HEAD), r["source"], F.lit("\n"), r["text"])
    )
    return (
        ranked.groupBy("query_id")
        .agg(rows.alias("rows"))
        .select(
            "query_id",
            F.array_join(with_source, PASSAGE_BREAK).alias("context"),
            F.array_join(F.transform("rows", lambda r: r["text"]), PASSAGE_BREAK).alias("passages"),
            F.get("rows", F.lit(0))["text"].alias("best_passage"),
            F.size("rows").alias("n_passages"),
        )
    )


def last_message(chat: DataFrame, role: str | None = None) -> DataFrame:
    """``(conv_id, turn, question)``: the newest message of each conversation, whatever its role."""
    rows = chat if role is None else chat.filter(F.col("role") == role)
    return rows.groupBy("conv_id").agg(
        F.max("turn").alias("turn"), F.max_by("text", "turn").alias("question")
    )


def reply_envelope(answer: Column, model: str, reply_id: str, created: Column) -> Column:
    """Chat-completion object as JSON text."""
    message = F.struct(F.lit("assistant").alias("role"), answer.alias("content"))
    choice = F.struct(
        F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason")
    )
    return F.to_json(
        F.struct(
            F.lit(reply_id).alias("id"),
            F.lit("chat.completion").alias("object"),
            created.alias("created"),
            F.lit(model).alias("model"),
            F.array(choice).alias("choices"),
        )
    )


def model_listing(spark, model: str, owner: str) -> DataFrame:
    """The one-row model list of the chat interface, as JSON text."""
    entry = F.struct(
        F.lit(model).alias("id"), F.lit("model").alias("object"), F.lit(owner).alias("owned_by")
    )
    return spark.range(1).select(
        F.to_json(F.struct(F.lit("list").alias("object"), F.array(entry).alias("data"))).alias("listing")
    )
