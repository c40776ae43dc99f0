"""Parsing of model replies."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import strip

# The reply that means every source, and the start of a positive grade.
EVERYWHERE = "tous"
YES = "oui"
NO_PASSAGES = "NON — aucun extrait récupéré"
# Source lists up to this length are compared inside the row.
INLINE_NAMES = 1000
# Bytes of the names of an automaton; a node takes some fifty bytes in each Python worker.
AUTOMATON_BYTES = 4 * 1024 * 1024


def is_sufficient(reply: Column, n_passages: Column) -> Column:
    graded = F.coalesce(F.startswith(F.lower(strip(reply)), F.lit(YES)), F.lit(False))
    return F.when(F.coalesce(n_passages, F.lit(0)) == 0, False).otherwise(graded)


def grade_verdict(reply: Column, n_passages: Column) -> Column:
    return F.when(F.coalesce(n_passages, F.lit(0)) == 0, NO_PASSAGES).otherwise(strip(reply))


def judge_number(reply: Column) -> Column:
    """First blank-separated word that reads as a number, clamped to 0..1; otherwise 0."""
    words = F.split(F.regexp_replace(reply, ",", "."), r"\s+")
    numbers = F.filter(
        F.transform(words, lambda w: F.when(w.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), w.try_cast("double"))),
        lambda x: x.isNotNull(),
    )
    first = F.get(numbers, F.lit(0))
    # least and greatest pass over NULL, so a reply without a number is told apart first.
    return F.when(first.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), first)))


def _names_by_automaton(pairs):
    """A column function: the sorted names of ``pairs``, a broadcast list of (needle, name), whose needle a text holds."""

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        needles: dict[str, list[str]] = {}
        for needle, name in pairs.value:
            needles.setdefault(needle, []).append(name)
        always = needles.pop("", [])
        automaton = ahocorasick.Automaton()
        for needle, names in needles.items():
            automaton.add_word(needle, names)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([
                None if text is None else sorted({n for _, names in automaton.iter(text) for n in names}.union(always)) or None
                for text in texts
            ], dtype=object)

    return find


def names_in_text(df: DataFrame, key: str, text: str, names: DataFrame, out: str = "names") -> DataFrame:
    """Adds ``out``: the entries of ``names(name, needle)`` whose needle occurs in ``text``, ignoring
    case, in alphabetical order; NULL when there is none.

    A short list is compared inside each row. A longer one becomes an automaton that meets all names in one pass over
    a text, in Arrow batches. Only a list too large for the memory of a task is met by an equi-join on the pieces of
    the text that have the length of a needle; so no row is paired with every name.
    """
    listed = names.select("name", F.lower("needle").alias("needle")).distinct()
    head = listed.limit(INLINE_NAMES + 1).collect()
    low = F.lower(F.col(text))
    if not head:
        return df.withColumn(out, F.lit(None).cast("array<string>"))
    if len(head) <= INLINE_NAMES:
        pairs = F.array(
            *[F.struct(F.lit(r["name"]).alias("name"), F.lit(r["needle"]).alias("needle")) for r in sorted(head)]
        )
        hits = F.transform(F.filter(pairs, lambda p: F.contains(low, p["needle"])), lambda p: p["name"])
        return df.withColumn(out, F.array_distinct(hits)).withColumn(
            out, F.when(F.size(out) > 0, F.col(out))
        )
    size = listed.agg(F.sum(F.octet_length("needle")).alias("n")).first()["n"]
    if size <= AUTOMATON_BYTES:
        pairs = [(r["needle"], r["name"]) for r in listed.collect()]
        found = _names_by_automaton(df.sparkSession.sparkContext.broadcast(pairs))
        return df.withColumn(out, found(low))
    # File names have at most 255 characters, so there are few distinct lengths.
    sizes = [r["n"] for r in listed.select(F.length("needle").alias("n")).distinct().collect()]
    starts = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))

    def cut(n: int) -> Column:
        return F.transform(starts, lambda i: F.substring(low, i, F.lit(n)))

    pieces = F.array_distinct(F.flatten(F.array(*[cut(n) for n in sizes])))
    found = (
        df.select(key, F.explode(pieces).alias("needle"))
        .join(listed, "needle")
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("name")).alias(out))
    )
    return df.join(found, key, "left")


def chosen_sources(df: DataFrame, key: str, reply: str, names: DataFrame) -> DataFrame:
    """Adds ``sources``: the file names a reply contains, NULL for every source or no known name."""
    everywhere = F.coalesce(F.contains(F.lower(F.col(reply)), F.lit(EVERYWHERE)), F.lit(False))
    return names_in_text(df, key, reply, names, "sources").withColumn(
        "sources", F.when(~everywhere, F.col("sources"))
    )
