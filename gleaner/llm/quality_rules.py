"""Quality rules as a ledger: every rule is evaluated once, its failure is one bit, its measurement one column.

A policy is a named, versioned mask over the ledger: a document fails it if it fails a rule of the mask. Changing a
policy, comparing versions and asking what each rule costs are bit operations over the ledger; no text is read again.

Defined results: a null text has no words; a text without words fails ``few_words`` and no ratio rule; repeated rows
are judged each on its own; an empty table gives an empty ledger. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import per_batch, texts, written

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words",
            "n_exclamations")


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL condition over the measurements; ``bit`` never changes once a ledger was stored."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "short_words", "word_chars < 3 * n_words"),
    Rule(5, "long_words", "word_chars > 10 * n_words"),
    Rule(6, "capitals", "100 * n_capital_words > 30 * n_words"),
    Rule(7, "exclamations", "2 * n_exclamations > n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {rule.name: rule.bit for rule in RULES}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(rule.name for rule in RULES))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows of ``window`` words found at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter((number[word] for word in words), np.uint64, len(words))
    key = np.zeros(n, np.uint64)
    for i in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + n] + np.uint64(1)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    often = np.zeros(n, bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    # Equal windows have equal keys; whether equal keys mean equal windows is checked on the words' numbers.
    seen: dict[bytes, list[int]] = defaultdict(list)
    for at in np.flatnonzero(often).tolist():
        seen[ids[at:at + window].tobytes()].append(at)
    edges = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            edges[places] += 1
            edges[np.array(places) + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def measured(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if not line.isspace() and line]
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    capitals = sum(word.isupper() and len(word) > 1 for word in words)
    return (
        len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), capitals, raw.count(b"!"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, ``failures``: bit i is set if the rule of bit i failed."""
    schema = pa.schema([("doc_id", pa.int64()), *((name, pa.int64()) for name in MEASURES)])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([measured(text) for text in batch.column("text").to_pylist()], np.int64).reshape(-1, len(MEASURES))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c) for c in found.T)], schema=schema)

    rows = per_batch(texts(docs), step, "doc_id long, " + ", ".join(f"{name} long" for name in MEASURES))
    return rows.withColumn("failures", failure_bits())


def failure_bits(condition: Callable[[str], str] = str) -> Column:
    """Bit i is set if the rule of bit i failed; ``condition`` says how its condition reads."""
    bits = [F.when(F.expr(condition(rule.failed)), F.lit(1 << rule.bit)).otherwise(F.lit(0)) for rule in RULES]
    return sum(bits[1:], bits[0]).cast("long")


def fails(policy: Policy, failures: Column | None = None) -> Column:
    bits = F.col("failures") if failures is None else failures
    return bits.bitwiseAND(F.lit(policy.mask)) != 0


def judged(rows: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """One boolean column ``kept_<name>_v<version>`` for each policy."""
    return rows.withColumns({f"kept_{p.name}_v{p.version}": ~fails(p) for p in policies})


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that would be kept without it."""
    bits = F.col("failures").bitwiseAND(F.lit(policy.mask))
    sums = [F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum((bits != 0).cast("long")), F.lit(0)).alias("n_rejected")]
    used = [rule for rule in RULES if rule.name in policy.rules]
    for rule in used:
        sums.append(F.coalesce(F.sum((bits.bitwiseAND(F.lit(1 << rule.bit)) != 0).cast("long")), F.lit(0)).alias(f"any_{rule.bit}"))
        sums.append(F.coalesce(F.sum((bits == F.lit(1 << rule.bit)).cast("long")), F.lit(0)).alias(f"only_{rule.bit}"))
    rules = F.array(*[
        F.struct(F.lit(rule.name).alias("rule"), F.col(f"any_{rule.bit}").alias("n_failed"),
                 F.col(f"only_{rule.bit}").alias("n_failed_alone"))
        for rule in used
    ])
    total = rows.agg(*sums).select("n_docs", "n_rejected", F.explode(rules).alias("r"))
    return total.select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "r.*", "n_rejected", "n_docs")


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger of ``docs``, written once; policies and ablations are read from it."""
    return written(ledger(docs), "ledger")


def with_ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``sole_rule``, the only rule of the policy that a document fails (null otherwise), and ``sole_docs``, how many
    documents fail that rule alone: the documents that the policy would keep without it."""
    counts = ablation(rows, policy).select(F.col("rule").alias("sole_rule"), F.col("n_failed_alone").alias("sole_docs"))
    bits = F.col("failures").bitwiseAND(F.lit(policy.mask))
    sole = F.coalesce(*[F.when(bits == F.lit(1 << rule.bit), F.lit(rule.name)) for rule in RULES])
    # A row for each rule.
    return rows.withColumn("sole_rule", sole).join(F.broadcast(counts), "sole_rule", "left")


def kept_rows(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The rows of ``docs`` that pass the policy, as they are."""

    def measure(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measured(text) for text in column], columns=MEASURES)

    found = F.pandas_udf(measure, ", ".join(f"{name} long" for name in MEASURES))(F.coalesce("text", F.lit("")))
    judged_rows = docs.withColumn("__rules", found).withColumn("__failures", failure_bits(in_struct))
    return judged_rows.filter(~fails(policy, F.col("__failures"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def in_struct(condition: str) -> str:
    """A condition over the measurements as fields of the column ``__rules``."""
    return re.sub(r"\b([a-z_]+)\b", r"__rules.\1", condition)
