"""Chat formatting in budgeted windows.

A turn is written as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>``, a line feed. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, which takes every control string apart and can be undone; a line feed
of a role becomes ``\\n``.

Prefix sums of the turns' tokens choose the windows: a window holds the turns that begin in one stretch of the
conversation. Before them it repeats the conversation's first system turn and the turns of the window before that begin
at most ``history`` tokens earlier. Only assistant texts of a window's own turns are targets, so each is learned once.
A stretch is half of what the budget leaves, so a window stays within the budget unless the system turn takes more than
``Budget.system`` or a turn more than half of the rest; such windows are whole and over budget, as turns are never cut.

Prefix sums are taken in two levels, within range partitions of (conversation, turn) and over the partitions' totals,
so a conversation of any length is spread; every later group is one window, whose turns are bounded by its tokens.

Defined results: turns are ordered by turn, role, text, nulls first; null texts and roles are empty; rows that repeat
are turns of their own; a null conv_id is a conversation of its own; without rows there are no windows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.bpe import encoder
from gleaner.llm.common import per_batch, slices, written

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Budget:
    window: int = 2048
    system: int = 256
    history: int = 384

    @property
    def stretch(self) -> int:
        return max(1, (self.window - self.system - self.history) // 2)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: str) -> str:
    return regex.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=regex.DOTALL)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lead (what a turn's text follows), body (its escaped text)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n"))
    return rows.withColumns({"lead": F.concat(F.lit(START), role, F.lit("\n")), "body": escaped(F.col("text"))})


def counted(rows: DataFrame, path: str) -> DataFrame:
    """``tokens`` of each formatted turn."""
    names = rows.columns

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(path)
        lead, body = batch.column("lead").to_pylist(), batch.column("body").to_pylist()
        sizes = [own.encode(f"{a}{b}{END}\n").size for a, b in zip(lead, body, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=[*names, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return per_batch(rows, step, f"{schema}, tokens long")


def numbered(rows: DataFrame) -> DataFrame:
    """``place`` of each turn in its conversation and the tokens ``before`` it."""
    key = ["turn", "role", "text"]
    dealt = written(rows.repartitionByRange("conv_id", *key).withColumn("part", F.spark_partition_id()), "turns")
    totals = dealt.groupBy("conv_id", "part").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.select(
        F.col("conv_id").alias("m_conv"), F.col("part").alias("m_part"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))
    inside = Window.partitionBy("conv_id", "part").orderBy(*key)
    own = dealt.withColumns({
        "place": F.row_number().over(inside),
        "before": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")})
    same = own["conv_id"].eqNullSafe(moved["m_conv"]) & (own["part"] == moved["m_part"])
    return own.join(moved, same).withColumns({"place": F.col("place") + F.col("n"), "before": F.col("before") + F.col("t")}).drop("t", "n", "m_conv", "m_part", "part")


def windows(conversations: DataFrame, path: str, budget: Budget = Budget()) -> DataFrame:
    """conv_id, window, text, n_tokens, n_repeated (turns before its own), spans (start, stop in code points) of the loss."""
    if budget.history > budget.stretch:
        raise ValueError("history must not exceed the stretch of a window")
    rows = written(
        numbered(counted(turns(conversations), path))
        .withColumn("window", F.expr(f"before div {budget.stretch}")), "numbered-turns")
    begins = written(rows.groupBy("conv_id", "window").agg(F.min("before").alias("begin")), "windows")
    named = begins.select(F.col("conv_id").alias("w_conv"), F.col("window").alias("w"), "begin")
    # A turn is history of the next window only: a later one begins more than ``history`` tokens after it.
    follows = rows["conv_id"].eqNullSafe(named["w_conv"]) & (named["w"] == rows["window"] + 1)
    history = rows.join(named, follows).filter(F.col("begin") - F.col("before") <= budget.history)
    first = rows.filter("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("place", "before", "window", "role", "lead", "body", "tokens")).alias("s"))
    later = first.join(named, first["conv_id"].eqNullSafe(named["w_conv"])).filter(
        (F.col("w") > F.col("s.window"))
        & ~((F.col("w") == F.col("s.window") + 1) & (F.col("begin") - F.col("s.before") <= budget.history)))

    def piece(kind: int, at: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[F.col(f"{at}{c}").alias(c) for c in ("place", "role", "lead", "body", "tokens")]).alias("piece")

    copies = (
        rows.select("conv_id", "window", piece(2, ""))
        .union(history.select("conv_id", F.col("w"), piece(1, "")))
        .union(later.select("conv_id", F.col("w"), piece(0, "s.")))
    )
    grouped = copies.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"], F.lit(END + "\n"))), "")
    ends = F.length(F.lit(END + "\n"))

    def add(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["lead"])
        stop = begin + F.length(p["body"])
        target = (p["kind"] == 2) & (p["role"] == "assistant")
        spans = F.when(target, F.concat(state["spans"], F.array(F.struct(begin.alias("start"), stop.alias("stop"))))).otherwise(state["spans"])
        return F.struct((stop + ends).alias("at"), spans.alias("spans"))

    nothing = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, stop: int>>)").alias("spans"))
    return grouped.select(
        "conv_id", "window", text.alias("text"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("n_tokens"),
        F.size(F.filter("pieces", lambda p: p["kind"] < 2)).alias("n_repeated"),
        F.aggregate("pieces", nothing, add, lambda s: s["spans"]).alias("spans"))


TURN = regex.compile(rf"{regex.escape(START)}([^\n]*)\n(.*?){regex.escape(END)}\n", regex.DOTALL)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted window."""
    found, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"unformatted text at {at}")
        found.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"unformatted text at {at}")
    return found


def digests(found: DataFrame) -> DataFrame:
    """What the windows say, one row a conversation: its own turns and the text under the loss mask, in order.

    A digest of a whole conversation is sequential, so its windows stream through one task, batch by batch."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, current = [], None
        for whole in batches:
            for batch in slices(whole):
                for row in batch.to_pylist():
                    if current is None or current[0] != row["conv_id"]:
                        if current:
                            done.append(current)
                        current = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    text = row["text"]
                    for role, said in read_turns(text)[row["n_repeated"]:]:
                        current[1] += 1
                        current[2].update(f"{role}\n{said}\n".encode())
                    for span in row["spans"]:
                        said = unescaped(text[span["start"]:span["stop"]])
                        current[3] += len(said)
                        current[4].update(said.encode())
                    current[5] += len(text)
            yield closed(done)
            done = []
        yield closed([current] if current else [])

    def closed(rows: list) -> pa.RecordBatch:
        rows = [(a, b, c.hexdigest(), d, e.hexdigest(), f) for a, b, c, d, e, f in rows]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    dealt = found.select("conv_id", "window", "text", "n_repeated", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
