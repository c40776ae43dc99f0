"""Size checks that decide between a broadcast and a shuffled join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the data size of ``df``: its rows as JSON text, added up on Spark."""
    row = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("n")).first()["n"]


def fits(df: DataFrame, max_bytes: int) -> bool:
    return measured_bytes(df) <= max_bytes


def hinted(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast hint where the size was checked; otherwise leave the join to Spark."""
    return F.broadcast(df) if small else df
