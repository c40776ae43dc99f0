"""Encoding and decoding of whole documents with the byte-level BPE of ``bpe``, on Spark."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.bpe import encoder
from gleaner.llm.common import per_batch, texts


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path).encode
        ids = pa.array([encode(text) for text in batch.column("text").to_pylist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids], schema=schema)

    return per_batch(texts(docs), step, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode = encoder(path).decode
        found = pa.array([decode(np.array(ids or [], np.int32)) for ids in batch.column("ids").to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), found], schema=schema)

    return per_batch(rows.select("doc_id", "ids"), step, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of the text decoded from them, so that
    neither leaves its task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, counts, ids_hex, text_hex = encoder(path), [], [], []
        for text in batch.column("text").to_pylist():
            ids = own.encode(text)
            counts.append(len(ids))
            ids_hex.append(hashlib.sha256(own.as_decimal(ids).encode()).hexdigest())
            text_hex.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()),
             pa.array(text_hex, pa.string())], schema=schema)

    return per_batch(texts(docs), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
