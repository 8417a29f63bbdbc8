"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.session import materialize

__all__ = ["CRC", "QUERIES", "SQL", "WORD", "as_bytes", "documents", "held_out", "materialize", "query", "text_or_empty"]

# Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that it must agree with where there is one."""

    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/documents.parquet")
    return df.select(*columns) if columns else df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def CRC(doc_id: Column) -> Column:
    """CRC-32 of the id written as decimal text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for the rows of one fold; a row without an id counts as held out, so nothing is learnt from it."""
    return F.coalesce(CRC(doc_id) % folds == fold, F.lit(True))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def long_column(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        yield tuple(batch.column(name).to_numpy(zero_copy_only=False) for name in names)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column in one run of bytes, and the n + 1 offsets of the texts; null is empty."""
    texts = as_bytes(column)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], ends)).astype(np.int64)


def same_document(left: DataFrame, right: DataFrame) -> Column:
    """Equal (doc_id, fingerprint of the text), null being equal to null: what makes two rows one document."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_key, text) with the text never null; ids need not be unique, so a hash of the text joins them."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_key"), whole.alias("text"))


def cut_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Remove byte spans from texts.

    ``spans`` has one row per (doc_id, text_key) with sorted, disjoint ``starts`` and ``ends`` (binary, 8-byte little
    endian numbers). Adds n_bytes, n_removed, n_spans and kept (binary) to (doc_id, text_key, text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = batch.column("doc_id"), batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
            size, removed, count, kept = [], [], [], []
            for text, a, b in zip(as_bytes(batch.column("text")), starts, ends):
                a = np.frombuffer(a or b"", np.int64)
                b = np.frombuffer(b or b"", np.int64)
                left = np.concatenate(([0], b)).tolist()
                right = np.append(a, len(text)).tolist()
                kept.append(b"".join(text[i:j] for i, j in zip(left, right)))
                size.append(len(text))
                removed.append(int((b - a).sum()))
                count.append(len(a))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    rows = texts.join(spans, same_document(texts, spans), "left").select(texts["doc_id"], "text", "starts", "ends")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
