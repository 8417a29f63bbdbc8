"""Overlapping chunks of page text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.functions import text as tx

# Fixed values.
TARGET_TOKENS = 512
OVERLAP_TOKENS = 64
CHARS_PER_TOKEN = 4
MIN_PAGE_CHARS = 20
DELIMITER_AFTER = 256
DELIMITERS = ("\n\n", "\n", " ")

SPANS = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(tx.trim(text)) / CHARS_PER_TOKEN).cast("bigint")


def chunk_spans(text: str, target: int, overlap: int, space: str) -> list[tuple[int, int]]:
    """Character ranges of the chunks of one page."""
    size = len(text)
    if len(text.strip(space)) < MIN_PAGE_CHARS:
        return []

    def skip(at: int) -> int:
        rest = text[at : at + 64]
        while rest and not rest.strip(space):
            at += len(rest)
            rest = text[at : at + 64]
        return at + len(rest) - len(rest.lstrip(space))

    spans, begin = [], skip(0)
    while begin < size:
        split = limit = min(begin + target, size)
        if limit < size:
            for mark in DELIMITERS:
                found = text.rfind(mark, begin, limit)
                if found > begin + DELIMITER_AFTER:
                    split = found
                    break
        piece = text[begin:split]
        left = begin + len(piece) - len(piece.lstrip(space))
        right = split - (len(piece) - len(piece.rstrip(space)))
        if right > left:
            spans.append((left, right))
        if split >= size:
            break
        again = skip(max(split - overlap, 0))
        begin = again if again > begin else skip(split)
    return spans


def chunk_documents(pages: DataFrame, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Cut every page into chunks of at most ``target`` tokens that share ``overlap`` tokens.

    Where to cut depends on the previous cut, so the ranges come from an Arrow-batched function over the page text.
    Pages are independent: there is no shuffle, and the text itself is cut by Spark."""
    target_chars = max(target, 1) * CHARS_PER_TOKEN
    overlap_chars = min(overlap, max(target - 1, 0)) * CHARS_PER_TOKEN
    space = tx.WHITESPACE_CHARS

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [[{"from": a, "to": b} for a, b in chunk_spans(t or "", target_chars, overlap_chars, space)] for t in texts]
            )

    cut = pages.select("document_id", "page_id", "text", F.posexplode(spans("text")).alias("chunk_no", "span"))
    text = F.substring("text", F.col("span.from") + 1, F.col("span.to") - F.col("span.from"))
    return cut.select(
        "document_id",
        "page_id",
        F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.col("span.from").cast("bigint").alias("char_start"),
        F.col("span.to").cast("bigint").alias("char_end"),
        F.ceil((F.col("span.to") - F.col("span.from")) / CHARS_PER_TOKEN).cast("bigint").alias("token_count"),
        text.alias("text"),
    )
