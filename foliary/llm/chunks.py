"""Substring de-duplication by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import byte_view, cut_spans, documents, keyed, materialize, query

WINDOW = 32  # bytes that a rolling hash of 32 bits depends on
GEAR = np.random.default_rng(8).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: the sum of table values of the last 32 bytes, each shifted left by its age.

    Built by doubling: the hash over 2n bytes is that over n plus the one n bytes earlier shifted by n.
    """
    out = GEAR[data]
    width = 1
    while width < WINDOW:
        out[width:] += out[:-width].copy() << np.uint32(width)
        width *= 2
    return out


def boundaries(data: np.ndarray, offsets: np.ndarray, bits: int, least: int, most: int) -> Iterator[list[int]]:
    """Ends of the chunks of each text, as positions in ``data``; an empty text has none.

    A chunk ends after a byte whose hash has ``bits`` leading zeros. Chunks have at least ``least`` bytes (no fewer
    than the window, so that a hash sees its own text only) and at most ``most``; none cuts a character. A shorter
    rest joins the last chunk.
    """
    inside = np.append((data & 0xC0) == 0x80, False)
    ends = np.nonzero(rolling(data) >> np.uint32(32 - bits) == 0)[0] + 1
    ends = ends[~inside[ends]]
    first, last = np.searchsorted(ends, offsets[:-1]), np.searchsorted(ends, offsets[1:])
    for a, b, start, stop in zip(first.tolist(), last.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        cuts, at = [], start
        for end in [*ends[a:b].tolist(), stop]:
            while end - at > most:
                at += most
                while inside[at]:
                    at -= 1
                cuts.append(at)
            if end - at >= least or end == stop:
                cuts.append(end)
                at = end
        cuts = [c for c in dict.fromkeys(cuts) if c > start]
        if len(cuts) > 1 and cuts[-1] - cuts[-2] < least:
            del cuts[-2]
        yield cuts


def chunk_table(texts: DataFrame, bits: int = 6, least: int = 32, most: int = 1024) -> DataFrame:
    """(doc_id, text_key, start, size, h1, h2): the chunks of every text with a digest of 128 bits."""
    if least < WINDOW or most < 2 * least:
        raise ValueError("least must cover the hash window and most must be at least twice as long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(2))
            raw = data.tobytes()
            starts, ends, counts = [], [], []
            for at, cuts in zip(offsets[:-1].tolist(), boundaries(data, offsets, bits, least, most)):
                starts += [at, *cuts[:-1]] if cuts else []
                ends += cuts
                counts.append(len(cuts))
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts, ends)), np.int64).reshape(-1, 2)
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            start, end = np.array(starts, np.int64), np.array(ends, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(start - np.repeat(offsets[:-1], counts)),
                    pa.array((end - start).astype(np.int32)),
                    pa.array(digests[:, 0].copy()),
                    pa.array(digests[:, 1].copy()),
                ],
                ["doc_id", "text_key", "start", "size", "h1", "h2"],
            )

    return texts.select("doc_id", "text_key", "text").mapInArrow(
        run, "doc_id long, text_key long, start long, size int, h1 long, h2 long"
    )


def _spans(rows: DataFrame) -> DataFrame:
    """Neighbouring removed chunks of a document as one span, in the binary form that cut_spans reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for chunks in batch.column("chunks").to_pylist():
                spans = np.array(sorted((c["start"], c["start"] + c["size"]) for c in chunks), np.int64)
                new = np.concatenate(([True], spans[1:, 0] > spans[:-1, 1]))
                starts.append(spans[new, 0].tobytes())
                ends.append(spans[np.append(new[1:], True), 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), batch.column("n_duplicates"), pa.array(starts, pa.binary()), pa.array(ends, pa.binary())],
                ["doc_id", "text_key", "n_duplicates", "starts", "ends"],
            )

    found = rows.groupBy("doc_id", "text_key").agg(
        F.count(F.lit(1)).alias("n_duplicates"), F.collect_set(F.struct("start", "size")).alias("chunks")
    )
    return found.mapInArrow(run, "doc_id long, text_key long, n_duplicates long, starts binary, ends binary")


def dedup_chunks(docs: DataFrame, bits: int = 6, least: int = 32, most: int = 1024, text: str = "text") -> DataFrame:
    """Remove every chunk that occurred earlier: in a document with a smaller doc_id, or before it in the same one.

    One row per document: doc_id, n_bytes, n_removed (bytes), n_spans (maximal removed runs) and kept (the remaining
    bytes, always whole characters). Null texts count as empty and stay empty. Only chunks of ``least`` bytes or more
    are removed, so a short text is never touched. A row without doc_id comes after all others. Rows that repeat both
    doc_id and text are one document: each is returned, none removes the other. Further columns are ignored.

    The first place of a digest is a minimum, combined on the map side, so a passage in a third of all documents is one
    row per task; the join back to the chunks is on digests that repeat only, and adaptive execution splits hot ones.
    """
    texts = keyed(docs, text)
    chunks = materialize(chunk_table(texts, bits, least, most), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    first = (
        chunks.filter(F.col("size") >= least)
        .groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("h1", "h2", "first")
    )
    later = chunks.join(first, ["h1", "h2"]).filter(place > F.col("first")).select("doc_id", "text_key", "start", "size")
    return cut_spans(texts, _spans(later))


@query("op8_chunk_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is kept, for every document."""
    found = dedup_chunks(documents(spark, folder, "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
