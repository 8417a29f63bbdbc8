"""Vectors: embedding of chunks with a pluggable model, and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliary.functions import text as tx

# Fixed value.
EMBED_BATCH = 64

DISTANCE_DIGITS = 6
# Queries travel to the tasks in blocks of at most this many bytes.
QUERY_BLOCK_BYTES = 32 << 20
# Vectors compared with the queries in one matrix product.
LIBRARY_BLOCK_ROWS = 4096

Embedder = Callable[[Sequence[str]], np.ndarray]


def l2_normalize(vector: Column) -> Column:
    """Scale to unit length; a zero vector stays as it is."""
    wide = F.transform(vector, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda total, v: total + v * v))
    return F.when(norm > float(np.finfo(np.float32).eps), F.transform(wide, lambda v: v / norm)).otherwise(wide)


def checked_dimension(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Fail on a vector of the wrong length."""
    size = F.size(column)
    message = F.concat(F.lit(f"embedding dimension mismatch: expected {dim}, got "), size.cast("string"))
    return vectors.withColumn(column, F.when(size == dim, F.col(column)).otherwise(F.raise_error(message).cast(vectors.schema[column].dataType)))


def normalize_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    return checked_dimension(vectors, dim).withColumn("embedding", l2_normalize(F.col("embedding")))


def token_buckets(text: Column, dim: int) -> Column:
    """Feature-hashing bucket of every token of a text."""
    number = lambda token: F.conv(F.left(F.md5(token.cast("binary")), F.lit(8)), 16, 10).cast("bigint")
    return F.transform(tx.tokens(text), lambda token: F.pmod(number(token), F.lit(dim)).cast("int"))


def embed_chunks(chunks: DataFrame, embedder: Embedder | None = None, dim: int = 384, batch: int = EMBED_BATCH) -> DataFrame:
    """One unit vector per chunk (``chunk_id, embedding``).

    ``embedder`` maps a list of texts to one vector each and is called on batches inside the tasks. Without one,
    tokens are hashed into ``dim`` buckets and counted. Neither way needs a shuffle."""
    if embedder is None:

        @F.pandas_udf("array<double>")
        def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for buckets in batches:
                rows = [np.bincount(b, minlength=dim).astype("float64") for b in buckets]
                yield pd.Series([row / (np.sqrt(row @ row) or 1.0) for row in rows])

        # Marked so that no filter on the result makes Spark run the function twice.
        counts = counts.asNondeterministic()
        return chunks.select("chunk_id", counts(token_buckets(F.col("text"), dim)).alias("embedding"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = np.asarray(embedder(part["text"].tolist()), dtype="float64")
                if len(vectors) != len(part):
                    raise ValueError(f"embedder returned {len(vectors)} vectors for {len(part)} chunks")
                if vectors.ndim != 2 or vectors.shape[1] != dim:
                    raise ValueError(f"embedding dimension mismatch: expected {dim}, got {vectors.shape[1:]}")
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = vectors / np.where(norms > np.finfo("float32").eps, norms, 1.0)
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "embedding": list(vectors)})

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id bigint, embedding array<double>")


def vector_text(vector: Column) -> Column:
    """A vector as JSON text with eight decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda v: F.format_string("%.8f", v.cast("double"))), ","), F.lit("]"))


def _nearest_in_partition(ids: np.ndarray, matrix: np.ndarray, k: int):
    """Task function: the ``k`` nearest library vectors of each query among the vectors of one partition."""
    squares = (matrix**2).sum(axis=1)
    # Rows this close to the k-th distance may still win on the rounded distance, so they are kept too.
    slack = 10.0**-DISTANCE_DIGITS

    def shortlist(frame_ids: np.ndarray, block: np.ndarray):
        size = np.sqrt(np.maximum(squares[:, None] + (block**2).sum(axis=1)[None, :] - 2.0 * matrix @ block.T, 0.0))
        if len(frame_ids) > k:
            edge = np.partition(size, k - 1, axis=1)[:, k - 1 : k] + slack
            rows, columns = np.nonzero(size <= edge)
        else:
            rows, columns = np.nonzero(np.ones_like(size, dtype=bool))
        exact = np.sqrt(((matrix[rows] - block[columns]) ** 2).sum(axis=1))
        return pd.DataFrame({"query_id": ids[rows], "chunk_id": frame_ids[columns], "distance": exact.round(DISTANCE_DIGITS)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            for start in range(0, len(frame), LIBRARY_BLOCK_ROWS):
                part = frame.iloc[start : start + LIBRARY_BLOCK_ROWS]
                found = shortlist(part["chunk_id"].to_numpy(), np.stack(part["embedding"].to_numpy()).astype("float64"))
                best = found if best is None else pd.concat([best, found])
                best = best.sort_values(["query_id", "distance", "chunk_id"]).groupby("query_id").head(k)
        if best is not None:
            yield best

    return run


def knn_join(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    admitted: DataFrame | None = None,
    filter_mode: str = "post",
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """Exact L2 nearest neighbours: ``query_id, chunk_id, distance, rank``.

    ``queries`` holds ``query_id, embedding``; ``vectors`` holds ``chunk_id, embedding``. ``admitted`` lists the chunks
    a caller may see: in ``post`` mode it is applied to the k nearest, so fewer than k may be left, in ``pre`` mode it
    decides what is compared at all.

    The library is scanned in place and never shuffled. Queries go to the tasks in blocks whose size is counted
    first; a query table above one block takes several passes. A task keeps k rows per query, so what is shuffled is
    (tasks x queries x k) short rows, whatever the size of the library."""
    if filter_mode not in ("post", "pre"):
        raise ValueError(f"unknown filter mode: {filter_mode}")
    library = vectors.select("chunk_id", "embedding")
    if admitted is not None and filter_mode == "pre":
        library = library.join(admitted.select("chunk_id"), "chunk_id", "left_semi")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    blocks = max(1, -(-size["n"] * (size["dim"] or 1) * 8 // block_bytes))
    spark = queries.sparkSession
    partial = None
    for number in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number) if blocks > 1 else queries
        rows = block.select("query_id", "embedding").toPandas()
        if rows.empty:
            continue
        ids, matrix = rows["query_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype("float64")
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(frames, shared=shared):
            ids, matrix = shared.value
            return _nearest_in_partition(ids, matrix, k)(frames)

        found = library.mapInPandas(run, "query_id bigint, chunk_id bigint, distance double")
        partial = found if partial is None else partial.unionByName(found)
    if partial is None:
        return spark.createDataFrame([], "query_id bigint, chunk_id bigint, distance double, rank bigint")
    nearest = topk_per_query(partial, k, ["distance", "chunk_id"])
    if admitted is not None and filter_mode == "post":
        kept = nearest.drop("rank").join(admitted.select("chunk_id"), "chunk_id", "left_semi")
        nearest = topk_per_query(kept, k, ["distance", "chunk_id"])
    return nearest.select("query_id", "chunk_id", "distance", "rank")


def topk_per_query(rows: DataFrame, k: int, order: Sequence[str | Column]) -> DataFrame:
    """The first ``k`` rows of every query with their rank. Spark limits each group on the map side as well."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))
