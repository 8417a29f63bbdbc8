"""Assignment of documents to shards by vector bin packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliary.llm.common import WORD, documents, materialize, query

SHARDS = 24
CELLS = 1 << 14  # small groups are placed as this many bundles; also the share from which a group is placed alone
SPREAD = 64  # parts that the rows of one bundle are numbered in
RECORD = 8  # bytes a row takes besides its text


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, size, tokens, text_crc32, g1, g2): what placing needs to know; (g1, g2) names the text."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(whole) + RECORD).cast("long").alias("size"),
        F.regexp_count(whole, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole).alias("g1"),
        F.xxhash64(F.lit("second"), whole).alias("g2"),
    )


def place(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item of a table of loads (bytes, tokens, rows).

    Loads are shares of what one shard should hold. Items come largest first, by their largest share; each goes where
    the dot product of its shares and the residual capacity is highest, among the shards where its bytes still fit.
    Where they fit nowhere, it goes to the shard with most room in bytes. Ties go to the lower shard.
    """
    total = np.maximum(loads.sum(axis=0), 1)
    share = loads / (total / shards)
    residual = np.ones((shards, loads.shape[1]))
    out = np.zeros(len(loads), np.int32)
    for i in np.lexsort((np.arange(len(loads)), -share.max(axis=1))).tolist():
        item = share[i]
        fits = residual[:, 0] >= item[0]
        at = int(np.argmax(np.where(fits, residual @ item, -np.inf))) if fits.any() else int(np.argmax(residual[:, 0]))
        residual[at] -= item
        out[i] = at
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS, text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Documents with equal texts form a group and share a shard. A group that holds over 1 / ``cells`` of all bytes,
    tokens or rows is placed alone; there are at most 3 * ``cells`` of those. The others are bundled by a hash of their
    text into ``cells`` cells. So at most 4 * ``cells`` loads reach the driver, whatever the input, and a shard's bytes
    miss the mean by about one cell. Only a group larger than a whole shard is divided, into parts of about equal
    numbers of rows by a hash of doc_id: no law on sizes could hold otherwise.

    Slots count from 0 without gaps in each shard. They are numbered within parts of a bundle, so neither a shard nor a
    hot group is one task. A null text counts as empty; rows that repeat a doc_id or have none are documents of their
    own; further columns are ignored; an empty table gives no rows.
    """
    rows = materialize(digest(docs, text), "digest")
    groups = materialize(
        rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "groups"
    )
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")).first()
    sums = {k: max(total[k] or 0, 1) for k in ("bytes", "tokens", "rows")}
    share = F.greatest(*(F.col(k) / F.lit(float(v)) for k, v in sums.items()))
    alone = share > 1.0 / cells
    parts = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(sums["bytes"] / shards)), F.ceil(F.col("rows") / F.lit(sums["rows"] / shards)))
    large = groups.filter(alone).select("g1", "g2", F.least(parts, F.lit(shards)).cast("int").alias("parts"))
    named = rows.join(large, ["g1", "g2"], "left").select(
        "doc_id", "size", "tokens", "text_crc32",
        F.when(F.col("parts").isNull(), F.pmod("g1", F.lit(cells))).otherwise(F.col("g1")).alias("u1"),
        F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.col("g2")).alias("u2"),
        F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int").alias("u3"),
        F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(SPREAD)).cast("int").alias("spread"),
    )
    named = materialize(named, "named")
    counts = named.groupBy("u1", "u2", "u3", "spread").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")
    )
    counts = materialize(counts, "counts")
    units = (
        counts.groupBy("u1", "u2", "u3").agg(F.sum("bytes"), F.sum("tokens"), F.sum("rows")).toPandas()  # at most 4 * cells + shards
        .sort_values(["u1", "u2", "u3"], ignore_index=True)
    )
    at = place(units.iloc[:, 3:6].to_numpy(np.float64), shards)
    base = np.zeros(len(units), np.int64)
    for s in range(shards):
        mine = np.nonzero(at == s)[0]
        n = units.iloc[mine, 5].to_numpy(np.int64)
        base[mine] = np.cumsum(n) - n
    keys = units.iloc[:, :3].to_numpy(np.int64)
    found = {tuple(k): (int(s), int(b)) for k, s, b in zip(keys.tolist(), at, base)}

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [found[k] for k in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            values = [batch.column(i) for i in range(4)]
            values += [pa.array([h[0] for h in hit], pa.int32()), pa.array([h[1] for h in hit], pa.int64())]
            yield pa.RecordBatch.from_arrays(values, ["u1", "u2", "u3", "spread", "shard", "base"])

    inner = W.partitionBy("u1", "u2", "u3").orderBy("spread").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("rows").over(inner), F.lit(0)))
    shape = "u1 long, u2 long, u3 int, spread int, shard int, base long"
    where = offsets.select("u1", "u2", "u3", "spread").mapInArrow(locate, shape)
    keys = ["u1", "u2", "u3", "spread"]
    offsets = where.join(offsets.select(*keys, "before"), keys).select(*keys, "shard", (F.col("base") + F.col("before")).alias("base"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("doc_id", "text_crc32", "size"))
    return (
        named.withColumn("rank", rank)
        .join(offsets, keys)
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


@query("op3_vector_sharding")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(documents(spark, folder, "doc_id", "text"))
