"""Fingerprints of documents: bottom-k sketches of their word shingles.

A shingle is a word with up to four before it, so a text has as many as it has words, and texts of a few words have some too. A
sketch holds the ``SIZE`` smallest distinct hashes of a text's shingles as hexadecimal text in ascending order. The sketch
of several texts is the smallest of all their hashes, so parts of a table are sketched apart and merged; two sketches
tell the resemblance of the sets, the share of one in the other, and how many distinct shingles a text has. A set that is
smaller than a sketch is held whole, so all of this is exact for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliary.llm.common import documents, query

SIZE, WORDS, DIGITS = 128, 5, 12
SLICE = 1 << 20  # bytes of one text that are split into words at a time
FACTOR = np.uint64(0x9E3779B97F4A7C15)  # any odd number: it sets the places of a shingle's words apart

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(32))) * FACTOR
    h = (h ^ (h >> np.uint64(29))) * FACTOR
    return h ^ (h >> np.uint64(32))


class Sketcher:
    """Smallest hashes of a text's shingles; hashes of words are remembered up to a bound."""

    KEPT = 500_000

    def __init__(self, size: int = SIZE, words: int = WORDS):
        self.size, self.words, self.known = size, words, {}

    def word_hashes(self, text: bytes) -> np.ndarray:
        plain, start, found = text.translate(_LOWER), 0, []
        while start < len(plain):
            end = plain.find(b" ", start + SLICE)
            end = len(plain) if end < 0 else end
            part = plain[start:end].split()
            if len(self.known) > self.KEPT:
                self.known.clear()
            for word in set(part).difference(self.known):
                self.known[word] = xxhash.xxh64_intdigest(word)
            found.append(np.fromiter(map(self.known.__getitem__, part), np.uint64, len(part)))
            start = end
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    def __call__(self, text: bytes) -> np.ndarray:
        hashes = self.word_hashes(text)
        total = hashes.copy()
        for back in range(1, min(self.words, len(hashes))):
            total[back:] += _mixed(hashes[:-back] + np.uint64(back)) * FACTOR
        total = _mixed(total) >> np.uint64(64 - 4 * DIGITS)
        if len(total) > 8 * self.size:
            # Repeats may fill the smallest places, so the cut is widened until it holds enough distinct hashes.
            wanted = 2 * self.size
            while wanted < len(total):
                least = np.unique(np.partition(total, wanted)[: wanted + 1])
                if len(least) > self.size:
                    return least[: self.size]
                wanted *= 4
        return np.unique(total)[: self.size]


def as_text(sketch: np.ndarray) -> str:
    return "".join([f"{h:0{DIGITS}x}" for h in sketch.tolist()])


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Resemblance of two sets by their sketches: the share of the smallest hashes of both together that both hold. Two empty
    sets are alike."""
    least = np.union1d(a, b)[:size]
    return float(np.isin(least, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(least) if len(least) else 1.0


# ---- sketches as columns ----------------------------------------------------------------------------------------------


def hashes(fingerprint: Column) -> Column:
    """The hashes of a fingerprint as ascending hexadecimal texts of one length, whose order is that of the numbers."""
    return F.regexp_extract_all(fingerprint, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def _least(a: Column, b: Column, size: int) -> Column:
    return F.slice(F.array_sort(F.array_union(hashes(a), hashes(b))), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of common shingles among all of two texts; 1 for two empty ones."""
    least = _least(a, b, size)
    both = F.array_intersect(F.array_intersect(hashes(a), hashes(b)), least)
    return F.when(F.size(least) == 0, 1.0).otherwise(F.size(both) / F.size(least))


def distinct_shingles(fingerprint: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles: exact below ``size``, then from how densely the smallest hashes lie."""
    found = hashes(fingerprint)
    largest = F.conv(F.element_at(found, -1), 16, 10).cast("double") + 1
    return F.when(F.size(found) < size, F.size(found).cast("double")).otherwise((size - 1) * F.lit(2.0 ** (4 * DIGITS)) / largest)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds; 1 for an empty ``a``."""
    together = F.concat_ws("", _least(a, b, size))
    common = resemblance(a, b, size) * distinct_shingles(together, size)
    own = distinct_shingles(a, size)
    return F.when(own == 0, 1.0).otherwise(F.least(F.lit(1.0), common / own))


def merge(parts: DataFrame, *keys: str, fingerprint: str = "fingerprint", size: int = SIZE) -> DataFrame:
    """One fingerprint per key of the fingerprints of its parts. Each task keeps ``size`` hashes a key before the shuffle, so a
    key with a third of all parts sends no more than any other. Parts that are null or empty add nothing."""
    exploded = parts.select(*keys, F.explode_outer(hashes(F.col(fingerprint))).alias("hash"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("hash"))
    kept = exploded.distinct().withColumn("rank", rank).filter(F.col("rank") <= size + 1)  # a null comes first
    least = F.slice(F.array_sort(F.collect_list("hash")), 1, size)
    return kept.groupBy(*keys).agg(F.concat_ws("", least).alias(fingerprint))


def fingerprints(docs: DataFrame, text: str = "text", size: int = SIZE, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint) of every row; a text that is null or without words has the empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(size, words)
        for batch in batches:
            made = [as_text(sketch((one or "").encode())) for one in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


# ---- edited texts ------------------------------------------------------------------------------------------------------


def edited(text: str, following: str) -> str:
    """The last half of a text (rounded down) replaced by as much of the start of another, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (part, tail, doc_id, body) in parts of descending doc_id (null last, equal ids by a hash of their texts). The last row of
    a part, ``tail`` 1, is a copy of the next part's first row, or of the very first row after the last part.

    The parts are bounded by quantiles of the ids, one part per shuffle partition, and each is a partition: every text is shuffled
    once. What reaches the driver is one bound and one head per part. Rows of one id share a part (ids are keys of the
    table), and so do rows without an id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts + 1000)).first()[0]
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.to_numpy(), side="right")).astype("int32")

    without = F.coalesce("doc_id", F.lit(-(2**63)))
    rows = rows.withColumn("hash", F.xxhash64("body")).withColumn("part", part_of(without))
    heads = rows.groupBy("part").agg(F.max(F.struct(without.alias("id"), "hash")).alias("head")).orderBy("part").collect()
    if not heads:
        return rows.select("part", F.lit(0).alias("tail"), "doc_id", "body")
    before = {row["part"]: heads[i - 1]["part"] for i, row in enumerate(heads)}  # the last part precedes the first
    head = {row["part"]: row["head"] for row in heads}
    numbers = range(len(bounds) + 1)

    def known(values, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("part"))

    first = (without == known([head[n]["id"] if n in head else None for n in numbers], "long")) & (F.col("hash") == known([head[n]["hash"] if n in head else None for n in numbers], "long"))
    here = F.struct(F.col("part").alias("to"), F.lit(0).alias("tail"))
    there = F.struct(known([before.get(n) for n in numbers], "int").alias("to"), F.lit(1).alias("tail"))
    copied = rows.withColumn("place", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))))
    dealt = copied.select(F.col("place.to").alias("part"), "place.tail", "doc_id", "hash", "body").repartitionById(len(bounds) + 1, F.col("part"))
    order = ["part", "tail", F.col("doc_id").desc_nulls_last(), F.col("hash").desc()]
    return dealt.sortWithinPartitions(*order).select("part", "tail", "doc_id", "body")


def edit_report(docs: DataFrame, text: str = "text", size: int = SIZE, words: int = WORDS) -> DataFrame:
    """Fingerprints of every document and of its text edited with the next document's, and how alike they are.

    The next document is that of the next smaller doc_id, and the first after the last. Null texts count as empty, rows
    without an id come last, rows of one id follow each other by a hash of their texts. An empty table gives no rows, and one
    of a single document edits it with itself. Two texts without words are alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, last = Sketcher(size, words), None
        for batch in batches:
            done = []
            for tail, doc_id, body in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if tail and last is None:
                    continue
                own = sketch(body.encode())
                if last is not None:
                    other = edited(last[1], body).encode()
                    changed = sketch(other)
                    sha = hashlib.sha256(other).hexdigest()
                    done.append((last[0], len(last[1]), sha, as_text(last[2]), as_text(changed), likeness(last[2], changed, size), likeness(last[2], own, size)))
                last = None if tail else (doc_id, body, own)
            columns = list(zip(*done)) or [()] * len(EDITS)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, EDITS.types)], EDITS.names)

    return in_parts(docs, text).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


EDITS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)


@query("op13_bottomk_fingerprints")
def _bottomk_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edit_report(documents(spark, folder, "doc_id", "text"))
