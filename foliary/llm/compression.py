"""Quality classifier from compressed sizes under two zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliary.llm.common import as_bytes, documents, held_out, query

PIECE = 2048  # texts are compressed in pieces, so that a dictionary counts as much in a long text as in a short one
SAMPLE = 1500  # labelled texts per label that a model is fitted on, at most
SAMPLE_PIECES = 4  # pieces of each of those texts, at most
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    level: int = LEVEL


@cache
def _compressors(good: bytes, bad: bytes, level: int):
    made = []
    for raw in (good, bad):
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=kind)
        dictionary.precompute_compress(level=level)
        made.append(zstandard.ZstdCompressor(dict_data=dictionary, level=level, write_dict_id=False, write_checksum=False, write_content_size=False))
    return made


def _pieces(text: bytes) -> list[bytes]:
    return [text[at : at + PIECE] for at in range(0, len(text), PIECE)]


def difference(text: bytes, good: bytes, bad: bytes, level: int = LEVEL) -> float:
    """(size under the bad dictionary - size under the good one) / their mean, over all of the text; 0 if it is empty."""
    if not text:
        return 0.0
    with_good, with_bad = _compressors(good, bad, level)
    g = b = 0
    for piece in _pieces(text):
        g += len(with_good.compress(piece))
        b += len(with_bad.compress(piece))
    return 2.0 * (b - g) / (b + g)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; too few samples to train on become the dictionary themselves."""
    if sum(map(len, samples)) > 8 * size and len(samples) >= 32:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    return b"\n".join(samples)[-size:] or b"-"


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and intercept of a logistic curve, by Newton steps; one pseudo-case of each label at the mean."""
    at = float(x.mean()) if len(x) else 0.0
    x, y = np.concatenate((x, [at, at])), np.concatenate((y, [0.0, 1.0]))
    scale = float(x.std()) or 1.0
    z = np.stack(((x - at) / scale, np.ones(len(x))), axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6]), z.T @ (y - p) - np.array([1e-2, 1e-6]) * w)
        w = np.clip(w + step, -30, 30)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(w[0], 0.0) / scale
    return float(slope), float(w[1] - slope * at)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dictionary: int = 1 << 16) -> Model:
    """Learn from rows of ``labels`` (doc_id, quality 0 or 1) and the texts of ``docs`` (doc_id, text).

    At most ``sample`` ids per label are used, in the order of a hash of the id, and at most SAMPLE_PIECES pieces of
    PIECE bytes of each text, spread over it. Those two bounds are what reaches the driver, whatever the input. Of the
    texts, two thirds make the dictionaries and the rest calibrates the score at the base rate of the labels.
    Labels that are null or neither 0 nor 1 are skipped. Without any label the score is one half.
    """
    usable = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality").distinct()
    order = W.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample)
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in as_bytes(batch.column(3)):
                parts = _pieces(text)
                out.append(parts[:: -(-len(parts) // SAMPLE_PIECES)] if parts else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.list_(pa.binary()))], ["doc_id", "quality", "n", "parts"])

    # at most 2 * sample ids: the one broadcast here has that bound
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "n", "text")
    found = rows.mapInArrow(clip, "doc_id long, quality int, n int, parts array<binary>").toPandas()
    found = found.drop_duplicates("doc_id").sort_values(["quality", "n"])
    training = found[found["n"] % 3 != 0]
    good, bad = (_dictionary([bytes(p) for parts in training[training["quality"] == q]["parts"] for p in parts], dictionary) for q in (1, 0))
    check = found[found["n"] % 3 == 0]
    x = np.array([difference(b"".join(map(bytes, parts)), good, bad) for parts in check["parts"]])
    y = check["quality"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return Model(good, bad, 0.0, 0.0)
    slope, intercept = _logistic(x, y)
    # the sample holds the labels in other shares than the table: move the intercept to the table's odds
    intercept += float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return Model(good, bad, slope, intercept)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if the score reaches ``threshold``, else 0).

    Whole texts are compressed. A null or empty text has difference 0 and gets the score of that. Rows that repeat a
    doc_id or have none are scored like others; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([difference(t, model.good, model.bad, model.level) for t in as_bytes(batch.column(1))], np.float64)
            found = 1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query("op5_compression_classifier")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from the labels outside fold 0 of 5."""
    docs = documents(spark, folder, "doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"), 5, 0)))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
