"""Packing of tokenized documents into fixed windows, planned by non-negative least squares."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from tokenizers import Tokenizer

from foliary.llm.common import as_bytes, documents, materialize, query

WINDOW, END_ID, STEP = 4096, 2, 16
TOKENIZER = "word_bpe_49k.json"
# A worker forgets its words when it knows this many, and long ones at once; this bounds its memory, not the result.
CACHED_WORDS, CACHED_BYTES = 1_000_000, 64
LINE = 64  # words that the tokenizer gets at once
SPREAD = 256  # parts that a length class is ranked in

_cache: dict[str, tuple[Tokenizer, dict[bytes, bytes]]] = {}


def _known(path: str) -> tuple[Tokenizer, dict[bytes, bytes]]:
    if path not in _cache:
        _cache[path] = Tokenizer.from_file(path), {}
    return _cache[path]


def _encoded(words: list[str], tokenizer: Tokenizer) -> Iterator[bytes]:
    """Ids of each word. Words go to the tokenizer in lines, which costs it half as much; the places of the tokens tell
    whose they are (a word may have none)."""
    lines = [words[i : i + LINE] for i in range(0, len(words), LINE)]
    for line, found in zip(lines, tokenizer.encode_batch([" ".join(line) for line in lines], add_special_tokens=False)):
        ends = np.cumsum([len(w) + 1 for w in line])
        bounds = [0, *np.searchsorted([a for a, _ in found.offsets], ends).tolist()]
        ids = array("I", found.ids).tobytes()
        for a, b in zip(bounds, bounds[1:]):
            yield ids[4 * a : 4 * b]


def token_bytes(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Token ids of each text as little-endian 32-bit numbers.

    The tokenizer never joins characters across white space, so a text's ids are those of its words in order, and each
    distinct word is encoded once.
    """
    tokenizer, known = _known(path)
    for at in range(0, len(texts), 500):
        split = [t.split() for t in texts[at : at + 500]]
        if len(known) > CACHED_WORDS:
            known.clear()
        words = set()
        for text in split:
            words.update(text)
        new = list(words.difference(known))
        known.update(zip(new, _encoded([w.decode() for w in new], tokenizer)))
        for text in split:
            yield b"".join(map(known.__getitem__, text))
        for word in new:
            if len(word) > CACHED_BYTES:
                del known[word]


def pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None, text: str = "text") -> DataFrame:
    """Documents cut into runs of ``window`` ids and a rest: (doc_id, start, length, ids_crc32, doc_tokens)."""
    path = path or public_tokenizers.path(TOKENIZER)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(token_bytes(as_bytes(batch.column(1)), path)):
                ids += end
                for at in range(0, len(ids), 4 * window):
                    piece = ids[at : at + 4 * window]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
            values = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(values, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def combinations(size: int) -> np.ndarray:
    """All ways to fill ``size`` units with one, two or three classes, largest first; absent places are 0."""
    rows = [(size, 0, 0)]
    for a in range(size - 1, 0, -1):
        for b in range(min(a, size - a), 0, -1):
            c = size - a - b
            if c <= b:
                rows.append((a, b, c))
    return np.array(rows, dtype=np.int64)


def repeats(shapes: np.ndarray, histogram: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance between the used classes and the histogram.

    Accelerated projected gradient; ``shapes`` is the matrix in sparse form, so a step costs a few passes over it.
    """
    size = len(histogram) - 1

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(shapes.ravel(), np.repeat(x, shapes.shape[1]), size + 1)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[shapes].sum(axis=1)

    probe = np.ones(len(shapes))
    for _ in range(30):
        probe = back(used(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = z = np.zeros(len(shapes))
    momentum = 1.0
    for _ in range(rounds):
        new = np.maximum(z - back(used(z) - histogram) / (1.05 * norm), 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z = new + (momentum - 1) / following * (new - x)
        x, momentum = new, following
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of classes (units of length) and how often each is used; every piece of the histogram is placed once.

    The solved counts are rounded, most frequent shape first, as far as pieces are left. What remains is packed
    greedily, class by class: the largest class left takes the largest classes that still fit, and the pattern is
    repeated until one of its classes is used up.
    """
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    shapes = combinations(size)
    wanted = np.rint(repeats(shapes, histogram.astype(float))).astype(np.int64)
    patterns = []

    def take(shape: tuple[int, ...], times: int) -> None:
        classes, counts = np.unique(shape, return_counts=True)
        times = min(times, int((left[classes] // counts).min()))
        if times > 0:
            left[classes] -= counts * times
            patterns.append((shape, times))

    for i in np.argsort(-wanted, kind="stable"):
        if wanted[i] <= 0:
            break
        take(tuple(int(c) for c in shapes[i] if c), int(wanted[i]))
    while left.any():
        room, shape, spare = size, [], left.copy()
        while room and (fit := np.nonzero(spare[: room + 1])[0]).size:
            best = int(fit[-1])
            n = min(room // best, int(spare[best]))
            shape += [best] * n
            spare[best] -= n
            room -= n * best
        take(tuple(shape), int(left.max()))
    return patterns


def pack(rows: DataFrame, window: int = WINDOW, step: int = STEP, spread: int = SPREAD) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, ...), all of 1 to ``window`` tokens.

    Lengths are counted in classes of ``step`` tokens; only this histogram (``window / step`` numbers) reaches the driver
    and only the plan returns. A piece's rank in its class decides its place. Ranks are made in ``spread`` parts per
    class by a hash of the piece, so a class with a third of all pieces is not one task.
    """
    size = window // step
    placed = rows.withColumn("class", F.ceil(F.col("length") / step).cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(spread)).cast("int")
    )
    counts = placed.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most window / step rows
        histogram[row["class"]] = row["n"]
    keys, first, slots, taken, sequence = [], [], [], np.zeros(size + 1, np.int64), 0
    for shape, times in plan(histogram):
        for slot, c in enumerate(shape):
            keys.append((c, int(taken[c])))
            first.append(sequence)
            slots.append(slot)
            taken[c] += times
        sequence += times
    order = sorted(range(len(keys)), key=keys.__getitem__)
    classes, ranks = (np.array([keys[i][j] for i in order], np.int64) for j in (0, 1))
    first, slots = np.array(first, np.int64)[order], np.array(slots, np.int64)[order]
    lowest = np.searchsorted(classes, np.arange(size + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, r = batch.column("class").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            at = np.empty(len(c), np.int64)
            for value in np.unique(c).tolist():
                mine = c == value
                a, b = lowest[value], lowest[value + 1]
                at[mine] = a + np.searchsorted(ranks[a:b], r[mine], side="right") - 1
            values = [batch.column(i) for i in range(5)]
            values += [pa.array(first[at] + r - ranks[at]), pa.array(slots[at])]
            yield pa.RecordBatch.from_arrays(values, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    before = counts.withColumn(
        "before", F.coalesce(F.sum("n").over(W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("n")
    inside = F.row_number().over(W.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32"))
    ranked = (
        placed.withColumn("inside", inside)
        .join(before, ["class", "part"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("before") + F.col("inside") - 1).cast("long").alias("rank"))
    )
    found = ranked.mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"
    )
    earlier = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return found.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")).drop("slot")


def pack_documents(docs: DataFrame, window: int = WINDOW, path: str | None = None, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and one end id (so a null or empty text has one token); it is cut only after each full
    window. Every sequence holds at most ``window`` tokens, its pieces follow each other from 0 without gaps, and pieces
    that share a sequence keep their ids. Rows that repeat a doc_id, or have none, are packed like any other. Further
    columns are ignored. An empty table gives no rows.
    """
    return pack(materialize(pieces(docs, window, path=path, text=text), "pieces"), window)


@query("op10_nnls_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder, "doc_id", "text"))
