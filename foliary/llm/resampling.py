"""Resampling of documents towards a target distribution by the importance of their hashed words.

The words of a table and of a target are counted in hash buckets; the gain of a bucket is the logarithm of how much more
often the target uses it. A document's weight is the sum of the gains of its features, its score that weight with Gumbel
noise, and the highest scores are a draw without replacement in proportion to exp(weight / 1000).

The cutoff of the draw is found by bisection: exact counts of the persisted scores above a threshold, then, among rows
of the cutoff score, of the ids up to a threshold. No row is ranked to decide whether it is drawn. The drawn rows are
range-partitioned by (score, id), so their ranks are their places in their ranges plus the sizes of the ranges before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import as_bytes, documents, materialize, query

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
SLICE = 1 << 20  # bytes of one text that are split into words at a time

# Fixed value: a word is a run of digits, letters a-z and characters beyond ASCII, after A-Z are lower-cased.
_BYTES = bytes(b if b > 0x7F or chr(b).isdigit() or "a" <= chr(b) <= "z" else ord(chr(b).lower()) if "A" <= chr(b) <= "Z" else 0x20 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice of it at a time; no word is cut."""
    plain, start = text.translate(_BYTES), 0
    while start < len(plain):
        end = plain.find(b" ", start + SLICE)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


class Hasher:
    """Buckets of the features of a text; the buckets of single words are remembered up to a bound."""

    KEPT = 500_000

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest, self.known = buckets, longest, {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, int]:
        """(bucket of every run of 1 to ``longest`` consecutive words, number of words)."""
        found, carry, n_words = [], [], 0
        for part in words(text):
            n_words += len(part)
            if len(self.known) > self.KEPT:
                self.known.clear()
            for word in set(part).difference(self.known):
                self.known[word] = zlib.crc32(word) % self.buckets
            found.append(np.fromiter(map(self.known.__getitem__, part), np.int64, len(part)))
            if self.longest > 1:
                run = carry + part
                for n in range(2, self.longest + 1):
                    # Runs that end in this slice; those that end in an earlier one were counted there.
                    first = max(len(carry) - n + 1, 0)
                    joined = (b" ".join(run[i : i + n]) for i in range(first, len(run) - n + 1))
                    found.append(np.fromiter((zlib.crc32(x) % self.buckets for x in joined), np.int64))
                carry = run[len(run) - min(self.longest - 1, len(run)) :]
        return (np.concatenate(found) if found else np.empty(0, np.int64)), n_words


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, text: str = "text") -> np.ndarray:
    """Occurrences of every bucket in all texts of a table. A task sends at most ``buckets`` numbers, and so does the
    aggregate to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for one in as_bytes(batch.column(0)):
                total += np.bincount(hasher(one)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    counted = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in counted.collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of every bucket."""
    size, all_source, all_target = len(source), int(source.sum()), int(target.sum())

    def gain(s: int, t: int) -> int:
        ratio = float(t + 1) * float(all_source + size) / (float(s + 1) * float(all_target + size))
        return math.floor(1000 * math.log(ratio))

    return np.array([gain(s, t) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the summed gains of a text's features. The array of gains has one number a
    bucket, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(len(gain), longest)
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for one in as_bytes(batch.column(1)):
                found, n = hasher(one)
                n_words.append(n)
                n_features.append(len(found))
                weight.append(int(gain[found].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long"
    )


def with_scores(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Add Gumbel noise that depends on the seed and the id only (an id that is null counts as empty text)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise.cast("long"))


def bisect(count: Callable[[int], int], low: int, high: int, wanted: int) -> int:
    """The smallest threshold in [low, high] with count(threshold) <= wanted, where count never rises with it."""
    while low < high:
        middle = (low + high) // 2
        if count(middle) <= wanted:
            high = middle
        else:
            low = middle + 1
    return low


def draw(scored: DataFrame, eligible, n_drawn: int) -> DataFrame:
    """Number the ``n_drawn`` eligible rows of the highest scores in ``rank`` (1, 2, 3...), null for all others.

    ``scored`` is a stored table with doc_id and score. Ties go to the smaller id, null being the largest; rows equal in
    both go by the rest of the row and then by their place in the table, so exactly ``n_drawn`` are drawn.
    """
    scored = scored.withColumn("place", F.monotonically_increasing_id()).withColumn("eligible", F.coalesce(eligible, F.lit(False)))
    kept = scored.filter("eligible")
    ends = kept.agg(F.min("score"), F.max("score")).first()
    nothing = scored.drop("place", "eligible").withColumn("rank", F.lit(None).cast("long"))
    if n_drawn <= 0 or ends[0] is None:
        return nothing
    # The cutoff: fewer than n_drawn rows lie above it, and n_drawn or more at it or above.
    cutoff = bisect(lambda at: kept.filter(F.col("score") > at).count(), ends[0] - 1, ends[1], n_drawn - 1)
    tied = kept.filter(F.col("score") == cutoff)
    left = n_drawn - kept.filter(F.col("score") > cutoff).count()
    some = tied.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    if some[2] >= left:
        # The last id: with the ids beyond it, no more rows than those left over stay out.
        last = bisect(lambda at: -tied.filter(F.col("doc_id") <= at).count(), some[0], some[1], -left)
        in_draw = F.coalesce(F.col("doc_id") <= last, F.lit(False))
    else:
        in_draw = F.lit(True)
    in_draw = F.col("eligible") & ((F.col("score") > cutoff) | ((F.col("score") == cutoff) & in_draw))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("place")]
    ordered = scored.filter(in_draw).repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of this number are the range, the lower 33 the place in it.
    ordered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, seen = [0] * (sizes[-1][0] + 1), 0
    for number, n in sizes:
        before[number] = seen
        seen += n
    starts = F.array(*[F.lit(n).cast("long") for n in before])
    rank = F.get(starts, part.cast("int")) + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn = ordered.withColumn("rank", F.when(rank <= n_drawn, rank)).drop("place", "eligible", "at")
    return drawn.unionByName(scored.filter(~in_draw).drop("place", "eligible").withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``, ``rank`` being null where it is not drawn.

    Both tables need a column ``text``, ``docs`` also ``doc_id``; other columns are not looked at. A text that is null or
    without words has no features and weight 0, and is too short to be drawn. Rows with equal ids share their noise and are
    drawn each for itself. An empty target gives all buckets the gain of the smoothed counts; an empty table gives no rows.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = materialize(with_scores(weigh(docs, gain, longest), seed), "scores")
    long_enough = F.col("n_words") >= least_words
    return draw(scored, long_enough, percent * scored.filter(long_enough).count() // 100)


# One row per distinct word, so the sum of a byte at a time is worked out once for each.
SQL = """
WITH RECURSIVE bits(byte, step, c) AS (
    SELECT range, 0, range::BIGINT FROM range(256)
    UNION ALL SELECT byte, step + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE step < 8
),
crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE step = 8),
pieces AS (
    SELECT 0 AS side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
    UNION ALL
    SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
used AS (SELECT side, doc_id, unnest(words) AS word FROM pieces),
counted AS (SELECT side, doc_id, word, count(*) AS n FROM used GROUP BY ALL),
vocabulary AS (
    SELECT word, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(word), (2 * i + 1)::BIGINT, 2))::BIGINT)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM counted), crc
),
hashed AS (SELECT side, doc_id, bucket, sum(n)::BIGINT AS n FROM counted JOIN vocabulary USING (word) GROUP BY ALL),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM hashed GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM buckets, totals),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM hashed JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scores AS (
    SELECT doc_id, coalesce(len(words), 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM (SELECT * FROM pieces WHERE side = 0) LEFT JOIN weights USING (doc_id)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (10 * n) // 100 THEN place END AS rank FROM ranked
"""


@query("op12_importance_resampling", SQL)
def _importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample(documents(spark, folder, "doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
