"""Files as tables: folder listings and file contents through Spark's binary file source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.operators.intake import folder_candidates
from foliary.session import materialize

PDF_GLOB = "*.[pP][dD][fF]"


def read_files(spark: SparkSession, folder: str, recursive: bool = True, excluded: Sequence[str] = ()) -> DataFrame:
    """Candidate files below a folder with their content (``path, modificationTime, length, content``).

    Listing and reading are Spark's; a query that does not use ``content`` does not read it."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", PDF_GLOB).option("recursiveFileLookup", str(recursive).lower())
    return folder_candidates(reader.load(folder), excluded=excluded)


def list_folder(spark: SparkSession, folder: str, recursive: bool = True, excluded: Sequence[str] = ()) -> DataFrame:
    """Snapshot of the candidate files of a folder: ``path, size, mtime`` (microseconds)."""
    files = read_files(spark, folder, recursive, excluded)
    return files.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))


def write_bucketed(rows: DataFrame, path: str, buckets: int = 64, key: str = "document_id") -> None:
    """Write child rows partitioned by a bucket of their document, replacing only the buckets that occur in ``rows``.

    Together with :func:`foliary.operators.library.replace_document_rows` on the touched buckets this replaces the rows
    of some documents in one commit per bucket."""
    tagged = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    writer = tagged.repartition("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(path)


class BucketedRows:
    """A table of rows under a key, stored by a hash of the key, in which the rows of some keys can be replaced.

    Replacing reads and overwrites the buckets of the touched keys and no others. The same replacement again gives the same
    table, so a micro-batch may be repeated. Every bucket that was ever written holds a row of nulls, so that it is
    overwritten, not left, when its last key goes."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = f"{schema}, bucket int"
        self.columns = spark.createDataFrame([], schema).columns
        spark.createDataFrame([], self.schema).write.mode("append").parquet(self.path)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().filter(F.col(self.key).isNotNull()).drop("bucket")

    def replace(self, rows: DataFrame, touched: DataFrame | None = None) -> None:
        """Make ``rows`` the whole content of the ``touched`` keys (by default those that ``rows`` has)."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        rows = materialize(rows.select(*self.columns, bucket), "bucket-rows")
        keys = materialize((rows if touched is None else touched).select(self.key, bucket).distinct(), "bucket-keys")
        numbers = sorted(row["bucket"] for row in keys.select("bucket").distinct().collect())  # at most one per bucket
        if not numbers:
            return
        kept = self._stored().filter(F.col("bucket").isin(numbers) & F.col(self.key).isNotNull()).join(keys.select(self.key), self.key, "left_anti")
        marks = keys.select("bucket").distinct().select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in self.columns], "bucket")
        # Stored before it is written back, because it reads the files that it replaces.
        merged = materialize(kept.select(*self.columns, "bucket").unionByName(rows).unionByName(marks), "bucket-merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
