"""Structured Streaming jobs: ingest, debounce, de-duplication, stability, progress, and index upkeep.

Windowed jobs are ordinary streaming aggregates. Jobs whose rule depends on order within a key are processors with a state
per key (``transformWithState``). Jobs that keep tables replace rows of the buckets they touch.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliary.operators import intake, library, postings, search, vectors
from foliary.operators.chunking import chunk_documents
from foliary.operators.ledger import FINISHED_STAGES, TERMINAL, clamp_progress
from foliary.session import materialize, scratch_path
from foliary.sources.files import BucketedRows, list_folder, read_files
from foliary.streaming.run import run_batches

# Fixed values.
RESCAN_SECONDS = (30, 300, 86_400)
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
DEBOUNCE = "2 seconds"
FLUSH_INTERVAL = "250 milliseconds"
ANCHOR_BUCKETS = 4096
MAX_FILE_AGE = "36500d"  # the source would skip files a week older than the newest


def rescan_seconds(setting: str | None) -> int:
    """Rescan interval from its setting: a default when absent or unreadable, always within bounds."""
    low, default, high = RESCAN_SECONDS
    text = (setting or "").strip()
    value = int(text) if text.isascii() and text.isdigit() and int(text) < 2**64 else default
    return min(max(value, low), high)


def watch_folder(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Stream of new PDF files below a folder (``path, content, length, modificationTime``).

    The source's own log remembers which files it has handed out, so unchanged files are not read again; trigger it
    with ``processingTime=f"{rescan_seconds(...)} seconds"`` for periodic scans. A file of any age counts as new when it
    first appears. A file written anew under a path that was handed out is not seen: let writers rename it into place."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("maxFileAge", MAX_FILE_AGE)
    return reader.option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)


def ingest_stream(files: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Candidate files of a stream with their content hash."""
    kept = intake.folder_candidates(files, excluded=excluded)
    return library.content_fingerprint(kept, "content").drop("content")


class FolderRescans:
    """Periodic scans of a folder that hand out every version of every candidate file once, when it has stopped changing.

    A scan compares the listing (path, size, mtime) with the one stored per path. A file that is new or differs is noted; one that is as it
    was noted, ``required`` microseconds or more ago, and was not handed out in that form, is read and handed out. So a file that
    is rewritten under its path comes again, and one that is still being written waits. A scan writes its rows into a folder of
    its own before it stores the listing, and a stored row knows the scan that handed it out, so repeating a scan after a failure at any
    point hands out the same rows once. Only rows that changed are stored. ``listing`` gives the files there are now, ``read`` the content of some of them (``path, size, mtime, content``)."""

    STATE = "path string, size bigint, mtime bigint, noted_at bigint, handed_by bigint"
    OUT = "path string, size bigint, mtime bigint, sha256 string, sha16 string, sha8 string"

    def __init__(self, spark: SparkSession, path: str, listing: Callable[[], DataFrame], read: Callable[[DataFrame], DataFrame], required: int = intake.STABLE_MICROS, buckets: int = 64):
        self.spark, self.path, self.required, self.listing, self.read = spark, path.rstrip("/"), required, listing, read
        self.state = BucketedRows(spark, f"{self.path}/state", "path", self.STATE, buckets)

    def scan(self, number: int, now: int) -> None:
        """Scan ``number`` at the time ``now`` (microseconds)."""
        files = self.listing().select("path", "size", "mtime")
        known = self.state.read().select("path", F.struct("size", "mtime", "noted_at", "handed_by").alias("known"))
        same = (F.col("known.size") == F.col("size")) & (F.col("known.mtime") == F.col("mtime"))
        seen = files.join(known, "path", "left").withColumn("same", F.coalesce(same, F.lit(False)))
        due = F.col("known.handed_by").isNull() & (F.lit(now) - F.col("known.noted_at") >= self.required)
        ready = F.col("same") & (due | F.coalesce(F.col("known.handed_by") == number, F.lit(False)))
        noted_at = F.when(F.col("same"), F.col("known.noted_at")).otherwise(F.lit(now))
        changed = seen.filter(~F.col("same") | ready).select("path", "size", "mtime", noted_at.alias("noted_at"), F.when(ready, F.lit(number)).cast("bigint").alias("handed_by"))
        changed = materialize(changed, "rescan")
        content = self.read(changed.filter("handed_by IS NOT NULL").select("path", "size", "mtime"))
        found = library.content_fingerprint(content.select("path", "size", "mtime", "content"), "content").drop("content")
        found.write.mode("overwrite").parquet(f"{self.path}/files/scan={number}")
        self.state.replace(changed)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        self.scan(batch_id, time.time_ns() // 1000)

    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files").drop("scan")


def rescan_folder(spark: SparkSession, folder: str, path: str, recursive: bool = True, excluded: Sequence[str] = ()) -> FolderRescans:
    """Scans of a real folder. Content is read for the versions asked for; the range of their modification times goes to the file
    source, which skips all other files before it opens them."""

    def read(wanted: DataFrame) -> DataFrame:
        ends = wanted.agg(F.min("mtime"), F.max("mtime")).first()
        files = read_files(spark, folder, recursive, excluded)
        inside = F.col("modificationTime").between(F.timestamp_micros(F.lit(ends[0] or 0)), F.timestamp_micros(F.lit(ends[1] or 0)))
        now = files.filter(inside).select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"), "content")
        return now.join(wanted, ["path", "size", "mtime"])

    return FolderRescans(spark, path, lambda: list_folder(spark, folder, recursive, excluded), read)


def start_rescans(rescans: FolderRescans, checkpoint: str, setting: str | None = None):
    """Scan for ever at the interval of the setting (:func:`rescan_seconds`); the stream gives one tick per scan."""
    ticks = rescans.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return run_batches(ticks, checkpoint, rescans.on_batch, trigger={"processingTime": f"{rescan_seconds(setting)} seconds"})


def with_end(events: DataFrame, ends: DataFrame) -> DataFrame:
    """A stream together with its end marks: ``ends`` streams moments (same name and type as the event time).

    A mark has nulls in all other columns. It moves the watermark past whatever is open, and gives no row itself,
    because nothing later closes it. It must lie a gap or interval and the allowed delay after the last event."""
    return events.unionByName(ends, allowMissingColumns=True)


def debounce_stream(events: DataFrame, key: str, ts: str, gap: str = DEBOUNCE, delay: str = "10 seconds") -> DataFrame:
    """Bursts of events of a key, each closed by a quiet ``gap``, as one row.

    Bursts still open when a feed ends are closed by :func:`with_end`."""
    burst = F.session_window(ts, gap).alias("burst")
    return (
        events.withWatermark(ts, delay)
        .groupBy(key, burst)
        .agg(F.count(F.lit(1)).alias("events"), F.max(ts).alias("last_event"))
        .select(key, F.col("burst.start").alias("first_event"), "last_event", "events")
    )


def progress_batches(updates: DataFrame, ts: str, columns: Sequence[str], delay: str = "10 seconds", interval: str = FLUSH_INTERVAL) -> DataFrame:
    """The last update of every job in each flush interval; an interval without updates gives nothing.

    Intervals still open when a feed ends are closed by :func:`with_end`."""
    last = F.max_by(F.struct(*columns), F.struct(ts, *columns)).alias("last")
    return (
        updates.withWatermark(ts, delay)
        .groupBy("job_id", F.window(ts, interval).alias("flush"))
        .agg(last, F.count(F.lit(1)).alias("updates"))
        .select("job_id", F.col("flush.start").alias("flush_start"), "updates", "last.*")
    )


def job_states(events: DataFrame) -> DataFrame:
    """State of each job after its progress updates (``stage, progress_pct``) and lifecycle events (``status``).

    Input rows hold ``job_id, seq, stage, progress_pct, status``; a lifecycle event has a status and no stage. As a
    streaming aggregate it runs in update mode."""
    is_progress = F.col("stage").isNotNull()
    status = F.when(is_progress, F.when(F.col("stage").isin(*FINISHED_STAGES), "done").otherwise("running")).otherwise(F.col("status"))
    progress = F.when(is_progress, clamp_progress(F.col("progress_pct"))).when(F.col("status").isin(*TERMINAL), 100.0)
    return events.groupBy("job_id").agg(
        F.max_by(status, "seq").alias("status"),
        F.max_by("stage", F.when(is_progress, F.col("seq"))).alias("stage"),
        F.coalesce(F.max_by(progress, F.when(progress.isNotNull(), F.col("seq"))), F.lit(0.0)).alias("progress_pct"),
        F.count(F.lit(1)).alias("events"),
    )


class JobStates:
    """Sink of :func:`job_states`: every micro-batch replaces the state of the jobs it changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.states = BucketedRows(spark, path, "job_id", "job_id bigint, status string, stage string, progress_pct double, events bigint")

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        self.states.replace(batch)


def _alike(value):
    """A key as Spark groups by it, for a dictionary: NaN equals NaN, and arrays have a hash."""
    if isinstance(value, (list, tuple)):
        return tuple(map(_alike, value))
    if isinstance(value, bytearray):
        return bytes(value)
    return value if value == value else "NaN"


class Anchors(StatefulProcessor):
    """State of one bucket of keys of :func:`dedup_stream`: for each of its keys the moment that passed last, until the watermark leaves
    its window. Every call into the state store costs a round trip, and so a bucket takes a few of them whatever its number of keys."""

    def __init__(self, keys: Sequence[str], ts: str, window: int, schema: str):
        self.keys, self.ts, self.window, self.schema = list(keys), ts, window, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.anchors = handle, handle.getListState("anchors", self.schema)

    def _over(self, anchor: int) -> int:
        return (anchor + self.window) // 1000 + 1

    def _keep(self, anchors: list[tuple], now: int) -> list[tuple]:
        """Store the anchors that may still hold something back."""
        live = [anchor for anchor in anchors if self._over(anchor[-1]) > now]
        if live:
            self.anchors.put(live)
        else:
            self.anchors.clear()
        return live

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        columns = [*self.keys, self.ts]
        anchors = {_alike(anchor[:-1]): anchor for anchor in self.anchors.get()}
        # In order of time over all keys of the bucket, so also of each; rows without a moment come last.
        moments = {(row[self.ts], _alike(of)): of for row in rows for of in [tuple(row[c] for c in self.keys)]}
        changed = False
        for (at, same), of in sorted(moments.items(), key=lambda moment: (moment[0][0] is None, moment[0][0] or 0)):
            if same not in anchors or (at is not None and at > anchors[same][-1] + self.window):
                yield Row(**dict(zip(columns, (*of, at))))
                if at is not None:
                    anchors[same], changed = (*of, at), True
        if changed:
            live = self._keep(list(anchors.values()), timerValues.getCurrentWatermarkInMs())
            if live:
                self.handle.registerTimer(self._over(max(anchor[-1] for anchor in live)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # A timer of earlier anchors says nothing about the present ones.
        self._keep(list(self.anchors.get()), expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def close(self) -> None:
        pass


def dedup_stream(events: DataFrame, keys: Sequence[str], ts: str, window: int = intake.DEDUP_MICROS, delay: str = "0 seconds", buckets: int = ANCHOR_BUCKETS) -> DataFrame:
    """Anchored de-duplication of a stream (``ts`` in microseconds): the moments at which an event of a key passes.

    The anchors of the keys of a bucket (a hash of the key) are one state, and go once nothing they could hold back can still come, with the
    next rows of their bucket or by a timer, so the state counts the keys of one window. A checkpoint is bound to its number of ``buckets``.
    Moments within a micro-batch are put in order; an event later than ``delay`` is dropped
    by the watermark, and one that comes after a later one of its key has passed does not pass."""
    moments = events.select(*keys, F.col(ts).cast("bigint").alias(ts)).withColumn("event_time", F.timestamp_micros(ts))
    schema = ", ".join(f"`{c}` {moments.schema[c].dataType.simpleString()}" for c in [*keys, ts])
    dealt = moments.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withWatermark("event_time", delay)
    return dealt.groupBy("_bucket").transformWithState(Anchors(keys, ts, window, schema), schema, "append", "eventTime")


LISTING = "path string, listing_id bigint, size bigint, mtime bigint, seen_at bigint"
CHECK = f"{LISTING}, stable boolean, failures bigint, alert boolean"


class LastListings(StatefulProcessor):
    """State of one path of :func:`stability_stream`: its last listing and the length of the current run of failed checks."""

    def __init__(self, required: int, forget: int | None):
        self.required, self.forget = required, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "size bigint, mtime bigint, seen_at bigint, failures bigint")

    def _over(self, seen_at: int) -> int:
        return (seen_at + self.forget) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        size, mtime, seen_at, failures = self.last.get() if self.last.exists() else (None, None, None, 0)
        for row in sorted(rows, key=lambda row: (row["seen_at"], row["listing_id"])):
            same = size is not None and mtime is not None and (row["size"], row["mtime"]) == (size, mtime)
            stable = same and row["seen_at"] - seen_at >= self.required
            failures = 0 if stable else failures + 1
            size, mtime, seen_at = row["size"], row["mtime"], row["seen_at"]
            yield Row(path=key[0], listing_id=row["listing_id"], size=size, mtime=mtime, seen_at=seen_at, stable=stable, failures=failures, alert=failures >= intake.ALERT_AFTER)
        if seen_at is not None:
            self.last.update((size, mtime, seen_at, failures))
            if self.forget is not None:
                self.handle.registerTimer(self._over(seen_at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists() and self._over(self.last.get()[2]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stability_stream(listings: DataFrame, required: int = intake.STABLE_MICROS, forget: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """Stability checks over successive listings of a stream (``path, listing_id, size, mtime, seen_at``, microseconds).

    With ``forget`` a path that was not listed for so many microseconds starts anew, and its state is freed; without it
    the state keeps one row per path for ever, as the batch operator would see it."""
    rows = listings.select("path", "listing_id", "size", "mtime", "seen_at")
    processor = LastListings(required, forget)
    if forget is None:
        return rows.groupBy("path").transformWithState(processor, CHECK, "append", "none")
    timed = rows.withColumn("event_time", F.timestamp_micros("seen_at")).withWatermark("event_time", delay)
    return timed.groupBy("path").transformWithState(processor, CHECK, "append", "eventTime")


class IndexStream:
    """Keeps an inverted index equal to a changing page table.

    Pages and their blocks lie in buckets of the page id. A batch of changes (``op, seq, page_id, document_id, text`` with op
    insert, update or delete) reads the pages of the buckets it touches, applies them, and overwrites those buckets of both
    tables, so its work follows the buckets it touches. A change counts only if its ``seq`` is not older than that of the
    page, and deleted pages stay as marks; so a batch that is written again after a failure, in part or as a whole, changes nothing."""

    PAGES = "page_id bigint, document_id bigint, text string, seq bigint, bucket int"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        for part, schema in (("pages", self.PAGES), ("blocks", f"{postings.BLOCKS}, bucket int")):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{part}")

    def _bucket(self):
        return F.pmod(F.xxhash64("page_id"), F.lit(self.buckets)).cast("int")

    def _overwrite(self, rows: DataFrame, part: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{part}")

    def pages(self) -> DataFrame:
        return self.spark.read.schema(self.PAGES).parquet(f"{self.path}/pages")

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        text = F.when(F.col("op") != "delete", F.coalesce("text", F.lit("")))
        changes = batch.select("page_id", "document_id", text.alias("text"), "seq", self._bucket().alias("bucket"))
        touched = sorted(row["bucket"] for row in changes.select("bucket").distinct().collect())  # at most one number per bucket
        if not touched:
            return
        inside = F.col("bucket").isin(touched)
        both = self.pages().filter(inside).unionByName(changes)
        newest = F.max_by(F.struct("document_id", "text", "seq"), F.struct("seq", "text")).alias("page")
        # Dealt by bucket alone, so the texts are shuffled once, and each file of the merged pages is part of one bucket.
        path = scratch_path(self.spark, "index-pages")
        both.repartition("bucket").groupBy("bucket", "page_id").agg(newest).select("page_id", "page.*", "bucket").write.partitionBy("bucket").parquet(path)
        merged = self.spark.read.schema(self.PAGES).parquet(path)
        self._overwrite(merged, "pages")
        # Rows of a bucket lie together, and a block never spans two of them; one that is cut in two only has more blocks.
        cut = postings.cut_blocks(merged.filter(F.col("text").isNotNull()), within="bucket")
        # A bucket whose last page has gone still gets its (empty) totals, so its old blocks are replaced.
        emptied = merged.groupBy("bucket").agg(F.count("text").alias("n")).filter("n = 0")
        blank = emptied.select(*[F.lit(0 if name in ("block", "n_rows", "n_tokens") else None).cast(kind).alias(name) for name, kind in postings.FIELDS], "bucket")
        self._overwrite(cut.unionByName(blank), "blocks")

    def index(self) -> search.Index:
        return search.index_of(self.spark.read.schema(f"{postings.BLOCKS}, bucket int").parquet(f"{self.path}/blocks").drop("bucket"))


class EmbedStream:
    """Chunks and embeds documents that reach a final state; their old chunks and vectors are replaced.

    The stream holds ``document_id, status``; the text comes from the page table."""

    CHUNKS = "chunk_id bigint, document_id bigint, page_id bigint, char_start bigint, char_end bigint, token_count bigint, text string, embedding array<double>"
    CHUNK_SLOTS = 100_000

    def __init__(self, spark: SparkSession, path: str, pages: DataFrame, embedder: vectors.Embedder | None = None, dim: int = 384):
        self.pages, self.embedder, self.dim = pages, embedder, dim
        self.chunks = BucketedRows(spark, path, "document_id", self.CHUNKS)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        ready = batch.filter(F.col("status").isin(*library.SEARCHABLE)).select("document_id").distinct()
        cut = chunk_documents(self.pages.join(ready, "document_id", "left_semi"))
        cut = cut.withColumn("chunk_id", F.col("page_id") * self.CHUNK_SLOTS + F.col("chunk_no"))
        embedded = cut.join(vectors.embed_chunks(cut, self.embedder, self.dim), "chunk_id")
        self.chunks.replace(embedded, ready)


class EnqueueStream:
    """Turns file events (``file_id, path, sha256``) into ledger rows.

    Each batch is decided against the library and the jobs of earlier batches. A new document takes the id of its first
    file, and its job the same id in a range of its own (negative, so it never meets those of the ledger). A job counts
    as queued until the ledger holds it with another status: ``jobs`` may be a function that reads the ledger anew for
    every batch, so that content whose job has ended is queued again."""

    def __init__(self, spark: SparkSession, path: str, documents: DataFrame, jobs: DataFrame | Callable[[], DataFrame]):
        self.spark, self.path = spark, path.rstrip("/")
        self.documents = documents.select("document_id", "sha256")
        self.ledger = jobs if callable(jobs) else lambda: jobs

    ACTIONS = "file_id bigint, sha256 string, action string, document_id bigint, active_job_id bigint, first_file_id bigint, batch bigint"

    def _earlier(self, batch_id: int) -> DataFrame:
        folders = [f"{self.path}/actions/batch={n}" for n in range(batch_id)]
        if not folders:
            return self.spark.createDataFrame([], self.ACTIONS)
        return self.spark.read.option("basePath", f"{self.path}/actions").schema(self.ACTIONS).parquet(*folders)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        done = self._earlier(batch_id).filter(F.col("action") != "reuse_job")
        target = F.coalesce("document_id", "first_file_id")
        created = done.filter(F.col("action") == "new_document").select(F.col("first_file_id").alias("document_id"), "sha256")
        jobs = self.ledger().select("job_id", "document_id", "status", "created_at")
        # A job of this stream is later than all that were in the ledger when it was made; the order is that of batches.
        queued = done.select((-1 - F.col("file_id")).alias("job_id"), target.alias("document_id"), F.lit("queued").alias("status"), (F.lit(2**40) + F.col("batch")).cast("bigint").alias("created_at"))
        queued = queued.join(jobs, "job_id", "left_anti")
        actions = intake.enqueue_files(batch, self.documents.unionByName(created), jobs.unionByName(queued))
        actions.write.mode("overwrite").parquet(f"{self.path}/actions/batch={batch_id}")

    def actions(self) -> DataFrame:
        return self.spark.read.schema(self.ACTIONS).parquet(f"{self.path}/actions").drop("batch")
