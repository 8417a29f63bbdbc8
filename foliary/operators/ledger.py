"""The job ledger: listing, merging, recovery and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions import text as tx

# Fixed values.
ACTIVE = ("queued", "running", "paused")
TERMINAL = ("done", "error", "cancelled")
STATUSES = ("queued", "running", "paused", "done", "error", "cancelled")
KINDS = ("ingest", "reocr", "rename", "index", "embed")
TABS = {"running": ACTIVE, "failed": ("error",), "done": ("done", "cancelled")}
FINISHED_STAGES = ("done", "partial_success", "naming")
MAX_LISTED = 2000


def known_status(status: Column) -> Column:
    return F.when(status.isin(*STATUSES), status).otherwise("queued")


def known_kind(kind: Column) -> Column:
    return F.when(kind.isin(*KINDS), kind).otherwise("ingest")


def clamp_progress(progress: Column) -> Column:
    return F.least(F.greatest(F.coalesce(progress, F.lit(0.0)), F.lit(0.0)), F.lit(100.0))


def latest_job_per_document(jobs: DataFrame) -> DataFrame:
    """Ingest jobs, only the newest (highest id) of each document; jobs without a document all stay.

    An aggregate rather than a window: it combines on the map side, so a document with very many jobs costs nothing
    extra."""
    ingest = jobs.filter(F.col("kind") == "ingest")
    newest = ingest.filter(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.max("job_id").alias("job_id"))
    kept = ingest.join(newest.select("job_id"), "job_id", "left_semi").select(*jobs.columns)
    return kept.unionByName(ingest.filter(F.col("document_id").isNull()))


def active_job_per_document(jobs: DataFrame) -> DataFrame:
    """The newest queued, running or paused job of every document that has one."""
    active = jobs.filter(F.col("status").isin(*ACTIVE) & F.col("document_id").isNotNull())
    newest = F.max_by(F.struct("job_id", "status", "created_at"), F.struct("created_at", "job_id"))
    return active.groupBy("document_id").agg(newest.alias("job")).select("document_id", "job.*")


def jobs_with_documents(jobs: DataFrame, documents: DataFrame, since: int | None = None, limit: int | None = None) -> DataFrame:
    """Newest ledger rows with the state of their documents and defaults for what is missing. A ledger without start and end times
    has nulls there."""
    rows = latest_job_per_document(jobs)
    if since is not None:
        rows = rows.filter(F.col("created_at") >= since)
    if limit is not None:
        rows = rows.orderBy(F.desc("created_at"), F.desc("job_id")).limit(max(1, min(limit, MAX_LISTED)))
    facts = documents.select("document_id", "original_path", F.col("status").alias("document_status"), "page_count")
    status = known_status(F.col("status"))
    return rows.join(facts, "document_id", "left").select(
        "job_id",
        "document_id",
        F.coalesce(F.nullif(tx.basename(F.col("original_path")), F.lit("")), F.lit("PDF")).alias("filename"),
        F.when(F.col("origin") == "watch", "watch").otherwise("manual").alias("source"),
        known_kind(F.col("kind")).alias("kind"),
        status.alias("status"),
        F.coalesce("document_status", status).alias("stage"),
        F.when(status.isin(*TERMINAL), 100.0).otherwise(0.0).alias("progress_pct"),
        "error_message",
        "created_at",
        *[(F.col(c) if c in jobs.columns else F.lit(None)).cast("bigint").alias(c) for c in ("started_at", "finished_at")],
        "original_path",
        F.coalesce("page_count", F.lit(0)).cast("bigint").alias("page_count"),
        "engine",
    )


def job_filter(
    listing: DataFrame,
    statuses: Sequence[str] | None = None,
    kind: str | None = None,
    since: int | None = None,
    limit: int = 500,
    tab: str | None = None,
    source: str | None = None,
) -> DataFrame:
    """Filter a job listing. ``since`` and ``limit`` cut the list first, the other criteria apply to what is left."""
    rows = listing if since is None else listing.filter(F.col("created_at") >= since)
    rows = rows.orderBy(F.desc("created_at"), F.desc("job_id")).limit(max(1, min(limit, MAX_LISTED)))
    if statuses is not None:
        rows = rows.filter(F.col("status").isin(*statuses))
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if tab in TABS:
        rows = rows.filter(F.col("status").isin(*TABS[tab]))
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    return rows


def merge_queue_snapshot(current: DataFrame, server: DataFrame) -> DataFrame:
    """Client rows brought up to date with server rows, both keyed by ``job_id``.

    Server fields win, progress never goes down, and terminal rows the server no longer reports disappear."""
    fields = [c for c in current.columns if c not in ("job_id", "progress_pct")]
    mine = current.select("job_id", F.struct(*fields, "progress_pct").alias("mine"))
    theirs = server.select("job_id", F.struct(*fields, "progress_pct").alias("theirs"))
    known, reported = F.col("mine").isNotNull(), F.col("theirs").isNotNull()
    # A NULL status counts as not terminal, hence the coalesce.
    stale = ~reported & F.coalesce(F.col("mine.status").isin(*TERMINAL), F.lit(False))
    progress = F.when(
        reported,
        F.greatest(F.coalesce("mine.progress_pct", F.lit(0.0)), F.coalesce("theirs.progress_pct", F.lit(0.0))),
    ).when(known, F.col("mine.progress_pct"))
    return (
        mine.join(theirs, "job_id", "full_outer")
        .filter(~stale)
        .select(
            "job_id",
            *[F.when(reported, F.col(f"theirs.{c}")).otherwise(F.col(f"mine.{c}")).alias(c) for c in fields],
            progress.alias("progress_pct"),
        )
    )


def recoverable_jobs(jobs: DataFrame, documents: DataFrame, listing: DataFrame) -> DataFrame:
    """What to do after a restart with jobs that were running or queued: requeue, or fail when the source is gone."""
    files = listing.select(F.col("path").alias("original_path")).distinct().withColumn("present", F.lit(True))
    message = F.concat(F.lit("Source file no longer exists at "), F.col("original_path"))
    return (
        jobs.filter(F.col("status").isin("running", "queued"))
        .select("job_id", "document_id")
        .join(documents.select("document_id", "original_path"), "document_id")
        .join(files, "original_path", "left")
        .select(
            "job_id",
            "document_id",
            F.when(F.col("present"), "queued").otherwise("error").alias("status"),
            F.when(F.col("present").isNull(), message).alias("error_message"),
        )
    )


def clear_completed(jobs: DataFrame) -> DataFrame:
    """The ledger without its terminal rows."""
    return jobs.filter(~F.col("status").isin(*TERMINAL))


def cleared_count(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status").isin(*TERMINAL)).alias("removed"))


def job_summary(jobs: DataFrame) -> DataFrame:
    """One row of counts per status, plus active and clearable."""

    def count(*statuses: str) -> Column:
        return F.count_if(F.col("status").isin(*statuses))

    return jobs.agg(
        count("queued").alias("queued"),
        count("running").alias("running"),
        count("paused").alias("paused"),
        count("error").alias("failed"),
        count("done").alias("done"),
        count(*ACTIVE).alias("active"),
        count(*TERMINAL).alias("clearable"),
    )


def overall_progress(jobs: DataFrame) -> DataFrame:
    """Mean clamped progress of the active jobs, 0 when there are none."""
    active = F.when(F.col("status").isin(*ACTIVE), clamp_progress(F.col("progress_pct")))
    return jobs.agg(F.round(F.coalesce(F.avg(active), F.lit(0.0)), 4).alias("overall_progress"))


# Banner id, severity, then groups of substrings; one hit in every group is needed.
ISSUES = (
    ("rate-limit", "warning", (("rate limit", "429"),)),
    ("ollama", "warning", (("ollama",), ("not reachable", "connection"))),
    ("rapidocr", "error", (("rapidocr",), ("missing",))),
)


def issue_report(jobs: DataFrame) -> DataFrame:
    """Errors per class, and which class the banner shows.

    The banner rule looks at all messages together, so its words may come from different jobs; it is worked out from
    one flag per word. A job's own class is the first whose words its message holds."""
    text = F.lower(F.coalesce("error_message", F.lit("")))
    errors = jobs.select(text.alias("text"), F.col("error_message").isNotNull().alias("has_error"))

    def every(groups: Sequence[Sequence[str]], found) -> Column:
        result = F.lit(True)
        for group in groups:
            hit = F.lit(False)
            for word in group:
                hit = hit | found(word)
            result = result & hit
        return result

    own = F.lit(None).cast("string")
    for banner, _, groups in reversed(ISSUES):
        own = F.when(every(groups, lambda w: F.contains(F.col("text"), F.lit(w))), banner).otherwise(own)
    words = sorted({w for _, _, groups in ISSUES for group in groups for w in group})
    seen = errors.agg(*[F.coalesce(F.bool_or(F.contains(F.col("text"), F.lit(w))), F.lit(False)).alias(w) for w in words])
    shown = F.lit(None).cast("string")
    for banner, _, groups in reversed(ISSUES):
        shown = F.when(every(groups, lambda w: F.col(f"`{w}`")), banner).otherwise(shown)
    return (
        errors.filter("has_error")
        .groupBy(F.coalesce(own, F.lit("other")).alias("issue"))
        .agg(F.count(F.lit(1)).alias("jobs"))
        .withColumn("is_banner", F.coalesce(F.col("issue") == seen.select(shown.alias("banner")).scalar(), F.lit(False)))
    )


def recent(rows: DataFrame, n: int, time: str, tie: str) -> DataFrame:
    """The newest ``n`` rows by time."""
    return rows.orderBy(F.desc(time), F.desc(tie)).limit(n)
