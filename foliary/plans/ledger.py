"""Registered queries over the job ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.operators import ledger
from foliary.plans.registry import query
from foliary.plans.tables import Tables

LATEST = """
latest AS (SELECT j.* FROM lib_jobs j WHERE kind = 'ingest' AND (document_id IS NULL
  OR job_id = (SELECT max(k.job_id) FROM lib_jobs k WHERE k.document_id = j.document_id AND k.kind = 'ingest')))"""


@query(f"WITH {LATEST} SELECT job_id, document_id, status FROM latest")
def latest_job_per_document(t: Tables) -> DataFrame:
    return ledger.latest_job_per_document(t.jobs).select("job_id", "document_id", "status")


@query(
    """
SELECT document_id, job_id, status, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC) AS n FROM lib_jobs
  WHERE status IN ('queued', 'running', 'paused') AND document_id IS NOT NULL) WHERE n = 1"""
)
def active_job_per_document(t: Tables) -> DataFrame:
    return ledger.active_job_per_document(t.jobs)


LISTING = f"""{LATEST},
listing AS (SELECT job_id, l.document_id, coalesce(regexp_extract(original_path, '[^/]*$'), 'PDF') AS filename, coalesce(origin, 'manual') AS source, kind, l.status,
    coalesce(d.status, l.status) AS stage, CASE WHEN l.status IN ('done', 'error', 'cancelled') THEN 100.0 ELSE 0.0 END::DOUBLE AS progress_pct,
    error_message, created_at, started_at, finished_at, original_path, coalesce(page_count, 0) AS page_count, engine
  FROM latest l LEFT JOIN lib_documents d ON d.document_id = l.document_id)"""


@query(f"WITH {LISTING} SELECT * FROM listing")
def jobs_with_documents(t: Tables) -> DataFrame:
    return ledger.jobs_with_documents(t.jobs, t.documents)


@query(
    f"""
WITH {LISTING}, cut AS (SELECT * FROM listing WHERE created_at >= 1704200000 ORDER BY created_at DESC, job_id DESC LIMIT 300)
SELECT * FROM cut WHERE status IN ('queued', 'running', 'paused') AND kind = 'ingest' AND source = 'manual'"""
)
def job_filter(t: Tables) -> DataFrame:
    listing = ledger.jobs_with_documents(t.jobs, t.documents)
    return ledger.job_filter(listing, kind="ingest", since=1704200000, limit=300, tab="running", source="manual")


@query(
    """
WITH cur AS (SELECT * FROM lib_jobs WHERE origin IS DISTINCT FROM 'watch'),
srv AS (SELECT job_id, document_id, CASE WHEN job_id % 10 = 3 THEN 'done' ELSE status END AS status, created_at, 100 - progress_pct AS progress_pct FROM lib_jobs WHERE kind = 'ingest')
SELECT coalesce(c.job_id, s.job_id) AS job_id, CASE WHEN s.job_id IS NOT NULL THEN s.document_id ELSE c.document_id END AS document_id,
  coalesce(s.status, c.status) AS status, coalesce(s.created_at, c.created_at) AS created_at,
  round(CASE WHEN s.job_id IS NULL THEN c.progress_pct ELSE greatest(coalesce(c.progress_pct, 0), s.progress_pct) END, 4) AS progress_pct
FROM cur c FULL JOIN srv s ON c.job_id = s.job_id WHERE NOT (s.job_id IS NULL AND c.status IN ('done', 'error', 'cancelled'))"""
)
def merge_queue_snapshot(t: Tables) -> DataFrame:
    fields = ["job_id", "document_id", "status", "created_at", "progress_pct"]
    current = t.jobs.filter(~F.col("origin").eqNullSafe("watch")).select(*fields)
    server = t.jobs.filter(F.col("kind") == "ingest").select(
        "job_id", "document_id", F.when(F.col("job_id") % 10 == 3, "done").otherwise(F.col("status")).alias("status"), "created_at", (100 - F.col("progress_pct")).alias("progress_pct")
    )
    return ledger.merge_queue_snapshot(current, server).withColumn("progress_pct", F.round("progress_pct", 4))


@query(
    """
WITH present AS (SELECT DISTINCT original_path FROM lib_documents WHERE status <> 'error')
SELECT job_id, j.document_id, CASE WHEN p.original_path IS NULL THEN 'error' ELSE 'queued' END AS status,
  CASE WHEN p.original_path IS NULL THEN 'Source file no longer exists at ' || d.original_path END AS error_message
FROM lib_jobs j JOIN lib_documents d ON d.document_id = j.document_id LEFT JOIN present p ON p.original_path = d.original_path
WHERE j.status IN ('running', 'queued')"""
)
def recoverable_jobs(t: Tables) -> DataFrame:
    listing = t.documents.filter(F.col("status") != "error").select(F.col("original_path").alias("path"))
    return ledger.recoverable_jobs(t.jobs, t.documents, listing)


@query("SELECT job_id, status FROM lib_jobs WHERE status NOT IN ('done', 'error', 'cancelled')")
def clear_completed(t: Tables) -> DataFrame:
    return ledger.clear_completed(t.jobs).select("job_id", "status")


@query("SELECT count(*) AS removed FROM lib_jobs WHERE status IN ('done', 'error', 'cancelled')")
def cleared_count(t: Tables) -> DataFrame:
    return ledger.cleared_count(t.jobs)


@query(
    """
SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'paused') AS paused,
  count(*) FILTER (status = 'error') AS failed, count(*) FILTER (status = 'done') AS done,
  count(*) FILTER (status IN ('queued', 'running', 'paused')) AS active, count(*) FILTER (status IN ('done', 'error', 'cancelled')) AS clearable FROM lib_jobs"""
)
def job_summary(t: Tables) -> DataFrame:
    return ledger.job_summary(t.jobs)


@query("SELECT round(coalesce(avg(greatest(least(progress_pct, 100), 0)) FILTER (status IN ('queued', 'running', 'paused')), 0), 4) AS overall_progress FROM lib_jobs")
def overall_progress(t: Tables) -> DataFrame:
    return ledger.overall_progress(t.jobs)


@query(
    """
SELECT CASE event_id % 4 WHEN 0 THEN 'rate-limit' WHEN 1 THEN 'ollama' WHEN 2 THEN 'rapidocr' ELSE 'other' END AS issue, count(*) AS jobs,
  event_id % 4 = 0 AS is_banner FROM events WHERE event_type = 'error' GROUP BY event_id % 4"""
)
def issue_report(t: Tables) -> DataFrame:
    return ledger.issue_report(t.jobs)


@query("SELECT thread_id, turn, created_at FROM lib_messages ORDER BY created_at DESC, thread_id * 1000 + turn DESC LIMIT 25")
def recent(t: Tables) -> DataFrame:
    numbered = t.messages.withColumn("message_id", F.col("thread_id") * 1000 + F.col("turn"))
    return ledger.recent(numbered, 25, "created_at", "message_id").select("thread_id", "turn", "created_at")
