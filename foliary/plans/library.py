"""Registered queries over the library, its files and its names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions import text as tx
from foliary.operators import intake, library, naming
from foliary.plans.registry import query
from foliary.plans.tables import Tables


@query(
    """
SELECT k.document_id, k.name AS display_name, regexp_extract(k.original_path, '[^/]*$') AS original_name, k.original_path, output_path,
  page_count, ingested_at, updated_at, ocr_engine, ai_provider, status
FROM known_names k JOIN lib_documents d USING (document_id) WHERE deleted_at IS NULL"""
)
def library_view(t: Tables) -> DataFrame:
    return library.library_view(t.documents)


@query(
    r"""
SELECT page_id, path FROM file_listing
WHERE lower(path) LIKE '%.pdf' AND NOT starts_with(regexp_extract(path, '[^/]*$'), '.')
  AND NOT starts_with(regexp_extract(path, '[^/]*$'), '~$') AND lower(path) NOT LIKE '%.tmp.pdf'
  AND path NOT LIKE '/watch/spam-farm.example.org/%'"""
)
def folder_candidates(t: Tables) -> DataFrame:
    return intake.folder_candidates(t.files, "/watch", True, ["/watch/spam-farm.example.org", "\\watch\\unused\\"]).select("page_id", "path")


@query("SELECT page_id, sha256(html) AS sha256, left(sha256(html), 16) AS sha16, left(sha256(html), 8) AS sha8 FROM pages")
def content_fingerprint(t: Tables) -> DataFrame:
    return library.content_fingerprint(t.raw("pages"), "html").select("page_id", "sha256", "sha16", "sha8")


@query(
    """
WITH cur AS (SELECT '/in/' || source AS path, 1 AS enabled, min(doc_id) AS added_at FROM documents GROUP BY source),
inc AS (SELECT '/in/' || source AS path, 0 AS enabled, max(doc_id) AS added_at FROM documents WHERE lang = 'de' GROUP BY source
        UNION ALL SELECT '/in/new_' || lang, 0, max(doc_id) FROM documents GROUP BY lang)
SELECT coalesce(c.path, i.path) AS path, coalesce(i.enabled, c.enabled)::BIGINT AS enabled, coalesce(c.added_at, i.added_at) AS added_at
FROM cur c FULL JOIN inc i ON c.path = i.path"""
)
def upsert_by_key(t: Tables) -> DataFrame:
    """Watched folders: known ones take the new flag and keep the time they were added."""
    docs = t.raw("documents")
    path = F.concat(F.lit("/in/"), "source").alias("path")
    current = docs.groupBy(path).agg(F.lit(1).cast("bigint").alias("enabled"), F.min("doc_id").alias("added_at"))
    renewed = docs.filter(F.col("lang") == "de").select(path, F.lit(0).cast("bigint").alias("enabled"), F.col("doc_id").alias("added_at"))
    fresh = docs.select(F.concat(F.lit("/in/new_"), "lang").alias("path"), F.lit(0).cast("bigint").alias("enabled"), F.col("doc_id").alias("added_at"))
    return library.upsert_by_key(current, renewed.unionByName(fresh), ["path"], keep=["added_at"], order="added_at")


@query(
    """
SELECT page_id, p.document_id, page_number, p.text FROM lib_pages p JOIN documents d ON doc_id = p.document_id WHERE lang <> 'fr'
UNION ALL SELECT doc_id * 100000 + 1, doc_id, 1, upper(text) FROM documents WHERE lang = 'fr'"""
)
def replace_document_rows(t: Tables) -> DataFrame:
    """French documents are re-extracted as one page each; their old pages go."""
    french = t.raw("documents").filter(F.col("lang") == "fr")
    fresh = french.select(
        (F.col("doc_id") * 100000 + 1).alias("page_id"), F.col("doc_id").alias("document_id"), F.lit(1).cast("bigint").alias("page_number"), F.upper("text").alias("text")
    )
    return library.replace_document_rows(t.pages.select("page_id", "document_id", "page_number", "text"), fresh)


def _outdated(t: Tables) -> DataFrame:
    return t.raw("documents").filter(F.col("source") == "src3").select(F.col("doc_id").alias("document_id"))


@query(
    """
SELECT document_id, status, CASE WHEN source = 'src3' THEN 1710000000 ELSE updated_at END AS updated_at,
  CASE WHEN source = 'src3' THEN 1710000000 ELSE deleted_at END AS deleted_at
FROM lib_documents JOIN documents ON doc_id = document_id""",
    name="delete_documents_soft",
)
def delete_soft(t: Tables) -> DataFrame:
    stamped = library.delete_documents(t.documents, _outdated(t), force=False, now=1710000000)["documents"]
    return stamped.select("document_id", "status", "updated_at", "deleted_at")


@query(
    """
WITH kept AS (SELECT doc_id FROM documents WHERE source <> 'src3')
SELECT 'documents' AS part, document_id AS id FROM lib_documents SEMI JOIN kept ON doc_id = document_id
UNION ALL SELECT 'pages', page_id FROM lib_pages SEMI JOIN kept ON doc_id = document_id
UNION ALL SELECT 'chunks', chunk_id FROM lib_chunks SEMI JOIN kept ON doc_id = document_id
UNION ALL SELECT 'vectors', vec_id FROM embeddings ANTI JOIN (SELECT doc_id FROM documents WHERE source = 'src3') ON doc_id = vec_id
UNION ALL SELECT 'jobs', job_id FROM lib_jobs ANTI JOIN (SELECT doc_id FROM documents WHERE source = 'src3') ON doc_id = document_id""",
    name="delete_documents_forced",
)
def delete_forced(t: Tables) -> DataFrame:
    children = {"pages": t.pages, "chunks": t.chunks, "vectors": t.vectors, "jobs": t.jobs}
    left = library.delete_documents(t.documents, _outdated(t), children, force=True)
    ids = {"documents": "document_id", "pages": "page_id", "chunks": "chunk_id", "vectors": "chunk_id", "jobs": "job_id"}
    parts = [table.select(F.lit(name).alias("part"), F.col(ids[name]).alias("id")) for name, table in left.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    r"""
SELECT document_id, base || CASE WHEN taker = 1 THEN '' ELSE '-' || (taker - 1) END || '-searchable.pdf' AS output_name
FROM (SELECT document_id, base, row_number() OVER (PARTITION BY base ORDER BY document_id) AS taker
      FROM (SELECT document_id, regexp_replace(regexp_extract(original_path, '[^/]*$'), '\.[^.]*$', '') || '-' || left(sha256, 8) AS base FROM lib_documents))"""
)
def assign_output_names(t: Tables) -> DataFrame:
    return library.assign_output_names(t.documents)


@query(
    """
WITH docs AS (SELECT document_id, left(sha256, 16) AS sha16, status FROM lib_documents ORDER BY ingested_at DESC, document_id DESC LIMIT 500),
jobs AS (SELECT document_id, job_id FROM lib_jobs ORDER BY created_at DESC, job_id DESC LIMIT 500),
grouped AS (SELECT document_id, count(*) AS jobs, string_agg(job_id::VARCHAR, ',' ORDER BY job_id DESC) AS job_ids FROM jobs GROUP BY document_id)
SELECT coalesce(d.document_id, g.document_id) AS document_id, sha16, status, coalesce(jobs, 0) AS jobs, coalesce(job_ids, '') AS job_ids,
  (SELECT count(*) FROM lib_documents) AS documents_count, (SELECT count(*) FROM lib_jobs) AS jobs_count
FROM docs d FULL JOIN grouped g ON d.document_id = g.document_id"""
)
def state_dump(t: Tables) -> DataFrame:
    return library.state_dump(t.documents, t.jobs)


# ---- predicates ------------------------------------------------------------------------------------------------------


@query("SELECT document_id, status FROM lib_documents WHERE status IN ('done', 'partial_success') AND deleted_at IS NULL")
def visible_documents(t: Tables) -> DataFrame:
    return library.visible_documents(t.documents).select("document_id", "status")


@query("SELECT document_id, status FROM lib_documents WHERE status IN ('done', 'partial_success', 'naming') AND deleted_at IS NULL")
def visible_documents_retrieval(t: Tables) -> DataFrame:
    return library.visible_documents(t.documents, "retrieval").select("document_id", "status")


@query(
    """
SELECT document_id, ocr_engine, ingested_at FROM lib_documents JOIN labels ON doc_id = document_id
WHERE ocr_engine = 'tesseract' AND ingested_at BETWEEN epoch(TIMESTAMP '2024-01-03 00:00:00')::BIGINT AND epoch(TIMESTAMP '2024-01-25 23:59:59')::BIGINT"""
)
def scope_filter(t: Tables) -> DataFrame:
    first, last = library.day_bounds("2024-01-03", "2024-01-25")
    labelled = t.raw("labels").select(F.col("doc_id").alias("document_id"))
    return library.scope_filter(t.documents, labelled, first, last, " tesseract ").select("document_id", "ocr_engine", "ingested_at")


LISTED = """
SELECT k.document_id, k.name AS display_name, regexp_extract(k.original_path, '[^/]*$') AS original_name, k.original_path, output_path,
  page_count, ingested_at, updated_at, ocr_engine, ai_provider, status
FROM known_names k JOIN lib_documents d USING (document_id) WHERE deleted_at IS NULL AND {condition}
ORDER BY ingested_at DESC, document_id DESC LIMIT {limit} OFFSET {offset}"""


@query(LISTED.format(condition="output_path IS NOT NULL", limit=500, offset=3))
def library_list(t: Tables) -> DataFrame:
    return library.library_list(t.documents, None, 900, 3)


@query(LISTED.format(condition="(contains(lower(d.display_name), 'r_1') OR contains(lower(d.original_path), 'r_1'))", limit=40, offset=0))
def library_list_query(t: Tables) -> DataFrame:
    return library.library_list(t.documents, " R_1 ", 40, 0)


@query(
    """
SELECT k.document_id, k.name AS display_name, ocr_engine FROM known_names k JOIN lib_documents d USING (document_id)
WHERE deleted_at IS NULL AND contains(lower(concat_ws(' ', k.name, regexp_extract(k.original_path, '[^/]*$'), ocr_engine, ai_provider)), 'pdf tess')"""
)
def needle_filter(t: Tables) -> DataFrame:
    fields = ["display_name", "original_name", "ocr_engine", "ai_provider"]
    return library.needle_filter(library.library_view(t.documents), " PDF Tess", fields).select("document_id", "display_name", "ocr_engine")


@query(
    """
SELECT document_id, page_number, left(text, 1200) AS text, ocr_status, mean_confidence
FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS n FROM lib_pages) WHERE n <= 50"""
)
def document_preview(t: Tables) -> DataFrame:
    return library.document_preview(t.pages)


@query(
    r"""
SELECT page_id, document_id, length(regexp_replace(text, '\s', '', 'g')) AS text_chars,
  CASE WHEN length(regexp_replace(text, '\s', '', 'g')) > 20 THEN 'native_text' ELSE 'needs_ocr' END AS ocr_status,
  CASE WHEN page_id % 4 IN (1, 3) THEN 2200 ELSE 1700 END AS width_px, CASE WHEN page_id % 4 IN (1, 3) THEN 1700 ELSE 2200 END AS height_px
FROM lib_pages"""
)
def classify_pages(t: Tables) -> DataFrame:
    sized = t.pages.withColumns(
        {"width_pt": F.lit(612.0), "height_pt": F.lit(792.0), "rotation": (F.col("page_id") % 4).cast("int") * 90 - 360}
    )
    return library.classify_pages(sized, 200)


# ---- aggregates ------------------------------------------------------------------------------------------------------


@query(
    """
SELECT (SELECT count(*) FROM lib_documents WHERE status IN ('done', 'partial_success') AND deleted_at IS NULL) AS documents,
  (SELECT count(*) FROM lib_pages JOIN lib_documents USING (document_id) WHERE status IN ('done', 'partial_success') AND deleted_at IS NULL) AS pages,
  (SELECT count(*) FROM lib_chunks) AS chunks,
  (SELECT count(*) FROM lib_documents WHERE deleted_at IS NULL AND output_path IS NOT NULL) AS listed_documents"""
)
def corpus_counts(t: Tables) -> DataFrame:
    return library.corpus_counts(t.documents, t.pages, t.chunks)


ROLLUP = """
SELECT document_id, CASE WHEN count(*) FILTER (ocr_status = 'ocr_failed') > 0 THEN 'partial_success' ELSE 'done' END AS status,
  count(*) AS page_count, count(*) FILTER (ocr_status = 'ocr_failed') AS failed_pages,
  least(90.0::DOUBLE, count(ocr_status) / count(*) * 90.0::DOUBLE) AS progress_pct, round(avg(mean_confidence), 4) AS mean_confidence
FROM lib_pages GROUP BY document_id"""


@query(ROLLUP)
def document_rollup(t: Tables) -> DataFrame:
    return library.document_rollup(t.pages)


@query(
    f"""
WITH rollup AS ({ROLLUP}),
busy AS (SELECT DISTINCT document_id FROM lib_jobs WHERE status = 'running'),
joined AS (SELECT coalesce(ocr_engine, 'none') AS engine, r.mean_confidence < 60 AS low, b.document_id IS NOT NULL AND d.page_count = 0 AS scan
  FROM lib_documents d LEFT JOIN rollup r USING (document_id) LEFT JOIN busy b USING (document_id) WHERE deleted_at IS NULL)
SELECT engine, count(*) AS documents, count(*) FILTER (low) AS low_confidence, count(*) FILTER (scan) AS scan_like,
  count(*) FILTER (low) > 0 OR count(*) FILTER (scan) > 5 AS suggest_upgrade FROM joined GROUP BY engine"""
)
def quality_report(t: Tables) -> DataFrame:
    return library.quality_report(t.documents, library.document_rollup(t.pages), t.jobs)


# ---- intake ----------------------------------------------------------------------------------------------------------


@query("SELECT file_id, sha256 FROM incoming_files SEMI JOIN lib_documents USING (sha256)")
def known_content(t: Tables) -> DataFrame:
    return intake.known_content(t.incoming, t.documents, "watch").select("file_id", "sha256")


@query("SELECT file_id, sha256 FROM incoming_files ANTI JOIN (SELECT sha256 FROM lib_documents WHERE deleted_at IS NULL) USING (sha256)")
def unknown_content_interactive(t: Tables) -> DataFrame:
    return intake.known_content(t.incoming, t.documents, "interactive", known=False).select("file_id", "sha256")


TRIAGE = r"""
by_hash AS (SELECT sha256, min(document_id) AS existing_id FROM lib_documents WHERE deleted_at IS NULL GROUP BY sha256),
active AS (SELECT document_id, arg_max(job_id, (created_at, job_id)) AS active_job_id FROM lib_jobs
  WHERE status IN ('queued', 'running', 'paused') AND document_id IS NOT NULL GROUP BY document_id),
named AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\.pdf$', ''), ' \(v[0-9]+\)$', '') AS shown FROM incoming_files),
triaged AS (SELECT file_id, batch, CASE WHEN existing_id IS NOT NULL THEN 'content_duplicate' WHEN max_version IS NOT NULL THEN 'name_collision' ELSE 'new' END AS kind,
    existing_id, active_job_id, CASE WHEN existing_id IS NULL AND max_version IS NOT NULL THEN shown || ' (v' || (max_version + 1) || ').pdf' END AS suggested_name
  FROM named LEFT JOIN by_hash USING (sha256) LEFT JOIN active ON active.document_id = existing_id LEFT JOIN name_roots ON root = lower(shown))"""


@query(f"WITH {TRIAGE} SELECT file_id, kind, existing_id, active_job_id, suggested_name FROM triaged")
def duplicate_triage(t: Tables) -> DataFrame:
    return intake.duplicate_triage(t.incoming, t.documents, t.jobs)


@query(
    f"""WITH {TRIAGE} SELECT batch, count(*) AS total, count(*) FILTER (kind = 'new') AS added, count(*) FILTER (kind = 'name_collision') AS versioned,
  count(*) FILTER (kind = 'content_duplicate') AS duplicates FROM triaged GROUP BY batch"""
)
def triage_summary(t: Tables) -> DataFrame:
    triaged = intake.duplicate_triage(t.incoming, t.documents, t.jobs)
    # The batch of a file follows from its id, so the triage does not carry it.
    offset = F.when(F.col("file_id") >= 1_000_000_000, F.col("file_id") - 1_000_000_000).otherwise(F.col("file_id"))
    return intake.triage_summary(triaged.withColumn("batch", offset % 40))


@query("SELECT root, max_version, documents, max_version + 1 AS next_version FROM name_roots")
def next_versions(t: Tables) -> DataFrame:
    return intake.next_versions(t.documents)


FOLDERS = """
folders AS (SELECT DISTINCT regexp_extract(path, '^/watch/[^/]+') AS path, true AS recursive FROM file_listing
  UNION ALL SELECT DISTINCT regexp_extract(path, '^/watch/[^/]+/[^/]+'), false FROM file_listing)"""


@query(
    rf"""
WITH {FOLDERS}, good AS (SELECT path FROM file_listing WHERE lower(path) LIKE '%.pdf' AND NOT regexp_matches(path, '(?i)\.tmp\.pdf$'))
SELECT f.path, f.recursive, count(g.path) AS file_count FROM folders f
LEFT JOIN good g ON CASE WHEN f.recursive THEN starts_with(g.path, f.path || '/') ELSE regexp_replace(g.path, '/[^/]*$', '') = f.path END
GROUP BY f.path, f.recursive"""
)
def folder_counts(t: Tables) -> DataFrame:
    top = t.files.select(F.regexp_extract("path", "^/watch/[^/]+", 0).alias("path"), F.lit(True).alias("recursive")).distinct()
    second = t.files.select(F.regexp_extract("path", "^/watch/[^/]+/[^/]+", 0).alias("path"), F.lit(False).alias("recursive")).distinct()
    return intake.folder_counts(t.files, top.unionByName(second))


@query(
    r"""
SELECT user_id AS batch, path, min(event_id) AS position
FROM (SELECT user_id, event_id, '/drop/' || event_type || '_' || (event_id % 3) || CASE WHEN event_id % 4 = 0 THEN '.txt' WHEN event_id % 4 = 1 THEN '.PDF' ELSE '.pdf' END AS path FROM events)
WHERE lower(path) LIKE '%.pdf' GROUP BY user_id, path"""
)
def distinct_drops(t: Tables) -> DataFrame:
    i = F.col("event_id")
    ending = F.when(i % 4 == 0, ".txt").when(i % 4 == 1, ".PDF").otherwise(".pdf")
    path = F.concat(F.lit("/drop/"), "event_type", F.lit("_"), (i % 3).cast("string"), ending)
    return intake.distinct_drops(t.raw("events").select(F.col("user_id").alias("batch"), i.alias("position"), path.alias("path")))


STABLE = """
stable AS (SELECT path, listing_id, seen_at, coalesce(size = lag(size) OVER w AND mtime = lag(mtime) OVER w AND seen_at - lag(seen_at) OVER w >= 1000000, false) AS stable,
    lag(seen_at) OVER w IS NULL AS first_seen
  FROM path_listings WINDOW w AS (PARTITION BY path ORDER BY seen_at, listing_id))"""


@query(f"WITH {STABLE} SELECT path, listing_id, stable, first_seen FROM stable")
def stable_files(t: Tables) -> DataFrame:
    return intake.stable_files(t.listings).select("path", "listing_id", "stable", "first_seen")


@query(
    f"""
WITH {STABLE}, islands AS (SELECT *, count(*) FILTER (stable) OVER (PARTITION BY path ORDER BY seen_at, listing_id) AS island FROM stable)
SELECT path, listing_id, failures, failures >= 3 AS alert FROM (
  SELECT path, listing_id, count(*) FILTER (NOT stable) OVER (PARTITION BY path, island ORDER BY seen_at, listing_id) AS failures FROM islands)"""
)
def instability_streaks(t: Tables) -> DataFrame:
    return intake.instability_streaks(intake.stable_files(t.listings)).select("path", "listing_id", "failures", "alert")


ANCHORED = """
WITH RECURSIVE moments AS (SELECT DISTINCT user_id, event_type, epoch_us(ts) AS moment FROM events),
anchors AS (SELECT user_id, event_type, min(moment) AS moment FROM moments GROUP BY user_id, event_type
  UNION ALL
  SELECT a.user_id, a.event_type, min(m.moment) AS moment FROM anchors a JOIN moments m
    ON m.user_id = a.user_id AND m.event_type = a.event_type AND m.moment {op} a.moment + {window} GROUP BY a.user_id, a.event_type)
SELECT user_id, event_type, moment FROM anchors"""


@query(ANCHORED.format(op=">", window=3600000000))
def anchored_dedup(t: Tables) -> DataFrame:
    moments = t.raw("events").select("user_id", "event_type", tx.epoch_micros(F.col("ts")).alias("moment"))
    return intake.anchored_dedup(moments, ["user_id", "event_type"], "moment")


@query(ANCHORED.format(op=">=", window=1500000))
def anchored_dedup_inclusive(t: Tables) -> DataFrame:
    moments = t.raw("events").select("user_id", "event_type", tx.epoch_micros(F.col("ts")).alias("moment"))
    return intake.anchored_dedup(moments, ["user_id", "event_type"], "moment", intake.UI_DEDUP_MICROS, inclusive=True)


@query(
    """
WITH library AS (SELECT sha256, min(document_id) AS document_id FROM lib_documents GROUP BY sha256),
active AS (SELECT document_id, arg_max(job_id, (created_at, job_id)) AS active_job_id FROM lib_jobs
  WHERE status IN ('queued', 'running', 'paused') AND document_id IS NOT NULL GROUP BY document_id),
firsts AS (SELECT sha256, min(file_id) AS first_file_id FROM incoming_files GROUP BY sha256)
SELECT file_id, sha256, CASE WHEN active_job_id IS NOT NULL OR file_id <> first_file_id THEN 'reuse_job' WHEN l.document_id IS NOT NULL THEN 'reset_document'
    ELSE 'new_document' END AS action, l.document_id, active_job_id, first_file_id
FROM incoming_files JOIN firsts USING (sha256) LEFT JOIN library l USING (sha256) LEFT JOIN active a ON a.document_id = l.document_id"""
)
def enqueue_files(t: Tables) -> DataFrame:
    return intake.enqueue_files(t.incoming, t.documents, t.jobs)


# ---- names -----------------------------------------------------------------------------------------------------------

SAFE = r"""
CASE WHEN regexp_matches({0}, '^(con|prn|aux|nul|com[1-9]|lpt[1-9])($|[._-])') THEN 'doc_' || {0} ELSE {0} END"""


@query(
    rf"""
WITH cut AS (SELECT document_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '\.pdf$', ''), '[^a-z0-9_-]', '_', 'g'), '_+', '_', 'g') AS c,
    regexp_replace(regexp_replace(regexp_replace(regexp_extract(original_path, '[^/]*$'), '\.pdf$', ''), '[^a-z0-9_-]', '_', 'g'), '_+', '_', 'g') AS f
  FROM (SELECT d.document_id, d.original_path, CASE WHEN d.document_id % 31 = 0 THEN 'CON' WHEN d.document_id % 37 = 0 THEN '***' ELSE coalesce(d.display_name, '') END AS name FROM lib_documents d)),
edged AS (SELECT document_id, regexp_replace(left(regexp_replace(c, '^[_.-]+|[_.-]+$', '', 'g'), 80), '^[_.-]+|[_.-]+$', '', 'g') AS c, f FROM cut),
stems AS (SELECT document_id, CASE WHEN c <> '' THEN {SAFE.format("c")} ELSE f END AS stem FROM edged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY document_id) AS taker FROM stems),
blocked AS (SELECT regexp_extract(stem, '^(.+)_([0-9]+)$', 1) AS stem, list_distinct(list(regexp_extract(stem, '^(.+)_([0-9]+)$', 2)::INT)) AS numbers
  FROM (SELECT DISTINCT stem FROM stems) WHERE regexp_matches(stem, '^(.+)_([2-9]|[1-9][0-9][0-9]?)$') GROUP BY 1),
placed AS (SELECT document_id, r.stem, CASE WHEN numbers IS NULL THEN CASE WHEN taker <= 999 THEN taker END
    ELSE list_filter(range(1, 1000), lambda x: NOT list_contains(numbers, x::INT))[taker] END AS n FROM ranked r LEFT JOIN blocked USING (stem))
SELECT document_id, stem || CASE WHEN n = 1 THEN '' ELSE '_' || n END || '.pdf' AS file_name FROM placed"""
)
def normalize_names(t: Tables) -> DataFrame:
    i = F.col("document_id")
    name = F.when(i % 31 == 0, "CON").when(i % 37 == 0, "***").otherwise(F.coalesce("display_name", F.lit("")))
    return naming.normalize_names(t.documents.select("document_id", name.alias("name"), "original_path"))


@query(
    r"""
SELECT doc_id AS document_id,
  CASE doc_id % 4 WHEN 0 THEN 'meeting_' || doc_id || '.pdf' WHEN 1 THEN lang || '_' || (doc_id % 50) || '.pdf' WHEN 2 THEN 'doc_aux.pdf' ELSE lang || '_' || (doc_id % 50) || '.pdf' END AS proposed_name,
  CASE doc_id % 4 WHEN 0 THEN left(trim(regexp_replace(replace(text, '"', ''''), '\s+', ' ', 'g')), 500)
    WHEN 1 THEN 'The AI response could not be parsed safely, so the original filename is suggested.' ELSE 'No reliable summary was returned.' END AS summary
FROM documents"""
)
def naming_proposals(t: Tables) -> DataFrame:
    """Model replies built from the documents: fenced JSON, no JSON at all, and JSON without name or summary."""
    i, number = F.col("doc_id"), F.col("doc_id").cast("string")
    body = F.to_json(F.struct(F.concat(F.lit("Meeting "), number).alias("filename_base"), F.replace("text", F.lit('"'), F.lit("'")).alias("summary")))
    reply = (
        F.when(i % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(i % 4 == 1, F.concat(F.lit("Sorry, no name: "), F.left("text", F.lit(40))))
        .when(i % 4 == 2, F.lit('{"filename_base": "AUX", "summary": "  "}'))
        .otherwise(F.lit('{"filename_base": "---"}'))
    )
    original = F.concat("lang", F.lit("_"), (i % 50).cast("string"), F.lit(".pdf"))
    return naming.naming_proposals(t.raw("documents").select(i.alias("document_id"), original.alias("original_filename"), reply.alias("reply")))


@query(
    """
WITH whole AS (SELECT document_id, left(string_agg(text, chr(10) ORDER BY page_number), 4000) AS text FROM lib_pages GROUP BY document_id)
SELECT document_id, regexp_extract(original_path, '[^/]*$') AS original_filename,
  'Original filename: ' || regexp_extract(original_path, '[^/]*$') || chr(10) || chr(10) || 'Document text (truncated):' || chr(10) || text AS prompt, length(text) AS sample_chars
FROM lib_documents JOIN whole USING (document_id)"""
)
def naming_inputs(t: Tables) -> DataFrame:
    return naming.naming_inputs(t.pages, t.documents)


# What each kind of line must become, from its number alone; long text becomes its length.
REDACT = r"""
shown AS (SELECT file, line_no, line, regexp_extract(line, '^2024 [A-Z]+ ') AS head FROM log_lines),
redacted AS (SELECT file, line_no, CASE line_no % 6 WHEN 0 THEN head || 'model call ' || line_no || ' signed <API_KEY> accepted'
    WHEN 1 THEN head || 'stored page image page' || line_no || '.png in time'
    WHEN 2 THEN head || 'loaded engine' || line_no || '.bin'
    WHEN 3 THEN head || 'copied letter' || line_no || '.pdf'
    WHEN 4 THEN '<TEXT len=' || (length(head) + 240 + length(line_no::VARCHAR)) || '>'
    ELSE line END AS redacted FROM shown)"""


@query(f"WITH {REDACT} SELECT file, line_no, redacted FROM redacted")
def redact_log(t: Tables) -> DataFrame:
    return naming.redact_log(t.logs).select("file", "line_no", "redacted")


@query(
    """
SELECT count(*) FILTER (event_id % 6 = 0) AS api_keys, count(*) FILTER (event_id % 6 = 2) AS windows_paths,
  count(*) FILTER (event_id % 6 = 1) AS unix_paths, count(*) FILTER (event_id % 6 = 4) AS elided FROM events"""
)
def redaction_counts(t: Tables) -> DataFrame:
    return naming.redaction_counts(t.logs)


@query(
    """
SELECT file, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS n FROM log_lines WHERE contains(line, ' INFO ')) WHERE n <= 50"""
)
def log_tail(t: Tables) -> DataFrame:
    return naming.log_tail(t.logs, "info", 10)
