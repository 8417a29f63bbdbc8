"""Explicit schemas of the library tables as DDL text, for readers and for JSON. Nothing is inferred."""

DOCUMENTS = (
    "document_id bigint, sha256 string, original_path string, output_path string, display_name string, "
    "page_count bigint, ocr_engine string, ai_provider string, status string, ingested_at bigint, "
    "updated_at bigint, deleted_at bigint"
)
PAGES = "page_id bigint, document_id bigint, page_number bigint, text string, ocr_status string, mean_confidence double"
CHUNKS = (
    "chunk_id bigint, document_id bigint, page_id bigint, char_start bigint, char_end bigint, token_count bigint, text string"
)
VECTORS = "chunk_id bigint, embedding array<float>"
JOBS = (
    "job_id bigint, document_id bigint, kind string, status string, error_message string, started_at bigint, "
    "finished_at bigint, created_at bigint, origin string, engine string, progress_pct double"
)
FILE_LISTING = "path string, size bigint, mtime bigint, seen_at bigint"
QUERIES = (
    "query_id bigint, q string, sort string, lim bigint, off bigint, date_from bigint, date_to bigint, engine string"
)
MESSAGES = "thread_id bigint, turn bigint, role string, content string, citations string, created_at bigint"
WORDS = (
    "page_id bigint, block bigint, line bigint, word bigint, text string, `left` bigint, top bigint, `right` bigint, "
    "bottom bigint, confidence double"
)
CITATION_REFS = "array<struct<index:bigint,chunk_id:bigint,page_id:bigint,document_id:bigint>>"
SAVED_QUERY = "q string, limit bigint, offset bigint, dateFrom bigint, dateTo bigint, engine string, sort string"
MODEL_REPLY = "filename_base string, summary string"
