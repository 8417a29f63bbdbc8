"""The library's logical tables over the given Parquet tables, for Spark and as SQL for the oracle.

Every derivation is deterministic and row-local, so it adds no shuffle and grows with its input.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions import text as tx
from foliary.operators import search
from foliary.operators.chunking import chunk_documents
from foliary.session import read_table

PAGE_LINES = 4

# Searches of one session share the index of a folder: it is a stored table, written once.
_STORED: dict[tuple[str, str, str], search.Index] = {}


def _cases(column, names: list[str]):
    expr = F.lit(names[-1])
    for number in range(len(names) - 2, -1, -1):
        expr = F.when(column == number, names[number]).otherwise(expr)
    return expr


def list_files(pages: DataFrame, content: str | None = None) -> DataFrame:
    """A file listing: page addresses as paths below a watched folder, with the extensions a scan meets."""
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", "/watch/"), "[?#].*$", "")
    bare = F.regexp_replace(bare, "/$", "")
    ending = _cases(F.col("page_id") % 6, [".pdf", ".PDF", ".tmp.pdf", ".txt", ".pdf.part", ".pdf"])
    extra = [F.col(content).alias("content")] if content else []
    return pages.select(F.concat(bare, ending).alias("path"), F.length("html").cast("bigint").alias("size"), "page_id", *extra)


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        """Library documents. Columns that no query asks for (such as the hash) are pruned away."""
        d = self.raw("documents")
        i = F.col("doc_id")
        name = F.concat("lang", F.lit("_"), (i % 50).cast("string"), F.lit(".pdf"))
        path = F.concat(F.lit("/in/"), "source", F.lit("/"), name)
        versioned = F.when(i % 11 == 0, F.replace(name, F.lit(".pdf"), F.lit(" (v2).pdf"))).otherwise(name)
        shown = F.when(i % 7 == 0, F.lit(None)).when(i % 7 == 1, F.lit("  ")).otherwise(versioned)
        status = i % 10
        ingested = F.lit(1704067200) + (i * 7919) % 2592000
        return d.select(
            i.alias("document_id"),
            F.sha2("text", 256).alias("sha256"),
            path.alias("original_path"),
            F.when(i % 13 != 0, F.concat(F.lit("/out/"), name)).alias("output_path"),
            shown.alias("display_name"),
            F.when(i % 19 == 0, 0)
            .otherwise(F.floor((F.size(F.split("text", "\n")) + PAGE_LINES - 1) / PAGE_LINES))
            .cast("bigint")
            .alias("page_count"),
            F.when(i % 3 == 0, "tesseract").when(i % 3 == 1, "rapidocr").alias("ocr_engine"),
            F.when(i % 2 == 0, "none").alias("ai_provider"),
            F.when(status <= 6, "done").when(status == 7, "partial_success").when(status == 8, "naming").otherwise("error").alias("status"),
            ingested.cast("bigint").alias("ingested_at"),
            (ingested + 60).cast("bigint").alias("updated_at"),
            F.when(i % 23 == 0, ingested + 3600).cast("bigint").alias("deleted_at"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        """Document text in pages of a few lines. The lines are grouped inside the row, without a shuffle."""
        lines = F.split("text", "\n")
        count = F.floor((F.size(lines) + PAGE_LINES - 1) / PAGE_LINES).cast("int")
        pages = F.transform(F.sequence(F.lit(0), count - 1), lambda n: F.array_join(F.slice(lines, n * PAGE_LINES + 1, F.lit(PAGE_LINES)), "\n"))
        cut = self.raw("documents").select("doc_id", F.posexplode(pages).alias("n", "text"))
        number = (F.col("n") + 1).cast("bigint")
        page_id = F.col("doc_id") * 100000 + number
        status = F.when(page_id % 29 == 0, "ocr_failed").when(page_id % 3 == 0, "ocr_done").otherwise("native_text")
        return cut.select(
            page_id.alias("page_id"),
            F.col("doc_id").alias("document_id"),
            number.alias("page_number"),
            "text",
            status.alias("ocr_status"),
            F.when(status == "ocr_done", (page_id * 7 % 1000) / 10.0).alias("mean_confidence"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        e = self.raw("events")
        i, kind = F.col("event_id"), F.col("event_type")
        status = F.when(kind == "click", "done").when(kind == "view", "running").when(kind == "purchase", "queued").when(kind == "error", "error").otherwise("cancelled")
        message = _cases(
            i % 4,
            ["HTTP 429 from provider", "Ollama not reachable: connection refused", "RapidOCR models missing", "disk full"],
        )
        created = tx.epoch_seconds(F.col("ts"))
        return e.select(
            i.alias("job_id"),
            F.when(i % 17 != 0, F.col("user_id")).alias("document_id"),
            F.when(i % 5 == 0, "embed").otherwise("ingest").alias("kind"),
            status.alias("status"),
            F.when(kind == "error", message).alias("error_message"),
            F.when(i % 9 == 0, F.lit(None)).when(i % 2 == 0, "watch").otherwise("manual").alias("origin"),
            F.when(i % 3 == 0, "tesseract").alias("engine"),
            created.alias("created_at"),
            F.when(kind.isin("click", "view", "error"), created + 2).alias("started_at"),
            F.when(kind.isin("click", "error", "signup"), created + 60).alias("finished_at"),
            F.least("value", F.lit(100.0)).alias("progress_pct"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")

    @cached_property
    def chunks(self) -> DataFrame:
        """One chunk per vector: the whole text of the document with that number, on its first page."""
        docs = self.raw("documents").select(F.col("doc_id").alias("chunk_id"), "text")
        return self.vectors.select("chunk_id").join(docs, "chunk_id").select(
            "chunk_id",
            F.col("chunk_id").alias("document_id"),
            (F.col("chunk_id") * 100000 + 1).alias("page_id"),
            F.lit(0).cast("bigint").alias("char_start"),
            F.length("text").cast("bigint").alias("char_end"),
            F.ceil(F.length("text") / 4).cast("bigint").alias("token_count"),
            "text",
        )

    @cached_property
    def cut_chunks(self) -> DataFrame:
        """Chunks that the chunker itself cuts from the pages."""
        cut = chunk_documents(self.pages)
        return cut.withColumn("chunk_id", F.col("page_id") * 1000 + F.col("chunk_no"))

    @cached_property
    def queries(self) -> DataFrame:
        """Two searches per benchmark text: its first three words, and its first two words as a phrase with the third."""
        words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
        w = [F.coalesce(F.get(words, F.lit(n)), F.lit("")) for n in range(3)]
        i = F.col("item_id")
        both = F.array(
            F.concat_ws(" ", *w), F.concat(F.lit('"'), w[0], F.lit(" "), w[1], F.lit('" '), w[2])
        )
        cut = self.raw("benchmark").select("item_id", F.posexplode(both).alias("form", "q"))
        return cut.select(
            (i * 2 + F.col("form")).cast("bigint").alias("query_id"),
            "q",
            _cases(i % 3, ["relevance", "newestFirst", "oldestFirst"]).alias("sort"),
            _cases(i % 4, ["0", "5", "20", "500"]).cast("bigint").alias("lim"),
            (i % 3).cast("bigint").alias("off"),
            F.when(i % 5 == 0, 1704500000).cast("bigint").alias("date_from"),
            F.when(i % 6 == 0, 1706000000).cast("bigint").alias("date_to"),
            F.when(i % 8 == 3, "tesseract").when(i % 8 == 5, "rapidocr").alias("engine"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        """Benchmark texts as questions: the first two words as search terms (every seventh has none), with a vector."""
        words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
        text = F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))
        vectors = self.raw("embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
        return self.raw("benchmark").join(vectors, "item_id").select(
            F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 7 == 6, "...").otherwise(text).alias("q"), "embedding"
        )

    @cached_property
    def messages(self) -> DataFrame:
        """Conversation turns. Assistant turns carry citation markers and stored citations, some of them bad."""
        c, t = F.col("conv_id"), F.col("turn")
        asks = F.col("role") == "user"
        marked = F.concat("text", F.lit(" ["), (t + 1).cast("string"), F.lit("] ["), (c % 12).cast("string"), F.lit("] ["), (t + 1).cast("string"), F.lit("]"))
        ref = lambda n, chunk: F.struct(
            F.lit(n).cast("bigint").alias("index"), chunk.alias("chunk_id"), (chunk * 100000 + 1).alias("page_id"), chunk.alias("document_id")
        )
        stored = F.to_json(F.array(ref(1, c), ref(2, c * 2 + t), ref(3, c + 1000000)))
        return self.raw("conversations").select(
            c.alias("thread_id"),
            t.alias("turn"),
            "role",
            F.when(asks, F.col("text")).otherwise(marked).alias("content"),
            F.when(~asks, F.when(c % 10 == 0, "{not json").otherwise(stored)).alias("citations"),
            (F.lit(1704067200) + (c * 5003) % 2000000 + t).cast("bigint").alias("created_at"),
        )

    @cached_property
    def files(self) -> DataFrame:
        return list_files(self.raw("pages"))

    @cached_property
    def listings(self) -> DataFrame:
        """Successive listings of files: one path per user, whose size changes with the kind of event."""
        e = self.raw("events")
        size = F.when(F.col("event_type").isin("click", "view", "signup"), 100).otherwise(200)
        return e.select(
            F.concat(F.lit("/watch/user_"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("path"),
            F.col("event_id").alias("listing_id"),
            size.cast("bigint").alias("size"),
            F.floor(F.col("value") / 20).cast("bigint").alias("mtime"),
            tx.epoch_micros(F.col("ts")).alias("seen_at"),
        )

    @cached_property
    def incoming(self) -> DataFrame:
        """Files to take in: every document again under its own name, and every web page under a name of its language."""
        docs = self.raw("documents").select(
            F.col("doc_id").alias("file_id"),
            F.concat(F.lit("/drop/"), "lang", F.lit("_"), (F.col("doc_id") % 50).cast("string"), F.lit(".pdf")).alias("path"),
            F.sha2("text", 256).alias("sha256"),
            (F.col("doc_id") % 40).alias("batch"),
        )
        language = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1)
        web = self.raw("pages").select(
            (F.lit(1_000_000_000) + F.col("page_id")).alias("file_id"),
            F.concat(F.lit("/drop/"), F.upper(language), F.lit("_"), (F.col("page_id") % 80).cast("string"), F.lit(" (v3).pdf")).alias("path"),
            F.sha2("html", 256).alias("sha256"),
            (F.col("page_id") % 40).alias("batch"),
        )
        return docs.unionByName(web)

    @cached_property
    def logs(self) -> DataFrame:
        """Log lines, one file per user, with keys, paths and long text in some of them."""
        e = self.raw("events")
        i = F.col("event_id")
        level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
        number = i.cast("string")
        text = (
            F.when(i % 6 == 0, F.concat(F.lit("model call "), number, F.lit(" signed sk-ant-demo_"), number, F.lit(" accepted")))
            .when(i % 6 == 1, F.concat(F.lit("stored page image /srv/scans/batch/page"), number, F.lit(".png in time")))
            .when(i % 6 == 2, F.concat(F.lit("loaded \\\\?\\D:\\Tools\\ocr\\engine"), number, F.lit(".bin")))
            .when(i % 6 == 3, F.concat(F.lit("copied \\\\nas\\archive\\letter"), number, F.lit(".pdf")))
            .when(i % 6 == 4, F.concat(F.repeat(F.lit("lorem folio "), 20), number))
            .otherwise(F.concat(F.lit("quota "), number, F.lit(" of sk-few tokens, props "), "props"))
        )
        return e.select(
            F.concat(F.lit("app-"), F.col("user_id").cast("string"), F.lit(".log")).alias("file"),
            i.alias("line_no"),
            F.concat(F.lit("2024 "), level, F.lit(" "), text).alias("line"),
        )

    def _stored(self, kind: str, rows: DataFrame, row_id: str) -> search.Index:
        key = (self.spark.sparkContext.applicationId, self.folder, kind)
        if key not in _STORED:
            _STORED[key] = search.store_index(search.build_index(rows, row_id))
        return _STORED[key]

    @property
    def page_index(self) -> search.Index:
        return self._stored("pages", self.pages, "page_id")

    @property
    def chunk_index(self) -> search.Index:
        # Documents that have a vector may lie together in a few files, so they are spread before their texts are cut. Dealt by the id
        # itself they would count as spread by their join, which Spark may yet turn into a broadcast where they lie.
        spread = self.chunks.repartition(F.xxhash64("chunk_id")).sortWithinPartitions("chunk_id")
        return self._stored("chunks", spread, "chunk_id")


# The same tables as SQL. Later entries may use earlier ones.
COMMON_TABLES: dict[str, str] = {
    "lib_documents": r"""
SELECT doc_id AS document_id, sha256(text) AS sha256, '/in/' || source || '/' || name AS original_path,
  CASE WHEN doc_id % 13 <> 0 THEN '/out/' || name END AS output_path,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN '  '
       WHEN doc_id % 11 = 0 THEN replace(name, '.pdf', ' (v2).pdf') ELSE name END AS display_name,
  CASE WHEN doc_id % 19 = 0 THEN 0 ELSE (len(string_split(text, chr(10))) + 3) // 4 END::BIGINT AS page_count,
  CASE doc_id % 3 WHEN 0 THEN 'tesseract' WHEN 1 THEN 'rapidocr' END AS ocr_engine,
  CASE WHEN doc_id % 2 = 0 THEN 'none' END AS ai_provider,
  CASE WHEN doc_id % 10 <= 6 THEN 'done' WHEN doc_id % 10 = 7 THEN 'partial_success' WHEN doc_id % 10 = 8 THEN 'naming' ELSE 'error' END AS status,
  (1704067200 + (doc_id * 7919) % 2592000)::BIGINT AS ingested_at,
  (1704067260 + (doc_id * 7919) % 2592000)::BIGINT AS updated_at,
  CASE WHEN doc_id % 23 = 0 THEN 1704070800 + (doc_id * 7919) % 2592000 END::BIGINT AS deleted_at
FROM (SELECT *, lang || '_' || (doc_id % 50) || '.pdf' AS name FROM documents)""",
    "lib_pages": r"""
SELECT page_id, document_id, page_number, text, ocr_status,
  CASE WHEN ocr_status = 'ocr_done' THEN (page_id * 7 % 1000) / 10.0::DOUBLE END AS mean_confidence
FROM (SELECT doc_id * 100000 + n + 1 AS page_id, doc_id AS document_id, n + 1 AS page_number,
        array_to_string(lines[4 * n + 1 : 4 * n + 4], chr(10)) AS text,
        CASE WHEN (doc_id * 100000 + n + 1) % 29 = 0 THEN 'ocr_failed' WHEN (doc_id * 100000 + n + 1) % 3 = 0 THEN 'ocr_done'
             ELSE 'native_text' END AS ocr_status
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range((len(string_split(text, chr(10))) + 3) // 4)) AS n FROM documents))""",
    "lib_jobs": r"""
SELECT event_id AS job_id, CASE WHEN event_id % 17 <> 0 THEN user_id END AS document_id,
  CASE WHEN event_id % 5 = 0 THEN 'embed' ELSE 'ingest' END AS kind,
  CASE event_type WHEN 'click' THEN 'done' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'queued' WHEN 'error' THEN 'error' ELSE 'cancelled' END AS status,
  CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'HTTP 429 from provider'
    WHEN 1 THEN 'Ollama not reachable: connection refused' WHEN 2 THEN 'RapidOCR models missing' ELSE 'disk full' END END AS error_message,
  CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'watch' ELSE 'manual' END AS origin,
  CASE WHEN event_id % 3 = 0 THEN 'tesseract' END AS engine,
  epoch_us(ts) // 1000000 AS created_at, CASE WHEN event_type IN ('click', 'view', 'error') THEN epoch_us(ts) // 1000000 + 2 END AS started_at,
  CASE WHEN event_type IN ('click', 'error', 'signup') THEN epoch_us(ts) // 1000000 + 60 END AS finished_at, least(value, 100.0::DOUBLE) AS progress_pct
FROM events""",
    "lib_chunks": r"""
SELECT vec_id AS chunk_id, vec_id AS document_id, vec_id * 100000 + 1 AS page_id, text
FROM embeddings JOIN documents ON doc_id = vec_id""",
    "query_table": r"""
SELECT item_id * 2 + form AS query_id,
  CASE form WHEN 0 THEN concat_ws(' ', coalesce(w[1], ''), coalesce(w[2], ''), coalesce(w[3], ''))
    ELSE '"' || coalesce(w[1], '') || ' ' || coalesce(w[2], '') || '" ' || coalesce(w[3], '') END AS q,
  CASE form WHEN 0 THEN list_filter([lower(w[1]), lower(w[2]), lower(w[3])], lambda x: x IS NOT NULL)
    ELSE list_filter([lower(concat_ws(' ', w[1], w[2])), lower(w[3])], lambda x: x IS NOT NULL AND x <> '') END AS phrases,
  CASE item_id % 3 WHEN 0 THEN 'relevance' WHEN 1 THEN 'newestFirst' ELSE 'oldestFirst' END AS sort,
  CASE item_id % 4 WHEN 0 THEN 50 WHEN 1 THEN 5 WHEN 2 THEN 20 ELSE 200 END AS lim, item_id % 3 AS off,
  CASE WHEN item_id % 5 = 0 THEN 1704500000 END AS date_from, CASE WHEN item_id % 6 = 0 THEN 1706000000 END AS date_to,
  CASE item_id % 8 WHEN 3 THEN 'tesseract' WHEN 5 THEN 'rapidocr' END AS engine
FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w, unnest([0, 1]) AS form FROM benchmark)""",
    "question_table": r"""
SELECT item_id AS query_id, embedding,
  CASE WHEN item_id % 7 = 6 THEN [] ELSE list_filter([lower(w[1]), lower(w[2])], lambda x: x IS NOT NULL) END AS phrases
FROM (SELECT item_id, embedding, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark JOIN embeddings ON item_id = vec_id)""",
    "lib_messages": r"""
SELECT conv_id AS thread_id, turn, role,
  CASE WHEN role = 'user' THEN text ELSE text || ' [' || (turn + 1) || '] [' || (conv_id % 12) || '] [' || (turn + 1) || ']' END AS content,
  1704067200 + (conv_id * 5003) % 2000000 + turn AS created_at
FROM conversations""",
    "file_listing": r"""
SELECT regexp_replace(regexp_replace(regexp_replace(url, '^https?://', '/watch/'), '[?#].*$', ''), '/$', '')
  || CASE page_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.tmp.pdf' WHEN 3 THEN '.txt' WHEN 4 THEN '.pdf.part' ELSE '.pdf' END AS path,
  length(html) AS size, page_id
FROM pages""",
    "path_listings": r"""
SELECT '/watch/user_' || user_id || '.pdf' AS path, event_id AS listing_id,
  CASE WHEN event_type IN ('click', 'view', 'signup') THEN 100 ELSE 200 END AS size, floor(value / 20)::BIGINT AS mtime, epoch_us(ts) AS seen_at
FROM events""",
    "incoming_files": r"""
SELECT doc_id AS file_id, '/drop/' || lang || '_' || (doc_id % 50) || '.pdf' AS path, sha256(text) AS sha256, doc_id % 40 AS batch FROM documents
UNION ALL
SELECT 1000000000 + page_id, '/drop/' || upper(regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1)) || '_' || (page_id % 80) || ' (v3).pdf', sha256(html), page_id % 40 FROM pages""",
    "log_lines": r"""
SELECT 'app-' || user_id || '.log' AS file, event_id AS line_no,
  '2024 ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END || ' ' ||
  CASE event_id % 6 WHEN 0 THEN 'model call ' || event_id || ' signed sk-ant-demo_' || event_id || ' accepted'
    WHEN 1 THEN 'stored page image /srv/scans/batch/page' || event_id || '.png in time'
    WHEN 2 THEN 'loaded \\?\D:\Tools\ocr\engine' || event_id || '.bin'
    WHEN 3 THEN 'copied \\nas\archive\letter' || event_id || '.pdf'
    WHEN 4 THEN repeat('lorem folio ', 20) || event_id
    ELSE 'quota ' || event_id || ' of sk-few tokens, props ' || props END AS line
FROM events""",
    "known_names": r"""
SELECT document_id, display_name, original_path,
  coalesce(CASE WHEN trim(display_name) <> '' THEN display_name END, regexp_extract(original_path, '[^/]*$')) AS name FROM lib_documents""",
    "name_roots": r"""
SELECT lower(regexp_replace(stem, '^(.*) \(v([0-9]+)\)$', '\1')) AS root, max(coalesce(try_cast(regexp_extract(stem, '^(.*) \(v([0-9]+)\)$', 2) AS BIGINT), 1)) AS max_version, count(*) AS documents
FROM (SELECT regexp_replace(k.name, '^(.+)\.[^.]*$', '\1') AS stem FROM known_names k JOIN lib_documents d USING (document_id) WHERE d.deleted_at IS NULL)
GROUP BY 1""",
    "page_tokens": r"""
SELECT page_id AS row_id, document_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS tokens FROM lib_pages""",
    "chunk_tokens": r"""
SELECT chunk_id AS row_id, document_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS tokens FROM lib_chunks""",
}
