"""The document library: listing, filtering, replacing, deleting and counting."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions import text as tx
from foliary.functions.grouping import rank_up_to

# Fixed values.
SEARCHABLE = ("done", "partial_success")
RETRIEVABLE = ("done", "partial_success", "naming")
ENGINES = ("tesseract", "rapidocr")
NATIVE_TEXT_CHARS = 20
MAX_LISTED = 500
PREVIEW_PAGES = 50
PREVIEW_CHARS = 1200
OUTPUT_ATTEMPTS = 1000


def library_view(documents: DataFrame) -> DataFrame:
    """Live documents with the name a reader sees."""
    return documents.filter(F.col("deleted_at").isNull()).select(
        "document_id",
        tx.document_name(F.col("display_name"), F.col("original_path")).alias("display_name"),
        tx.basename(F.col("original_path")).alias("original_name"),
        "original_path",
        "output_path",
        "page_count",
        "ingested_at",
        "updated_at",
        "ocr_engine",
        "ai_provider",
        "status",
    )


def content_fingerprint(df: DataFrame, content: str) -> DataFrame:
    """SHA-256 of a content column, in full and in the two short forms used in logs and file names."""
    return (
        df.withColumn("sha256", F.sha2(F.col(content), 256))
        .withColumn("sha16", F.left("sha256", F.lit(16)))
        .withColumn("sha8", F.left("sha256", F.lit(8)))
    )


# ---- predicates ----------------------------------------------------------------------------------------------------


def visible_documents(documents: DataFrame, mode: str = "search") -> DataFrame:
    """Documents a search (or a retrieval, which also admits those being named) may show."""
    if mode not in ("search", "retrieval"):
        raise ValueError(f"unknown visibility mode: {mode}")
    statuses = SEARCHABLE if mode == "search" else RETRIEVABLE
    return documents.filter(F.col("status").isin(*statuses) & F.col("deleted_at").isNull())


def checked_engine(engine: str | None) -> str | None:
    engine = (engine or "").strip()
    if engine and engine not in ENGINES:
        raise ValueError(f"invalid OCR engine filter: {engine}")
    return engine or None


def day_bounds(date_from: str | None, date_to: str | None) -> tuple[int | None, int | None]:
    """First and last second of the given days (UTC) as epoch seconds."""

    def epoch(day: str | None, time: str) -> int | None:
        return int(datetime.fromisoformat(f"{day}T{time}").replace(tzinfo=timezone.utc).timestamp()) if day else None

    return epoch(date_from, "00:00:00"), epoch(date_to, "23:59:59")


def scope_filter(
    documents: DataFrame,
    document_ids: Sequence[int] | DataFrame | None = None,
    date_from: int | None = None,
    date_to: int | None = None,
    engine: str | None = None,
) -> DataFrame:
    """Restrict to given ids, an inclusive ingest range and one engine; an absent parameter restricts nothing.

    Ids that are not positive are dropped, and a list that is empty after that means no restriction. Ids may also
    come as a table, which becomes a semi-join.
    """
    if isinstance(document_ids, DataFrame):
        documents = documents.join(document_ids.select("document_id"), "document_id", "left_semi")
    elif wanted := [i for i in document_ids or () if i > 0]:
        documents = documents.filter(F.col("document_id").isin(wanted))
    if date_from is not None:
        documents = documents.filter(F.col("ingested_at") >= date_from)
    if date_to is not None:
        documents = documents.filter(F.col("ingested_at") <= date_to)
    if engine := checked_engine(engine):
        documents = documents.filter(F.col("ocr_engine") == engine)
    return documents


def _like_regex(pattern: str) -> str:
    """Regular expression equal to a LIKE pattern whose escape character is the backslash."""
    out, position = [], 0
    while position < len(pattern):
        char = pattern[position]
        if char == "\\" and position + 1 < len(pattern):
            position += 1
            out.append("\\Q" + pattern[position] + "\\E")
        else:
            out.append({"%": ".*", "_": "."}.get(char, "\\Q" + char + "\\E"))
        position += 1
    return "(?s)^" + "".join(out) + "$"


def _ascii_lower(value: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in value)


def library_list(documents: DataFrame, query: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest documents first. With a query: a substring of display name or path, where case matters only beyond ASCII.
    Without one: documents that have an output file."""
    needle = (query or "").strip()
    live = documents.filter(F.col("deleted_at").isNull())
    if needle:
        escaped = needle.replace("%", r"\%").replace("_", r"\_")
        regex = _like_regex("%" + _ascii_lower(escaped) + "%")
        matches = [F.coalesce(tx.ascii_lower(F.col(c)).rlike(regex), F.lit(False)) for c in ("display_name", "original_path")]
        live = live.filter(matches[0] | matches[1])
    else:
        live = live.filter(F.col("output_path").isNotNull())
    page = live.orderBy(F.desc("ingested_at"), F.desc("document_id")).offset(offset).limit(max(1, min(limit, MAX_LISTED)))
    return library_view(page)


def needle_filter(rows: DataFrame, needle: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose joined fields hold the needle, without regard to case."""
    wanted = needle.strip().lower()
    if not wanted:
        return rows
    present = [F.when(F.col(c) != "", F.col(c)) for c in columns]
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *present)), F.lit(wanted)))


def document_preview(pages: DataFrame) -> DataFrame:
    """The first pages of every document in page order, each cut to a preview.

    Pages of a document are numbered without repeats, so the filter on the rank bounds what one document sends."""
    from pyspark.sql.window import Window as W

    ranked = pages.withColumn("rank", F.row_number().over(W.partitionBy("document_id").orderBy("page_number")))
    return ranked.filter(F.col("rank") <= PREVIEW_PAGES).select(
        "document_id",
        "page_number",
        F.substring("text", 1, PREVIEW_CHARS).alias("text"),
        "ocr_status",
        "mean_confidence",
    )


def rendered_size(width_pt: Column, height_pt: Column, rotation: Column, dpi: int) -> tuple[Column, Column]:
    """Pixel size of a page rendered at ``dpi``; a quarter turn swaps the sides."""
    turned = F.pmod(rotation, F.lit(360)).isin(90, 270)
    sides = (F.when(turned, height_pt).otherwise(width_pt), F.when(turned, width_pt).otherwise(height_pt))
    width, height = (F.greatest(F.round(side / 72.0 * dpi), F.lit(1.0)).cast("bigint") for side in sides)
    return width, height


def classify_pages(pages: DataFrame, dpi: int = 200) -> DataFrame:
    """Decide per page whether its own text is dense enough or recognition is needed, and the size to render at."""
    width, height = rendered_size(F.col("width_pt"), F.col("height_pt"), F.col("rotation"), dpi)
    density = F.length(F.regexp_replace("text", f"[{tx.WHITESPACE}]+", "")).cast("bigint")
    return pages.select(
        "page_id",
        "document_id",
        density.alias("text_chars"),
        F.when(density > NATIVE_TEXT_CHARS, "native_text").otherwise("needs_ocr").alias("ocr_status"),
        width.alias("width_px"),
        height.alias("height_px"),
    )


# ---- changes ---------------------------------------------------------------------------------------------------------


def upsert_by_key(
    current: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), order: str | None = None
) -> DataFrame:
    """Insert new rows, and for known keys take the incoming values except in the ``keep`` columns.

    With ``order``, several incoming rows of one key collapse to the latest one before the join."""
    values = [c for c in current.columns if c not in keys]
    if order is not None:
        latest = incoming.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("__row"))
        incoming = latest.select(*keys, "__row.*")
    old = current.select(*keys, F.struct(*values).alias("__old"))
    new = incoming.select(*keys, F.struct(*values).alias("__new"))
    joined = old.join(new, list(keys), "full_outer")

    def pick(column: str) -> Column:
        first, second = ("__old", "__new") if column in keep else ("__new", "__old")
        return F.when(F.col(first).isNotNull(), F.col(first)[column]).otherwise(F.col(second)[column]).alias(column)

    return joined.select(*keys, *[pick(c) for c in values])


def replace_document_rows(current: DataFrame, incoming: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """Child rows after the given documents were rewritten.

    ``replaced`` lists the rewritten documents; it defaults to those with incoming rows, but a document that now has
    no rows at all must be listed to lose its old ones."""
    touched = (replaced if replaced is not None else incoming).select("document_id").distinct()
    return current.join(touched, "document_id", "left_anti").select(*current.columns).unionByName(incoming.select(*current.columns))


def delete_documents(
    documents: DataFrame, ids: DataFrame, children: dict[str, DataFrame] | None = None, force: bool = False, now: int = 0
) -> dict[str, DataFrame]:
    """Soft delete stamps the documents; a forced one removes them and every child row, vectors included.

    Children are tables with a ``document_id``; a table keyed only by ``chunk_id`` follows the ``chunks`` table."""
    ids = ids.select("document_id").distinct()
    children = dict(children or {})
    if not force:
        hit = ids.withColumn("__hit", F.lit(True))
        stamped = documents.join(hit, "document_id", "left")
        for column in ("deleted_at", "updated_at"):
            stamped = stamped.withColumn(column, F.when(F.col("__hit"), F.lit(now)).otherwise(F.col(column)).cast("bigint"))
        return {"documents": stamped.select(*documents.columns), **children}
    result = {"documents": documents.join(ids, "document_id", "left_anti")}
    for name, table in children.items():
        if "document_id" in table.columns:
            result[name] = table.join(ids, "document_id", "left_anti")
        else:
            gone = children["chunks"].join(ids, "document_id", "left_semi").select("chunk_id")
            result[name] = table.join(gone, "chunk_id", "left_anti")
    return result


def assign_output_names(documents: DataFrame) -> DataFrame:
    """Output file name per document: safe stem, short hash, and a number from the second taker of a name on.

    A name that is still taken after the last attempt stays NULL, which is the reference point for an error."""
    stem = F.regexp_replace(tx.file_stem(tx.basename(F.col("original_path"))), r'[<>:"/\\|?*\p{Cc}]', "_")
    stem = F.regexp_replace(F.substring(stem, 1, 80), r"^[ .]+|[ .]+$", "")
    named = documents.select(
        "document_id",
        F.concat(F.when(stem != "", stem).otherwise("document"), F.lit("-"), F.left("sha256", F.lit(8))).alias("base"),
    )
    ranked = rank_up_to(named, ["base"], "document_id", OUTPUT_ATTEMPTS, "taker")
    number = F.when(F.col("taker") == 1, F.lit("")).otherwise(F.concat(F.lit("-"), (F.col("taker") - 1).cast("string")))
    return ranked.select("document_id", F.concat("base", number, F.lit("-searchable.pdf")).alias("output_name"))


# ---- aggregates ------------------------------------------------------------------------------------------------------


def corpus_counts(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: visible documents, their pages, all chunks, documents shown in the library."""
    visible = visible_documents(documents)
    listed = F.count_if(F.col("deleted_at").isNull() & F.col("output_path").isNotNull())
    shown = F.count_if(F.col("deleted_at").isNull() & F.col("status").isin(*SEARCHABLE))
    visible_pages = pages.join(visible.select("document_id"), "document_id", "left_semi")
    return documents.agg(shown.alias("documents"), listed.alias("listed_documents")).select(
        "documents",
        visible_pages.agg(F.count(F.lit(1)).alias("n")).scalar().alias("pages"),
        chunks.agg(F.count(F.lit(1)).alias("n")).scalar().alias("chunks"),
        "listed_documents",
    )


def document_rollup(pages: DataFrame) -> DataFrame:
    """Status, page count, failures and progress of every document from its pages."""
    failed = F.count_if(F.col("ocr_status") == "ocr_failed")
    completed = F.count_if(F.col("ocr_status").isNotNull())
    total = F.count(F.lit(1))
    progress = F.least(F.greatest(completed / total * 90.0, F.lit(0.0)), F.lit(90.0))
    return pages.groupBy("document_id").agg(
        F.when(failed > 0, "partial_success").otherwise("done").alias("status"),
        total.alias("page_count"),
        failed.alias("failed_pages"),
        F.round(progress, 4).alias("progress_pct"),
        F.round(F.avg("mean_confidence"), 4).alias("mean_confidence"),
    )


def quality_report(documents: DataFrame, rollup: DataFrame, jobs: DataFrame, low_confidence: float = 60.0) -> DataFrame:
    """Per engine: documents below the confidence threshold, running scan-like documents, and whether to suggest a
    better engine (any of the former, or more than five of the latter)."""
    running = jobs.filter(F.col("status") == "running").groupBy("document_id").agg(F.lit(True).alias("is_running"))
    joined = (
        documents.filter(F.col("deleted_at").isNull())
        .select("document_id", F.coalesce("ocr_engine", F.lit("none")).alias("engine"), "page_count")
        .join(rollup.select("document_id", "mean_confidence"), "document_id", "left")
        .join(running, "document_id", "left")
    )
    low = F.count_if(F.col("mean_confidence") < low_confidence)
    scans = F.count_if(F.col("is_running") & (F.coalesce("page_count", F.lit(0)) == 0))
    return joined.groupBy("engine").agg(
        F.count(F.lit(1)).alias("documents"),
        low.alias("low_confidence"),
        scans.alias("scan_like"),
        ((low > 0) | (scans > 5)).alias("suggest_upgrade"),
    )


def state_dump(documents: DataFrame, jobs: DataFrame, newest: int = 500) -> DataFrame:
    """Diagnostics: the newest documents and jobs, jobs grouped under their document, with the total counts.

    Both sides are cut to ``newest`` rows first, so the groups stay small whatever the size of the tables."""
    count = F.count(F.lit(1)).alias("n")
    recent_docs = (
        documents.orderBy(F.desc("ingested_at"), F.desc("document_id"))
        .limit(newest)
        .select("document_id", F.left("sha256", F.lit(16)).alias("sha16"), "status")
    )
    recent_jobs = jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(newest)
    grouped = recent_jobs.groupBy("document_id").agg(
        count.alias("jobs"),
        F.array_join(F.transform(F.sort_array(F.collect_list("job_id"), asc=False), lambda x: x.cast("string")), ",").alias("job_ids"),
    )
    matched = recent_docs["document_id"] == grouped["document_id"]
    return recent_docs.join(grouped, matched, "full_outer").select(
        F.coalesce(recent_docs["document_id"], grouped["document_id"]).alias("document_id"),
        "sha16",
        "status",
        F.coalesce("jobs", F.lit(0)).cast("bigint").alias("jobs"),
        F.coalesce("job_ids", F.lit("")).alias("job_ids"),
        documents.agg(count).scalar().alias("documents_count"),
        jobs.agg(count).scalar().alias("jobs_count"),
    )
