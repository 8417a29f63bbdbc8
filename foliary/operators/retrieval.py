"""Hybrid retrieval, prompt context, citations and conversation threads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliary.functions import text as tx
from foliary.operators.library import visible_documents
from foliary.operators.search import Index, matches
from foliary.operators.vectors import knn_join, topk_per_query
from foliary.sources import schemas

# Fixed values.
RRF_K = 60.0
CONTEXT_CHARS = 1800
CITATION_CHARS = 700
PREVIEW_CHARS = 90
TITLE_CHARS = 64
MAX_THREADS = 100
NOT_FOUND = "I couldn't find that in your library."
FUSED_DIGITS = 8


@dataclass(frozen=True)
class RetrievalConfig:
    """Depths and weights of the two branches (fixed values)."""

    top_k_fts: int = 20
    top_k_vec: int = 20
    top_k_final: int = 8
    fts_weight: float = 0.4
    vec_weight: float = 0.6


def admitted_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of documents a retrieval may use."""
    return chunks.join(visible_documents(documents, "retrieval").select("document_id"), "document_id", "left_semi").select("chunk_id")


def chunk_metadata(ids: DataFrame, chunks: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Place and document name of the chunks named by ``chunk_id`` in ``ids`` (other columns of ``ids`` stay)."""
    names = documents.select("document_id", tx.document_name(F.col("display_name"), F.col("original_path")).alias("document_name"))
    return (
        ids.join(chunks.select("chunk_id", "document_id", "page_id", "text"), "chunk_id")
        .join(pages.select("page_id", "page_number"), "page_id")
        .join(names, "document_id")
        .select(*ids.columns, "document_id", "page_id", "page_number", "document_name", "text")
    )


def candidate_union(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """One row per query and chunk from both ranked lists, with the score and rank of each source."""
    no_rank, no_score = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    left = lexical.select(
        "query_id", "chunk_id", F.col("bm25_score").alias("fts_score"), F.col("rank").alias("fts_rank"), no_score.alias("vec_score"), no_rank.alias("vec_rank")
    )
    closeness = 1.0 / (1.0 + F.greatest("distance", F.lit(0.0)))
    right = vector.select(
        "query_id", "chunk_id", no_score.alias("fts_score"), no_rank.alias("fts_rank"), closeness.alias("vec_score"), F.col("rank").alias("vec_rank")
    )
    parts = ("fts_score", "fts_rank", "vec_score", "vec_rank")
    return left.unionByName(right).groupBy("query_id", "chunk_id").agg(*[F.max(c).alias(c) for c in parts])


def rrf_fuse(candidates: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Weighted reciprocal-rank fusion, best ``top_k_final`` per query; equal scores go by chunk id."""
    lexical = F.coalesce(config.fts_weight / (RRF_K + F.col("fts_rank")), F.lit(0.0))
    vector = F.coalesce(config.vec_weight / (RRF_K + F.col("vec_rank")), F.lit(0.0))
    fused = candidates.withColumn("combined_score", F.round(lexical + vector, FUSED_DIGITS))
    return topk_per_query(fused, config.top_k_final, [F.desc("combined_score"), "chunk_id"])


def lexical_candidates(questions: DataFrame, index: Index, documents: DataFrame, k: int) -> DataFrame:
    """Best ``k`` chunks per question by BM25; the visibility filter comes before the cut."""
    visible = visible_documents(documents, "retrieval").select("document_id")
    found = matches(questions, index).join(visible, "document_id", "left_semi")
    return topk_per_query(found.select("query_id", F.col("row_id").alias("chunk_id"), "bm25_score"), k, ["bm25_score", "chunk_id"])


def hybrid_retrieve(
    questions: DataFrame,
    index: Index,
    vectors: DataFrame,
    chunks: DataFrame,
    pages: DataFrame,
    documents: DataFrame,
    config: RetrievalConfig = RetrievalConfig(),
    filter_mode: str = "post",
) -> DataFrame:
    """Answer a table of questions (``query_id, q, embedding``): both branches, fused, with chunk metadata.

    ``documents`` may already be narrowed by :func:`foliary.operators.library.scope_filter`. A question without search
    terms has only vector hits."""
    lexical = lexical_candidates(questions, index, documents, config.top_k_fts)
    vector = knn_join(questions, vectors, config.top_k_vec, admitted_chunks(chunks, documents), filter_mode)
    fused = rrf_fuse(candidate_union(lexical, vector), config)
    return chunk_metadata(fused.select("query_id", "rank", "chunk_id", "fts_score", "vec_score", "combined_score"), chunks, pages, documents)


def prompt_context(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Numbered excerpts per question, or the fixed not-found answer. Groups hold at most ``top_k_final`` rows."""
    line = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), "document_name", F.lit(", page "), F.col("page_number").cast("string"),
        F.lit(": "), tx.excerpt(F.col("text"), CONTEXT_CHARS),
    )
    lines = retrieved.select("query_id", "rank", line.alias("line")).groupBy("query_id")
    joined = lines.agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    return questions.select("query_id").join(joined, "query_id", "left").select(
        "query_id",
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("excerpts"),
        F.array_join(F.transform("lines", lambda part: part["line"]), "\n\n").alias("context"),
        F.when(F.col("lines").isNull(), NOT_FOUND).alias("answer"),
    )


MARKER = r"\[(\d{1,4})\]"


def ground_citations(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Check the ``[n]`` markers of each answer (``answer_id, query_id, answer``) against what was retrieved.

    A marker outside 1..max becomes ``[?]``; valid ones are listed once, in the order first seen, with their chunks."""
    available = retrieved.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("max_index"),
        F.map_from_entries(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.struct("chunk_id", "page_id", "document_id")))).alias("by_rank"),
    )
    maximum = F.coalesce("max_index", F.lit(0))
    marks = F.transform(F.regexp_extract_all("answer", F.lit(MARKER), F.lit(1)), lambda digits: digits.cast("int"))
    joined = answers.join(available, "query_id", "left").withColumn("marks", marks)
    valid = F.filter("marks", lambda n: (n > 0) & (n <= maximum))
    gaps = F.split("answer", MARKER)

    def rewritten(gap, position):
        number = F.col("marks")[position - 1]
        shown = F.when((number > 0) & (number <= maximum), F.concat(F.lit("["), number.cast("string"), F.lit("]"))).otherwise("[?]")
        return F.when(position == 0, gap).otherwise(F.concat(shown, gap))

    refs = F.transform(
        F.array_distinct(valid),
        lambda n: F.struct(
            n.cast("bigint").alias("index"),
            F.col("by_rank")[n]["chunk_id"].alias("chunk_id"),
            F.col("by_rank")[n]["page_id"].alias("page_id"),
            F.col("by_rank")[n]["document_id"].alias("document_id"),
        ),
    )
    return joined.select(
        "answer_id",
        "query_id",
        F.array_join(F.transform(gaps, rewritten), "").alias("content"),
        refs.alias("citations"),
        (F.size("marks") - F.size(valid)).cast("bigint").alias("rejected"),
    )


def parse_citation_refs(citations):
    """Citations stored as JSON text; text that does not parse gives an empty list."""
    return F.coalesce(F.from_json(citations, schemas.CITATION_REFS), F.array().cast(schemas.CITATION_REFS))


def enrich_citations(messages: DataFrame, chunks: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The citations of every message (``thread_id, turn, citations`` as JSON) with name, page and excerpt.

    References to chunks that no longer exist drop out. One row per citation, numbered as in the message."""
    refs = messages.select("thread_id", "turn", F.posexplode(parse_citation_refs(F.col("citations"))).alias("position", "ref"))
    named = refs.select("thread_id", "turn", F.col("position").cast("bigint").alias("position"), F.col("ref.index").alias("index"), F.col("ref.chunk_id").alias("chunk_id"))
    return chunk_metadata(named, chunks, pages, documents).withColumn("text", tx.excerpt(F.col("text"), CITATION_CHARS)).withColumnRenamed("text", "excerpt")


def thread_list(messages: DataFrame) -> DataFrame:
    """The most recently updated threads with a title and a preview from their first user message.

    Both come from one aggregate per thread that combines on the map side."""
    asked = F.col("role") == "user"
    first = F.min_by(F.when(asked, F.col("content")), F.when(asked, F.struct("created_at", "turn")))
    threads = messages.groupBy("thread_id").agg(
        first.alias("first_message"),
        F.count(F.lit(1)).alias("messages"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
    )
    title = tx.excerpt(F.coalesce("first_message", F.lit("")), TITLE_CHARS)
    return (
        threads.orderBy(F.desc("updated_at"), F.desc("thread_id"))
        .limit(MAX_THREADS)
        .select(
            "thread_id",
            F.when(title != "", title).otherwise("New thread").alias("title"),
            tx.excerpt(F.col("first_message"), PREVIEW_CHARS).alias("preview"),
            "messages",
            "created_at",
            "updated_at",
        )
    )
