"""Registered queries of chunking, vectors, hybrid retrieval, citations and threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.operators import chunking, retrieval, vectors
from foliary.plans.registry import query
from foliary.plans.search import matching
from foliary.plans.tables import Tables


def _skip(text: str, at: str) -> str:
    """SQL: first position at or after ``at`` that is not white space."""
    return rf"({at} + length(substr({text}, {at} + 1)) - length(regexp_replace(substr({text}, {at} + 1), '^\s+', '')))"


def _last(mark: str, size: int) -> str:
    """SQL: position of the last delimiter of the window, when it is far enough in."""
    place = f"2048 - strpos(reverse(substr(text, b + 1, 2048)), {mark}) - {size} + 1"
    return f"CASE WHEN strpos(reverse(substr(text, b + 1, 2048)), {mark}) > 0 AND {place} > 256 THEN b + {place} END"


SPLIT = f"CASE WHEN b + 2048 >= n THEN n ELSE coalesce({_last('chr(10) || chr(10)', 2)}, {_last('chr(10)', 1)}, {_last(chr(39) + ' ' + chr(39), 1)}, b + 2048) END"
CHUNKS = rf"""
WITH RECURSIVE texts AS (SELECT page_id, document_id, text, length(text) AS n FROM lib_pages WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20),
cuts AS (SELECT page_id, {_skip("text", "0")} AS b FROM texts
  UNION ALL
  SELECT page_id, nb FROM (SELECT page_id, n, CASE WHEN again > b THEN again ELSE after END AS nb FROM (
    SELECT page_id, b, n, {_skip("text", "greatest(s - 256, 0)")} AS again, {_skip("text", "s")} AS after FROM (
      SELECT page_id, b, n, text, {SPLIT} AS s FROM cuts JOIN texts USING (page_id)) WHERE s < n)) WHERE nb < n),
pieces AS (SELECT page_id, document_id, text, b, {SPLIT} AS s FROM cuts JOIN texts USING (page_id)),
edges AS (SELECT page_id, document_id, text, {_skip("text", "b")} AS l, b + length(regexp_replace(substr(text, b + 1, s - b), '\s+$', '')) AS r FROM pieces)
SELECT document_id, page_id, row_number() OVER (PARTITION BY page_id ORDER BY l) - 1 AS chunk_no, l AS char_start, r AS char_end,
  ceil((r - l) / 4.0)::BIGINT AS token_count, substr(text, l + 1, r - l) AS text FROM edges WHERE r > l"""


@query(CHUNKS)
def chunk_documents(t: Tables) -> DataFrame:
    return chunking.chunk_documents(t.pages)


@query(
    """
SELECT vec_id AS chunk_id, unnest(range(len(embedding))) AS dim, round(unnest(list_transform(embedding, lambda x: x::DOUBLE))
  / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS value FROM embeddings"""
)
def normalize_vectors(t: Tables) -> DataFrame:
    unit = vectors.normalize_vectors(t.vectors, 64)
    cells = unit.select("chunk_id", F.posexplode("embedding").alias("dim", "value"))
    return cells.select("chunk_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 4).alias("value"))


@query(
    """
WITH buckets AS (SELECT row_id AS chunk_id, ('0x' || left(md5(term), 8))::BIGINT % 64 AS dim, count(*) AS n
  FROM (SELECT row_id, unnest(tokens) AS term FROM chunk_tokens) GROUP BY 1, 2)
SELECT chunk_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)), 4) AS value FROM buckets"""
)
def embed_chunks(t: Tables) -> DataFrame:
    embedded = vectors.embed_chunks(t.chunks, dim=64)
    cells = embedded.select("chunk_id", F.posexplode("embedding").alias("dim", "value")).filter(F.col("value") > 0)
    return cells.select("chunk_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 4).alias("value"))


@query(
    """
SELECT c.chunk_id, c.document_id, c.page_id, page_number, name AS document_name, c.text
FROM lib_chunks c JOIN lib_pages p ON p.page_id = c.page_id JOIN known_names k ON k.document_id = c.document_id"""
)
def chunk_metadata(t: Tables) -> DataFrame:
    return retrieval.chunk_metadata(t.vectors.select("chunk_id"), t.chunks, t.pages, t.documents)


NEAREST = """
distances AS (SELECT query_id, vec_id AS chunk_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance FROM question_table q, embeddings e),
admitted AS (SELECT chunk_id FROM lib_chunks JOIN lib_documents USING (document_id) WHERE status IN ('done', 'partial_success', 'naming') AND deleted_at IS NULL),
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS n FROM distances) WHERE n <= 20),
vec AS (SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM nearest SEMI JOIN admitted USING (chunk_id))"""


@query(f"WITH {NEAREST} SELECT query_id, chunk_id, distance, rank FROM vec")
def knn_join(t: Tables) -> DataFrame:
    return vectors.knn_join(t.questions, t.vectors, 20, retrieval.admitted_chunks(t.chunks, t.documents))


@query(
    f"""
WITH {NEAREST} SELECT query_id, chunk_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
  FROM distances SEMI JOIN admitted USING (chunk_id)) WHERE rank <= 20"""
)
def knn_join_prefiltered(t: Tables) -> DataFrame:
    return vectors.knn_join(t.questions, t.vectors, 20, retrieval.admitted_chunks(t.chunks, t.documents), "pre")


LEXICAL = f"""
{matching("chunk_tokens", "question_table")},
lex AS (SELECT query_id, chunk_id, bm25_score, rank FROM (
  SELECT query_id, row_id AS chunk_id, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score, row_id) AS rank
  FROM matched JOIN lib_documents USING (document_id) WHERE status IN ('done', 'partial_success', 'naming') AND deleted_at IS NULL) WHERE rank <= 20)"""
UNITED = f"""{LEXICAL}, {NEAREST},
united AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.chunk_id, v.chunk_id) AS chunk_id, bm25_score AS fts_score, l.rank AS fts_rank,
    1.0::DOUBLE / (1.0 + distance) AS vec_score, v.rank AS vec_rank FROM lex l FULL JOIN vec v ON l.query_id = v.query_id AND l.chunk_id = v.chunk_id)"""
FUSED = f"""{UNITED},
scored AS (SELECT *, round(coalesce(0.4::DOUBLE / (60 + fts_rank), 0) + coalesce(0.6::DOUBLE / (60 + vec_rank), 0), 8) AS combined_score FROM united),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 8)"""
RETRIEVED = f"""{FUSED},
retrieved AS (SELECT query_id, rank, chunk_id, fts_score, round(vec_score, 4) AS vec_score, combined_score, c.document_id, c.page_id, page_number, name AS document_name, c.text
  FROM fused JOIN lib_chunks c USING (chunk_id) JOIN lib_pages p ON p.page_id = c.page_id JOIN known_names k ON k.document_id = c.document_id)"""


def _lexical(t: Tables) -> DataFrame:
    return retrieval.lexical_candidates(t.questions, t.chunk_index, t.documents, 20)


def _united(t: Tables) -> DataFrame:
    return retrieval.candidate_union(_lexical(t), knn_join(t))


def _retrieved(t: Tables) -> DataFrame:
    return retrieval.hybrid_retrieve(t.questions, t.chunk_index, t.vectors, t.chunks, t.pages, t.documents)


@query(f"WITH {LEXICAL} SELECT * FROM lex")
def topk_per_query(t: Tables) -> DataFrame:
    return _lexical(t)


@query(f"WITH {UNITED} SELECT query_id, chunk_id, fts_score, fts_rank, round(vec_score, 4) AS vec_score, vec_rank FROM united")
def candidate_union(t: Tables) -> DataFrame:
    return _united(t).withColumn("vec_score", F.round("vec_score", 4))


@query(f"WITH {FUSED} SELECT query_id, rank, chunk_id, combined_score FROM fused")
def rrf_fuse(t: Tables) -> DataFrame:
    return retrieval.rrf_fuse(_united(t)).select("query_id", "rank", "chunk_id", "combined_score")


@query(f"WITH {RETRIEVED} SELECT * FROM retrieved")
def hybrid_retrieve(t: Tables) -> DataFrame:
    return _retrieved(t).withColumn("vec_score", F.round("vec_score", 4))


SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _excerpt(column: str, limit: int) -> str:
    flat = SQUEEZED.format(column)
    return f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE left({flat}, {limit}) || '…' END"


# Every benchmark text is a question here; those without a vector find nothing.
@query(
    f"""
WITH {RETRIEVED}, lines AS (SELECT query_id, rank, '[' || rank || '] ' || document_name || ', page ' || page_number || ': ' || {_excerpt("text", 1800)} AS line FROM retrieved)
SELECT b.item_id AS query_id, count(line) AS excerpts, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS context,
  CASE WHEN count(line) = 0 THEN 'I couldn''t find that in your library.' END AS answer
FROM (SELECT item_id FROM benchmark UNION ALL SELECT item_id + 1000000 FROM benchmark) b LEFT JOIN lines ON query_id = b.item_id GROUP BY b.item_id"""
)
def prompt_context(t: Tables) -> DataFrame:
    asked = t.raw("benchmark").select(F.col("item_id").alias("query_id"))
    asked = asked.unionByName(asked.select((F.col("query_id") + 1000000).alias("query_id")))
    return retrieval.prompt_context(asked, _retrieved(t))


GROUNDED = f"""{RETRIEVED}, limits AS (SELECT query_id, count(*) AS most FROM retrieved GROUP BY query_id),
answers AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id AS query_id, text, turn + 1 AS a, conv_id % 12 AS b, coalesce(most, 0) AS most
  FROM conversations LEFT JOIN limits ON query_id = conv_id WHERE role <> 'user')"""


def _grounded(t: Tables) -> DataFrame:
    replies = t.messages.filter(F.col("role") != "user")
    answers = replies.select((F.col("thread_id") * 1000 + F.col("turn")).alias("answer_id"), F.col("thread_id").alias("query_id"), F.col("content").alias("answer"))
    return retrieval.ground_citations(answers, _retrieved(t))


@query(
    f"""
WITH {GROUNDED} SELECT answer_id, query_id, text || ' ' || CASE WHEN a <= most THEN '[' || a || ']' ELSE '[?]' END || ' ' || CASE WHEN b BETWEEN 1 AND most THEN '[' || b || ']' ELSE '[?]' END
    || ' ' || CASE WHEN a <= most THEN '[' || a || ']' ELSE '[?]' END AS content,
  CASE WHEN a <= most THEN 1 ELSE 0 END + CASE WHEN b BETWEEN 1 AND most AND b <> a THEN 1 ELSE 0 END AS citations,
  CASE WHEN a <= most THEN 0 ELSE 2 END + CASE WHEN b BETWEEN 1 AND most THEN 0 ELSE 1 END AS rejected FROM answers"""
)
def ground_citations(t: Tables) -> DataFrame:
    return _grounded(t).withColumn("citations", F.size("citations").cast("bigint"))


@query(
    f"""
WITH {GROUNDED}, refs AS (SELECT answer_id, query_id, 0 AS position, a AS index FROM answers WHERE a <= most
  UNION ALL SELECT answer_id, query_id, CASE WHEN a <= most THEN 1 ELSE 0 END, b FROM answers WHERE b BETWEEN 1 AND most AND b <> a)
SELECT answer_id, position, index, chunk_id, page_id, document_id FROM refs r JOIN retrieved x ON x.query_id = r.query_id AND x.rank = r.index"""
)
def ground_citations_refs(t: Tables) -> DataFrame:
    refs = _grounded(t).select("answer_id", F.posexplode("citations").alias("position", "ref"))
    return refs.select("answer_id", F.col("position").cast("bigint").alias("position"), "ref.*")


@query(
    f"""
WITH refs AS (SELECT conv_id AS thread_id, turn, unnest([0, 1, 2]) AS position, unnest([1, 2, 3]) AS index, unnest([conv_id, conv_id * 2 + turn, conv_id + 1000000]) AS chunk_id
  FROM conversations WHERE role <> 'user' AND conv_id % 10 <> 0)
SELECT thread_id, turn, position, index, r.chunk_id, c.document_id, c.page_id, page_number, name AS document_name, {_excerpt("c.text", 700)} AS excerpt
FROM refs r JOIN lib_chunks c ON c.chunk_id = r.chunk_id JOIN lib_pages p ON p.page_id = c.page_id JOIN known_names k ON k.document_id = c.document_id"""
)
def enrich_citations(t: Tables) -> DataFrame:
    return retrieval.enrich_citations(t.messages, t.chunks, t.pages, t.documents)


@query(
    f"""
WITH threads AS (SELECT thread_id, arg_min(content, (created_at, turn)) FILTER (role = 'user') AS first_message, count(*) AS messages,
    min(created_at) AS created_at, max(created_at) AS updated_at FROM lib_messages GROUP BY thread_id)
SELECT thread_id, CASE WHEN {SQUEEZED.format("coalesce(first_message, '')")} = '' THEN 'New thread' ELSE {_excerpt("first_message", 64)} END AS title,
  {_excerpt("first_message", 90)} AS preview, messages, created_at, updated_at FROM threads ORDER BY updated_at DESC, thread_id DESC LIMIT 100"""
)
def thread_list(t: Tables) -> DataFrame:
    return retrieval.thread_list(t.messages)
