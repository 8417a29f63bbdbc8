"""Registered queries of full-text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.operators import highlight, search
from foliary.plans.registry import query
from foliary.plans.tables import Tables


def matching(tokens: str, queries: str) -> str:
    """SQL of BM25 matching: rows of ``tokens`` that hold every phrase of each query of ``queries``."""
    return f"""
lens AS (SELECT row_id, document_id, len(tokens) AS row_len FROM {tokens}),
corpus AS (SELECT count(*) AS n_rows, sum(row_len) / count(*) AS avg_len FROM lens),
postings AS (SELECT row_id, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM {tokens}),
asked AS (SELECT query_id, len(phrases) AS n_phrases, unnest(phrases) AS phrase FROM {queries}),
words AS (SELECT phrase, len(string_split(phrase, ' ')) AS n_words, unnest(string_split(phrase, ' ')) AS term,
    unnest(range(len(string_split(phrase, ' ')))) AS shift FROM (SELECT DISTINCT phrase FROM asked)),
runs AS (SELECT phrase, row_id, pos - shift AS begin_at FROM words JOIN postings USING (term) GROUP BY phrase, n_words, row_id, pos - shift HAVING count(*) = n_words),
hits AS (SELECT phrase, row_id, count(*) AS f FROM runs GROUP BY phrase, row_id),
weights AS (SELECT phrase, CASE WHEN ln((n_rows - count(*) + 0.5) / (count(*) + 0.5)) > 0 THEN ln((n_rows - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf
  FROM hits, corpus GROUP BY phrase, n_rows),
matched AS (SELECT query_id, row_id, document_id, 0.0::DOUBLE - round(sum(idf * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * row_len / avg_len))), 8) AS bm25_score
  FROM asked JOIN hits USING (phrase) JOIN weights USING (phrase) JOIN lens USING (row_id), corpus
  GROUP BY query_id, n_phrases, row_id, document_id HAVING count(*) = n_phrases)"""


SEARCH = f"""
{matching("page_tokens", "query_table")},
ranked AS (SELECT m.*, d.ingested_at, d.ocr_engine, q.lim, q.off, count(*) OVER (PARTITION BY m.query_id) AS total_hits,
    row_number() OVER (PARTITION BY m.query_id ORDER BY CASE q.sort WHEN 'newestFirst' THEN -d.ingested_at WHEN 'oldestFirst' THEN d.ingested_at ELSE 0 END, bm25_score, row_id) AS rank
  FROM matched m JOIN lib_documents d USING (document_id) JOIN query_table q USING (query_id)
  WHERE d.status IN ('done', 'partial_success') AND d.deleted_at IS NULL AND (q.date_from IS NULL OR d.ingested_at >= q.date_from)
    AND (q.date_to IS NULL OR d.ingested_at <= q.date_to) AND (q.engine IS NULL OR d.ocr_engine = q.engine)),
found AS (SELECT query_id, rank, total_hits, r.document_id, k.name AS display_name, row_id AS page_id, page_number, bm25_score, ingested_at, ocr_engine
  FROM ranked r JOIN lib_pages p ON p.page_id = r.row_id JOIN known_names k ON k.document_id = r.document_id WHERE rank > off AND rank <= off + lim)"""


def _search(t: Tables) -> DataFrame:
    return search.search(t.queries, t.page_index, t.pages, t.documents)


@query(
    """
SELECT unnest(tokens) AS term, row_id, document_id, len(tokens) AS row_len, unnest(range(len(tokens))) AS position FROM page_tokens"""
)
def build_index(t: Tables) -> DataFrame:
    return search.build_index(t.pages).postings.withColumn("position", F.col("position").cast("bigint"))


@query(
    """
WITH postings AS (SELECT row_id, unnest(tokens) AS term FROM page_tokens),
corpus AS (SELECT count(*) AS n_rows, round(sum(len(tokens)) / count(*), 4) AS avg_len FROM page_tokens)
SELECT term, count(DISTINCT row_id) AS df, count(*) AS occurrences, n_rows, avg_len FROM postings, corpus GROUP BY term, n_rows, avg_len"""
)
def term_stats(t: Tables) -> DataFrame:
    return search.term_stats(t.page_index)


@query(
    """
SELECT query_id, '"' || array_to_string(CASE WHEN query_id % 2 = 0 THEN string_split(q, ' ')
  ELSE list_filter([replace(regexp_extract(q, '"(.*)"', 1), '"', ''), trim(regexp_replace(q, '".*"', ''))], lambda x: x <> '') END, '" "') || '"' AS match_expr,
  NULL::VARCHAR AS warning, NULL::VARCHAR AS error FROM query_table"""
)
def match_expressions(t: Tables) -> DataFrame:
    return search.match_expressions(t.queries).select("query_id", "match_expr", "warning", "error")


@query(f"WITH {SEARCH} SELECT * FROM found", name="search")
def search_pages(t: Tables) -> DataFrame:
    return _search(t)


@query(
    f"""
WITH {SEARCH}, targets AS (SELECT query_id, arg_min(document_id, rank) AS document_id FROM found GROUP BY query_id)
SELECT query_id, rank, document_id, page_id, page_number, bm25_score FROM (
  SELECT m.query_id, m.document_id, m.row_id AS page_id, page_number, bm25_score, row_number() OVER (PARTITION BY m.query_id ORDER BY page_number) AS rank
  FROM matched m JOIN targets USING (query_id, document_id) JOIN lib_pages p ON p.page_id = m.row_id) WHERE rank <= 100"""
)
def search_in_document(t: Tables) -> DataFrame:
    """Each search again, inside the document of its best hit."""
    best = _search(t).groupBy("query_id").agg(F.min_by("document_id", "rank").alias("document_id"))
    return search.search_in_document(t.queries.join(best, "query_id"), t.page_index, t.pages, t.documents)


@query(
    f"""
WITH {SEARCH}, groups AS (SELECT query_id, document_id, display_name, min(rank) AS first_rank, count(*) AS hits,
  string_agg(page_number::VARCHAR, ',' ORDER BY rank) AS page_numbers FROM found GROUP BY query_id, document_id, display_name)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS group_no FROM groups"""
)
def group_hits(t: Tables) -> DataFrame:
    return search.group_hits(_search(t))


@query(f"WITH {SEARCH} SELECT query_id, rank, total_hits, row_id AS page_id, bm25_score FROM ranked WHERE rank > off AND rank <= off + lim")
def page_hits(t: Tables) -> DataFrame:
    found = search.scoped(search.matches(t.queries, t.page_index), t.queries, t.documents)
    page = search.page_hits(found, t.queries)
    return page.select("query_id", "rank", "total_hits", F.col("row_id").alias("page_id"), "bm25_score")


@query(f"WITH {SEARCH} SELECT * FROM found", name="run_saved_searches")
def saved_searches(t: Tables) -> DataFrame:
    """The query table written out as JSON, as saved searches are stored."""
    body = F.struct(
        "q", F.col("lim").alias("limit"), F.col("off").alias("offset"), F.col("date_from").alias("dateFrom"), F.col("date_to").alias("dateTo"), "engine", "sort"
    )
    saved = t.queries.select("query_id", F.to_json(body).alias("query"))
    return search.run_saved_searches(saved, t.page_index, t.pages, t.documents)


# Without look-around, word boundaries are made visible first: chr(1) on both sides of every run of other characters.
BOUNDED = r"chr(1) || regexp_replace({0}, '([^\p{{L}}\p{{N}}]+)', chr(1) || '\1' || chr(1), 'g') || chr(1)"


def _escaped(text: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        text = f"replace({text}, '{raw}', '{entity}')"
    return f"replace(replace(replace({text}, chr(1), ''), chr(2), '<mark>'), chr(3), '</mark>')"


# The window rule of snippets, one step per table: tokens with the text before them, phrase occurrences, sentence starts,
# the worth of a window at each occurrence and at the start of its sentence, the best window, its marks, its text.
WINDOWED = r"[\p{L}\p{N}]+"
SNIPPETS = rf"""
WITH {SEARCH},
texts AS (SELECT page_id, regexp_extract_all(text, '{WINDOWED}') AS words, string_split_regex(text, '{WINDOWED}') AS gaps FROM lib_pages SEMI JOIN found USING (page_id)),
shown AS (SELECT query_id, page_id, len(words) AS n, words, gaps, list_transform(words, lambda w: lower(strip_accents(w))) AS keys, phrases
  FROM found JOIN texts USING (page_id) JOIN query_table USING (query_id)),
wanted AS (SELECT query_id, page_id, n, keys, unnest(phrases) AS phrase, unnest(range(len(phrases))) AS number FROM shown),
places AS (SELECT query_id, page_id, n, keys, number, string_split(phrase, ' ') AS parts, unnest(range(n)) AS pos FROM wanted),
marks AS (SELECT query_id, page_id, n, number, pos, len(parts) AS size FROM places WHERE keys[pos + 1 : pos + len(parts)] = parts),
sentences AS (SELECT query_id, page_id, p AS pos FROM (SELECT query_id, page_id, gaps, unnest(range(n)) AS p FROM shown) WHERE p = 0 OR regexp_matches(gaps[p + 1], '[.:][ \t\r\n]+$')),
starts AS (SELECT m.query_id, m.page_id, m.number, m.pos, m.n, m.pos AS open, 0 AS form, 0 AS bonus FROM marks m
  UNION ALL
  SELECT m.query_id, m.page_id, m.number, m.pos, m.n, max(s.pos), 1, CASE WHEN max(s.pos) = 0 THEN 120 ELSE 100 END
  FROM marks m JOIN sentences s ON s.query_id = m.query_id AND s.page_id = m.page_id AND s.pos <= m.pos WHERE m.n > 16
  GROUP BY m.query_id, m.page_id, m.number, m.pos, m.n HAVING max(s.pos) < m.pos),
worth AS (SELECT s.query_id, s.page_id, s.number, s.pos, s.n, s.open, s.form, s.bonus + count(DISTINCT m.number) * 999 + count(*) AS score, min(m.pos) AS first, arg_max(m.pos + m.size, (m.pos, m.number)) AS last
  FROM starts s JOIN marks m ON m.query_id = s.query_id AND m.page_id = s.page_id AND m.pos >= s.open AND m.pos < s.open + 16
  GROUP BY s.query_id, s.page_id, s.number, s.pos, s.n, s.open, s.form, s.bonus),
windows AS (SELECT *, CASE WHEN form = 1 THEN open ELSE greatest(least(first - trunc((16 - (last - first)) / 2.0)::BIGINT, n - 16), 0) END AS begin_at FROM worth),
best AS (SELECT query_id, page_id, begin_at FROM (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY score DESC, pos, number, form) AS r FROM windows) WHERE r = 1),
reach AS (SELECT *, max(pos + size - 1) OVER (PARTITION BY query_id, page_id ORDER BY pos, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM marks),
islands AS (SELECT *, count(*) FILTER (before IS NULL OR pos > before) OVER (PARTITION BY query_id, page_id ORDER BY pos, number) AS island FROM reach),
spans AS (SELECT query_id, page_id, min(pos) AS first, max(pos + size - 1) AS last FROM islands GROUP BY query_id, page_id, island),
kept AS (SELECT query_id, page_id, list(first) AS opens, list(least(last, begin_at + 15)) AS closes FROM spans JOIN best USING (query_id, page_id) WHERE first BETWEEN begin_at AND begin_at + 15 GROUP BY query_id, page_id),
tokens AS (SELECT s.query_id, s.page_id, n, begin_at, gaps, unnest(range(begin_at, least(begin_at + 16, n))) AS p, words, opens, closes
  FROM shown s JOIN best USING (query_id, page_id) LEFT JOIN kept USING (query_id, page_id)),
pieces AS (SELECT query_id, page_id, n, begin_at, gaps, p, CASE WHEN p > begin_at THEN gaps[p + 1] ELSE '' END || CASE WHEN list_contains(opens, p) THEN chr(2) ELSE '' END || words[p + 1]
    || CASE WHEN list_contains(closes, p) THEN chr(3) ELSE '' END AS piece FROM tokens),
joined AS (SELECT query_id, page_id, CASE WHEN begin_at > 0 THEN '…' ELSE gaps[1] END || string_agg(piece, '' ORDER BY p) || CASE WHEN begin_at + 15 >= n - 1 THEN gaps[n + 1] ELSE '…' END AS text
  FROM pieces GROUP BY query_id, page_id, n, begin_at, gaps)
SELECT query_id, page_id, {_escaped("text")} AS snippet_html FROM joined"""


@query(SNIPPETS)
def snippets(t: Tables) -> DataFrame:
    return search.snippets(_search(t).select("query_id", "page_id"), t.queries, t.pages)


PHRASE_HITS = rf"""
WITH bounded AS (SELECT page_id, {BOUNDED.format("text")} AS text FROM lib_pages)
SELECT page_id, len(regexp_extract_all(text, '(?i)\x01of\x01\s+\x01the\x01')) AS hits FROM bounded"""

PHRASE_HTML = rf"""
WITH bounded AS (SELECT page_id, {BOUNDED.format("text")} AS text FROM lib_pages),
marked AS (SELECT page_id, regexp_replace(text, '(?i)\x01(of)\x01(\s+)\x01(the)\x01', chr(2) || '\1\2\3' || chr(3), 'g') AS text FROM bounded)
SELECT page_id, length(text) - length(replace(text, chr(2), '')) AS hits, {_escaped("text")} AS html FROM marked"""

# Lines are joined by chr(4) in place of the space; a match across it is closed before and opened again after it.
ITEM_HTML = rf"""
WITH joined AS (SELECT page_id, replace(text, chr(10), chr(4)) AS text FROM lib_pages),
bounded AS (SELECT page_id, {BOUNDED.format("text")} AS text FROM joined),
marked AS (SELECT page_id, regexp_replace(text, '(?i)\x01(of)(?:\x01([\s\x04]*)\x01)?(the)\x01', chr(2) || '\1\2\3' || chr(3), 'g') AS text FROM bounded),
divided AS (SELECT page_id, regexp_replace(text, '(\x02[^\x03\x04]*)\x04([^\x03\x04]*\x03)', '\1' || chr(3) || chr(4) || chr(2) || '\2', 'g') AS text FROM marked),
items AS (SELECT page_id, unnest(string_split(text, chr(4))) AS text, unnest(range(len(string_split(text, chr(4))))) AS item_no FROM divided)
SELECT page_id, item_no, {_escaped("text")} AS html FROM items"""


@query(PHRASE_HITS)
def phrase_highlight_counts(t: Tables) -> DataFrame:
    return highlight.phrase_highlight(t.pages.select("page_id", "text"), "of the").select("page_id", "hits")


@query(PHRASE_HTML)
def phrase_highlight(t: Tables) -> DataFrame:
    return highlight.phrase_highlight(t.pages.select("page_id", "text"), "of the").select("page_id", "hits", "html")


@query(ITEM_HTML)
def highlight_items(t: Tables) -> DataFrame:
    """Every line of a page is one text item."""
    lines = t.pages.select("page_id", F.posexplode(F.split("text", "\n")).alias("item_no", "text"))
    return highlight.highlight_items(lines.withColumn("item_no", F.col("item_no").cast("bigint")), "of the")
