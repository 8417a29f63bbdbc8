import html
import sqlite3

import pytest
from pyspark.sql import functions as F

from foliary.operators import library, search
from foliary.plans.tables import Tables

QUERY = "query_id bigint, q string, sort string, lim bigint, off bigint, date_from bigint, date_to bigint, engine string"


def queries_of(spark, *texts):
    return spark.createDataFrame([(n, q, "relevance", 200, 0, None, None, None) for n, q in enumerate(texts)], QUERY)


def terms(spark, text):
    row = search.match_expressions(queries_of(spark, text)).first()
    return row["match_expr"], row["warning"], row["error"]


@pytest.mark.parametrize(
    "text, expression",
    [
        ("invoice* status:paid", '"invoice" "status" "paid"'),
        ('"acme corp" invoice', '"acme corp" "invoice"'),
        ("a b c", '"a" "b" "c"'),
        ("'); DROP TABLE pages;--", '"DROP" "TABLE" "pages"'),
        ('one "two  three', '"one" "two three"'),
        ('a"b c"d', '"a" "b c" "d"'),
        ("école", '"cole"'),
    ],
)
def test_query_grammar(spark, text, expression):
    assert terms(spark, text) == (expression, None, None)


def test_query_limits(spark):
    expression, warning, _ = terms(spark, "a" * 300)
    assert len(expression) == 258 and warning == "Query truncated to 256 chars"
    assert terms(spark, "    ")[2] == "Search query is empty after sanitization"
    assert terms(spark, '*** "" é')[2] is not None


TEXTS = [
    "École des chats. The straße is long; the cat sat.",
    "the the the cat cat",
    "a cat in the hat & the <b>dog</b> \"quoted\" it's",
    "Nothing here at all",
    "",
    "ecole ÉCOLE école cat the",
    "One two three four. Five six seven eight nine ten: eleven twelve thirteen fourteen fifteen sixteen seventeen. "
    "Eighteen the cat nineteen twenty twentyone the dog twentytwo twentythree. Twentyfour the cat twentyfive end",
    "start " + "filler words go on " * 12 + "the cat. Then more filler words go on " + "and on " * 20 + "the dog the cat the hat",
    "cat " * 40,
    "x y " * 30 + "needle. Another sentence with needle and the cat needle " + "z " * 30,
]
SEARCHES = ["cat", "the cat", '"the cat"', '"the cat" dog', "ecole", "strasse", "needle cat", '"the the"', "the the cat", '"filler words go on"', "hat dog", "end", '"cat cat cat"', "absent", "the absent"]


def fts5(texts):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO f(rowid, text) VALUES(?, ?)", texts)
    return con


def expected(con, expressions):
    sql = "SELECT rowid, bm25(f), snippet(f, 0, char(1), char(2), '…', 16) FROM f WHERE f MATCH ?"
    out = {}
    for number, expression in expressions:
        for row, score, snippet in con.execute(sql, (expression,)):
            marked = html.escape(snippet).replace("&#x27;", "&#39;").replace("\1", "<mark>").replace("\2", "</mark>")
            out[number, row] = (score, marked)
    return out


def compare_with_fts5(spark, texts, asked):
    rows = spark.createDataFrame([(i, i, 1, text) for i, text in texts], "page_id bigint, document_id bigint, page_number bigint, text string")
    expressions = [(r["query_id"], r["match_expr"]) for r in search.match_expressions(asked).collect() if r["match_expr"]]
    want = expected(fts5(texts), expressions)
    found = search.matches(asked, search.build_index(rows)).select("query_id", F.col("row_id").alias("page_id"), "bm25_score")
    got = {(r["query_id"], r["page_id"]): r["bm25_score"] for r in found.collect()}
    assert got == pytest.approx({key: score for key, (score, _) in want.items()}, abs=2e-8)
    shown = {(r["query_id"], r["page_id"]): r["snippet_html"] for r in search.snippets(found, asked, rows).collect()}
    assert shown == {key: snippet for key, (_, snippet) in want.items()}
    return len(want)


def test_matches_scores_and_snippets_equal_fts5(spark):
    assert compare_with_fts5(spark, list(enumerate(TEXTS, 1)), queries_of(spark, *SEARCHES)) > 30


def test_given_pages_equal_fts5(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    texts = [(r["page_id"], r["text"]) for r in tables.pages.select("page_id", "text").collect()]
    assert compare_with_fts5(spark, texts, tables.queries) > 50


def test_stored_index_gives_the_same_matches(spark):
    rows = spark.createDataFrame([(i, i, text) for i, text in enumerate(TEXTS)], "page_id bigint, document_id bigint, text string")
    asked = queries_of(spark, *SEARCHES)
    plain = search.build_index(rows)
    stored = search.store_index(plain)
    assert sorted(search.matches(asked, plain).collect()) == sorted(search.matches(asked, stored).collect())


@pytest.fixture(scope="module")
def small_library(spark):
    pages = spark.createDataFrame(
        [(n, 1, n, f"Synthetic page {n} contains needle and invoice text.") for n in range(1, 1001)], "page_id bigint, document_id bigint, page_number bigint, text string"
    )
    documents = spark.createDataFrame([(1, "/in/a.pdf", None, "done", None, 5, "tesseract")], "document_id bigint, original_path string, display_name string, status string, deleted_at bigint, ingested_at bigint, ocr_engine string")
    return pages, documents


def test_a_thousand_pages(spark, small_library):
    pages, documents = small_library
    asked = spark.createDataFrame([(1, "needle", "relevance", 0, 0, None, None, None), (2, "needle", "oldestFirst", 500, 990, None, None, " ")], QUERY)
    rows = search.search(asked, search.build_index(pages), pages, documents).collect()
    first, second = [[r for r in rows if r["query_id"] == n] for n in (1, 2)]
    assert len(first) == 50 and {r["total_hits"] for r in first} == {1000} and first[0]["display_name"] == "a.pdf"
    assert sorted(r["rank"] for r in second) == list(range(991, 1001))


def test_bad_engine_fails(spark, small_library):
    pages, documents = small_library
    asked = spark.createDataFrame([(1, "needle", "relevance", 0, 0, None, None, "abbyy")], QUERY)
    with pytest.raises(Exception, match="invalid OCR engine"):
        search.search(asked, search.build_index(pages), pages, documents).collect()
    with pytest.raises(ValueError):
        library.scope_filter(documents, engine="abbyy")


def test_saved_search_that_is_not_json_is_empty(spark):
    saved = spark.createDataFrame([(1, "{oops"), (2, '{"q":"cat","limit":7,"sort":"NewestFirst"}')], "query_id bigint, query string")
    rows = {r["query_id"]: r for r in search.parse_saved_searches(saved).collect()}
    assert rows[1]["q"] == "" and (rows[2]["q"], rows[2]["lim"], rows[2]["sort"]) == ("cat", 7, "newestFirst")


def test_blocks_answer_stop_words_phrases_and_long_texts(spark):
    texts = [f"the number {n} of the list" for n in range(2500)] + ["École the red fox", "red the fox", "the " * 30_000 + "red fox", None, ""]
    rows = spark.createDataFrame([(n, n, text) for n, text in enumerate(texts)], "page_id bigint, document_id bigint, text string")
    asked = spark.createDataFrame([(1, "the"), (2, "ecole"), (3, 'x "red fox'), (4, '"red fox'), (5, "the the red"), (6, '"the red fox"'), (7, "of 77")], "query_id bigint, q string")
    for index in (search.build_index(rows), search.store_index(search.build_index(rows.repartition(3)), buckets=5)):
        found = {}
        for row in search.matches(asked, index).collect():
            found.setdefault(row["query_id"], set()).add(row["row_id"])
        assert found == {1: set(range(2503)), 2: {2500}, 4: {2500, 2502}, 5: {2500, 2501, 2502}, 6: {2500, 2502}, 7: {77}}
        facts = index.corpus.first()
        assert facts["n_rows"] == 2505 and facts["total_len"] == sum(len((t or "").split()) for t in texts)


def test_pages_of_hits_are_limited_per_query(spark):
    hits = spark.range(1000).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("row_id"), F.col("id").alias("document_id"), (-F.col("id")).cast("double").alias("bm25_score"), F.col("id").alias("ingested_at"))
    asked = spark.createDataFrame([(0, "relevance", 5, 0), (1, "oldestFirst", 3, 300), (2, None, 0, 2)], "query_id bigint, sort string, lim int, off int")
    page = search.page_hits(hits, asked)
    assert "WindowGroupLimit" in page._jdf.queryExecution().toString()
    got = {}
    for row in page.collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["row_id"], row["total_hits"]))
    assert sorted(got[0]) == [(n + 1, 999 - 3 * n, 334) for n in range(5)]
    assert sorted(got[1]) == [(301 + n, 901 + 3 * n, 333) for n in range(3)]
    assert len(got[2]) == 50 and min(got[2])[:2] == (3, 998 - 6)


def test_texts_without_hits_are_not_shuffled(spark):
    """Of many texts only those that a hit asks for, and a few more, reach the join with the hits."""
    rows = spark.range(20000).select((F.col("id") * 7 - 500).alias("page_id"), F.lit("x").alias("text"))
    keys = spark.createDataFrame([(n * 7,) for n in range(100)] + [(-500,), (None,), (3,)], "page_id bigint")
    kept = {r["page_id"] for r in search.that_may_meet(rows, keys, "page_id").collect()}
    asked = {r["page_id"] for r in rows.join(keys, "page_id", "left_semi").collect()}
    assert asked and asked <= kept and len(kept) < len(asked) + 20
    assert search.that_may_meet(rows, keys.filter("page_id = 1"), "page_id").count() == 0
    for other in ("int", "string", "double"):  # equal ids of another type have other hashes
        assert search.that_may_meet(rows, keys.select(F.col("page_id").cast(other)), "page_id").count() == 20000
    hits = spark.createDataFrame([(1, 6500)], "query_id bigint, page_id bigint")
    found = search.snippets(hits, queries_of(spark, "a", "x"), rows)
    assert [tuple(r) for r in found.collect()] == [(1, 6500, "<mark>x</mark>")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan
