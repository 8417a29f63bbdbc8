import pytest
from pyspark.sql import functions as F

from foliary.operators import highlight, naming


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw, safe",
    [
        ("", None), ("/_-. .-_/", None), ("Nul", "doc_nul.pdf"), ("LPT7", "doc_lpt7.pdf"), (r"..\up\..\Keller\plan", "up_keller_plan.pdf"),
        ("com1-x", "doc_com1-x.pdf"), ("com0", "com0.pdf"), ("console", "console.pdf"), (" Årsrapport.PDF ", "rsrapport.pdf"), ("q" * 143, "q" * 80 + ".pdf"), ("b" * 79 + "--x", "b" * 79 + ".pdf"),
    ],
)
def test_safe_names(spark, raw, safe):
    assert one(spark, raw, naming.safe_name) == safe


def test_collisions_skip_taken_names(spark):
    rows = [(1, "report"), (2, "Report.pdf"), (3, "report_2"), (4, "report"), (5, "***"), (6, "other")]
    docs = spark.createDataFrame([(i, n, "/in/---.pdf") for i, n in rows], "document_id bigint, name string, original_path string")
    existing = spark.createDataFrame([("other.pdf",), ("report_4.pdf",)], "file_name string")
    names = {r["document_id"]: r["file_name"] for r in naming.normalize_names(docs, existing).collect()}
    assert names == {1: "report.pdf", 2: "report_3.pdf", 3: "report_2.pdf", 4: "report_5.pdf", 5: "pdf_parser_file.pdf", 6: "other_2.pdf"}


def test_too_many_collisions_are_an_error(spark):
    docs = spark.range(1, 1005).select(F.col("id").alias("document_id"), F.lit("same").alias("name"), F.lit("/x").alias("original_path"))
    names = [r["file_name"] for r in naming.normalize_names(docs).orderBy("document_id").collect()]
    assert names[0] == "same.pdf" and names[998] == "same_999.pdf" and names[999:] == [None] * 5


@pytest.mark.parametrize(
    "reply, original, name, summary",
    [
        ('```json\n{"filename_base":"tide_log","summary":"High water."}\n```', "Roll 7.PDF", "tide_log.pdf", "High water."),
        ("not json", "Original Name.pdf", "original_name.pdf", naming.UNREADABLE_SUMMARY),
        ('{"summary": " a \\n b "}', "x.pdf", "x.pdf", "a b"),
        ('{"filename_base": "N"}', "", "n.pdf", naming.NO_SUMMARY),
        ('{"filename_base": "***"}', "...", "pdf_parser_file.pdf", naming.NO_SUMMARY),
        ('[1]', "a.b.pdf", "a_b.pdf", naming.UNREADABLE_SUMMARY),
    ],
)
def test_proposals(spark, reply, original, name, summary):
    row = naming.naming_proposals(spark.createDataFrame([(1, original, reply)], "document_id bigint, original_filename string, reply string")).first()
    assert (row["proposed_name"], row["summary"]) == (name, summary)


def test_model_runs_in_batches(spark):
    inputs = spark.createDataFrame([(n, "f.pdf", f"prompt {n}") for n in range(9)], "document_id bigint, original_filename string, prompt string")
    replies = naming.model_replies(inputs, lambda prompts: ['{"filename_base":"%s"}' % p for p in prompts], batch=4)
    assert naming.naming_proposals(replies).filter("proposed_name = 'prompt_8.pdf'").count() == 1


def test_naming_inputs_join_parts_in_order(spark):
    pages = spark.createDataFrame([(1, n, f"{n:03d}") for n in range(1, 400)], "document_id bigint, page_number bigint, text string")
    docs = spark.createDataFrame([(1, "/in/a.pdf"), (2, "/in/b.pdf")], "document_id bigint, original_path string")
    rows = {r["document_id"]: r for r in naming.naming_inputs(pages, docs, pages_per_part=7).collect()}
    assert rows[1]["prompt"].endswith("\n".join(f"{n:03d}" for n in range(1, 400))) and rows[1]["sample_chars"] == 399 * 4 - 1
    assert rows[2]["sample_chars"] == 0


@pytest.mark.parametrize(
    "line, shown",
    [
        ("signed sk-ant-demo_7 twice", "signed <API_KEY> twice"), ("image (/srv/scans/b/p7.png)", "image (p7.png)"), ("moved /one.png", "moved /one.png"),
        (r"loaded \\?\D:\Tools\ocr\e.bin", "loaded e.bin"), ("folio " * 40, "<TEXT len=240>"), ("quota sk-few", "quota sk-few"),
        (r"copied \\nas\archive\l.pdf", "copied l.pdf"), ("y" * 200, "y" * 200), ("y" * 201, "<TEXT len=201>"),
    ],
)
def test_redaction(spark, line, shown):
    assert one(spark, line, naming.redacted) == shown


@pytest.mark.parametrize(
    "query, text, html",
    [
        ("in it", "In  it stood a cabin item, in\nit.", "<mark>In  it</mark> stood a cabin item, <mark>in\nit</mark>."),
        ("(12-19)", "y (12 – 19) <i>", "y <mark>(12 – 19)</mark> &lt;i&gt;"),
        ("ever/more", "ever/more never/more", "<mark>ever/more</mark> never/more"),
        ("q & r", "Q R q & r", "<mark>Q R</mark> q &amp; r"),
        ("  ", "plain", "plain"),
    ],
)
def test_phrase_highlight(spark, query, text, html):
    row = highlight.phrase_highlight(spark.createDataFrame([(text,)], "text string"), query).first()
    assert row["html"] == html and row["hits"] == html.count("<mark>")


def test_highlight_across_items(spark):
    items = spark.createDataFrame([(1, 0, ""), (1, 1, "a lant"), (1, 2, "ern"), (1, 3, "at b<"), (1, 4, "A"), (1, 5, "Lantern")], "page_id bigint, item_no bigint, text string")
    rows = {r["item_no"]: r["html"] for r in highlight.highlight_items(items, "a lantern").collect()}
    assert rows == {0: "", 1: "a lant", 2: "ern", 3: "at b&lt;", 4: "<mark>A</mark>", 5: "<mark>Lantern</mark>"}
    rows = {r["item_no"]: r["html"] for r in highlight.highlight_items(items, "ern at").collect()}
    assert rows[2] == "<mark>ern</mark>" and rows[3] == "<mark>at</mark> b&lt;"


def test_a_reply_is_parsed_once(spark):
    rows = [(1, "a.pdf", '```json\n{"filename_base": "X y", "summary": " s  t "}\n```'), (2, "b.pdf", "no"), (3, "c.pdf", None), (4, "d.pdf", '{"summary": ""}'), (5, "e.pdf", "{bad}"), (6, "f.pdf", "[1]")]
    found = naming.naming_proposals(spark.createDataFrame(rows, "document_id bigint, original_filename string, reply string"))
    unread = naming.UNREADABLE_SUMMARY
    got = [(r["proposed_name"], r["summary"]) for r in found.orderBy("document_id").collect()]
    assert got == [("x_y.pdf", "s t"), ("b.pdf", unread), ("c.pdf", unread), ("d.pdf", naming.NO_SUMMARY), ("e.pdf", unread), ("f.pdf", unread)]
    plan = spark.range(6).selectExpr("id AS document_id", "concat(id, '.pdf') AS original_filename", "concat('{', id, '}') AS reply")
    text = naming.naming_proposals(plan)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json") == 1
