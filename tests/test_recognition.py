import pytest
from pyspark.sql import functions as F

from foliary.operators import library, recognition

WORDS = "page_id bigint, block bigint, line bigint, word bigint, text string, `left` bigint, top bigint, `right` bigint, bottom bigint"


def test_two_words_on_a_line(spark):
    word = '<span class="ocrx_word" title="bbox {} 4 {} 14; x_wconf {}">{}</span>'.format
    markup = '<div class="ocr_carea"><span class="ocr_line">' + word(3, 33, 70, "Harbour") + word(40, 61, 60, "log") + "</span></div>"
    words = recognition.hocr_words(spark.createDataFrame([(1, markup)], "page_id bigint, hocr string"))
    rows = [(r["text"], r["left"], r["top"], r["right"], r["bottom"], r["confidence"]) for r in words.orderBy("word").collect()]
    assert rows == [("Harbour", 3, 4, 33, 14, 70.0), ("log", 40, 4, 61, 14, 60.0)]
    page = recognition.page_text_from_words(words).first()
    assert (page["text"], page["words_count"], page["mean_confidence"]) == ("Harbour log", 2, 65.0)


def test_markup_corner_cases(spark):
    markup = (
        '<div class="ocrx_block"><span class="ocr_line"><span title="x_wconf oops" class="ocrx_word"><strong>a &amp;lt; b</strong></span><span class="ocrx_word"/></span>'
        '<span class="ocr_line"><span class="ocrx_word">  </span></span><span class="ocr_line"><span class="ocrx_word">c</span></span></div>'
        '<div class="ocr_carea"></div><div class="ocr_carea"><span class="ocr_line"><span class="ocrx_word">d</span></span></div>'
    )
    words = recognition.hocr_words(spark.createDataFrame([(1, markup)], "page_id bigint, hocr string"))
    rows = [(r["block"], r["line"], r["word"], r["text"], r["right"], r["confidence"]) for r in words.orderBy("block", "line", "word").collect()]
    assert rows == [(0, 0, 0, "a &lt; b", 0, None), (0, 1, 0, "c", 0, None), (1, 0, 0, "d", 0, None)]
    page = recognition.page_text_from_words(words).first()
    assert page["text"] == "a &lt; b\nc\n\nd" and page["mean_confidence"] is None


def test_what_follows_a_closed_block_starts_a_new_one(spark):
    markup = (
        "<div class='ocr_page'><div class='ocr_carea'><span class='ocr_line'><span class='ocrx_word'>in  side</span></span></div>"
        "<!-- <span class='ocrx_word'>no</span> --><span class='ocr_line'><span class='ocrx_word' title='x_wconf 30'><span lang='x'>out</span><em> er </em></span>"
        "<span class='ocrx_word' title='x_wconf 10'> </span><span class='ocrx_word' title='x_wconf 20'/></span><span class='ocrx_word'>alone</span></div>"
    )
    words = recognition.hocr_words(spark.createDataFrame([(1, markup), (2, None), (3, "<span class='ocrx_word' title='x_wconf 7'></span>")], "page_id bigint, hocr string"), blank=True)
    rows = [(r["block"], r["line"], r["word"], r["text"]) for r in words.filter("page_id = 1 AND text <> ''").orderBy("block", "line", "word").collect()]
    assert rows == [(0, 0, 0, "in  side"), (1, 0, 0, "outer"), (1, 1, 0, "alone")]
    pages = {r["page_id"]: (r["text"], r["words_count"], r["mean_confidence"]) for r in recognition.page_text_from_words(words).collect()}
    assert pages == {1: ("in  side\n\nouter\nalone", 3, 20.0), 3: ("", 0, 7.0)}


@pytest.mark.parametrize(
    "markup, text",
    [("caf&#233; &#xE9;&#x1F600;", "café é😀"), ("&#38;lt; &amp;#233; &#38;amp;", "&lt; &#233; &amp;"), ("&#55296; &#; &#x; &#99999999; a&#", "&#55296; &#; &#x; &#99999999; a&#"), ("&#39;&lt;&#34;", "'<\"")],
)
def test_character_references(spark, markup, text):
    assert spark.createDataFrame([(markup,)], "m string").select(recognition.unescape(F.col("m"))).first()[0] == text


def test_quad_to_box(spark):
    quad = [(21.5, 60.2), (70.1, 58.9), (71.4, 80.0), (20.2, 81.3)]
    schema = "page_id bigint, line_id bigint, polygon array<struct<x:double,y:double>>, text string, confidence double, width_px int, height_px int"
    rows = recognition.reading_order(spark.createDataFrame([(2, 1, quad, "Tide table", 0.8, 100, 82), (2, 2, quad, " ", 0.8, 100, 82)], schema)).collect()
    assert len(rows) == 1 and (rows[0]["left"], rows[0]["top"], rows[0]["right"], rows[0]["bottom"]) == (20, 58, 72, 82)


# Two pixels of the image are one unit of a page of 500 by 400.
@pytest.mark.parametrize(
    "page, rotation, image, box, expected",
    [
        ((500, 400), 0, (1000, 800), (200, 100, 400, 300), (100, 250, 200, 350)),
        ((500, 400), 90, (800, 1000), (200, 100, 400, 300), (350, 200, 450, 300)),
        ((500, 400), 180, (1000, 800), (200, 100, 400, 300), (300, 50, 400, 150)),
        ((500, 400), -90, (800, 1000), (400, 300, 200, 100), (50, 100, 150, 200)),
        ((300, 150), 360, (900, 450), (0, 0, 900, 450), (0, 0, 300, 150)),
    ],
)
def test_page_coordinates(spark, page, rotation, image, box, expected):
    words = spark.createDataFrame([(1, 0, 0, 0, "w", *box)], WORDS)
    shape = spark.createDataFrame([(1, 0.0, 0.0, float(page[0]), float(page[1]), rotation, *image)], "page_id bigint, crop_left double, crop_bottom double, crop_right double, crop_top double, rotation int, width_px int, height_px int")
    row = recognition.word_geometry(words, shape).first()
    assert (row["x_min"], row["y_min"], row["x_max"], row["y_max"]) == pytest.approx(expected, abs=0.02)


def test_scale_is_clamped(spark):
    words = spark.createDataFrame([(1, 0, 0, 0, "hello", 0, 0, 100, 10), (1, 0, 0, 1, "verylongword", 0, 0, 1, 10)], WORDS)
    shape = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0, 0, 100, 100)], "page_id bigint, crop_left double, crop_bottom double, crop_right double, crop_top double, rotation int, width_px int, height_px int")
    assert [r["horizontal_scale"] for r in recognition.word_geometry(words, shape).orderBy("word").collect()] == [400.0, 20.0]


def test_page_class_and_size(spark):
    rows = [(1, 1, "x" * 20 + " \n", 612.0, 792.0, 0), (2, 1, "x" * 21, 612.0, 792.0, 90), (3, 1, "", 0.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "page_id bigint, document_id bigint, text string, width_pt double, height_pt double, rotation int")
    got = [(r["ocr_status"], r["width_px"], r["height_px"]) for r in library.classify_pages(df).orderBy("page_id").collect()]
    assert got == [("needs_ocr", 1700, 2200), ("native_text", 2200, 1700), ("needs_ocr", 1, 1)]


def test_words_leave_in_small_batches_and_carry_their_page(spark, monkeypatch):
    monkeypatch.setattr(recognition, "WORD_ROWS", 3)
    word = "<span class='ocrx_word' title='bbox 10 20 40 50'>w{}</span>"
    markup = "<div class='ocr_carea'><span class='ocr_line'>" + "".join(word.format(n) for n in range(8)) + "</span></div>"
    pages = spark.createDataFrame([(1, markup), (2, None), (3, markup), (3, markup)], "page_id bigint, hocr string").coalesce(1)
    words = recognition.hocr_words(pages).collect()
    assert [(r["page_id"], r["word"], r["text"]) for r in words] == [(p, n, f"w{n}") for p in (1, 3, 3) for n in range(8)]
    geometry = spark.createDataFrame([(1, 0.0, 0.0, 612.0, 792.0, 0, 612, 792), (3, 5.0, 7.0, 617.0, 799.0, 90, 792, 612), (3, 0.0, 0.0, 612.0, 792.0, 180, 612, 792)], "page_id bigint, crop_left double, crop_bottom double, crop_right double, crop_top double, rotation int, width_px int, height_px int")
    joined = recognition.word_geometry(recognition.hocr_words(pages), geometry)
    carried = recognition.word_geometry(recognition.hocr_words(pages.join(geometry, "page_id"), keep=recognition.GEOMETRY))
    assert sorted(carried.collect()) == sorted(joined.collect()) and carried.count() == 8 + 4 * 8
    plan = carried._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")  # above the join, so words are not shuffled
