"""The readers of recognition markup, the markup made of pages, and what is made of words."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliary.functions import text as tx
from foliary.operators import markup, recognition
from foliary.plans.markup import with_markup

WORD = "<span class='ocrx_word' title='bbox {} 2 30 40; x_wconf {}'>{}</span>"
PIECES = [
    WORD.format(7, 95, "a"), WORD.format(8, 60, "b &amp; c"), "<span class='ocrx_word' title='bbox 1 2 3 4'><span lang='en'>x</span>y</span>", "<span class=\"ocr_line\">", "</span>",
    "<div class='ocr_carea'>", "</div>", "<em>", "</em>", "text", " ", "é", "<span class='ocrx_word' title='x_wconf 9.5'>", "<span class='ocrx_word'/>", "<!-- <b> -->", "it's",
    "<span title='x_wconf 3' class='ocrx_word' id='w'>", "<p class='a=b'>", "<!DOCTYPE html \"x\">", "<span class='ocrx_word' title='bbox 1 2 3 12345678901234567'>w</span>", "</span >", "a>b",
]


def both(pages, most=1000):
    one = [(i, *w) for i, page in enumerate(pages) for w in markup.words_of(page or "")]
    found = [r for owner, columns in markup.words_of_pages(pa.array(pages, pa.string()), most) for r in zip(owner.tolist(), *(c.to_pylist() for c in columns))]
    return one, found


def test_both_readers_find_the_same_words(monkeypatch):
    rng = random.Random(4)
    for size in (200, 2_000_000):
        monkeypatch.setattr(markup, "TOGETHER", size)
        for _ in range(150):
            some = PIECES[: rng.choice([11, len(PIECES)])]
            pages = [None if rng.random() < 0.1 else "".join(rng.choices(some, k=rng.randrange(25))) for _ in range(6)]
            one, found = both(pages, rng.choice([2, 1000]))
            assert found == one, pages


def test_plain_pages_are_read_together(monkeypatch):
    page = "<!DOCTYPE html PUBLIC \"-//W3C//DTD\"><div class='ocr_page' id='p'><div class='ocr_carea'><span class='ocr_line'>" + "".join(WORD.format(n, n % 100, "w<span lang='x'>o</span>") for n in range(50)) + "</span></div></div>"
    one, found = both([page, None, page])
    assert found == one and len(one) == 100
    monkeypatch.setattr(markup, "words_of", lambda _: pytest.fail("read piece by piece"))
    assert sum(len(owner) for owner, _ in markup.words_of_pages(pa.array([page, None, page]), 30)) == 100


def test_a_long_page_is_read_piece_by_piece(monkeypatch):
    monkeypatch.setattr(markup, "LONG_PAGE", 100)
    monkeypatch.setattr(markup, "TOGETHER", 100)
    one, found = both([WORD.format(1, 2, "a") * 9, WORD.format(1, 2, "b")], 4)
    assert found == one and len(one) == 10


def test_markup_of_pages(spark):
    rows = [(5, "one two\n\n&x\n　", 1.5), (None, "a b", 2.5), (7, None, 3.5), (-33, "t" * 3, 4.5), (6, "", 5.5)]
    made = {r["extra"]: (r["page_id"], r["hocr"]) for r in with_markup(spark.createDataFrame(rows, "page_id bigint, text string, extra double")).collect()}
    word = "<span class='ocrx_word' title='{}'>{}</span>".format
    blank = ["<span class='ocrx_word' title='x_wconf 50'> </span></span>", "<span class='ocrx_word' title=''> </span></span>"]
    line = ["<div class='ocr_carea'><span class='ocr_line'>", "<span class='ocr_line'>"]
    first = word("; x_wconf 5", "one") + "\n" + word("bbox 50 0 80 30; x_wconf 18", "two")
    third = word("bbox 0 80 20 110; x_wconf 19", "&amp;x")
    assert made[1.5] == (5, "<div class='ocr_page'>" + "\n".join([line[0] + first + blank[0], line[1] + blank[1], line[0] + third + blank[0] + "</div>", line[1] + blank[1]]) + "</div></div>")
    assert made[2.5] == (None, "<div class='ocr_page'>" + line[0] + blank[0] + "</div></div>") and made[3.5] == (7, None)
    assert made[4.5][1] == "<div class='ocr_page'>" + line[0] + word("; x_wconf -33", "ttt") + blank[0] + "</div></div>"
    assert made[5.5][1] == "<div class='ocr_page'>" + line[0] + blank[0] + "</div></div>"


def test_four_decimals_are_those_of_round(spark):
    rng = random.Random(6)
    values = [rng.uniform(-1000, 1000) for _ in range(2000)] + [rng.randrange(-(10**7), 10**7) / 10**5 for _ in range(2000)] + [0.00005, -0.00005, -0.0, 1e12 + 0.1, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert rows.filter(~recognition._rounded(F.col("v")).eqNullSafe(F.round("v", 4))).count() == 0


def test_geometry_is_worked_out_once(spark):
    """What all four edges need is not repeated in each of them."""
    words = spark.range(1).selectExpr(*(f"id AS {c}" for c in ("page_id", "block", "line", "word", "left", "top", "right", "bottom")), "'w' AS text")
    shape = spark.range(1).selectExpr("id AS page_id", *(f"CAST(id AS double) AS {c}" for c in recognition.GEOMETRY))
    plan = recognition.word_geometry(words.join(shape, "page_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("greatest(left") == 1 and "regexp_replace" not in plan


def test_page_text_of_words_in_any_order(spark):
    """The words of a page in one place, or dealt out one by one, give what brute force gives."""
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]), rng.randrange(2), rng.randrange(2), rng.randrange(30), rng.choice(["a", " b　", "", None, "é"]), rng.choice([None, 10.0, 45.5])) for _ in range(300)]
    rows += [(3, 0, 0, 0, " ", None), (4, 0, 0, 1, "x", 1.0), (4, None, 0, 1, "y", 2.0)]
    expected = {}
    for page in (1, 2, 3, None):
        mine = [r for r in rows if r[0] == page]
        words = sorted((b, l, w, t.strip(tx.WHITESPACE_CHARS)) for _, b, l, w, t, _ in mine if (t or "").strip(tx.WHITESPACE_CHARS))
        text, known = "", [r[5] for r in mine if r[5] is not None]
        for k, (b, l, _, t) in enumerate(words):
            text += ("" if k == 0 else "\n\n" if words[k - 1][0] != b else "\n" if words[k - 1][1] != l else " ") + t
        expected[page] = (text, len(words), round(sum(known) / len(known), 4) if known else None)
    expected[4] = ("y x", 2, 1.5)
    table = spark.createDataFrame(rows, "page_id bigint, block bigint, line bigint, word bigint, text string, confidence double")
    for words in (table.repartition(7), table.coalesce(1).sortWithinPartitions("page_id", "block")):
        assert {r["page_id"]: (r["text"], r["words_count"], r["mean_confidence"]) for r in recognition.page_text_from_words(words).collect()} == expected


def test_few_rows_are_shuffled_for_the_text_of_pages():
    """A run of words of one page is one row."""
    columns = [[1] * 500 + [2] * 500, [0] * 1000, [0] * 1000, list(range(1000)), ["w"] * 999 + [None], [50.0] * 1000]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.float64()]
    made = recognition._parts_of_pages(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "block", "line", "word", "text", "confidence"]))
    assert made.column("words_count").to_pylist() == [500, 499] and made.column("known").to_pylist() == [500, 500]
