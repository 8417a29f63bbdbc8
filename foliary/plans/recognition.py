"""Registered queries over recognised text: markup, words, reading order, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.operators import recognition
from foliary.plans.markup import with_markup
from foliary.plans.registry import query
from foliary.plans.tables import Tables


def hocr(t: Tables, pages: DataFrame | None = None) -> DataFrame:
    """Pages (with the geometry they may carry) written as markup: two lines per block, boxes from the word's place, some confidences and boxes missing. Some words hold inner
    spans or spaces, some blocks end before their second line, and every line ends in a blank word, some with a confidence."""
    # Few rows carry much work here, so they are spread before the markup is made.
    pages = t.pages.select("page_id", "text") if pages is None else pages
    return with_markup(pages.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions"))))


WORDS = r"""
source_lines AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line_text, unnest(range(len(string_split(text, chr(10))))) AS i FROM lib_pages),
source_words AS (SELECT page_id, i, CASE WHEN page_id % 5 = 0 AND i = 3 THEN 3 ELSE i // 2 * 2 END AS area, unnest(w) AS raw, unnest(range(len(w))) AS j FROM
  (SELECT page_id, i, list_filter(string_split(trim(regexp_replace(line_text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM source_lines)),
words AS (SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY area) - 1 AS block, dense_rank() OVER (PARTITION BY page_id, area ORDER BY i) - 1 AS line, j AS word,
    raw || CASE WHEN (i + j) % 13 = 6 THEN '  x' ELSE '' END AS text,
    CASE WHEN (i + j) % 17 = 0 THEN 0 ELSE j * 50 END AS "left", CASE WHEN (i + j) % 17 = 0 THEN 0 ELSE i * 40 END AS top,
    CASE WHEN (i + j) % 17 = 0 THEN 0 ELSE j * 50 + 10 * length(raw) END AS "right", CASE WHEN (i + j) % 17 = 0 THEN 0 ELSE i * 40 + 30 END AS bottom,
    CASE WHEN ((page_id + i * 7 + j * 13) % 100) % 10 <> 0 THEN (page_id + i * 7 + j * 13) % 100 END::DOUBLE AS confidence FROM source_words)"""


@query(f"WITH {WORDS} SELECT * FROM words")
def hocr_words(t: Tables) -> DataFrame:
    return recognition.hocr_words(hocr(t))


@query(
    f"""
WITH {WORDS}, lines AS (SELECT page_id, block, line, string_agg(text, ' ' ORDER BY word) AS text FROM words GROUP BY page_id, block, line),
blocks AS (SELECT page_id, block, string_agg(text, chr(10) ORDER BY line) AS text FROM lines GROUP BY page_id, block),
joined AS (SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY block) AS text FROM blocks GROUP BY page_id),
blanks AS (SELECT page_id, count_if(i % 2 = 0) AS n FROM source_lines GROUP BY page_id),
sums AS (SELECT page_id, count(*) AS words_count, count(confidence) AS n, sum(confidence) AS total FROM words GROUP BY page_id)
SELECT page_id, coalesce(j.text, '') AS text, coalesce(words_count, 0) AS words_count,
  round((coalesce(total, 0) + 50 * blanks.n) / (coalesce(sums.n, 0) + blanks.n), 4) AS mean_confidence FROM blanks LEFT JOIN joined j USING (page_id) LEFT JOIN sums USING (page_id)"""
)
def page_text_from_words(t: Tables) -> DataFrame:
    return recognition.page_text_from_words(recognition.hocr_words(hocr(t), blank=True))


def _lines(t: Tables) -> DataFrame:
    """Text lines in boxes that are slightly askew and partly outside the page."""
    cut = t.pages.select("page_id", F.posexplode(F.split("text", "\n")).alias("line_id", "text"))
    x = (F.col("line_id") * 53 + F.col("page_id")) % 120 - 10.5
    y = (F.col("line_id") * 37 + F.col("page_id")) % 90 + 0.5
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    quad = F.array(point(x, y), point(x + 30.25, y - 1.5), point(x + 31, y + 12), point(x - 1, y + 11.25))
    return cut.select(
        "page_id", F.col("line_id").cast("bigint").alias("line_id"), "text", quad.alias("polygon"), ((F.col("page_id") + F.col("line_id")) % 100 / 100.0).alias("confidence"),
        F.lit(120).alias("width_px"), F.lit(80).alias("height_px"),
    )


READING = r"""
quads AS (SELECT page_id, line_id, text, (line_id * 53 + page_id) % 120 - 10.5::DOUBLE AS x, (line_id * 37 + page_id) % 90 + 0.5::DOUBLE AS y
  FROM (SELECT page_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line_id FROM lib_pages)),
boxes AS (SELECT page_id, line_id, trim(text) AS text, greatest(least(floor(x - 1), 120), 0)::BIGINT AS "left", greatest(least(floor(y - 1.5), 80), 0)::BIGINT AS top,
    greatest(least(ceil(x + 31), 120), 0)::BIGINT AS "right", greatest(least(ceil(y + 12), 80), 0)::BIGINT AS bottom, ((page_id + line_id) % 100) / 100.0::DOUBLE AS confidence
  FROM quads WHERE trim(text) <> '')"""


@query(f"""WITH {READING} SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY top, "left", line_id) AS position FROM boxes""")
def reading_order(t: Tables) -> DataFrame:
    return recognition.reading_order(_lines(t))


@query(f"""WITH {READING} SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY top // 10, "left", line_id) AS position FROM boxes""")
def reading_order_banded(t: Tables) -> DataFrame:
    return recognition.reading_order(_lines(t), banded=True)


def _boxes(t: Tables) -> DataFrame:
    turn = (F.col("page_id") % 4).cast("int")
    sideways = turn.isin(1, 3)
    geometry = t.pages.select(
        "page_id", F.lit(10.0).alias("crop_left"), F.lit(20.0).alias("crop_bottom"), F.lit(622.0).alias("crop_right"), F.lit(812.0).alias("crop_top"),
        (turn * 90).alias("rotation"), F.when(sideways, 2200).otherwise(1700).alias("width_px"), F.when(sideways, 1700).otherwise(2200).alias("height_px"),
    )
    # Pages meet their geometry before the markup is made of them, so words and markup are never shuffled.
    marked = hocr(t, t.pages.select("page_id", "text").join(geometry, "page_id"))
    return recognition.word_geometry(recognition.hocr_words(marked, keep=recognition.GEOMETRY))


GEOMETRY = f"""{WORDS},
shown AS (SELECT *, page_id % 4 AS turn, CASE WHEN page_id % 4 IN (1, 3) THEN 792.0 ELSE 612.0 END::DOUBLE AS w, CASE WHEN page_id % 4 IN (1, 3) THEN 612.0 ELSE 792.0 END::DOUBLE AS h FROM words),
scaled AS (SELECT *, "left" * (w / CASE WHEN turn IN (1, 3) THEN 2200 ELSE 1700 END) AS x0, "right" * (w / CASE WHEN turn IN (1, 3) THEN 2200 ELSE 1700 END) AS x1,
    h - top * (h / CASE WHEN turn IN (1, 3) THEN 1700 ELSE 2200 END) AS y1, h - bottom * (h / CASE WHEN turn IN (1, 3) THEN 1700 ELSE 2200 END) AS y0 FROM shown),
turned AS (SELECT page_id, block, line, word, text,
    10 + CASE turn WHEN 0 THEN x0 WHEN 1 THEN y0 WHEN 2 THEN 612 - x1 ELSE 612 - y1 END AS x_min, 20 + CASE turn WHEN 0 THEN y0 WHEN 1 THEN 792 - x1 WHEN 2 THEN 792 - y1 ELSE x0 END AS y_min,
    10 + CASE turn WHEN 0 THEN x1 WHEN 1 THEN y1 WHEN 2 THEN 612 - x0 ELSE 612 - y0 END AS x_max, 20 + CASE turn WHEN 0 THEN y1 WHEN 1 THEN 792 - x0 WHEN 2 THEN 792 - y0 ELSE x1 END AS y_max FROM scaled),
boxes AS (SELECT page_id, block, line, word, round(x_min, 4) AS x_min, round(y_min, 4) AS y_min, round(x_max, 4) AS x_max, round(y_max, 4) AS y_max, round(greatest(y_max - y_min, 1), 4) AS font_size,
    round(least(greatest(greatest(x_max - x_min, 1) / (length(text) * greatest(y_max - y_min, 1) * 0.5) * 100, 20), 400), 4) AS horizontal_scale FROM turned)"""


@query(f"WITH {GEOMETRY} SELECT * FROM boxes")
def word_geometry(t: Tables) -> DataFrame:
    return _boxes(t)


@query(f"WITH {GEOMETRY} SELECT page_id, count(*) AS words, min(x_min) AS x_min, min(y_min) AS y_min, max(x_max) AS x_max, max(y_max) AS y_max FROM boxes GROUP BY page_id")
def text_extent(t: Tables) -> DataFrame:
    return recognition.text_extent(_boxes(t))
