"""Results of text recognition as tables: markup to words, words to text, reading order, page geometry."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliary.functions import text as tx
from foliary.operators import markup

# Fixed values.
SCALE_BOUNDS = (20.0, 400.0)
BAND_PX = 10

# Words that leave a task in one batch.
WORD_ROWS = 10_000
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
REFERENCE = "^(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));"  # what follows "&#" in a character reference


def _character(part: Column) -> Column:
    """Text behind ``&#`` with its reference replaced; left as it is where that is none, or is no character."""
    digits, decimal = F.regexp_extract(part, REFERENCE, 1), F.regexp_extract(part, REFERENCE, 2)
    code = F.when(digits != "", F.conv(digits, 16, 10)).otherwise(decimal).try_cast("bigint")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    safe = F.when(valid, code).otherwise(63)
    found = F.when(code == 38, "&amp;").otherwise(F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32"))
    return F.when(valid, F.concat(found, F.regexp_replace(part, REFERENCE, ""))).otherwise(F.concat(F.lit("&#"), part))


def unescape(text: Column) -> Column:
    """Named and numbered character references as characters; the ampersand comes last, so nothing is read twice."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    parts = F.split(text, "&#")
    numbered = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), _character), ""))
    return F.replace(F.when(F.contains(text, F.lit("&#")), numbered).otherwise(text), F.lit("&amp;"), F.lit("&"))


def hocr_words(pages: DataFrame, blank: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Markup of whole pages (``page_id, hocr``) to a word table, with the columns ``keep`` of a page beside each of its words.

    Places number the blocks, lines and words that have text. Text keeps its inner spaces; around tags it is trimmed. A missing box is
    all zeros, a missing or unreadable confidence NULL. Words without text are left out, unless ``blank`` asks for them:
    then they come without a place, for the sake of their confidence. Markup that is not well formed is read as far as it goes."""
    kept = ["page_id", *keep]
    kinds = [*["bigint"] * 3, "string", *["bigint"] * 4, "double"]
    names = ["block", "line", "word", "text", "left", "top", "right", "bottom", "confidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, columns in markup.words_of_pages(batch.column(0), WORD_ROWS):
                if not blank:
                    shown = pc.not_equal(columns[3], "")
                    owner, columns = owner[shown.to_numpy(zero_copy_only=False)], [c.filter(shown) for c in columns]
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(1, len(kept) + 1)), *columns], [*kept, *names])

    schema = [*((n, pages.schema[n].dataType.simpleString()) for n in kept), *zip(names, kinds)]
    return pages.select("hocr", *kept).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in schema))


NO_PLACE = np.iinfo(np.int64).min  # stands for a missing number, and comes first like one
PART = "page_id {}, words_count bigint, total double, known bigint, places binary, sizes binary, letters binary"
JOINED_PAGES = 1000  # pages whose words are put together at once


def _parts_of_pages(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(page_id, block, line, word, text, confidence) as one row per run of words of a page: how many have text, the sum and number of the
    known confidences, and the places, sizes and letters of the words with text, as bytes."""
    page = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
    heads = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
    owner = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(page))))
    text = pc.utf8_trim(batch.column(4).cast(pa.string()).fill_null(""), tx.WHITESPACE_CHARS)
    full = pc.not_equal(text, "")
    text, full = text.filter(full).cast(pa.binary()), full.to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.bincount(owner[full], minlength=len(heads)))
    places = np.stack([batch.column(i).fill_null(NO_PLACE).to_numpy()[full] for i in (1, 2, 3)], axis=1)
    sizes = pc.binary_length(text).to_numpy().astype(np.int32)
    sure = batch.column(5)
    known = sure.is_valid().to_numpy(zero_copy_only=False)
    total = np.bincount(owner, weights=sure.fill_null(0.0).to_numpy(), minlength=len(heads))

    def cut(data: np.ndarray, width) -> pa.Array:
        offsets = np.append(0, ends * width if isinstance(width, int) else np.append(0, np.cumsum(width))[ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])

    bounds = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    letters = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    columns = [
        batch.column(0).take(pa.array(heads)), pa.array(np.diff(ends, prepend=0)), pa.array(total), pa.array(np.bincount(owner, weights=known, minlength=len(heads)).astype(np.int64)),
        cut(places, 24), cut(sizes, 4), cut(letters, sizes),
    ]
    return pa.RecordBatch.from_arrays(columns, ["page_id", "words_count", "total", "known", "places", "sizes", "letters"])


def _joined_parts(parts: pa.ListArray) -> pa.Array:
    """The text of each page from its parts (places, sizes, letters)."""
    bounds = parts.offsets.to_numpy().astype(np.int64)
    held = parts.values.slice(bounds[0], bounds[-1] - bounds[0])
    places, sizes, letters = (held.field(i) for i in range(3))
    count = pc.binary_length(sizes).to_numpy().astype(np.int64) >> 2
    page = np.repeat(np.repeat(np.arange(len(parts)), np.diff(bounds)), count)

    def run(column: pa.Array, kind: type) -> np.ndarray:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer((column.buffers()[2] or b"")[offsets[0] : offsets[-1]], kind) if len(column) else np.empty(0, kind)

    place, size = run(places, np.int64).reshape(-1, 3), run(sizes, np.int32)
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(run(letters, np.uint8))])
    keys = [page, *place.T]
    ahead, equal = np.zeros(max(len(page) - 1, 0), bool), np.ones(max(len(page) - 1, 0), bool)
    for key in keys:
        ahead |= equal & (key[1:] > key[:-1])
        equal &= key[1:] == key[:-1]
    if not ahead.all():
        names = ["page", "block", "line", "word", "text"]
        order = pc.sort_indices(pa.table([*map(pa.array, keys), words.cast(pa.binary())], names), [(n, "ascending") for n in names]).to_numpy()
        words, keys = words.take(pa.array(order)), [key[order] for key in keys]
    page, block, line = keys[:3]
    new = [np.append(True, (key[1:] != key[:-1]) & (key[1:] != NO_PLACE) & (key[:-1] != NO_PLACE))[: len(page)] for key in (block, line)]
    first = np.append(True, page[1:] != page[:-1])[: len(page)]
    gap = pa.array(["", " ", "\n", "\n\n"]).take(pa.array(np.where(first, 0, np.where(new[0], 3, np.where(new[1], 2, 1)))))
    pieces = pc.binary_join_element_wise(gap, words, "")
    ends = np.searchsorted(page, np.arange(len(parts)), side="right")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pieces), "")


def page_text_from_words(words: DataFrame) -> DataFrame:
    """Words to lines, lines to blocks, blocks to the text of a page, with the mean known confidence.

    Words without text count for the confidence alone; a page of such words has an empty text.
    Words that lie together are shuffled as one row of bytes, so a table in which the words of a page follow each other has few rows to shuffle."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_parts_of_pages(batch) for batch in batches if batch.num_rows)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, JOINED_PAGES):
                part = batch.slice(low, JOINED_PAGES)
                yield pa.RecordBatch.from_arrays([part.column(0), _joined_parts(part.column(3)), part.column(1), part.column(2)], ["page_id", "text", "words_count", "mean_confidence"])

    kind = words.schema["page_id"].dataType.simpleString()
    plain = words.select("page_id", *(F.col(c).cast("bigint").alias(c) for c in ("block", "line", "word")), "text", F.col("confidence").cast("double").alias("confidence"))
    parts = plain.mapInArrow(gather, PART.format(kind))
    known, total = F.sum("known"), F.sum("total")
    # Every group is part of one page.
    pages = parts.groupBy("page_id").agg(
        F.sum("words_count").alias("words_count"), F.round(F.when(known > 0, total / known), 4).alias("mean_confidence"), F.collect_list(F.struct("places", "sizes", "letters")).alias("parts")
    )
    return pages.mapInArrow(join, f"page_id {kind}, text string, words_count bigint, mean_confidence double")


def polygon_box(polygon: Column, width: Column, height: Column) -> Column:
    """Pixel box around a quad, clamped to the page."""

    def clamp(value: Column, most: Column) -> Column:
        return F.when(F.isnan(value) | (value <= 0), 0).when(value >= most, most).otherwise(value).cast("bigint")

    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.struct(
        clamp(F.floor(F.array_min(xs)).cast("double"), width).alias("left"),
        clamp(F.floor(F.array_min(ys)).cast("double"), height).alias("top"),
        clamp(F.ceil(F.greatest(F.array_max(xs), F.lit(0.0))).cast("double"), width).alias("right"),
        clamp(F.ceil(F.greatest(F.array_max(ys), F.lit(0.0))).cast("double"), height).alias("bottom"),
    )


def reading_order(lines: DataFrame, banded: bool = False) -> DataFrame:
    """Recognised lines (``page_id, line_id, polygon, text, confidence, width_px, height_px``) in reading order.

    Order is by top edge, then left edge; ``banded`` compares the top edge in bands of a few pixels. Lines without
    text drop out. Groups are the lines of one page."""
    boxed = lines.filter(tx.trim(F.col("text")) != "").withColumn("box", polygon_box(F.col("polygon"), F.col("width_px"), F.col("height_px")))
    top = F.floor(F.col("box.top") / BAND_PX) if banded else F.col("box.top")
    position = F.row_number().over(W.partitionBy("page_id").orderBy(top, F.col("box.left"), F.col("line_id")))
    return boxed.select("page_id", "line_id", position.cast("bigint").alias("position"), tx.trim(F.col("text")).alias("text"), "box.*", "confidence")


GEOMETRY = ("crop_left", "crop_bottom", "crop_right", "crop_top", "rotation", "width_px", "height_px")


def word_geometry(words: DataFrame, geometry: DataFrame | None = None) -> DataFrame:
    """Word boxes from image pixels to page coordinates, with the horizontal scale that fits the text to its box.

    ``geometry`` has one row per page: ``page_id, crop_left, crop_bottom, crop_right, crop_top, rotation, width_px,
    height_px``; without it the words have these columns (:func:`hocr_words` keeps them), and nothing is shuffled. The image is the page as
    displayed, so a quarter turn swaps its sides."""
    c = F.col
    placed = words if geometry is None else words.join(geometry, "page_id")
    # What several expressions use is a column of its own, so it is worked out once and the generated code stays small.
    width, height = c("crop_right") - c("crop_left"), c("crop_top") - c("crop_bottom")
    sideways = c("turn").isin(90, 270)
    sized = placed.select(
        "page_id", "block", "line", "word", "crop_left", "crop_bottom", width.alias("width"), height.alias("height"), F.pmod(c("rotation"), F.lit(360)).alias("turn"),
        F.least("left", "right").alias("x0"), F.greatest("left", "right").alias("x1"), F.greatest("top", "bottom").alias("y0"), F.least("top", "bottom").alias("y1"),
        "width_px", "height_px", F.length(F.trim("text", F.lit(tx.WHITESPACE_CHARS))).alias("letters"),
    )
    shown_w, shown_h = F.when(sideways, c("height")).otherwise(c("width")), F.when(sideways, c("width")).otherwise(c("height"))
    scaled = sized.withColumns(
        {"x_scale": shown_w / F.greatest(c("width_px"), F.lit(1)), "y_scale": shown_h / F.greatest(c("height_px"), F.lit(1)), "shown_h": shown_h}
    )
    # The displayed rectangle (x0, y0)-(x1, y1).
    shown = scaled.withColumns({x: c(x) * c("x_scale") for x in ("x0", "x1")} | {y: c("shown_h") - c(y) * c("y_scale") for y in ("y0", "y1")})
    # Turned back: which displayed edge becomes which page edge.
    straight = tuple(map(c, ("x0", "y0", "x1", "y1")))
    x0, y0, x1, y1 = straight
    turned = {
        90: (y0, c("height") - x1, y1, c("height") - x0),
        180: (c("width") - x1, c("height") - y1, c("width") - x0, c("height") - y0),
        270: (c("width") - y1, x0, c("width") - y0, x1),
    }

    def edge(n: int, origin: str) -> Column:
        value = straight[n]
        for angle, edges in turned.items():
            value = F.when(c("turn") == angle, edges[n]).otherwise(value)
        return c(origin) + value

    boxed = shown.select(
        "page_id", "block", "line", "word", "letters",
        edge(0, "crop_left").alias("x_min"), edge(1, "crop_bottom").alias("y_min"),
        edge(2, "crop_left").alias("x_max"), edge(3, "crop_bottom").alias("y_max"),
    )
    boxed = boxed.withColumn("size", F.greatest(c("y_max") - c("y_min"), F.lit(1.0)))
    box_w = F.greatest(c("x_max") - c("x_min"), F.lit(1.0))
    natural = F.greatest(c("letters"), F.lit(1)) * c("size") * 0.5
    low, high = SCALE_BOUNDS
    scale = F.least(F.greatest(box_w / natural * 100.0, F.lit(low)), F.lit(high))
    boxed = boxed.select("page_id", "block", "line", "word", "x_min", "y_min", "x_max", "y_max", "size", scale.alias("scale"))
    rounded = [_rounded(c(name)).alias(name) for name in ("x_min", "y_min", "x_max", "y_max")]
    return boxed.select("page_id", "block", "line", "word", *rounded, _rounded(c("size")).alias("font_size"), _rounded(c("scale")).alias("horizontal_scale"))


def _rounded(value: Column) -> Column:
    """``value`` to four decimals, as ``F.round`` gives it, which goes by way of the decimal text of each number. Away from the middle
    between two results the nearest whole number of ten-thousandths is the same number."""
    steps = value * 10000.0
    plain = (F.abs(value) < 1e6) & (F.abs(steps - F.floor(steps) - 0.5) > 1e-3)
    return F.when(plain, F.floor(steps + 0.5).cast("double") / 10000.0).otherwise(F.round(value, 4))


def text_extent(boxes: DataFrame) -> DataFrame:
    """Smallest rectangle around the words of every page."""
    return boxes.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("words"), F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max")
    )
