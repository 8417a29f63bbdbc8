"""Recognition markup made of the text of pages, many pages at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

TOGETHER = 500_000  # bytes of text that are marked up at once
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WIDE_SPACES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def _put(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "", null_handling="replace")


def _text(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers).cast(pa.string())


def _lists(ends: np.ndarray, values: pa.Array, glue: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values), glue)


def marked(texts: pa.Array, page_ids: np.ndarray, known: np.ndarray) -> pa.Array:
    """The markup of texts without nulls; a page without an id (not ``known``) has no words."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if (data >= 0x80).any():
        data = np.frombuffer(WIDE_SPACES.sub(lambda m: b" " * len(m.group()), data.tobytes()), np.uint8)
    breaks = np.flatnonzero(data == 10)
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    solid = ~SPACES[data]
    starts = np.flatnonzero(solid & (np.append(True, ~solid[:-1]) | edge[:-1])[: len(data)])
    ends = np.flatnonzero(solid & (np.append(~solid[1:], True) | edge[1:])[: len(data)]) + 1
    page = np.searchsorted(bounds, starts, side="right") - 1
    there = known[page]
    starts, ends, page = starts[there], ends[there], page[there]
    # Lines: one more than the breaks of a page.
    above = np.searchsorted(breaks, bounds)
    line_ends = above[1:] + np.arange(1, len(texts) + 1)
    line_page = np.repeat(np.arange(len(texts)), np.diff(np.append(0, line_ends)))
    line_no = np.arange(len(line_page)) - np.append(0, line_ends)[line_page]
    line = np.searchsorted(breaks, starts) + page
    n = line_no[line]
    word_ends = np.searchsorted(line, np.arange(len(line_page)), side="right")
    j = np.arange(len(starts)) - np.append(0, word_ends)[line]
    offsets = np.empty(2 * len(starts) + 2, np.int32)
    offsets[0], offsets[-1], offsets[1:-1:2], offsets[2:-1:2] = 0, len(data), starts, ends
    every = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    words = every.take(pa.array(np.arange(1, 2 * len(starts), 2))).cast(pa.string())
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    for raw, entity in ENTITIES:
        if (data == ord(raw)).any():
            words = pc.replace_substring(words, raw, entity)
    at, left = n + j, j * 50
    box = _put("bbox ", _text(left), " ", _text(n * 40), " ", _text(left + 10 * size), " ", _text(n * 40 + 30))
    sure = np.fmod(page_ids[page] + n * 7 + j * 13, 100)
    choose = lambda where, yes, no: pc.if_else(pa.array(where), yes, no)
    box = choose(at % 17 == 0, "", box)
    confidence = choose(sure % 10 == 0, "", _put("; x_wconf ", _text(sure)))
    nested = at % 11 == 5
    opening, closing = choose(nested, "<span lang='en'>", ""), choose(nested, "</span></span>", "</span>")
    words = _put("<span class='ocrx_word' title='", box, confidence, "'>", opening, words, choose(at % 13 == 6, "  x", ""), closing)
    even = line_no % 2 == 0
    blank = choose(even, "<span class='ocrx_word' title='x_wconf 50'> </span></span>", "<span class='ocrx_word' title=''> </span></span>")
    ended = known[line_page] & (page_ids[line_page] % 5 == 0) & (line_no == 2)
    lines = _put(choose(even, "<div class='ocr_carea'>", ""), "<span class='ocr_line'>", _lists(word_ends, words, "\n"), blank, choose(ended, "</div>", ""))
    return _put("<div class='ocr_page'>", _lists(line_ends, lines, "\n"), "</div></div>")


def with_markup(pages: DataFrame) -> DataFrame:
    """The columns of ``pages`` without ``text``, and the markup made of it."""
    kept = [c for c in pages.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(0).cast(pa.string()), batch.column(1 + kept.index("page_id")).cast(pa.int64())
            filled, known, numbers = texts.fill_null(""), ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            ends = np.cumsum(pc.binary_length(filled).to_numpy().astype(np.int64))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TOGETHER, side="right")))
                made = marked(filled.slice(low, high - low), numbers[low:high], known[low:high])
                made = pc.if_else(texts.slice(low, high - low).is_valid(), made, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(low, high - low) for i in range(1, len(kept) + 1)), made], [*kept, "hocr"])
                low = high

    schema = [*((c, pages.schema[c].dataType.simpleString()) for c in kept), ("hocr", "string")]
    return pages.select("text", *kept).mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in schema))
