"""Marking a searched phrase in a table of texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions import text as tx

# Fixed values.
MAX_WORDS = 24
DASHES = "[-\u2010-\u2015\u2212]"
BLANKS = f"{tx.WHITESPACE}\ufeff"
LETTER = "[\\p{L}\\p{N}]"

# Code points that are never text: begin and end of a hit, and the seam between two items.
BEGIN, END, SEAM = "\ufdd0", "\ufdd1", "\ufdd2"

UNIT = re.compile(r"(?P<letters>[^\W_]+)|(?P<dash>-)|(?P<sign>[_/()])|(?P<blank>\s+)", re.IGNORECASE)


def phrase_expression(query: str, blanks: str, apart: bool) -> str | None:
    """Java expression of a phrase, or None where the query has nothing to look for.

    The query is read once, unit by unit: runs of letters and digits, signs and dashes stand for themselves, a dash for
    any dash with ``blanks`` around it; whatever else is typed is passed over. Between two words there are ``blanks``,
    at least one of them if ``apart``. A phrase that begins or ends in letters does not begin or end inside a run of them.
    """
    parts, kinds, words, between = [], [], 0, True
    for unit in UNIT.finditer(query.lower()):
        kind = unit.lastgroup
        if kind == "blank":
            between = True
            continue
        if between:
            if words == MAX_WORDS:
                break
            if words:
                parts.append(f"[{blanks}]" + ("+" if apart else "*"))
            words, between = words + 1, False
        kinds.append(kind)
        parts.append(f"[{blanks}]*{DASHES}[{blanks}]*" if kind == "dash" else f"\\Q{unit[0]}\\E")
    if not kinds:
        return None
    edges = [f"(?<!{LETTER})" if kinds[0] == "letters" else "", f"(?!{LETTER})" if kinds[-1] == "letters" else ""]
    return "(?iu)" + "".join(parts).join(edges)


def _plain(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BEGIN + END + SEAM, "")


def _html(marked: Column) -> Column:
    escaped = tx.escape_html(F.replace(marked, F.lit(BEGIN + END), F.lit("")))
    return F.replace(F.replace(escaped, F.lit(BEGIN), F.lit("<mark>")), F.lit(END), F.lit("</mark>"))


def phrase_highlight(texts: DataFrame, query: str, column: str = "text") -> DataFrame:
    """Number of phrase hits and the escaped text with the hits marked. Whole texts, one pass, no shuffle."""
    expression = phrase_expression(query, BLANKS, apart=True)
    text = _plain(F.col(column))
    if expression is None:
        return texts.withColumn("hits", F.lit(0).cast("bigint")).withColumn("html", tx.escape_html(text))
    hits = F.regexp_count(text, F.lit(expression)).cast("bigint")
    return texts.withColumn("hits", hits).withColumn("html", _html(F.regexp_replace(text, expression, f"{BEGIN}$0{END}")))


def highlight_items(items: DataFrame, query: str) -> DataFrame:
    """Mark phrase hits that may run across the text items of a page (``page_id, item_no, text``).

    The items of a page become one text with seams, which count as blanks; hits are marked there, a hit is closed before
    each seam in it and opened again behind it, and the text is taken apart at its seams. Linear in the text of a page.
    Groups are the items of one page."""
    expression = phrase_expression(query, BLANKS + SEAM, apart=False)
    if expression is None:
        return items.select("page_id", "item_no", tx.escape_html(_plain(F.col("text"))).alias("html"))
    in_order = F.sort_array(F.collect_list(F.struct("item_no", _plain(F.col("text")).alias("text"))))
    pages = items.groupBy("page_id").agg(in_order.alias("items"))
    marked = F.regexp_replace(F.array_join("items.text", SEAM), expression, f"{BEGIN}$0{END}")

    def reopened(part: Column) -> Column:
        """What follows the begin of a hit: the hit itself, its end, and text without a hit."""
        hit = F.substring_index(part, END, 1)
        return F.concat(F.replace(hit, F.lit(SEAM), F.lit(END + SEAM + BEGIN)), F.substr(part, F.length(hit) + 1))

    parts = F.split("marked", BEGIN)
    whole = F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2), F.size(parts)), reopened)), BEGIN)
    pieces = pages.withColumn("marked", marked).withColumn("html", F.split(whole, SEAM))
    rows = pieces.select("page_id", F.explode(F.arrays_zip(F.col("items.item_no").alias("item_no"), "html")).alias("item"))
    return rows.select("page_id", "item.item_no", _html(F.col("item.html")).alias("html"))
