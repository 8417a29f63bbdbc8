"""Column expressions over text. Everything here is built-in functions, so it stays inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space property, as a regex character class body.
WHITESPACE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITESPACE_CHARS = "\t\n\v\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Combining diacritics are part of a token but carry no weight in it.
MARKS = "\u0300-\u036f"
TOKEN = f"[\\p{{L}}\\p{{N}}\\p{{Co}}][\\p{{L}}\\p{{N}}\\p{{Co}}{MARKS}]*"


def _accent_table() -> tuple[str, str]:
    """Lower-case letters whose canonical decomposition starts with an ASCII letter, and those ASCII letters."""
    source, target = [], []
    for point in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(point)
        base = unicodedata.normalize("NFD", letter)[0]
        if letter.islower() and base != letter and base.isascii() and base.isalpha():
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_table()


def trim(text: Column) -> Column:
    """Strip Unicode white space from both ends (``F.trim`` knows only the space character)."""
    return F.regexp_replace(text, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one space and strip the ends."""
    return F.trim(F.regexp_replace(text, f"[{WHITESPACE}]+", " "))


def excerpt(text: Column, limit: int) -> Column:
    """White space collapsed, cut to ``limit`` characters with an ellipsis when something was cut."""
    flat = squeeze(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("…")))


def non_blank(text: Column) -> Column:
    """The text unchanged, or NULL when it holds nothing but white space."""
    return F.when(trim(text) != "", text)


def basename(path: Column) -> Column:
    """Last segment of a path with either kind of separator."""
    return F.regexp_extract(F.regexp_replace(path, r"[\\/]+$", ""), r"([^\\/]*)$", 1)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def file_extension(name: Column) -> Column:
    """Extension without the dot, NULL when the name has none."""
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))


def document_name(display_name: Column, original_path: Column) -> Column:
    """The name shown for a document: its display name, or the file name where that is blank."""
    return F.coalesce(non_blank(display_name), basename(original_path))


def fold(text: Column) -> Column:
    """Lower case without diacritics; letters that only look accented (such as sharp s) stay."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), f"[{MARKS}]", "")


def tokens(text: Column) -> Column:
    """Index tokens of a text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def ascii_lower(text: Column) -> Column:
    """Lower-case only A-Z, the way a case-insensitive LIKE compares."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def epoch_seconds(ts: Column) -> Column:
    return F.floor(epoch_micros(ts) / 1_000_000).cast("bigint")
