"""Recognition markup of pages as columns of words.

Pages whose tags are plain are read together, as arrays over the bytes of many pages (:func:`words_of_pages`). A page with anything
else in it (comments, quotes of both kinds in a tag, tags that are never closed in a word) is read piece by piece (:func:`words_of`),
which says what a word is; both readers give the same words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliary.functions import text as tx

# Class names of recognition markup.
BLOCK_CLASSES, LINE_CLASS, WORD_CLASS = ("ocr_carea", "ocrx_block"), "ocr_line", "ocrx_word"

# A whole word without inner markup comes as one piece; all else as a tag, or the text up to the next one.
PIECE = re.compile(
    r"""<(?P<word>[sS][pP][aA][nN]\b(?:[^>"']|"[^"]*"|'[^']*')*(?<!/))>(?P<inner>[^<]*)</[sS][pP][aA][nN]\s*>|<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(?P<tag>(?:[^>"']|"[^"]*"|'[^']*')*)>|(?P<text>[^<]+)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""\b(class|title)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
BOX = re.compile(r"bbox\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)")
CONFIDENCE = re.compile(r"x_wconf\s+([0-9.+-]+)")
REFERENCES = re.compile(r"&(?:(lt|gt|quot|apos|amp)|#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7}));")
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def _resolved(found: re.Match) -> str:
    name, digits, decimal = found.groups()
    if name:
        return NAMED[name]
    code = int(digits, 16) if digits else int(decimal)
    return chr(code) if 0 < code < 0xD800 or 0xE000 <= code <= 0x10FFFF else found.group()


def _resolve(text: str) -> str:
    return REFERENCES.sub(_resolved, text) if "&" in text else text


def _attributes(tag: str) -> tuple[str, str]:
    kept = {"class": "", "title": ""}
    for name, double, single in ATTRIBUTE.findall(tag):
        kept[name] = double or single
    return kept["class"], _resolve(kept["title"])


def _facts(title: str) -> tuple[tuple[int, int, int, int], float | None]:
    """Box and confidence in a title."""
    box, sure = BOX.search(title), CONFIDENCE.search(title)
    try:
        confidence = float(sure.group(1)) if sure else None
    except ValueError:
        confidence = None
    return tuple(map(int, box.groups())) if box else (0, 0, 0, 0), confidence


def _kind(name: str, classes: str) -> str:
    """What an element is to the page: block, line, word or nothing."""
    if name == "div":
        return "block" if any(c in classes for c in BLOCK_CLASSES) else ""
    return "line" if LINE_CLASS in classes else "word" if WORD_CLASS in classes else ""


def words_of(markup: str) -> Iterator[tuple]:
    """(block, line, word, text, left, top, right, bottom, confidence) of every word of a page, in one pass over its pieces.

    A word that is not blank takes the next place; opening or closing a line or block starts a new one there, once such a
    word follows. Blank words have no place."""
    at = [-1, -1, -1]
    fresh = 0  # what the next word starts: 0 a block, 1 a line, 2 neither
    opened = {"div": [], "span": []}
    title, parts = None, []

    def finished() -> tuple:
        nonlocal fresh
        text, (sides, confidence) = "".join(parts), _facts(title)
        if not text.strip(tx.WHITESPACE_CHARS):
            return (None, None, None, "", *sides, confidence)
        at[fresh] += 1
        at[fresh + 1 :] = [0] * (2 - fresh)
        fresh = 2
        return (*at, text, *sides, confidence)

    for piece in PIECE.finditer(markup):
        whole, tag, text = piece["word"], piece["tag"], piece["text"]
        if whole is not None and title is None:
            classes, found = _attributes(whole)
            kind = _kind("span", classes)
            if kind == "word":
                title, parts = found, [_resolve(piece["inner"].strip(" \t\r\n"))]
                yield finished()
                title = None
            elif kind == "line":
                fresh = min(fresh, 1)
        elif whole is not None:  # a span inside a word
            parts.append(_resolve(piece["inner"].strip(" \t\r\n")))
        elif text is not None:
            if title is not None:
                parts.append(_resolve(text.strip(" \t\r\n")))
        elif tag:
            name = tag.strip("/").split(None, 1)[0].lower() if tag.strip("/ \t\r\n") else ""
            if name not in opened:
                continue
            if tag[0] == "/":
                kind = opened[name].pop() if opened[name] else ""
                if kind == "word" and title is not None:
                    yield finished()
                    title = None
                elif kind in ("block", "line"):
                    fresh = min(fresh, 0 if kind == "block" else 1)
                continue
            classes, found = _attributes(tag)
            kind = _kind(name, classes)
            if tag[-1] == "/":
                if kind == "word":
                    before = title, parts
                    title, parts = found, []
                    yield finished()
                    title, parts = before
                continue
            opened[name].append(kind)
            if kind == "word":
                title, parts = found, []
            elif kind:
                fresh = min(fresh, 0 if kind == "block" else 1)
    if title is not None:
        yield finished()


# ---- many pages at once ----------------------------------------------------------------------------------------------

LONG_PAGE = 8_000_000  # bytes of a page from which it is read piece by piece
TOGETHER = 2_000_000  # bytes of the pages that are read together
NOTHING, BLOCK, LINE, WORD = range(4)
KINDS = {"": NOTHING, "block": BLOCK, "line": LINE, "word": WORD}
OTHER, DIV, SPAN = range(3)
SAFE_DIGITS = 15  # of a number that a float holds exactly
FOREIGN = np.isin(np.arange(256), [ord(c) for c in "!?ABCEFGHIJKLMNOPQRTUVWXYZabcefghijklmnopqrtuvwxyz"])  # first of a name that is no div or span
TYPES = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 4 + [pa.float64()]


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pieces of a run of bytes, in order and without overlap, as a binary column."""
    offsets = np.empty(2 * len(starts) + 2, np.int32)
    offsets[0], offsets[-1] = 0, len(data)
    offsets[1:-1:2], offsets[2:-1:2] = starts, ends
    every = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return every.take(pa.array(np.arange(1, 2 * len(starts), 2)))


def _lookup(pieces: pa.Array, value) -> np.ndarray:
    """``value`` of the text of each piece, worked out once for pieces that are equal."""
    coded = pieces.dictionary_encode()
    values = np.array([value(x.decode()) for x in coded.dictionary.to_pylist()], np.int64)
    return values[coded.indices.to_numpy()] if len(values) else np.empty(0, np.int64)


def _between(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.searchsorted(marks, ends) - np.searchsorted(marks, starts)


def _name(tag: str) -> int:
    """The element of a tag, as far as it counts here; -1 where its name is not plain."""
    found = tag.strip("/").split(None, 1)
    name = found[0].lower() if tag.strip("/ \t\r\n") else ""
    if tag[:1].isspace() or re.match(r"span\b.", name):
        return -1
    return {"div": DIV, "span": SPAN}.get(name, OTHER)


def _first_name(before: str) -> int:
    """The same from the text before the first value of a tag, which has to hold all of the name."""
    return _name(before) if len(before.strip("/").split(None, 1)) == 2 else -1


def _attribute(before: str) -> int:
    """Which attribute the text before a value names: 1 a class, 2 a title."""
    found = re.search(r"\b(class|title)\s*$", before)
    return 0 if not found else 1 if found.group(1) == "class" else 2


def _numbers(data: np.ndarray, is_digit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and value of each run of digits; the value of one of more than ``SAFE_DIGITS`` is not right."""
    edge = np.diff(is_digit.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size, value = ends - starts, np.zeros(len(starts), np.int64)
    for k in range(min(int(size.max(initial=0)), SAFE_DIGITS)):
        has = size > k
        value[has] = value[has] * 10 + (data[starts[has] + k] - 48)
    return starts, size, value


def _boxes(titles: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, tuple, float | None]]]:
    """Box and confidence of titles, and whether there is a confidence. What is not plain is read one by one and comes as a list."""
    n = len(titles)
    offsets = np.frombuffer(titles.buffers()[1], np.int32)[titles.offset : titles.offset + n + 1]
    data = np.frombuffer(titles.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    is_digit = (data >= 48) & (data <= 57)
    box, sure, known, odd = np.zeros((n, 4), np.int64), np.zeros(n), np.zeros(n, bool), []
    # Numbers that meet where two titles meet would be one run, so a space goes between titles.
    spaced = np.full(len(data) + n, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))
    spaced[place] = data
    digits = np.zeros(len(spaced), bool)
    digits[place] = is_digit
    starts, size, value = _numbers(spaced, digits)
    # Titles that differ in the digits of their numbers alone have one form, in which every number is a zero.
    kept = ~digits
    kept[starts] = True
    form = np.where(digits, 48, spaced)[kept].astype(np.uint8)
    ends = np.append(0, np.cumsum(kept))[offsets[1:] + np.arange(1, n + 1)].astype(np.int32)
    forms = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(np.int32(0), ends)), pa.py_buffer(form)]).dictionary_encode()
    which = forms.indices.to_numpy()
    first = np.searchsorted(starts, offsets[:-1] + np.arange(n))  # the first number of each title
    count = np.diff(np.append(first, len(starts)))
    large = np.zeros(n, bool)
    large[np.repeat(np.arange(n), count)[size > SAFE_DIGITS]] = True
    for number, raw in enumerate(forms.dictionary.to_pylist()):
        mine = np.flatnonzero(which == number)
        shape = raw[:-1].decode()  # without the space
        plain = shape.isascii() and "&" not in shape
        at, sign = BOX.search(shape), CONFIDENCE.search(shape)
        if plain and sign and sign.group(1) != "0":
            plain = False
        alone = mine if not plain else mine[large[mine]]
        for i in alone.tolist():
            odd.append((i, *_facts(_resolve(titles[i].as_py().decode()))))
        mine = mine[~large[mine]] if plain else mine[:0]
        if at:
            for side in range(4):
                box[mine, side] = value[first[mine] + shape.count("0", 0, at.start(side + 1))]
        if sign:
            sure[mine] = value[first[mine] + shape.count("0", 0, sign.start(1))]
            known[mine] = True
    return box, sure, known, odd


def _joined(texts: pa.Array, owner: np.ndarray, words: int) -> pa.Array:
    """The texts of each of ``words``, put together; texts lie in the order of their words."""
    if len(owner) == words and (owner == np.arange(words)).all():
        return texts
    bounds = np.searchsorted(owner, np.arange(words + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), texts), "")


def _plain_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[pa.Array], np.ndarray]:
    """Page, columns (block, line, word, text, sides, confidence) and order of the words of pages that lie one after the other in ``data``
    and end at ``ends``; and which pages are not plain, whose words are not to be used."""
    pages = len(ends)
    starts = np.append(0, ends[:-1])
    opens = np.flatnonzero(data == 60)
    page = np.searchsorted(ends, opens, side="right")
    odd = np.zeros(pages, bool)
    stop = np.minimum(np.append(opens[1:], len(data)), ends[page])
    closers = np.flatnonzero(data == 62)
    at = np.searchsorted(closers, opens)
    close = closers[np.minimum(at, len(closers) - 1)] if len(closers) else stop
    bad = (at >= len(closers)) | (close >= stop)
    begin = opens + 1
    bad[~bad] |= close[~bad] == begin[~bad]  # "<>"
    second, third = (data[np.minimum(begin + k, len(data) - 1)] for k in (0, 1))
    bad |= (second == 33) & ((third == 45) | (third == 91))  # comments and the like
    odd[page[bad]] = True
    good = ~odd[page]
    begin, close, stop, page = begin[good], close[good], stop[good], page[good]
    named = np.where(second == 47, third, second)[good]
    foreign = FOREIGN[named]  # neither div nor span, whatever follows
    # Quotes of one kind, in pairs, each behind an equals sign, and no other such sign: then every value is one of an attribute.
    single, double, equals = (np.flatnonzero(data == c) for c in (39, 34, 61))
    singles, doubles = _between(single, begin, close), _between(double, begin, close)
    bad = (singles & 1 | doubles & 1).astype(bool) | ((singles > 0) & (doubles > 0)) | ~foreign & (_between(equals, begin, close) * 2 != singles + doubles)
    odd[page[bad]] = True
    good = ~odd[page]
    begin, close, stop, page, foreign = begin[good], close[good], stop[good], page[good], foreign[good]
    quotes = np.sort(np.concatenate((single, double)))
    pairs = np.where(foreign, 0, (singles + doubles)[good] >> 1)
    tag = np.repeat(np.arange(len(begin)), pairs)
    inner = np.arange(len(tag)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    left = np.searchsorted(quotes, begin)[tag] + 2 * inner
    value_begin, value_end = (quotes[left] + 1, quotes[left + 1]) if len(left) else (left, left)
    before = np.where(inner == 0, begin[tag], np.append(0, value_end[:-1] + 1) if len(tag) else 0)
    named = value_begin - 2
    bad = (data[np.maximum(named, 0)] != 61) | (named < before)
    odd[page[tag[bad]]] = True
    if odd.any():  # begin again without these pages, whose bytes are blanked
        for k in np.flatnonzero(odd).tolist():
            data[starts[k] : ends[k]] = 32
        owner, columns, more = _plain_words(data, ends)
        return owner, columns, odd | more
    attribute = _lookup(_cut(data, before, named), _attribute)
    heads = inner == 0
    name = np.full(len(begin), OTHER, np.int64)
    name[pairs > 0] = _lookup(_cut(data, before[heads], named[heads]), _first_name)
    bare = (pairs == 0) & ~foreign
    name[bare] = _lookup(_cut(data, begin[bare], close[bare]), _name)
    odd[page[name < 0]] = True
    closing, closed = data[begin] == 47, data[close - 1] == 47
    # The last of an attribute counts.
    classes, titles = attribute == 1, attribute == 2
    class_of, title_of = np.full(len(begin), -1), np.full(len(begin), -1)
    class_of[tag[classes]], title_of[tag[titles]] = np.flatnonzero(classes), np.flatnonzero(titles)
    kind = np.zeros(len(begin), np.int64)
    shown = np.flatnonzero((class_of >= 0) & (name > OTHER) & ~closing)
    for element, label in ((DIV, "div"), (SPAN, "span")):
        mine = shown[name[shown] == element]
        held = class_of[mine]
        kind[mine] = _lookup(_cut(data, value_begin[held], value_end[held]), lambda c, label=label: KINDS[_kind(label, c)])
    element = name > OTHER
    end_tag, self_closed = closing & element, closed & element & ~closing
    start_tag = element & ~closing & ~closed
    # A span that holds text alone is one piece.
    simple = np.zeros(len(begin), bool)
    if len(begin) > 1:
        short = end_tag & (name == SPAN) & (pairs == 0)
        short[short] = _lookup(_cut(data, begin[short], close[short]), lambda t: bool(re.fullmatch(r"/[sS][pP][aA][nN]\s*", t))).astype(bool)
        simple[:-1] = start_tag[:-1] & (name[:-1] == SPAN) & short[1:] & (page[1:] == page[:-1])
    second_half = np.append(False, simple[:-1]) if len(simple) else simple
    # Which tag an end tag closes: of the tags of its page at its depth, the one before it.
    partner = np.full(len(begin), -1)
    for which in (DIV, SPAN):
        mine = np.flatnonzero((name == which) & (start_tag | end_tag) & ~simple & ~second_half)
        if not len(mine):
            continue
        step = np.where(end_tag[mine], -1, 1)
        depth = np.cumsum(step)
        first = np.append(True, page[mine][1:] != page[mine][:-1])
        depth -= np.repeat((depth - step)[first], np.diff(np.append(np.flatnonzero(first), len(mine))))
        odd[page[mine[depth < 0]]] = True
        level = depth + (step < 0)
        order = np.lexsort((level, page[mine]))
        ranked = mine[order]
        after = np.flatnonzero(end_tag[ranked[1:]] & (page[ranked[1:]] == page[ranked[:-1]]))
        partner[ranked[after + 1]] = ranked[after]
    kind[end_tag] = np.where(partner[end_tag] >= 0, kind[partner[end_tag]], NOTHING)
    last = np.full(len(begin), -1)  # the tag that ends a word
    word_ends = np.flatnonzero(end_tag & (kind == WORD) & ~second_half)
    last[partner[word_ends]] = word_ends
    whole = start_tag & (kind == WORD) & ~simple
    odd[page[whole & (last < 0)]] = True  # a word that is never closed
    # Where a word of several pieces is open, nothing but its text may come.
    long_words = np.flatnonzero(whole & (last >= 0))
    depth = np.zeros(len(begin) + 1, np.int64)
    np.add.at(depth, long_words + 1, 1)
    np.add.at(depth, last[long_words], -1)
    in_word = np.cumsum(depth)[:-1] > 0
    odd[page[in_word & (kind != NOTHING) & ~simple & ~second_half]] = True
    first = np.flatnonzero(((kind == WORD) & (simple | self_closed) & ~in_word) | (whole & (last >= 0)))
    final = np.where(simple[first], first + 1, np.where(self_closed[first], first, last[first]))
    event = (kind != NOTHING) & (kind != WORD) & ~in_word & ~self_closed & ~second_half
    block_events, line_events = np.append(0, np.cumsum(event & (kind == BLOCK))), np.append(0, np.cumsum(event & (kind == LINE)))
    # Text: the pieces between the tags of a word, trimmed and resolved one by one.
    size = np.maximum(final - first, 0)
    owner = np.repeat(np.arange(len(first)), size)
    piece = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    plain = ~odd[page[piece]]
    owner, piece = owner[plain], piece[plain]
    texts = pc.ascii_trim(_cut(data, close[piece] + 1, stop[piece]).cast(pa.string()), " \t\r\n")
    marked = np.flatnonzero(pc.match_substring(texts, "&").to_numpy(zero_copy_only=False))
    if len(marked):
        mask = np.zeros(len(texts), bool)
        mask[marked] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([_resolve(t) for t in texts.take(pa.array(marked)).to_pylist()], pa.string()))
    texts = _joined(texts, owner, len(first))
    keep = ~odd[page[first]]
    first, texts = first[keep], texts.filter(pa.array(keep))
    blank = pc.equal(pc.utf8_trim(texts, tx.WHITESPACE_CHARS), "").to_numpy(zero_copy_only=False)
    where = page[first]
    # Places: a block or line that was opened or closed since the word before starts a new one.
    full = np.flatnonzero(~blank)
    blocks, lines, at_page = block_events[first[full]], line_events[first[full]], where[full]
    new_page = np.append(True, at_page[1:] != at_page[:-1])[: len(full)]
    new_block = new_page | np.append(True, blocks[1:] != blocks[:-1])[: len(full)]
    new_line = new_block | np.append(True, lines[1:] != lines[:-1])[: len(full)]

    def since(count: np.ndarray, restart: np.ndarray) -> np.ndarray:
        return count - np.repeat(count[restart], np.diff(np.append(np.flatnonzero(restart), len(count))))

    places = [since(np.cumsum(new_block), new_page), since(np.cumsum(new_line), new_block), since(np.arange(len(full)), new_line)]
    held = title_of[first]
    empty = np.zeros(len(first), np.int64)
    # words without a title take an empty piece at their own tag
    from_, to = np.where(held >= 0, value_begin[held] if len(value_begin) else empty, begin[first]), np.where(held >= 0, value_end[held] if len(value_end) else empty, begin[first])
    box, sure, known, special = _boxes(_cut(data, from_, to))
    for i, sides, confidence in special:
        box[i], sure[i], known[i] = sides, confidence or 0.0, confidence is not None
    columns = []
    for place in places:
        value = np.zeros(len(first), np.int64)
        value[full] = place
        columns.append(pa.array(value, mask=blank))
    columns.append(pc.if_else(pa.array(blank), "", texts))
    columns += [pa.array(np.ascontiguousarray(box[:, side])) for side in range(4)]
    columns.append(pa.array(sure, mask=~known))
    return where, columns, odd


def _one_by_one(markup: str, most: int) -> Iterator[list[pa.Array]]:
    found = []
    for word in words_of(markup):
        found.append(word)
        if len(found) == most:
            yield [pa.array(c, kind) for c, kind in zip(zip(*found), TYPES)]
            found = []
    if found:
        yield [pa.array(c, kind) for c, kind in zip(zip(*found), TYPES)]


def words_of_pages(pages: pa.Array, most: int) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """The words of a string column of markup, in the order of pages, at most ``most`` at a time: the number of the page of each word,
    and the columns of :func:`words_of`."""
    pages = pages.cast(pa.binary()).fill_null(b"")
    if not len(pages):
        return
    bounds = np.frombuffer(pages.buffers()[1], np.int32)[pages.offset : pages.offset + len(pages) + 1].astype(np.int64)
    every, low = np.frombuffer(pages.buffers()[2] or b"", np.uint8), 0
    while low < len(pages):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + TOGETHER, side="right")) - 1)
        if high - low > 1 or bounds[high] - bounds[low] <= LONG_PAGE:
            where, columns, odd = _plain_words(every[bounds[low] : bounds[high]].copy(), bounds[low + 1 : high + 1] - bounds[low])
        else:
            where, columns, odd = np.empty(0, np.int64), [pa.array([], kind) for kind in TYPES], np.array([True])
        at = 0
        for number in [*np.flatnonzero(odd).tolist(), high - low]:
            upto = int(np.searchsorted(where, number))
            for begin in range(at, upto, most):
                size = min(most, upto - begin)
                yield low + where[begin : begin + size], [c.slice(begin, size) for c in columns]
            at = upto
            if number < high - low:
                for found in _one_by_one(pages[low + number].as_py().decode(), most):
                    yield np.full(len(found[0]), low + number), found
        low = high
