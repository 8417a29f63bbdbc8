"""Suffix arrays in numpy: whole ones by induced sorting, sparse ones to a bounded depth by radix."""

from __future__ import annotations

import numpy as np


def _is_smaller(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one (S type). ``s`` ends with its unique smallest symbol."""
    step = (s[1:] > s[:-1]).astype(np.int8) - (s[1:] < s[:-1])
    # a run of equal symbols has the type that the first different symbol after it gives
    at = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(step[following] > 0, True)


def _scan(sa: np.ndarray, s: np.ndarray, wanted: np.ndarray, pointer: np.ndarray, forward: bool) -> None:
    """Induce the suffixes of one type from those already in ``sa``, in place.

    Every entry v, in order, puts v - 1 (if it is of the ``wanted`` type) at the pointer of its bucket, which moves on.
    Entries are taken in blocks: as no target lies before its source, the targets of a block can be worked out together,
    and a block ends where its first target would fall into it.
    """
    n, at, size, sign = len(sa), 0, 1024, 1 if forward else -1
    while at < n:
        end = min(at + size, n)
        block = sa[at:end] if forward else sa[n - end : n - at][::-1]
        source = np.nonzero(block > 0)[0]
        before = block[source] - 1
        keep = wanted[before]
        source, before = source[keep], before[keep]
        if len(source):
            symbol = s[before]
            order = np.argsort(symbol, kind="stable")
            ordered = symbol[order]
            first = np.concatenate(([0], np.nonzero(ordered[1:] != ordered[:-1])[0] + 1))
            count = np.diff(np.append(first, len(ordered)))
            shift = pointer[ordered[first]] - sign * first
            target = np.empty(len(ordered), np.int64)
            target[order] = np.repeat(shift, count) + sign * np.arange(len(ordered))
            place = target if forward else n - 1 - target  # in the order of the scan
            cut = int(place.min())
            if cut < end:
                keep = source + at < cut
                size = max(64, (cut - at) * 2)
                end = cut
                before, target = before[keep], target[keep]
                np.add.at(pointer, symbol[keep], sign)
            else:
                size = min(size * 2, 1 << 16)
                pointer[ordered[first]] += sign * count
            sa[target] = before
        else:
            size = min(size * 2, 1 << 16)
        at = end


def _induce(s: np.ndarray, smaller: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array from leftmost-smaller suffixes given in the order they have within their buckets."""
    sa = np.full(len(s), -1, np.int32)
    symbol = s[lms]
    order = np.argsort(symbol, kind="stable")
    ordered = symbol[order]
    last = np.searchsorted(ordered, ordered, side="right")
    sa[ends[ordered] - (last - np.arange(len(ordered)))] = lms[order]
    _scan(sa, s, ~smaller, np.concatenate(([0], ends[:-1])), forward=True)
    _scan(sa, s, smaller, ends - 1, forward=False)
    return sa


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes of ``s``, under 2^31 of them: numbers below ``symbols``, ending with a 0 that occurs nowhere else.

    Suffixes are classified as smaller or larger than their successor; substrings between leftmost smaller ones are
    sorted by inducing and named; if names repeat, the string of names is sorted the same way; the order of the
    leftmost smaller suffixes then induces that of all.
    """
    n = len(s)
    s = s.astype(np.uint16 if symbols <= 1 << 16 else np.int32)  # narrow symbols sort by radix
    if n < 3:
        return np.argsort(s, kind="stable")
    smaller = _is_smaller(s)
    ends = np.cumsum(np.bincount(s, minlength=symbols))
    lms = (np.nonzero(smaller[1:] & ~smaller[:-1])[0] + 1).astype(np.int32)
    if len(lms) < 2:
        return _induce(s, smaller, ends, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = _induce(s, smaller, ends, lms)
    ordered = sa[is_lms[sa]]
    length = np.zeros(n, np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    pair = np.nonzero(same)[0]
    size = length[a[pair]]
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    differs = s[np.repeat(a[pair], size) + inner] != s[np.repeat(b[pair], size) + inner]
    if len(size):
        same[pair] = ~np.logical_or.reduceat(differs, np.cumsum(size) - size)
    names = np.zeros(n, np.int32)
    names[ordered] = np.concatenate(([0], np.cumsum(~same)))
    kinds = int(names[ordered[-1]]) + 1
    if kinds < len(lms):
        ordered = lms[suffix_array(names[lms], kinds)]
    return _induce(s, smaller, ends, ordered)


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position of ``data`` the length of what its suffix shares with the suffix before it in ``sa``, at most
    ``most``. ``data`` is bytes; it is read as if zeros followed."""
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate((data, np.zeros(most + 16, np.uint8)))
    words = np.zeros(n + most + 8, np.uint64)
    for i in range(8):
        words |= padded[i : i + len(words)].astype(np.uint64) << np.uint64(8 * i)
    out = np.zeros(n, np.int64)
    alive = np.nonzero(before >= 0)[0]
    for at in range(0, most, 8):
        differ = words[alive + at] ^ words[before[alive] + at]
        lowest = differ & (~differ + np.uint64(1))
        out[alive] += np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)) >> 3).astype(np.int64)
        alive = alive[differ == 0]
    return np.minimum(out, most)


def sparse_suffix_array(data: np.ndarray, positions: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``data`` that start at ``positions``, in the order of their first ``depth`` bytes: an index of
    ``positions``, and per place there whether those bytes differ from the ones before.

    Suffixes are sorted by eight bytes at a time; only those that are equal so far go on to the next eight. ``data`` is
    read as if zeros followed.
    """
    padded = np.concatenate((data, np.zeros(depth + 16, np.uint8)))
    words = np.zeros(len(data) + depth + 8, np.uint64)
    for i in range(8):
        words = words << np.uint64(8) | padded[i : i + len(words)]
    order = np.arange(len(positions))
    new = np.zeros(len(positions), bool)
    new[:1] = True
    # places whose bytes so far are equal to those of another, and the number of each such run
    equal, group = order.copy(), np.zeros(len(positions), np.int64)
    for at in range(0, depth, 8):
        word = words[positions[order[equal]] + at] >> np.uint64(8 * max(at + 8 - depth, 0))
        moved = np.lexsort((word, group)) if at else np.argsort(word, kind="stable")
        order[equal], word = order[equal[moved]], word[moved]
        starts = np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1]))[: len(group)]
        new[equal[starts]] = True
        group = np.cumsum(starts) - 1
        several = (np.bincount(group) > 1)[group] if len(group) else starts
        equal, group = equal[several], group[several]
    return order, new
