"""Benchmark decontamination by a random-walk embedding of the edit distance, sampled coordinates and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import as_bytes, documents, query

SIMILARITY = 0.8  # share of an item's words that may not be edited
LEAST_WORDS = 5  # shorter items are not passages
SAMPLED, KEYS = 2, 12  # coordinates of a key, and keys of a walk
STEPS = 2  # per symbol of a walk that are sampled: it moves at every other step, so the rest of its three is mostly past the end and tells nothing
RECALL = 0.999  # of matches at the full edit allowance
TRIALS = 64  # edited items per kind of edit that the number of walks is worked out on
VERIFIED, CELLS = 4096, 4_000_000  # pairs whose edit tables are worked out together, and cells of a row of them
BLOCK_ITEMS, BLOCK_WORDS = 1000, 200_000  # of the benchmark that one pass over the documents answers


def edits(words: int, similarity: float = SIMILARITY) -> int:
    return int(words * (1 - similarity) + 1e-9)


def shared_run(words: int, similarity: float = SIMILARITY) -> int:
    """Consecutive words (3 at most) that any text within the allowed edits of an item must share with it: the edits cut
    the item into one more piece than there are edits, and the longest piece has at least this many words."""
    e = edits(words, similarity)
    return max(1, min(3, (words - e) // (e + 1)))


def shared_runs(words: int, similarity: float = SIMILARITY) -> int:
    """How many of its runs of ``shared_run`` words any match of an item keeps: an edit spoils one run per word of it."""
    length = shared_run(words, similarity)
    return max(1, words - length + 1 - edits(words, similarity) * length)


def embed(windows: np.ndarray, coordinates: np.ndarray, walk: int) -> np.ndarray:
    """Values of one random walk over each row of symbols, at the given coordinates in ascending order.

    The walk has three steps per symbol. A step writes the symbol under the pointer, then moves on by one or stays, as a
    random function of walk, step and symbol says; past the end it writes 0. Where two rows differ by few edits their
    pointers meet again after each, so they agree at many coordinates: edit distance becomes Hamming distance.
    """
    n, m = windows.shape
    padded = np.concatenate((windows, np.zeros((n, 1), windows.dtype)), axis=1).astype(np.uint64)
    odd = np.random.default_rng([6, walk]).integers(0, 1 << 63, 3 * m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    rows, at = np.arange(n), np.zeros(n, np.int64)
    out, wanted = np.empty((len(coordinates), n), np.uint64), {c: i for i, c in enumerate(coordinates.tolist())}
    for step in range(int(coordinates[-1]) + 1):
        symbol = padded[rows, at]
        if step in wanted:
            out[wanted[step]] = symbol
        move = ((symbol + np.uint64(0x5851F42D4C957F2D)) * odd[step]) >> np.uint64(63)
        at = np.minimum(at + move.astype(np.int64), m)
    return out.T


def keys(windows: np.ndarray, times: int) -> np.ndarray:
    """(rows, times * KEYS) keys: each is a hash of its number and of one walk at SAMPLED coordinates."""
    m, parts = windows.shape[1], []
    for walk in range(times):
        drawn = np.random.default_rng([60, m, walk]).integers(0, STEPS * m, (KEYS, SAMPLED))
        coordinates, index = np.unique(drawn, return_inverse=True)
        values, index = embed(windows, coordinates, walk), index.reshape(KEYS, SAMPLED)
        out = np.tile(np.arange(KEYS, dtype=np.uint64) + np.uint64(1 + walk * KEYS), (len(windows), 1))
        for i in range(SAMPLED):
            out = (out ^ (values[:, index[:, i]] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        parts.append(out)
    return np.concatenate(parts, axis=1)


@lru_cache(maxsize=None)
def _walks(words: int, similarity: float, recall: float) -> int:
    rng, e, sampled = np.random.default_rng(words), edits(words, similarity), np.arange(STEPS * words)
    items = rng.integers(1, 1 << 40, (4 * TRIALS, words))
    edited = np.zeros_like(items)
    for i, item in enumerate(items.tolist()):
        for at in sorted(rng.choice(words, e, replace=False).tolist(), reverse=True):
            way = i % 4 if i % 4 < 3 else int(rng.integers(3))
            item[at : at + (way != 1)] = [] if way == 2 else [int(rng.integers(1, 1 << 40))]
        edited[i, : len(item)] = item[:words]
    missed = np.ones(len(items))
    for walk in count():
        agreement = (embed(items, sampled, walk) == embed(edited, sampled, walk)).mean(axis=1)
        missed *= (1 - agreement**SAMPLED) ** KEYS
        if missed.reshape(-1, 4).mean(axis=0).max() <= 1 - recall:
            return walk + 1


def walks(words: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Independent walks that an item of this many words needs, so that a text at its full edit allowance shares a key
    with it at the wanted chance, whether words were replaced, inserted, deleted or all of that: worked out from the
    agreement of walks over edited items (at most an eighth longer ones)."""
    step = max(1, words // 8)
    return _walks(-(-words // step) * step, similarity, recall)


def best_matches(items: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edit distance, start, end) of the part of each region nearest to the item in the same row: exact, by rows of the
    edit tables of all pairs. Regions are filled up on the right with a symbol that no item has; as the first of equal
    ends counts, no match ends there."""
    n, width = len(regions), regions.shape[1] + 1
    steps = np.arange(width, dtype=np.int32)
    cost, start = np.zeros((n, width), np.int32), np.tile(steps, (n, 1))
    cross, origin = np.full((n, width), 1 << 30, np.int32), np.zeros((n, width), np.int32)
    for symbol in items.T:
        cost += 1
        cross[:, 1:] = cost[:, :-1] - (regions == symbol[:, None])
        diagonal = cross <= cost
        origin[:, 1:] = start[:, :-1]
        origin = np.where(diagonal, origin, start)
        # a step to the right costs one: the best is the smallest of cost - position so far, the last such place
        level = np.minimum(cost, cross) - steps
        low = np.minimum.accumulate(level, axis=1)
        source = np.maximum.accumulate(np.where(level == low, steps, 0), axis=1)
        cost, start = low + steps, np.take_along_axis(origin, source, axis=1)
    row, end = np.arange(n), np.argmin(cost, axis=1)
    return cost[row, end], start[row, end], end


@dataclass
class Index:
    """A block of benchmark items, ready to search for."""

    similarity: float
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: dict[int, list[tuple[int, np.ndarray]]] = field(default_factory=dict)  # by number of words
    keys: dict[int, tuple[np.ndarray, np.ndarray, int]] = field(default_factory=dict)  # in order, whose they are, and walks
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # words in a row, where in an item, and in which
    all_runs: dict[int, np.ndarray] = field(default_factory=dict)  # those of all items, by their number of words

    @classmethod
    def build(cls, items: list[tuple[int, list[bytes]]], similarity: float, recall: float = RECALL) -> Index:
        index = cls(similarity)
        for item_id, words in items:
            ids = np.array([index.vocabulary.setdefault(w, len(index.vocabulary) + 1) for w in words], np.int64)
            index.items.setdefault(len(words), []).append((item_id, ids))
        for m, group in index.items.items():
            times = walks(m, similarity, recall)
            found = keys(np.stack([ids for _, ids in group]), times).ravel()
            order = np.argsort(found, kind="stable")
            index.keys[m] = found[order], order // (times * KEYS), times
            length = shared_run(m, similarity)
            if length not in index.all_runs:
                index.all_runs[length] = np.unique(np.concatenate([index._grams(ids, length) for g in index.items.values() for _, ids in g]))
            grams = np.concatenate([index._grams(ids, length)[: m - length + 1] for _, ids in group])
            order = np.argsort(grams, kind="stable")
            owner = np.repeat(np.arange(len(group)), m - length + 1)
            index.runs[m] = grams[order], np.tile(np.arange(m - length + 1), len(group))[order], owner[order]
        return index

    def _grams(self, symbols: np.ndarray, length: int) -> np.ndarray:
        """Each run of ``length`` symbols as one number, -1 where it holds an unknown word (or would pass the end)."""
        out = symbols.copy()
        for i in range(1, length):
            following = np.append(symbols[i:], np.zeros(min(i, len(symbols)), np.int64))
            out = np.where((out > 0) & (following > 0), out * (len(self.vocabulary) + 1) + following, 0)
        return np.where(out > 0, out, -1)

    def places(self, symbols: np.ndarray, document: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per item length: documents, items and places that a match may start at, give or take ``e`` allowed edits; no
        other place can.

        A match keeps ``shared_runs`` runs of its item, each shifted by ``e`` words at most, so at least as many runs
        that say where the item starts agree within ``2 * e`` words.
        """
        grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m, group in self.items.items():
            e, length = edits(m, self.similarity), shared_run(m, self.similarity)
            if length not in grams:
                all_grams, own = self._grams(symbols, length), self.all_runs[length]
                at = np.nonzero(all_grams >= 0)[0]
                slot = np.minimum(np.searchsorted(own, all_grams[at]), len(own) - 1)
                at = at[own[slot] == all_grams[at]]
                grams[length] = at, all_grams[at]
            at, value = grams[length]
            item_grams, shift, owner = self.runs[m]
            low, high = (np.searchsorted(item_grams, value, side=s) for s in ("left", "right"))
            count = high - low
            run = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(at, count)
            span = len(symbols) + 2 * (m + e) + 2  # of the starts of one document and item: from -m on
            start = np.sort((document[at] * len(group) + owner[run]) * span + at - shift[run] + m)
            last = np.searchsorted(start, start + 2 * e, side="right")
            first = np.nonzero(last - np.arange(len(start)) >= shared_runs(m, self.similarity))[0]
            agree = np.zeros(len(start) + 1, np.int64)
            np.add.at(agree, first, 1)
            np.add.at(agree, last[first], -1)
            pair, start = np.divmod(np.unique(start[np.cumsum(agree[:-1]) > 0]), span)
            yield m, pair // len(group), pair % len(group), start - m

    def candidates(self, symbols: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per item length: documents, items and places, where a window of as many words as the item shares a key with it.

        Windows start at the places that may hold a match, whichever item that place was found for. A match of a
        candidate lies between ``e`` words before and ``m + 4 * e`` words after its place, a multiple of ``2 * e + 1``.
        """
        document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for m, docs, _, places in self.places(symbols, document):
            e, (ordered, owner, times), found = edits(m, self.similarity), self.keys[m], []
            windows = np.unique(np.stack((docs, np.maximum(places, offsets[docs]))), axis=1)
            step = max(1, CELLS // (m + times * KEYS))
            for some in range(0, windows.shape[1], step):
                doc, at = windows[:, some : some + step]
                place = at[:, None] + np.arange(m)  # past the end of a text a window is filled with unknown words
                near = keys(np.where(place < offsets[doc + 1][:, None], symbols[np.minimum(place, len(symbols) - 1)], 0), times)
                low, high = (np.searchsorted(ordered, near.ravel(), side=s) for s in ("left", "right"))
                each = high - low
                hit = np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                window = np.repeat(np.arange(len(each)) // (times * KEYS), each)
                found.append(np.unique(np.stack((doc[window], owner[hit], at[window] // (2 * e + 1))), axis=1))
            if found:
                doc, item, place = np.unique(np.concatenate(found, axis=1), axis=1)
                yield m, doc, item, place * (2 * e + 1)

    def search(self, symbols: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Best match of each (document, item) that is similar enough, as (distance, start, end) in the document's words."""
        return self.verified(self.candidates(symbols, offsets), symbols, offsets)

    def verified(self, candidates, symbols: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """The candidates that hold a match by the exact edit distance."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for m, docs, items, places in candidates:
            e, ids = edits(m, self.similarity), np.stack([x for _, x in self.items[m]])
            step = max(1, min(VERIFIED, CELLS // (m + 5 * e)))
            for some in range(0, len(docs), step):
                doc, g, at = (x[some : some + step] for x in (docs, items, places))
                first = np.maximum(offsets[doc], at - e)
                place = first[:, None] + np.arange(m + 5 * e)
                last = np.minimum(offsets[doc + 1], at + m + 4 * e)
                regions = np.where(place < last[:, None], symbols[np.minimum(place, len(symbols) - 1)], 0)
                cost, start, end = best_matches(ids[g], regions)
                for k in np.nonzero(cost <= e)[0].tolist():
                    key, shift = (int(doc[k]), self.items[m][g[k]][0]), int(first[k] - offsets[doc[k]])
                    if key not in found or cost[k] < found[key][0]:
                        found[key] = int(cost[k]), shift + int(start[k]), shift + int(end[k])
        return found


def _blocks(benchmark: DataFrame, least: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Benchmark items as lists of lower-cased words, in blocks of bounded size; they go to the tasks with the plan, which therefore grows with the benchmark (not with the documents)."""
    block, words = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        split = (row[1] or "").lower().encode().split()
        if row[0] is None or len(split) < least:
            continue
        block.append((row[0], split))
        words += len(split)
        if len(block) >= BLOCK_ITEMS or words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def _search(texts: list[bytes], index: Index) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Matches in lower-cased texts by (text, item)."""
    split = [t.split() for t in texts]
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))))
    symbols = np.fromiter((s for words in split for s in map(index.vocabulary.get, words, repeat(0))), np.int64, int(offsets[-1]))
    return index.search(symbols, offsets) if len(symbols) else {}


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, least: int = LEAST_WORDS, text: str = "text"
) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; see ``contaminated`` for what counts.

    Rows are dropped where they are read, so this needs neither ids nor a shuffle.
    """
    out, name = docs, "__lowered"
    for block in _blocks(benchmark, least):
        index = Index.build(block, similarity, recall)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    keep = np.ones(part.num_rows, bool)
                    keep[[d for d, _ in _search(as_bytes(part.column(part.num_columns - 1)), index)]] = False
                    part = part.filter(pa.array(keep))
                    yield pa.RecordBatch.from_arrays(part.columns[:-1], part.schema.names[:-1])

        out = out.withColumn(name, F.lower(F.col(text).cast("string"))).mapInArrow(run, docs.schema)
    return out


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, least: int = LEAST_WORDS
) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, distance, first_word, n_words.

    Texts are compared as lower-case words. A document holds an item of m words if some run of its words is within
    ``(1 - similarity) * m`` insertions, deletions or replacements of words. Windows of as many words as an item are
    embedded by independent random walks, which turn edit distance into Hamming distance; keys of sampled coordinates
    pick the candidates, as many walks as the item's length needs for ``recall`` at the full edit allowance (measured by
    ``walks``). Each is verified by the exact edit distance, and the best place in the document is returned. Verbatim
    copies share every key. Windows are taken only where enough of an item's runs of up to three words agree on a start:
    a match cannot lie elsewhere, so this loses none.

    The benchmark is a stated query set: it is read in blocks of bounded size and each block is searched for in one pass
    over the documents without a shuffle. Null texts and ids hold nothing: items without id or with fewer than ``least``
    words are not searched for, documents without text hold none; a document without doc_id is reported without it. Of
    rows that repeat a doc_id each is searched, so equal rows give equal results. Further columns are ignored. With an
    empty table on either side there are no rows.
    """
    shape = "doc_id long, item_id long, distance long, first_word long, n_words long"
    rows = docs.select(F.col("doc_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text")).filter("text IS NOT NULL")
    found = None
    for block in _blocks(benchmark, least):
        index = Index.build(block, similarity, recall)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):  # a window table of a few texts at a time
                    part = batch.slice(at, 500)
                    hits = _search(as_bytes(part.column(1)), index)
                    rows = np.array([(d, i, c, s, e - s) for (d, i), (c, s, e) in hits.items()], np.int64).reshape(-1, 5)
                    values = [part.column(0).take(pa.array(rows[:, 0].copy())), *(pa.array(rows[:, k].copy()) for k in range(1, 5))]
                    yield pa.RecordBatch.from_arrays(values, ["doc_id", "item_id", "distance", "first_word", "n_words"])

        part = rows.mapInArrow(run, shape)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], shape)


@query("op6_cgk_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(documents(spark, folder, "doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet"))
