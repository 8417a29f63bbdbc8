"""Block postings: an inverted index whose rows hold a term's occurrences in a block of texts.

A block is up to ``BLOCK_ROWS`` texts that one task tokenised together, named by the smallest row id in it. All terms share the
blocks, so two terms can only meet in one row within one block. Positions are a column of their own, which a query without
phrases does not read. Both columns are runs of numbers of seven bits a byte (:func:`encoded`), a few bytes an occurrence, so that
what is shuffled, sorted and stored stays near the size of the texts. The counts of rows and tokens per block add up to the statistics that ranking needs. Because a block is cut
where the text is read, texts are tokenised once and what is shuffled is blocks, not tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions import text as tx

BLOCK_ROWS = 1024
BLOCKS = "term string, block bigint, n_rows bigint, n_tokens bigint, entries binary, positions binary"
FIELDS = [tuple(field.split(" ", 1)) for field in BLOCKS.split(", ")]
NAMES = [name for name, _ in FIELDS]


def encoded(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers as bytes of seven bits, the lowest first, with a mark on all but the last byte; and where each number ends."""
    numbers = np.asarray(numbers).astype(np.uint64)
    size = np.ones(len(numbers), np.int64)
    for bits in range(7, 64, 7):
        more = numbers >> np.uint64(bits) > 0
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(size.max() if len(size) else 0):
        has = size > k
        part = (numbers[has] >> np.uint64(7 * k) & np.uint64(0x7F)).astype(np.uint8)
        out[(ends - size)[has] + k] = part | ((size[has] > k + 1).astype(np.uint8) << 7)
    return out, ends


def decoded(data: np.ndarray) -> np.ndarray:
    """The numbers in bytes written by :func:`encoded`."""
    if not len(data):
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(data < 0x80)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.bitwise_or.reduceat((data & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column cut from one run of bytes."""
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _run(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column without nulls, one value after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)


def _signed(numbers: np.ndarray) -> np.ndarray:
    """Numbers of either sign as unsigned ones, small where they are near zero."""
    return (numbers << 1 ^ numbers >> 63).view(np.uint64)


def _unsigned(numbers: np.ndarray) -> np.ndarray:
    return (numbers >> np.uint64(1)).view(np.int64) ^ -(numbers & np.uint64(1)).view(np.int64)


@dataclass
class Entries:
    """The entries of many (term, block) rows, one after the other: row, its document (0 where there is none), whether it has one, the
    row's length, and how often it holds the term."""

    row_ids: np.ndarray
    document_ids: np.ndarray
    known: np.ndarray
    row_lens: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(column: pa.Array, blocks: np.ndarray, n_rows: np.ndarray) -> Entries:
        numbers = decoded(_run(column)).reshape(-1, 4)
        counts = numbers[:, 3].astype(np.int64)
        rows = numbers[:, 0].astype(np.int64) + np.repeat(blocks, n_rows)
        return Entries(rows, _unsigned(np.ascontiguousarray(numbers[:, 1])), (counts & 1) == 0, numbers[:, 2].astype(np.int64), counts >> 1)

    def documents(self, at: np.ndarray) -> pa.Array:
        return pa.array(self.document_ids[at], pa.int64(), mask=~self.known[at])


def _places(column: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Positions of all entries: the first of an entry as it is, the next ones by their distance."""
    steps = decoded(_run(column)).astype(np.int64)
    total = np.cumsum(steps)
    first = np.cumsum(counts) - counts
    return total - np.repeat(total[first] - steps[first], counts) if len(steps) else steps


def _blocks_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of one block of (row_id, document_id, tokens), and a row without a term that counts its texts and tokens."""
    batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
    row_ids, documents, tokens = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
    known, documents = documents.is_valid().to_numpy(zero_copy_only=False), documents.fill_null(0).to_numpy()
    lens = tokens.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    parents = np.repeat(np.arange(len(lens)), lens)
    places = np.arange(len(parents)) - np.repeat(np.cumsum(lens) - lens, lens)
    words = tokens.flatten().dictionary_encode()
    codes = words.indices.to_numpy()
    order = np.argsort(codes, kind="stable")  # texts and places stay in order within a term
    codes, parents, places = codes[order], parents[order], places[order]
    head = np.ones(len(codes), bool)
    head[1:] = (codes[1:] != codes[:-1]) | (parents[1:] != parents[:-1])
    entries = np.flatnonzero(head)  # one per term and text
    counts = np.diff(np.append(entries, len(codes)))
    rows, codes = parents[entries], codes[entries]
    terms = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    numbers = lambda v: pa.array(v, pa.int64())
    block = int(row_ids[0])
    each = np.stack([(row_ids[rows] - block).view(np.uint64), _signed(documents[rows]), lens[rows].astype(np.uint64), (counts << 1 | ~known[rows]).astype(np.uint64)], axis=1)
    data, ends = encoded(each.ravel())
    steps = np.where(head, places, places - np.append(0, places[:-1]))
    shown, stops = encoded(steps)
    last = np.append(terms[1:], len(entries)) if len(terms) else terms
    columns = [
        words.dictionary.cast(pa.string()).take(numbers(codes[terms])),
        numbers(np.full(len(terms), block)),
        numbers(last - terms),
        numbers(np.add.reduceat(counts, terms) if len(terms) else np.empty(0, np.int64)),
        _binary(data, ends[4 * last - 1]),
        _binary(shown, stops[np.append(entries, len(head))[last] - 1]),
    ]
    totals = pa.RecordBatch.from_pylist([{"term": None, "block": block, "n_rows": len(lens), "n_tokens": int(lens.sum())}], schema=pa.schema(list(zip(NAMES, [c.type for c in columns]))))
    return pa.concat_batches([pa.RecordBatch.from_arrays(columns, NAMES), totals])


def cut_blocks(rows: DataFrame, row_id: str = "page_id", text: str = "text", within: str | None = None) -> DataFrame:
    """Block postings of a table of texts. Row-local: nothing is shuffled. A text without an id can't be found and is left out; a
    null text has no tokens. ``within`` names an int column by which the rows lie sorted: no block holds two of its values,
    and it is added to the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                for start in range(low, high, BLOCK_ROWS):
                    made = _blocks_of(batch.slice(start, min(BLOCK_ROWS, high - start)))
                    value = pa.array(np.full(made.num_rows, own[low]), pa.int32())
                    yield pa.RecordBatch.from_arrays([*made.columns, value], [*NAMES, "bucket"]) if within else made

    tokens = F.coalesce(tx.tokens(F.col(text)), F.array().cast("array<string>"))
    own = (F.col(within) if within else F.lit(0)).cast("int")
    named = rows.filter(F.col(row_id).isNotNull())
    named = named.select(F.col(row_id).cast("long").alias("row_id"), F.col("document_id").cast("long").alias("document_id"), tokens.alias("tokens"), own.alias("bucket"))
    cut = named.mapInArrow(run, f"{BLOCKS}, bucket int" if within else BLOCKS)
    return cut.withColumnRenamed("bucket", within) if within else cut


def term_totals(blocks: DataFrame) -> DataFrame:
    """Rows and occurrences of every term; reads two numbers a block."""
    return blocks.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n_rows").alias("df"), F.sum("n_tokens").alias("occurrences"))


def corpus_totals(blocks: DataFrame) -> DataFrame:
    """Number of rows and their summed length, as one row."""
    return blocks.filter(F.col("term").isNull()).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.sum("n_tokens").alias("total_len"))


def _where_all(keys: list[np.ndarray]) -> np.ndarray:
    """Sorted numbers that all of some sorted, distinct runs hold; the shortest is narrowed down by the others."""
    keys = sorted(keys, key=len)
    common = keys[0]
    for other in keys[1:]:
        at = np.searchsorted(other, common)
        common = common[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == common)] if len(other) else common[:0]
    return common


PHRASE_BLOCKS = "term string, block bigint, n_rows bigint, entries binary"


def phrases_in_blocks(grouped: DataFrame) -> DataFrame:
    """Postings of phrases, a block at a time: ``found`` has the postings (offset, n_rows, entries, positions) of all words of the phrase
    ``term`` in ``block``. A place is a number (row, position - offset), so one intersection finds all occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(1).to_numpy()
            bounds, found = batch.column(2).offsets.to_numpy(), batch.column(2).values
            bounds, found = bounds - bounds[0], found.slice(bounds[0], bounds[-1] - bounds[0])
            shifts, n_rows = found.field("offset").to_numpy(), found.field("n_rows").to_numpy()
            all_rows = Entries.of(found.field("entries"), np.repeat(blocks, np.diff(bounds)), n_rows)
            at = np.append(0, np.cumsum(n_rows))
            places = _places(found.field("positions"), all_rows.counts)
            ends = np.append(0, np.cumsum(all_rows.counts))
            row_ids, rows, counts, kept = all_rows.row_ids, [], [], []
            for low, high in zip(bounds, bounds[1:]):
                ids = np.unique(np.concatenate([row_ids[at[i] : at[i + 1]] for i in range(low, high)]))
                keys = []
                for i in range(low, high):
                    number = np.repeat(np.searchsorted(ids, row_ids[at[i] : at[i + 1]]), all_rows.counts[at[i] : at[i + 1]])
                    keys.append((number << 32) + places[ends[at[i]] : ends[at[i + 1]]] - shifts[i] + (1 << 31))
                row, count = np.unique(_where_all(keys) >> 32, return_counts=True)
                kept.append(len(row))
                rows.append(at[low] + np.searchsorted(row_ids[at[low] : at[low + 1]], ids[row]))
                counts.append(count)
            rows, counts = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (rows, counts))
            kept = np.array(kept, np.int64)
            each = [(row_ids[rows] - np.repeat(blocks, kept)).view(np.uint64), _signed(all_rows.document_ids[rows]), all_rows.row_lens[rows].astype(np.uint64), (counts << 1 | ~all_rows.known[rows]).astype(np.uint64)]
            data, stops = encoded(np.stack(each, axis=1).ravel())
            made = _binary(data, np.append(0, stops)[4 * np.cumsum(kept)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept), made], ["term", "block", "n_rows", "entries"])

    return grouped.select("term", "block", "found").mapInArrow(run, PHRASE_BLOCKS).filter(F.col("n_rows") > 0)


def scores_in_blocks(grouped: DataFrame, k1: float, b: float) -> DataFrame:
    """BM25 of the rows that hold all terms of a query, a block at a time: ``found`` has the postings (weight, n_rows, entries) of each
    of its terms in ``block``, ``avg_len`` the average length of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, average, blocks = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            bounds, found = batch.column(3).offsets.to_numpy(), batch.column(3).values
            bounds, found = bounds - bounds[0], found.slice(bounds[0], bounds[-1] - bounds[0])
            weights, n_rows = found.field("weight").to_numpy(), found.field("n_rows").to_numpy()
            all_rows = Entries.of(found.field("entries"), np.repeat(blocks, np.diff(bounds)), n_rows)
            at, row_ids = np.append(0, np.cumsum(n_rows)), all_rows.row_ids
            owner, rows, scores = [], [], []
            for number, (low, high) in enumerate(zip(bounds, bounds[1:])):
                common = _where_all([row_ids[at[i] : at[i + 1]] for i in range(low, high)])
                score = np.zeros(len(common))
                for i in range(low, high):
                    place = at[i] + np.searchsorted(row_ids[at[i] : at[i + 1]], common)
                    f = all_rows.counts[place]
                    score += weights[i] * f * (k1 + 1) / (f + k1 * (1 - b + b * all_rows.row_lens[place] / average[number]))
                owner.append(np.full(len(common), number))
                rows.append(at[low] + np.searchsorted(row_ids[at[low] : at[low + 1]], common))
                scores.append(score)
            joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
            rows = joined(rows, np.int64)
            columns = [queries.take(pa.array(joined(owner, np.int64))), pa.array(row_ids[rows]), all_rows.documents(rows), pa.array(joined(scores, np.float64))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "row_id", "document_id", "score"])

    return grouped.select("query_id", "avg_len", "block", "found").mapInArrow(run, "query_id bigint, row_id bigint, document_id bigint, score double")


TOKEN_ROWS = 100_000  # tokens that leave a task in one batch


def tokens_of(blocks: DataFrame) -> DataFrame:
    """The blocks as one row per token (term, row_id, document_id, row_len, position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(3).to_numpy())
            low = 0
            while low < batch.num_rows:  # a row is one term in one block, so parts are bounded
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TOKEN_ROWS, side="right")))
                part = batch.slice(low, high - low)
                n_rows = part.column(2).to_numpy()
                found = Entries.of(part.column(4), part.column(1).to_numpy(), n_rows)
                at = np.repeat(np.arange(len(found.counts)), found.counts)
                terms = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), n_rows)[at], pa.int64()))
                columns = [terms, pa.array(found.row_ids[at]), found.documents(at), pa.array(found.row_lens[at]), pa.array(_places(part.column(5), found.counts), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["term", "row_id", "document_id", "row_len", "position"])
                low = high

    rows = blocks.filter(F.col("term").isNotNull()).select(*NAMES)
    return rows.mapInArrow(run, "term string, row_id bigint, document_id bigint, row_len bigint, position int")
