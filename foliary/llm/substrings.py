"""Exact substring de-duplication with sharded suffix arrays."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import as_bytes, documents, materialize, query
from foliary.llm.suffix_array import sparse_suffix_array

LENGTH = 50  # bytes of a string whose later copies are removed
GRAM = 20  # bytes of an anchor
BATCH_BYTES, BATCH_ROWS = 4_000_000, 4096
BLOCK = 1 << 16  # windows whose anchors are worked out at once
SHARD_BYTES = 4_000_000  # text that one suffix array covers, about
FREQUENT = 4096  # batches that share an anchor, from which its windows are dealt one by one
NOBODY = np.iinfo(np.int64).max

TABLE = np.random.default_rng(2).integers(0, 1 << 63, 256, dtype=np.uint64)
PRIME = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(PRIME, n, 1 << 64))


def window_anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each window of ``length`` bytes the smallest hash of its runs of ``gram`` bytes; equal windows have equal ones.

    Windows are taken in blocks whose numbers stay in the cache of a core."""
    count = max(len(data) - length + 1, 0)
    out = np.empty(count, np.uint64)
    for at in range(0, count, BLOCK):
        end = min(at + BLOCK, count)
        out[at:end] = _anchors_of(data[at : end + length - 1], length, gram)
    return out


def _anchors_of(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Hashes of runs and minima over windows are both built by doubling."""
    count = len(data) - length + 1
    parts, width, h = {}, 1, TABLE[data]
    while True:
        if gram & width:
            parts[width] = h
        if width * 2 > gram:
            break
        last = h
        h = h[:-width] * _power(width)
        h += last[width:]
        width *= 2
    total, at = None, 0
    for width in sorted(parts, reverse=True):
        piece = parts[width][at : at + len(data) - gram + 1]
        total = piece if total is None else total * _power(width) + piece
        at += width
    total = total ^ total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(29)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        total = np.minimum(total[:-width], total[width:])
        width *= 2
    return np.minimum(total[:count], total[span - width : span - width + count])


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are in ``some``."""
    return np.isin(keys, some, kind="sort") if len(some) else np.zeros(len(keys), bool)


def _numbered(strings: Iterable[bytes], known: dict[bytes, int]) -> np.ndarray:
    """The number of each string in ``known``, which grows by those that are new."""
    numbers = []
    add, number = numbers.append, known.setdefault
    for x in strings:
        add(number(x, len(known)))
    return np.array(numbers, np.int64)


class Batch:
    """Documents of one batch, and the anchors of the runs of windows in them."""

    def __init__(self, packed: bytes, buckets: int):
        self.ids, sizes, squeezed = pickle.loads(packed)
        self.data = np.frombuffer(zstandard.decompress(squeezed), np.uint8) if squeezed else np.zeros(0, np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        anchors = window_anchors(self.data)
        change = np.ones(len(anchors), bool)
        np.not_equal(anchors[1:], anchors[:-1], out=change[1:])
        # a document's windows begin with it, and end where one would reach into the next
        edges = np.concatenate((self.offsets, self.offsets[1:] - LENGTH + 1))
        change[edges[(edges >= 0) & (edges < len(anchors))]] = True
        start = np.nonzero(change)[0]
        end = np.append(start[1:], len(anchors))
        document = np.searchsorted(self.offsets, start, side="right") - 1
        keep = start + LENGTH <= self.offsets[document + 1]
        self.start, self.end, self.document = start[keep], end[keep], document[keep]
        anchor = anchors[self.start]
        self.bucket = (anchor % np.uint64(buckets)).astype(np.int64)
        self.tag = anchor >> np.uint64(24)  # 40 bits
        self.key = self.bucket.astype(np.uint64) << np.uint64(40) | self.tag

    @classmethod
    def pack(cls, ids: list, texts: list[bytes]) -> bytes:
        joined = b"".join(texts)
        return pickle.dumps((ids, np.fromiter(map(len, texts), np.int64, len(texts)), zstandard.compress(joined, 3) if joined else b""))

    def strings(self, shared: np.ndarray, frequent: np.ndarray, buckets: int):
        """Distinct strings around shared anchors, and which run of windows has which.

        A string comes with its bucket and a mark of its anchor: strings with different marks share no window.

        A run of windows with one shared anchor is one string; under a frequent anchor each window is its own, dealt by
        a hash of all of it.
        """
        hit = _among(self.key, shared)
        start, end, document = self.start[hit], self.end[hit], self.document[hit]
        bucket, mark = self.bucket[hit], (self.tag[hit] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        often = _among(self.key[hit], frequent)
        if often.any():
            size = np.where(often, end - start, 1)
            row = np.repeat(np.arange(len(start)), size)
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            single = often[row]
            start = np.where(single, start[row] + inner, start[row])
            end, document, bucket, mark = np.where(single, start + 1, end[row]), document[row], bucket[row], mark[row]
            raw = self.data.tobytes()
            for i in np.nonzero(single)[0].tolist():
                h = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + LENGTH])
                bucket[i], mark[i] = h % buckets, h >> 32
        raw, known = self.data.tobytes(), {}
        index = _numbered([raw[a:b] for a, b in zip(start.tolist(), (end + LENGTH - 1).tolist())], known)
        return list(known), index, start, end, document, bucket, mark


ROW = "target long, batch long, a binary, b binary"
NAMES = ["target", "batch", "a", "b"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], NAMES)


def _five(tags: np.ndarray) -> bytes:
    return np.ascontiguousarray(tags.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _tags(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def batches_of(docs: DataFrame, text: str) -> DataFrame:
    """(batch, packed): the documents in compressed batches of bounded size, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 24, [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([Batch.pack(ids, texts)], pa.binary())], ["batch", "packed"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if texts and (size + len(text) > BATCH_BYTES or len(texts) >= BATCH_ROWS):
                    yield flush()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, "batch long, packed binary")


def _find_shared(batches: Iterator[pa.RecordBatch], frequent: int) -> Iterator[pa.RecordBatch]:
    """Answer each request with its anchors that occur in two documents or more, and with the frequent ones of those."""
    rows = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(4)))]
    by_target: dict[int, list[tuple]] = {}
    for r in rows:
        by_target.setdefault(r[0], []).append(r)
    for target, mine in by_target.items():
        parts = [_tags(x) for r in mine for x in r[2:]]  # of each request those of one document, then the others
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        tags = np.concatenate(parts)
        _, place, counts = np.unique(tags, return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[place[np.repeat(np.arange(len(parts)) % 2 == 1, sizes)]] = True
        often = (counts >= frequent)[place]
        hit = shared[place]
        bounds = np.append(0, np.cumsum(sizes))[::2].tolist()
        found = []
        for r, a, b in zip(mine, bounds[:-1], bounds[1:]):
            own, many = tags[a:b][hit[a:b]], tags[a:b][hit[a:b] & often[a:b]]
            if len(own):
                found.append((target, r[1], _five(own), _five(many)))
        yield _rows(found)


def first_documents(strings: list[bytes], lowest: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of each string, one after the other, the smallest ``lowest`` among the strings that hold an equal
    window.

    The suffix array is sparse: it has the places where a window starts, a quarter of all in strings around anchors."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    windows = sizes - length + 1
    inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    position = np.repeat(np.cumsum(sizes) - sizes, windows) + inner
    order, new = sparse_suffix_array(np.frombuffer(b"".join(strings), np.uint8), position, length)
    new = np.nonzero(new)[0]
    least = np.minimum.reduceat(np.repeat(lowest, windows)[order], new)
    first = np.empty(len(position), np.int64)
    first[order] = np.repeat(least, np.diff(np.append(new, len(order))))
    return first


def _runs(strings: list[bytes], lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one first document: how many each string has, their windows, their documents."""
    first = first_documents(strings, lowest)
    begin = np.cumsum([0, *(len(text) - LENGTH + 1 for text in strings)])
    change = np.append(True, first[1:] != first[:-1])
    change[begin[:-1]] = True
    change = np.append(np.nonzero(change)[0], len(first))
    return np.diff(np.searchsorted(change, begin)), np.diff(change), first[change[:-1]]


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort the windows of the strings of each bucket, shard by shard, and answer with the first document of every
    window: how many runs each string has, their windows, their documents.

    A string has one anchor, so equal strings have one mark."""
    rows = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(4)))]
    by_target: dict[int, list[tuple]] = {}
    for r in rows:
        by_target.setdefault(r[0], []).append(r)
    for target, mine in by_target.items():
        known: dict[bytes, int] = {}
        asked, marks, ids = [], [], []
        for r in mine:
            strings, m, d = pickle.loads(zstandard.decompress(r[2]))  # strings, marks, lowest documents
            asked.append(_numbered(strings, known))
            marks.append(m)
            ids.append(d)
        strings, at = list(known), np.concatenate(asked)
        lowest = np.full(len(strings), NOBODY)
        np.minimum.at(lowest, at, np.concatenate(ids))
        mark = np.zeros(len(strings), np.uint32)
        mark[at] = np.concatenate(marks)
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        # A string whose mark no other has shares no window: it is one run, and there is nothing to sort.
        order = np.argsort(mark, kind="stable")
        new = np.append(True, mark[order][1:] != mark[order][:-1])
        several = order[~(new & np.append(new[1:], True))]
        alone = order[new & np.append(new[1:], True)]
        parts = [(alone, np.ones(len(alone), np.int64), size[alone] - LENGTH + 1, lowest[alone])]
        ends, low = np.cumsum(size[several]), 0
        steps = np.append(np.nonzero(mark[several][1:] != mark[several][:-1])[0] + 1, len(several))  # where a shard may end
        while low < len(several):
            full = np.searchsorted(ends, (ends[low - 1] if low else 0) + SHARD_BYTES) + 1
            high = int(steps[min(np.searchsorted(steps, full), len(steps) - 1)])
            group = several[low:high]
            parts.append((group, *_runs([strings[i] for i in group.tolist()], lowest[group])))
            low = high
        owner, count, width, value = (np.concatenate(x) for x in zip(*parts))
        counts, base = np.empty(len(strings), np.int64), np.empty(len(strings), np.int64)
        counts[owner], base[owner] = count, np.cumsum(count) - count
        for r, number in zip(mine, asked):
            n = counts[number]
            runs = np.repeat(base[number] - np.cumsum(n) + n, n) + np.arange(n.sum())
            content = n.astype(np.int32).tobytes() + width[runs].astype(np.int32).tobytes() + value[runs].tobytes()
            yield _rows([(target, r[1], zstandard.compress(content, 1), np.array([len(n), len(runs)], np.int64).tobytes())])


def _exchange(rows: DataFrame, buckets: int, answer) -> DataFrame:
    """Deal requests to their buckets, answer them, and gather the answers of each batch."""
    answers = rows.repartition(buckets, "target").mapInArrow(answer, ROW)
    return answers.groupBy("batch").agg(F.collect_list(F.struct("target", "a", "b")).alias("answers"))


def repeated_spans(docs: DataFrame, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    A byte is removed if a string of 50 bytes that covers it also starts in a document with a smaller doc_id. Strings
    are judged on the input texts as UTF-8; a null text is empty. A row without doc_id is later than any other; rows
    that repeat a doc_id do not remove each other's strings. Further columns are ignored; no rows give no rows.

    Windows of 50 bytes are dealt to shards by an anchor, the smallest hash of a run of 20 bytes in them, so equal
    windows meet. A first exchange finds the anchors that occur in more than one document (each batch of documents names
    an anchor once); only the text around those is sent, each distinct string once per batch. The windows of a shard's
    distinct strings are sorted into a sparse suffix array (a string that is the only one around its anchor needs none);
    neighbours that share 50 bytes form the groups of equal windows, and the smallest document of each group returns to
    the batches. A frequent anchor's windows are dealt one by one by a hash
    of all their bytes, so it fills no shard.
    """
    spark = docs.sparkSession
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = materialize(batches_of(docs, text), "batches")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, packed in zip(*(batch.column(i).to_pylist() for i in range(2))):
                b = Batch(packed, buckets)
                order = np.lexsort((b.document, b.key))
                key, document = b.key[order].view(np.int64), b.document[order]
                new_key = np.append(True, key[1:] != key[:-1])[: len(key)]
                new_document = new_key | np.append(True, document[1:] != document[:-1])[: len(key)]
                keys, counts = key[new_key], np.add.reduceat(new_document.astype(np.int64), np.nonzero(new_key)[0]) if len(key) else key
                bounds = np.searchsorted(keys >> 40, np.arange(buckets + 1))
                tags, rows = (keys & ((1 << 40) - 1)).astype(np.uint64), []
                for t in range(buckets):
                    mine, n = tags[bounds[t] : bounds[t + 1]], counts[bounds[t] : bounds[t + 1]]
                    if len(mine):
                        rows.append((t, number, _five(mine[n == 1]), _five(mine[n > 1])))
                yield _rows(rows)

    def shared_of(answers) -> tuple[np.ndarray, np.ndarray]:
        keys = [[_tags(x[k]) | np.uint64(x["target"] << 40) for x in answers or []] for k in ("a", "b")]
        return tuple(np.concatenate([np.zeros(0, np.uint64), *k]) for k in keys)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, packed, answers in zip(*(batch.column(i).to_pylist() for i in range(3))):
                b = Batch(packed, buckets)
                strings, index, _, _, document, bucket, mark = b.strings(*shared_of(answers), buckets)
                ids = np.array([NOBODY if i is None else i for i in b.ids], np.int64)
                lowest = np.full(len(strings), NOBODY)
                np.minimum.at(lowest, index, ids[document])
                first = np.full(len(strings), -1)
                first[index[::-1]] = np.arange(len(index))[::-1]
                home, own = bucket[first], mark[first]
                order = np.argsort(home, kind="stable")
                bounds = np.searchsorted(home[order], np.arange(buckets + 1))
                for t in range(buckets):
                    mine = order[bounds[t] : bounds[t + 1]]
                    if len(mine):
                        content = pickle.dumps(([strings[i] for i in mine.tolist()], own[mine].astype(np.uint32), lowest[mine]))
                        yield _rows([(t, number, zstandard.compress(content, 1), None)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, answers, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                b = Batch(packed, buckets)
                strings, index, start, end, document, bucket, _ = b.strings(*shared_of(answers), buckets)
                ids = np.array([NOBODY if i is None else i for i in b.ids], np.int64)
                covered = np.zeros(len(b.data) + 1, np.int64)
                if len(strings):
                    first = np.full(len(strings), -1)
                    first[index[::-1]] = np.arange(len(index))[::-1]
                    order = np.argsort(bucket[first], kind="stable")
                    place = np.empty(len(strings), np.int64)
                    place[order] = np.arange(len(strings))
                    runs = []
                    for x in sorted(found, key=lambda x: x["target"]):
                        raw, (n, m) = zstandard.decompress(x["a"]), np.frombuffer(x["b"], np.int64).tolist()
                        runs.append((np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.int32, m, 4 * n), np.frombuffer(raw[4 * (n + m) :], np.int64)))
                    count, width, docs_first = (np.concatenate(x).astype(np.int64) for x in zip(*runs))
                    base = np.cumsum(count) - count
                    # one row per run of windows of each occurrence
                    mine = place[index]
                    n = count[mine]
                    row = np.repeat(np.arange(len(index)), n)
                    at = np.repeat(base[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    done = np.cumsum(width) - width
                    begin = start[row] + done[at] - done[np.repeat(base[mine], n)]
                    later = docs_first[at] < ids[document[row]]
                    np.add.at(covered, begin[later], 1)
                    np.add.at(covered, begin[later] + width[at][later] + LENGTH - 1, -1)
                gone = np.cumsum(covered[:-1]) > 0
                raw, total = b.data, np.concatenate(([0], np.cumsum(gone)))
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                inner = b.offsets[(b.offsets > 0) & (b.offsets < len(gone))]
                opens[inner] = gone[inner]
                spans = np.concatenate(([0], np.cumsum(opens)))
                a, z = b.offsets[:-1], b.offsets[1:]
                kept = [raw[i:j][~gone[i:j]].tobytes() for i, j in zip(a.tolist(), z.tolist())]
                values = [pa.array(b.ids, pa.int64()), pa.array(z - a), pa.array(total[z] - total[a]), pa.array(spans[z] - spans[a]), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(values, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    shared = materialize(_exchange(table.mapInArrow(ask, ROW), buckets, lambda it: _find_shared(it, frequent)), "anchors")
    known = table.join(shared, "batch", "left")
    first = _exchange(known.select("batch", "packed", "answers").mapInArrow(send, ROW), buckets, _sort_shards)
    whole = known.join(first.select("batch", F.col("answers").alias("found")), "batch", "left")
    return whole.select("packed", "answers", "found").mapInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


@query("op2_suffix_array_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is kept, for every document."""
    found = repeated_spans(documents(spark, folder, "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
