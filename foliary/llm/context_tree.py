"""Language-model scores: context-tree weighting of bytes over depths 0 to ``DEPTH``, beside a smoothed word model."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import as_bytes, documents, held_out, materialize, query

END = 0xFF  # never a byte of UTF-8: stands before a text (twice) and ends it
SYMBOLS = 256
DEPTH = 5  # bytes of the longest context
ROOT = 2  # a bucket holds all that was counted after contexts that end in the same two bytes
BYTE = np.uint64(8)
BATCH_ROWS, BATCH_BYTES = 4096, 8_000_000
CODEC = "zstd"  # of texts that travel
PART_BYTES = 1 << 21  # bytes whose grams are worked out at once
HELD_GRAMS = 1_000_000  # distinct grams that a task adds up before it sends them
FREQUENT = 8  # a word in a batch's every eighth document, or more, is counted once for the batch
HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers, by Stirling's series after eight steps up."""
    x = np.asarray(x, np.float64)
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    return series - np.log(product)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1)


def split_bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 binary decisions of a byte, by its leading bits: (n, 256) -> two of (n, 255)."""
    n = len(counts)
    zeros, ones = [], []
    for level in range(8):
        halves = counts.reshape(n, 1 << level, 2, 1 << (7 - level)).sum(axis=3)
        zeros.append(halves[:, :, 0])
        ones.append(halves[:, :, 1])
    return np.concatenate(zeros, axis=1), np.concatenate(ones, axis=1)


def byte_logs(ones: np.ndarray) -> np.ndarray:
    """log10 of the probability of each byte from the probability of a one at each decision: (n, 255) -> (n, 256)."""
    logs = np.zeros((len(ones), 1))
    for level in range(8):
        p = ones[:, (1 << level) - 1 : (2 << level) - 1]
        logs = np.stack((logs + np.log10(1 - p), logs + np.log10(p)), axis=2).reshape(len(ones), -1)
    return logs


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts between marks, two before and one after each, and where each begins with its first mark."""
    edge, end = bytes([END, END]), bytes([END])
    sizes = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    return np.frombuffer(b"".join(x for t in texts for x in (edge, t, end)), np.uint8), np.cumsum(sizes) - sizes


@dataclass
class Model:
    """log10 probabilities of a byte after each context of two bytes that was seen, and after each other one."""

    row: np.ndarray  # (65536,) context (second last byte << 8 | last byte) -> row
    logs: np.ndarray  # (rows, 256)

    def position_logs(self, stream: np.ndarray) -> np.ndarray:
        """log10 probability of each byte of a stream after the two before it (0 for the first two)."""
        s = stream.astype(np.int64)
        out = np.zeros(len(s))
        out[2:] = self.logs.ravel()[(self.row[s[:-2] << 8 | s[1:-1]].astype(np.int64) << 8) | s[2:]]
        return out

    def text_scores(self, texts: list[bytes]) -> np.ndarray:
        stream, starts = _stream(texts)
        logs = self.position_logs(stream)
        logs[starts] = 0
        logs[starts + 1] = 0
        return np.add.reduceat(logs, starts) if len(texts) else np.zeros(0)


def weigh(grams: np.ndarray, counts: np.ndarray) -> Model:
    """The model of counted runs of three bytes (second last << 16 | last << 8 | byte).

    Each of the 255 decisions of a byte has a context tree of its own over the bytes before: the empty context, the last
    byte, the last two. At a context the sequence seen there is explained either by one Krichevsky-Trofimov estimate or
    by the longer contexts, half and half; this gives every depth its weight after the training data, and a prediction
    is the mixture over all depths.
    """
    order = np.argsort((grams >> 8 & 0xFF) << 8 | grams >> 16, kind="stable")
    grams, counts = grams[order], counts[order].astype(np.float64)
    contexts, first = np.unique((grams >> 8 & 0xFF) << 8 | grams >> 16, return_index=True)  # last byte first
    table = np.zeros((len(contexts), SYMBOLS))
    np.add.at(table, (np.searchsorted(contexts, (grams >> 8 & 0xFF) << 8 | grams >> 16), grams & 0xFF), counts)
    last = contexts >> 8
    root_counts = table.sum(axis=0, keepdims=True)
    root_zero, root_one = split_bits(root_counts)
    lasts = np.unique(last)
    below, parts = np.zeros((1, 255)), {}
    for c in lasts.tolist():
        mine = table[last == c]
        zero, one = split_bits(mine.sum(axis=0, keepdims=True))
        own = HALF + estimate(zero, one)
        whole = np.logaddexp(own, HALF + estimate(*split_bits(mine)).sum(axis=0, keepdims=True))
        below += whole
        parts[c] = np.exp(own - whole), (one + 0.5) / (zero + one + 1)
    own = HALF + estimate(root_zero, root_one)
    w0, p0 = np.exp(own - np.logaddexp(own, HALF + below)), (root_one + 0.5) / (root_zero + root_one + 1)
    rows, at = np.zeros(1 << 16, np.int32), 0
    logs = [byte_logs(w0 * p0 + (1 - w0) * 0.5)]  # row 0: a last byte never seen
    at = 1
    for c in lasts.tolist():
        w1, p1 = parts[c]
        index = np.nonzero(last == c)[0]
        zero, one = split_bits(np.concatenate((np.zeros((1, SYMBOLS)), table[index])))  # first: a second last never seen
        p = w0 * p0 + (1 - w0) * (w1 * p1 + (1 - w1) * (one + 0.5) / (zero + one + 1))
        logs.append(byte_logs(p))
        rows[np.arange(SYMBOLS) << 8 | c] = at
        rows[(contexts[index] & 0xFF) << 8 | c] = at + 1 + np.arange(len(index))
        at += 1 + len(index)
    return Model(rows, np.concatenate(logs).astype(np.float32))


def grams_of(texts: list[bytes], depth: int = DEPTH) -> Iterator[np.ndarray]:
    """Runs of ``depth`` + 1 bytes that end at each byte of the texts and at their end marks, as numbers, in parts of bounded size.
    As many marks as a context has bytes stand before a text."""
    edge, end = bytes([END]) * depth, bytes([END])
    sizes = np.fromiter((len(t) + depth + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    stream = np.frombuffer(b"".join(x for t in texts for x in (edge, t, end)), np.uint8)
    inside = np.ones(len(stream), bool)
    for k in range(depth):
        inside[starts + k] = False
    for low in range(depth, len(stream), PART_BYTES):
        high = min(low + PART_BYTES, len(stream))
        found = np.zeros(high - low, np.uint64)
        for back in range(depth, -1, -1):
            found <<= BYTE
            found |= stream[low - back : high - back]
        yield found[inside[low:high]]


def distinct(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers


def counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.sort(numbers)
    first = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])) if len(numbers) else np.zeros(0, np.int64)
    return numbers[first], np.diff(np.append(first, len(numbers)))


def packed(grams: np.ndarray) -> bytes:
    """Grams in order, the first bytes of all before the second bytes: neighbours share them, so they compress."""
    return np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def added(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, with the sums of their counts."""
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams, counts = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def shares(grams: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets and the places of their grams: all contexts that end in the same two bytes share a bucket."""
    mixed = (grams >> BYTE & np.uint64(0xFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if bounds[b] < bounds[b + 1]:
            yield b, order[bounds[b] : bounds[b + 1]]


def _prefix(byte: np.ndarray, level: int) -> np.ndarray:
    """The decision (1 to 255) that settles a bit of a byte: the bits before it, after a leading one."""
    return byte >> np.uint64(8 - level) | np.uint64(1 << level)


class Subtrees:
    """Context trees below contexts of ``ROOT`` bytes, from the counted grams of whole contexts of that length.

    Only contexts and decisions that were seen are nodes; what was not seen has an estimate of a half at every depth below. ``nodes``
    holds for each depth the sorted keys (context << 8 | decision), the weight of the node's own estimate, and that estimate."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH):
        self.depth, self.nodes, whole, deeper = depth, {}, None, None
        for d in range(depth, ROOT - 1, -1):
            grams, counts = added([grams & np.uint64((1 << 8 * (d + 1)) - 1)], [counts])
            byte, base = grams & np.uint64(0xFF), grams & ~np.uint64(0xFF)
            keys = np.concatenate([base | _prefix(byte, level) for level in range(8)])
            ones = np.concatenate([byte >> np.uint64(7 - level) & np.uint64(1) for level in range(8)]).astype(bool)
            n = np.tile(counts, 8)
            keys, at = np.unique(keys, return_inverse=True)
            one = np.bincount(at, n * ones, len(keys))
            zero = np.bincount(at, n * ~ones, len(keys))
            own = estimate(zero, one)
            if deeper is None:
                weight, total = np.ones(len(keys)), own
            else:
                parent = np.searchsorted(keys, deeper & np.uint64((1 << 8 * (d + 1)) - 1))
                total = np.logaddexp(HALF + own, HALF + np.bincount(parent, whole, len(keys)))
                weight = np.exp(HALF + own - total)
            self.nodes[d] = keys, weight, (one + 0.5) / (zero + one + 1)
            whole, deeper = total, keys
        self.whole = whole  # log probability of what was seen at each node of depth ROOT
        self.counts = grams, counts  # of contexts of ROOT bytes

    def logs(self, grams: np.ndarray, top: Top) -> np.ndarray:
        """log10 probability of the last byte of each gram after its context."""
        out = np.zeros(len(grams))
        byte = grams & np.uint64(0xFF)
        last = (grams >> BYTE & np.uint64(0xFF)).astype(np.int64)
        for level in range(8):
            prefix = _prefix(byte, level)
            p = np.full(len(grams), 0.5)
            for d in range(self.depth, ROOT - 1, -1):
                keys, weight, mine = self.nodes[d]
                wanted = grams & np.uint64((1 << 8 * (d + 1)) - 1) & ~np.uint64(0xFF) | prefix
                at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
                if len(keys):
                    p = np.where(keys[at] == wanted, weight[at] * mine[at] + (1 - weight[at]) * p, p)
            place = prefix.astype(np.int64) - 1
            w, mine = top.weights[1 + last, place], top.ones[1 + last, place]
            p = w * mine + (1 - w) * p
            w, mine = top.weights[0, place], top.ones[0, place]
            p = w * mine + (1 - w) * p
            out += np.log10(np.where(byte >> np.uint64(7 - level) & np.uint64(1), p, 1 - p))
        return out


@dataclass
class Top:
    """The tree above contexts of ``ROOT`` bytes: weights and estimates of a one at the 255 decisions, of the empty context (row 0)
    and of each last byte (row 1 + byte)."""

    weights: np.ndarray  # (257, 255)
    ones: np.ndarray  # (257, 255)


def crown(lasts: np.ndarray, below: np.ndarray, counts: np.ndarray) -> Top:
    """The top from what lies below each last byte: summed log probabilities (n, 255) and counts of bytes (n, 256)."""
    weights, ones = np.ones((257, 255)), np.full((257, 255), 0.5)
    total = np.zeros((1, 255))
    for c, under, n in zip(lasts, below, counts):
        zero, one = split_bits(n[None].astype(np.float64))
        own = HALF + estimate(zero, one)
        whole = np.logaddexp(own, HALF + under)
        weights[1 + c], ones[1 + c] = np.exp(own - whole)[0], ((one + 0.5) / (zero + one + 1))[0]
        total += whole
    zero, one = split_bits(counts.sum(axis=0, keepdims=True).astype(np.float64).reshape(1, SYMBOLS))
    own = HALF + estimate(zero, one)
    weights[0], ones[0] = np.exp(own - np.logaddexp(own, HALF + total))[0], ((one + 0.5) / (zero + one + 1))[0]
    return Top(weights, ones)


def _roots(trees: Subtrees) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each last byte: the summed log probabilities (255,) of the contexts of ROOT bytes that end in it, and counts of bytes (256,)."""
    keys, grams, n = trees.nodes[ROOT][0], *trees.counts
    last, decision = (keys >> BYTE & np.uint64(0xFF)).astype(np.int64), (keys & np.uint64(0xFF)).astype(np.int64) - 1
    mine, byte = (grams >> BYTE & np.uint64(0xFF)).astype(np.int64), (grams & np.uint64(0xFF)).astype(np.int64)
    for c in np.unique(mine).tolist():
        yield c, np.bincount(decision[last == c], trees.whole[last == c], 255), np.bincount(byte[mine == c], n[mine == c], SYMBOLS).astype(np.int64)


TREE, ROOTS = -1, -2  # kinds of rows beside those below: counted grams of a bucket, what lies below a last byte


def train(docs: DataFrame, buckets: int, text: str = "text", depth: int = DEPTH) -> tuple[DataFrame, Top]:
    """Count the runs of ``depth`` + 1 bytes in all texts, A-Z in lower case: rows of (bucket, grams, counts), and the top of the tree.

    Tasks count in parts of bounded size, and a bucket adds up the grams of its contexts, so what it holds are distinct grams. What lies
    below each last byte is summed by Spark; at most 256 rows of 4 KB reach the driver, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return _rows([(b, 0, TREE, packed(grams[at]), packed(n[at]), None, None) for b, at in shares(grams, buckets)])

        grams, n = added([], [])
        for batch in batches:
            for part in _slices(as_bytes(batch.column(0))):
                for found in grams_of([t.lower() for _, t in part], depth):
                    found, times = counted(found)
                    grams, n = added([grams, found], [n, times])
                    if len(grams) > HELD_GRAMS:
                        yield rows(grams, n)
                        grams, n = added([], [])
        if len(grams):
            yield rows(grams, n)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, int]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                target = batch.column(0)[i].as_py()
                grams, n, size = held.get(target, ([], [], 0))
                grams.append(unpacked(batch.column(3)[i].as_py()))
                n.append(unpacked(batch.column(4)[i].as_py()).view(np.int64))
                if sum(map(len, grams)) > 2 * size + HELD_GRAMS:
                    grams, n = ([x] for x in added(grams, n))
                    size = len(grams[0])
                held[target] = grams, n, size
        for target in sorted(held):
            grams, n = added(*held.pop(target)[:2])
            yield _rows([(target, 0, TREE, packed(grams), packed(n), None, None)])
            for c, below, counts in _roots(Subtrees(grams, n, depth)):
                yield _rows([(target, c, ROOTS, below.tobytes(), counts.tobytes(), None, None)])

    def total(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(name).to_pylist() for name in ("target", "batch", "a", "b"))))  # a fixed order of additions
        below, counts = np.zeros(255), np.zeros(SYMBOLS, np.int64)
        for _, _, a, b in rows:
            below += np.frombuffer(a, np.float64)
            counts += np.frombuffer(b, np.int64)
        return pa.table({"last": [rows[0][1]], "below": [below.tobytes()], "counts": [counts.tobytes()]}, pa.schema([("last", pa.int64()), ("below", pa.binary()), ("counts", pa.binary())]))

    whole = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    trees = materialize(whole.mapInArrow(count, ROW).repartition(buckets, "target").mapInArrow(merge, ROW), "context-trees")
    found = trees.filter(F.col("kind") == ROOTS).groupBy("batch").applyInArrow(total, "last long, below binary, counts binary").collect()
    found = sorted(((r["last"], np.frombuffer(r["below"], np.float64), np.frombuffer(r["counts"], np.int64)) for r in found), key=lambda r: r[0])
    lasts, below, counts = zip(*found) if found else ((), (), ())
    top = crown(np.array(lasts, np.int64), np.array(below).reshape(-1, 255), np.array(counts, np.int64).reshape(-1, SYMBOLS))
    return trees.filter(F.col("kind") == TREE), top


def _slices(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Numbered texts in parts of bounded rows and bytes (a longer text is a part of its own)."""
    part, size = [], 0
    for i, text in enumerate(texts):
        if part and (len(part) >= BATCH_ROWS or size + len(text) > BATCH_BYTES):
            yield part
            part, size = [], 0
        part.append((i, text))
        size += len(text)
    if part:
        yield part


ROW = "target long, batch long, kind int, a binary, b binary, c binary, d binary"
NAMES = ["target", "batch", "kind", "a", "b", "c", "d"]
REQUEST, OWNER, STATS, GRAMS = 0, 1, 2, 3


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], NAMES)


def _request(batch: int, buckets: int, texts: list[bytes], learn: np.ndarray) -> tuple[list[tuple], tuple]:
    """What a batch asks each bucket of words, and what it keeps: the counts of its frequent words by document."""
    hashes, docs, counts, n_tokens = [], [], [], np.zeros(len(texts), np.int64)
    digest = xxhash.xxh3_64_intdigest
    for i, text in enumerate(texts):
        found = Counter(text.lower().split())
        hashes.extend(map(digest, found))
        docs.append(np.full(len(found), i, np.uint16))
        counts.extend(found.values())
        n_tokens[i] = found.total() + 1
    h, doc, n = np.array(hashes, np.uint64), np.concatenate(docs), np.array(counts, np.int64)
    values, inverse, spread = np.unique(h, return_inverse=True, return_counts=True)
    common = spread * FREQUENT >= max(len(texts), FREQUENT * 8)
    learnt = np.bincount(inverse, n * learn[doc], len(values)).astype(np.int64)
    kept = common[inverse]
    slot = np.cumsum(common) - 1
    owner = (values[common].tobytes(), slot[inverse[kept]].astype(np.uint32).tobytes(), doc[kept].tobytes(), n[kept].tobytes(), n_tokens)
    h, doc, n = h[~kept], doc[~kept], n[~kept]
    while (n > 255).any():  # a count has one byte: larger ones are split
        over = n > 255
        h, doc, n = (np.concatenate(x) for x in ((h, h[over]), (doc, doc[over]), (np.where(over, 255, n), n[over] - 255)))
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    common_values, common_learnt = values[common], learnt[common]
    home = (common_values % np.uint64(buckets)).astype(np.int64)
    rows = []
    for b in range(buckets):
        mine, theirs = order[bounds[b] : bounds[b + 1]], home == b
        if len(mine) or theirs.any():
            frequent = np.stack((common_values[theirs].view(np.int64), common_learnt[theirs]), axis=1)
            packed = (doc[mine].astype(np.uint16) << np.uint16(1)) | learn[doc[mine]]
            rows.append((b, batch, REQUEST, h[mine].tobytes(), packed.astype(np.uint16).tobytes(), n[mine].astype(np.uint8).tobytes(), frequent.tobytes()))
    return rows, owner


def _logs(tree: Subtrees, grams: np.ndarray, top: Top) -> np.ndarray:
    parts = [tree.logs(grams[low : low + PART_BYTES // 16], top) for low in range(0, len(grams), PART_BYTES // 16)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _asked(texts: list[bytes], depth: int) -> np.ndarray:
    return distinct(np.concatenate([distinct(part) for part in grams_of(texts, depth)]))


def _text_scores(texts: list[bytes], answers: dict[int, bytes], buckets: int, depth: int) -> np.ndarray:
    """log10 probability of each text from the answers of the buckets to the grams of all."""
    grams = _asked(texts, depth)
    told = np.zeros(len(grams))
    for b, at in shares(grams, buckets):
        told[at] = np.frombuffer(answers[b], np.float32)
    index = pd.Index(grams)
    logs = np.concatenate([told[index.get_indexer(part)] for part in grams_of(texts, depth)])
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.add.reduceat(logs, np.cumsum(sizes) - sizes)


def _answer(batches: Iterator[pa.RecordBatch], top: Top, depth: int) -> Iterator[pa.RecordBatch]:
    """Count the words of the requests of a task's buckets, and answer each with sums by document; answer grams with their logs.

    Rows come in the order of their kind, so the trees are there before the first gram is asked for."""
    requests, trees = [], {}
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(batch.column(k)[i].as_py() for k in range(7))
            if row[2] == OWNER:
                yield _rows([row])
            elif row[2] == TREE:
                known = unpacked(row[3])
                tree = Subtrees(known, unpacked(row[4]).view(np.int64), depth)
                trees[row[0]] = tree, known, _logs(tree, known, top)
            elif row[2] == GRAMS:
                grams = unpacked(row[3])
                if row[0] not in trees:
                    trees[row[0]] = Subtrees(np.zeros(0, np.uint64), np.zeros(0, np.int64), depth), np.zeros(0, np.uint64), np.zeros(0)
                tree, known, logs = trees[row[0]]
                at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
                new = known[at] != grams if len(known) else np.ones(len(grams), bool)
                found = logs[at] if len(known) else np.zeros(len(grams))
                found[new] = _logs(tree, grams[new], top)
                yield _rows([(row[0], row[1], GRAMS, found.astype(np.float32).tobytes(), None, None, None)])
            else:
                requests.append(row)
    if not requests:
        return
    hashes = [np.frombuffer(r[3], np.uint64) for r in requests]
    packed = [np.frombuffer(r[4], np.uint16) for r in requests]
    n = [np.frombuffer(r[5], np.uint8).astype(np.int64) for r in requests]
    frequent = [np.frombuffer(r[6], np.int64).reshape(-1, 2) for r in requests]
    values, inverse = np.unique(np.concatenate([*hashes, *(f[:, 0].view(np.uint64) for f in frequent)]), return_inverse=True)
    weight = np.concatenate([*((p & 1) * k for p, k in zip(packed, n)), *(f[:, 1] for f in frequent)])
    total = np.bincount(inverse, weight, len(values)).astype(np.int64)
    logs = np.log10(total + 0.5)
    at = 0
    for r, p, k in zip(requests, packed, n):
        mine = inverse[at : at + len(p)]
        at += len(p)
        doc, index = np.unique(p >> 1, return_inverse=True)
        sums, known = np.bincount(index, k * logs[mine], len(doc)), np.bincount(index, k * (total[mine] > 0), len(doc))
        f = np.frombuffer(r[6], np.int64).reshape(-1, 2)[:, 0].view(np.uint64)
        back = np.stack((f.view(np.int64), total[np.searchsorted(values, f)]), axis=1)
        yield _rows([(r[0], r[1], REQUEST, doc.astype(np.uint16).tobytes(), sums.tobytes(), known.astype(np.int64).tobytes(), back.tobytes())])
    distinct = np.array([(total > 0).sum()], np.int64).tobytes()
    yield _rows([(requests[0][0], -1 - requests[0][0], STATS, distinct, None, None, None)])


SCORES = "kind int, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"
SCORE_NAMES = [x.split()[0] for x in SCORES.split(", ")]


def _finish(table: pa.Table, buckets: int, depth: int) -> pa.Table:
    """Sum the answers of one batch by document; pass on the number of distinct words of a bucket."""
    rows = list(zip(*(table.column(i).to_pylist() for i in range(7))))
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    if rows[0][2] == STATS:
        distinct = sum(int(np.frombuffer(r[3], np.int64)[0]) for r in rows)
        values = [[STATS], [None], [None], [None], [distinct], [None], [None]]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(values, types)], SCORE_NAMES)
    owner, size = next((r[3], r[4]) for r in rows if r[2] == OWNER)
    ids, held, n_tokens, texts, words, slot, doc, n = pickle.loads(pa.decompress(owner, int.from_bytes(size), CODEC, asbytes=True))
    scores = _text_scores(texts, {r[0]: r[3] for r in rows if r[2] == GRAMS}, buckets, depth)
    known, logs = np.zeros(len(ids), np.int64), np.zeros(len(ids))
    totals = {}
    for r in sorted(r for r in rows if r[2] == REQUEST):  # a fixed order of additions
        at = np.frombuffer(r[3], np.uint16)
        logs[at] += np.frombuffer(r[4], np.float64)
        known[at] += np.frombuffer(r[5], np.int64)
        totals.update(np.frombuffer(r[6], np.int64).reshape(-1, 2).tolist())
    words = np.frombuffer(words, np.int64)
    slot, doc, n = np.frombuffer(slot, np.uint32), np.frombuffer(doc, np.uint16), np.frombuffer(n, np.int64)
    total = np.array([totals[w] for w in words.tolist()], np.int64)
    if len(words):
        logs += np.bincount(doc, n * np.log10(total + 0.5)[slot], len(ids))
        known += np.bincount(doc, n * (total > 0)[slot], len(ids)).astype(np.int64)
    values = [[OWNER] * len(ids), ids, held, n_tokens, known, logs, scores]
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(values, types)], SCORE_NAMES)


def score_documents(docs: DataFrame, folds: int = 5, fold: int = 1, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the log10 probability of the text (A-Z in lower case, ended by a mark) under context-tree weighting of
    its bytes, learnt from the documents outside the fold. ``base_score`` is that of its words under add-a-half counts of
    the same documents. A null or empty text has one token, its end. Rows that repeat a doc_id are documents of their
    own; one without doc_id counts as held out and is scored. Further columns are ignored; no rows give no rows.

    Word counts: a task packs the words of a batch of documents by bucket (hash), so that a shuffled row is a block of
    numbers; a bucket's task counts its words and answers each batch with sums by document. Words that many documents
    of a batch hold travel once per batch, so no frequent word fills a bucket. There are as many buckets as shuffle
    partitions, which bounds a task's memory by the user's setting.

    Context trees: a batch asks for each of its distinct runs of ``depth`` + 1 bytes once. The bucket of the context's last two
    bytes holds the trees below these, and answers one batch after the other. The model has a node for every context that occurs, so
    it grows with the corpus.
    """
    if not ROOT < depth <= 6:
        raise ValueError("contexts have 3 to 6 bytes")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long"), folds, fold).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    trees, top = train(rows.filter(~F.col("held_out")), buckets, depth=depth)
    shared = spark.sparkContext.broadcast(top)  # 1 MB

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24  # the same again if the task is repeated
        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _slices(as_bytes(batch.column(2))):
                texts, index = [t for _, t in part], [i for i, _ in part]
                mine = np.array([held[i] for i in index])
                found, (words, slot, doc, n, n_tokens) = _request(number, buckets, texts, (~mine).astype(np.uint16))
                texts = [t.lower() for t in texts]
                grams = _asked(texts, depth)
                asked = [(b, number, GRAMS, packed(grams[at]), None, None, None) for b, at in shares(grams, buckets)]
                owner = pickle.dumps(([ids[i] for i in index], mine.tolist(), n_tokens, texts, words, slot, doc, n))
                size = len(owner).to_bytes(8)
                yield _rows([*found, *asked, (number, number, OWNER, pa.compress(owner, CODEC, asbytes=True), size, None, None)])
                number += 1

    # a bucket is one task: the number of partitions is that of the buckets, and rows go to the partition of their target
    asked = rows.mapInArrow(ask, ROW).unionByName(trees).repartition(buckets, "target").sortWithinPartitions("kind")
    answered = asked.mapInArrow(lambda batches: _answer(batches, shared.value, depth), ROW)
    found = materialize(answered.groupBy("batch").applyInArrow(lambda table: _finish(table, buckets, depth), SCORES), "scores")
    sums = found.agg(
        F.sum(F.when((F.col("kind") == OWNER) & ~F.col("held_out"), F.col("n_tokens"))).alias("tokens"),
        F.count(F.when((F.col("kind") == OWNER) & ~F.col("held_out"), 1)).alias("ends"),
        F.sum(F.when(F.col("kind") == STATS, F.col("n_known"))).alias("distinct"),
    ).first()
    tokens, ends = sums["tokens"] or 0, sums["ends"]
    distinct = (sums["distinct"] or 0) + (ends > 0)  # words, and the end
    whole = float(np.log10(tokens + 0.5 * (distinct + 1)))
    return found.filter(F.col("kind") == OWNER).select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + float(np.log10(ends + 0.5)) - F.col("n_tokens") * whole).alias("base_score"), "score",
    )


@query("op7_context_tree_scores")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(documents(spark, folder, "doc_id", "text"))
