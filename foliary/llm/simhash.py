"""SimHash near-duplicates, found through Golay codewords of fingerprint segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import as_bytes, documents, materialize, query
from foliary.llm.golay import nearby, nearest
from foliary.llm.graph import components

SEED = 42
# First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRWISE = 48  # groups up to this size are compared by shifts, larger ones by visiting
# First bits of the two 23-bit segments of a lane that give codeword keys; its other bits only verify.
HALVES = (0, 23)
LANES, NEAREST = 6, 3
RESEMBLANCE = 0.8  # of the sets of shingles of two near copies, at least
DIFFERING = 92  # of the 384 bits of six lanes: 58 are expected at a resemblance of 0.8 (deviation 7), 92 at 0.58
BLOCK = 2000  # rows of a key that are compared with so many others in one step
CARRIED = 1024  # shingles of a text whose set travels to the cells; pairs with a longer text are asked for one by one


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The hashes themselves in lane 0, and as if by another seed in the others."""
    if lane:
        hashes = (hashes ^ np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        hashes = (hashes ^ hashes >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        hashes = hashes ^ hashes >> np.uint64(32)
    return hashes


def shingle_hashes(text: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words of a UTF-8 text, repeats included; of all words if there are fewer."""
    words = text.lower().split()  # of bytes: only A-Z and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[last:].tolist())), np.uint64, len(words) - last
    )


def margins(hashes: np.ndarray, lane: int = 0) -> np.ndarray:
    """Per bit of a lane: in how many more hashes it is set than not."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = _lane(hashes[at : at + 65536], lane)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * ones - len(hashes)


def simhash(text: bytes, shingle: int, seed: int = SEED) -> int:
    """Fingerprint of a UTF-8 text: a bit is set if it is set in over half of the hashes of the shingles."""
    bits = np.packbits(margins(shingle_hashes(text, shingle, seed)) > 0, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = SEED, text: str = "text") -> DataFrame:
    """doc_id and the fingerprint ``fp`` of every text, a signed long; null and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t, shingle, seed) for t in as_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _mix(kind: int, *parts: np.ndarray) -> np.ndarray:
    """Pack a kind and up to 56 bits of parts into a key, spread over all 64 bits by an odd multiplier (one to one)."""
    key = parts[0].astype(np.uint64)
    for part in parts[1:]:
        key = key << np.uint64(12) | part
    return (key | np.uint64(kind) << np.uint64(57)) * np.uint64(0x9E3779B97F4A7C15)


def golay_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 64-bit fingerprints, and the row that each belongs to: values at distance 3 or less share a key.

    Three errors fall on the three segments in one of two ways. Either a segment is free of errors and another has at
    most one: the key is the bits of the first and a codeword index of the second. Or each segment has one: the key is
    three codeword indices, where one row gives all its codewords for the first segment and the nearest for the others,
    and the other row the reverse, so that 6 + 36 keys do instead of 216.
    """
    parts = [values >> np.uint64(first) & np.uint64((1 << width) - 1) for first, width in SEGMENTS]
    near = [nearby(part) for part in parts]
    keys, rows = [], []

    def add(kind: int, columns: list[np.ndarray], valid: np.ndarray) -> None:
        keys.append(_mix(kind, *columns)[valid])
        rows.append(np.nonzero(valid)[0])

    for i in range(3):
        for j in range(3):
            for a in range(6 if i != j else 0):
                add(3 * i + j, [parts[i], near[j][0][:, a]], near[j][1] > a)
    (first, n0), (second, n1), (third, n2) = near
    for a in range(6):
        add(15, [first[:, a], second[:, 0], third[:, 0]], n0 > a)
    for b in range(6):
        for c in range(6):
            if b or c:  # the nearest of all three is there already
                add(15, [first[:, 0], second[:, b], third[:, c]], (n1 > b) & (n2 > c))
    return np.concatenate(keys), np.concatenate(rows)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _visit(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within one group: what has been reached is not compared again."""
    rest, left, right = values, [], []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            hit = _distance(rest, at) <= most
            if hit.any():
                reached = rest[hit]
                left.append(np.full(len(reached), at, np.uint64))
                right.append(reached)
                frontier.extend(reached.tolist())
                rest = rest[~hit]
                frontier = [np.uint64(x) for x in frontier]
    return (np.concatenate(left), np.concatenate(right)) if left else (values[:0], values[:0])


def links_in_groups(keys: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among values with equal keys; ``keys`` is sorted. Enough of them to connect what is connected."""
    change = np.concatenate(([True], keys[1:] != keys[:-1]))
    starts = np.nonzero(change)[0]
    sizes = np.diff(np.append(starts, len(keys)))
    left, right = [], []
    big = sizes > PAIRWISE
    for start, size in zip(starts[big].tolist(), sizes[big].tolist()):
        a, b = _visit(np.unique(values[start : start + size]), most)
        left.append(a)
        right.append(b)
    small = np.repeat(~big & (sizes > 1), sizes)
    keys, values = keys[small], values[small]
    for shift in range(1, PAIRWISE):
        if shift >= len(keys):
            break
        same = keys[shift:] == keys[:-shift]
        if not same.any():
            break
        a, b = values[:-shift][same], values[shift:][same]
        hit = (_distance(a, b) <= most) & (a != b)
        left.append(a[hit])
        right.append(b[hit])
    return (np.concatenate(left), np.concatenate(right)) if left else (values[:0], values[:0])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of one task as (node, smallest node that it reaches): one per node instead of one per pair."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _marks(column: pa.Array) -> np.ndarray:
    """A column of bit strings of one length as rows of 64-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _marks_apart(marks: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(marks ^ other).sum(axis=-1, dtype=np.int64)


def resembles(one: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of some sets of shingles have a Jaccard resemblance of at least ``least`` with a set; all are sorted."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    values = np.concatenate([one[:0], *others])
    if len(one):
        found = one[np.minimum(np.searchsorted(one, values), len(one) - 1)] == values
    else:
        found = np.zeros(len(values), bool)
    total = np.concatenate(([0], np.cumsum(found)))
    ends = np.cumsum(sizes)
    shared = total[ends] - total[ends - sizes]
    return shared >= least * (len(one) + sizes - shared) - 1e-9


def pairs_in_groups(
    cells: np.ndarray, nodes: np.ndarray, roots: np.ndarray, marks: np.ndarray, sets: list[np.ndarray | None] | None, most: int, least: float
) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of nodes with equal cells (``cells`` is sorted) and different roots whose marks differ in at most ``most``
    bits, in parts, and whether they are known to be linked.

    Without ``sets`` all are. With them, pairs whose sets are both there are judged at once: those that resemble each
    other are linked, and what they connect is not compared again. Of the others it is not known.
    """
    roots = roots.copy()

    def judged(i: int, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        here = np.array([sets[i] is not None and sets[j] is not None for j in others.tolist()], bool)
        if not here.all():
            yield np.full((~here).sum(), nodes[i]), nodes[others[~here]], False
        linked = others[here]
        if len(linked):
            linked = linked[resembles(sets[i], [sets[j] for j in linked.tolist()], least)]
        if len(linked):
            yield np.full(len(linked), nodes[i]), nodes[linked], True

    starts = np.nonzero(np.concatenate(([True], cells[1:] != cells[:-1])))[0]
    sizes = np.diff(np.append(starts, len(cells)))
    big = sizes > PAIRWISE
    for start, size in zip(starts[big].tolist(), sizes[big].tolist()):
        mine = roots[start : start + size]
        place = {node: at for at, node in enumerate(nodes[start : start + size].tolist())}
        for i in range(start, start + size - 1):
            rest = np.nonzero(roots[i + 1 : start + size] != roots[i])[0] + i + 1
            rest = rest[_marks_apart(marks[rest], marks[i]) <= most]
            if not len(rest):
                continue
            if sets is None:
                yield np.full(len(rest), nodes[i]), nodes[rest], True
                continue
            for a, b, known in judged(i, rest):
                yield a, b, known
                if known:
                    mine[np.isin(mine, mine[[place[node] for node in b.tolist()]])] = roots[i]
    small = np.nonzero(np.repeat(~big & (sizes > 1), sizes))[0]
    left, right = [], []
    for shift in range(1, PAIRWISE):
        a, b = small[:-shift], small[shift:]
        same = cells[a] == cells[b]
        if not same.any():
            break
        a, b = a[same], b[same]
        keep = roots[a] != roots[b]
        a, b = a[keep], b[keep]
        keep = _marks_apart(marks[a], marks[b]) <= most
        left.append(a[keep])
        right.append(b[keep])
    if not left:
        return
    a, b = np.concatenate(left), np.concatenate(right)
    if sets is None:
        yield nodes[a], nodes[b], True
        return
    a, b = np.where(nodes[a] < nodes[b], a, b), np.where(nodes[a] < nodes[b], b, a)
    order = np.lexsort((nodes[b], nodes[a]))  # a pair that shares several cells is judged once
    a, b = a[order], b[order]
    new = np.concatenate(([True], (nodes[a[1:]] != nodes[a[:-1]]) | (nodes[b[1:]] != nodes[b[:-1]])))[: len(a)]
    a, b = a[new], b[new]
    first = np.nonzero(np.concatenate(([True], nodes[a[1:]] != nodes[a[:-1]])))[0] if len(a) else a
    for i, others in zip(a[first].tolist(), np.split(b, first[1:])):
        yield from judged(i, others)


def _in_company(rows: DataFrame, most: int) -> DataFrame:
    """(key, node, least): of ``rows`` (key, node, mark) those that share their key with a row whose mark differs in at
    most ``most`` bits, and the smallest node among them.

    Rows of unlike texts that happen to share a key end here, so what goes on grows with the near copies alone. Keys of
    more than ``PAIRWISE`` rows go on as they are, and are never held.
    """

    def sifted(keys: np.ndarray, nodes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0]
        sizes = np.diff(np.append(starts, len(keys)))
        keep = np.repeat(sizes > PAIRWISE, sizes)
        small = np.nonzero(~keep & np.repeat(sizes > 1, sizes))[0]
        for shift in range(1, PAIRWISE):
            a, b = small[:-shift], small[shift:]
            same = keys[a] == keys[b]
            if not same.any():
                break
            a, b = a[same], b[same]
            close = _marks_apart(marks[a], marks[b]) <= most
            keep[a[close]] = keep[b[close]] = True
        keys, nodes = keys[keep], nodes[keep]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]
        return keys, nodes, nodes[first][np.cumsum(first) - 1]

    def send(keys: np.ndarray, nodes: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes), pa.array(least)], ["key", "node", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), _marks(batch.column(2))]
            if passing:
                cut = np.searchsorted(columns[0], passing[0], side="right")
                if cut:
                    yield send(columns[0][:cut], columns[1][:cut], np.full(cut, passing[1]))
                    columns = [c[cut:] for c in columns]
                if not len(columns[0]):
                    continue
                passing = None
            if held:
                columns = [np.concatenate(parts) for parts in zip(held, columns)]
            cut = np.searchsorted(columns[0], columns[0][-1])  # the last key may go on
            if cut:
                yield send(*sifted(*(c[:cut] for c in columns)))
            held = [c[cut:] for c in columns]
            if len(held[0]) > PAIRWISE:
                passing = held[0][0], held[1][0]
                yield send(held[0], held[1], np.full(len(held[0]), passing[1]))
                held = None
        if held:
            yield send(*sifted(*held))

    dealt = rows.select("key", "node", "mark").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "key long, node long, least long")


def _nearest_first(shared: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(a, b): per node the nearest of the smallest nodes of its keys, if its mark differs in at most ``most`` bits."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = _marks_apart(_marks(batch.column(1)), _marks(batch.column(3)))
                close = pa.array(apart <= most)
                columns = [batch.column(0), batch.column(2), pa.array(apart)]
                yield pa.RecordBatch.from_arrays([c.filter(close) for c in columns], ["a", "b", "apart"])

    pairs = shared.filter("node <> least").select("node", "least").distinct()
    marked = pairs.join(nodes.select("node", "mark"), "node").join(nodes.select(F.col("node").alias("least"), F.col("mark").alias("other")), "least")
    close = marked.select("node", "mark", "least", "other").mapInArrow(compare, "a long, b long, apart long")
    return close.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", "best.b")


def _dealt(shared: DataFrame, placed: DataFrame, block: int) -> DataFrame:
    """(cell, node, root, mark) of the keys whose nodes have several roots: every two rows of a key with different roots
    meet in a cell of some ``2 * block`` rows at most.

    The rows of a key's most frequent root and all its other rows are cut into blocks by a hash, and each two blocks,
    other than two of the most frequent root, make a cell.
    """
    rooted = shared.select("key", "node").join(placed, "node")
    counted = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = counted.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("n")).filter("n > n_top")
    tops, rests = F.ceil(F.col("n_top") / block).cast("int"), F.ceil((F.col("n") - F.col("n_top")) / block).cast("int")
    cuts = rooted.join(mixed, "key").select("*", tops.alias("tops"), rests.alias("rests"), (F.col("root") == F.col("top")).alias("is_top"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("rests"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda kind, i, j: F.xxhash64(F.col("key"), F.lit(kind), i, j)
    across = F.transform(upto(F.col("tops")), lambda i: cell(0, i, F.col("mine")))
    within = F.transform(upto(F.col("rests")), lambda j: cell(1, F.least(F.col("mine"), j), F.greatest(F.col("mine"), j)))
    cells = F.when(F.col("is_top"), F.transform(upto(F.col("rests")), lambda j: cell(0, F.col("mine"), j))).otherwise(F.concat(across, within))
    return cuts.withColumn("mine", mine).select(F.explode(cells).alias("cell"), "node", "root", "mark")


def connected(
    nodes: DataFrame,
    rows: DataFrame,
    most: int,
    confirm: Callable[[DataFrame], DataFrame] | None = None,
    sets: Callable[[DataFrame], DataFrame] | None = None,
    least: float = RESEMBLANCE,
    block: int = BLOCK,
) -> DataFrame:
    """(node, root) of the components by links between nodes that share a key and whose marks differ in at most ``most``
    bits; with ``confirm``, only the pairs (a, b) that it returns of those it is given are links.

    ``nodes`` has node and mark (binary), ``rows`` key, node and mark. First the rows that share a key with no near mark
    are left out. Then every node is linked to the nearest of the smallest nodes of its keys. After that, only keys whose
    nodes are not all connected are left, and within them only pairs that are not connected yet are compared, in cells of
    bounded size. So no task holds the rows of a key, a family of near copies is not compared pairwise, and no link is
    lost. ``sets`` gives (node, shingles) for some of the nodes it is given, sorted hashes of at most ``CARRIED``
    shingles: they travel with the rows, so a cell judges its pairs by itself (linked at a resemblance of ``least``) and
    gives links instead of pairs to confirm, one per node that it connects.
    """
    shared = materialize(_in_company(rows, most), "shared")
    first = _nearest_first(shared, nodes, most)
    first = materialize(confirm(first) if confirm else first, "links")
    roots = components(first)
    placed = materialize(nodes.join(roots, "node", "left").select("node", "mark", F.coalesce("root", "node").alias("root")), "placed")
    judges, unasked = sets is not None, confirm is None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(cells: np.ndarray, nodes: np.ndarray, roots: np.ndarray, marks: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
            held = [None if x is None else np.frombuffer(x, np.uint64) for x in found.tolist()] if judges else None
            parts = {True: [], False: []}
            size = 0
            for a, b, known in pairs_in_groups(cells, nodes, roots, marks, held, most, least):
                parts[known or unasked].append((np.minimum(a, b), np.maximum(a, b)))
                size += len(a)
                if size > 1_000_000:
                    yield from send(parts)
                    parts, size = {True: [], False: []}, 0
            yield from send(parts)

        def send(parts: dict[bool, list]) -> Iterator[pa.RecordBatch]:
            for known, pairs in parts.items():
                if not pairs:
                    continue
                a, b = (np.concatenate(x) for x in zip(*pairs))
                if known:
                    a, b = stars(a, b)
                else:
                    order = np.lexsort((b, a))
                    a, b = a[order], b[order]
                    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                    a, b = a[new], b[new]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([known] * len(a), pa.bool_())], ["a", "b", "known"])

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.empty(batch.num_rows, object)
            found[:] = batch.column(4).to_pylist()
            held.append((*(batch.column(i).to_numpy() for i in range(3)), _marks(batch.column(3)), found))
            if held[0][0][0] == held[-1][0][-1]:
                continue  # all of one cell so far
            columns = [np.concatenate(parts) for parts in zip(*held)]
            cut = np.searchsorted(columns[0], columns[0][-1])  # the last cell may go on
            yield from settle(*(c[:cut] for c in columns))
            held = [tuple(c[cut:] for c in columns)]
        if held:
            yield from settle(*(np.concatenate(parts) for parts in zip(*held)))

    dealt = _dealt(shared, placed, block)
    if judges:
        dealt = materialize(dealt, "cells")
        dealt = dealt.join(materialize(sets(dealt.select("node").distinct()), "sets"), "node", "left").select("cell", "node", "root", "mark", "shingles")
    else:
        dealt = dealt.withColumn("shingles", F.lit(None).cast("binary"))
    second = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long, known boolean").distinct()
    second = materialize(second, "links")
    links = first.union(second.filter("known").select("a", "b"))
    if confirm:
        links = links.union(materialize(confirm(second.filter("NOT known").select("a", "b")), "links"))
    return components(links)


def fingerprint_components(values: DataFrame, most: int = 3, block: int = BLOCK) -> DataFrame:
    """(node, root) of the components of the distinct fingerprints in ``values.fp``, by links of at most ``most`` bits.

    All are found up to 3 bits. With a higher ``most``, pairs beyond 3 bits are linked if they happen to share a key.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(found), 20_000):
                part = found[at : at + 20_000]
                keys, rows = golay_keys(part)
                marks = pa.array([x.tobytes() for x in part], pa.binary()).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part[rows].view(np.int64)), marks], ["key", "node", "mark"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in batch.column(0).to_numpy()], pa.binary())], ["node", "mark"])

    fps = values.select("fp")
    return connected(fps.mapInArrow(mark, "node long, mark binary"), fps.mapInArrow(explode, "key long, node long, mark binary"), most, block=block)


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3, text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits) and component_id.

    Fingerprints that differ in at most ``most`` bits are linked; component_id is the smallest doc_id that a document
    reaches through links, its own included. Equal fingerprints, that of blank and null texts among them, are always
    linked. Rows that repeat a doc_id are kept; a row without doc_id is kept and takes part, but gives no component its
    id. Further columns are ignored. An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, shingle, text=text), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = fingerprint_components(nodes, most)
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    labelled = materialize(labelled, "labels")
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = labelled.join(smallest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def sketches(docs: DataFrame, shingle: int = 5, lanes: int = LANES, seed: int = SEED, text: str = "text") -> DataFrame:
    """(doc_id, text_key, mark, digest, codes) of every text: the bits of ``lanes`` fingerprints of its distinct shingles,
    a digest of their set, and for both segments of every lane the indices of the ``NEAREST`` codewords, weighing each
    bit by its margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            found, digests = np.zeros((len(texts), lanes, 64), np.float32), []
            for row, text in zip(found, texts):
                hashes = np.unique(shingle_hashes(text, shingle, seed))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                for lane in range(lanes):
                    row[lane] = margins(hashes, lane)
            marks = np.packbits(found > 0, axis=2, bitorder="little").reshape(len(texts), -1)
            codes = np.stack([nearest(found[:, :, at : at + 23].reshape(-1, 23), NEAREST) for at in HALVES], axis=1)
            codes = codes.astype(np.uint16).reshape(len(texts), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m.tobytes() for m in marks], pa.binary()), pa.array(digests, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())],
                ["doc_id", "text_key", "mark", "digest", "codes"],
            )

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_key"), whole.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, mark binary, digest binary, codes binary")


def sketch_keys(nodes: DataFrame, lanes: int = LANES) -> DataFrame:
    """(key, node, mark): a key is a lane and a codeword index of each of its two segments, ``NEAREST`` squared keys per lane
    and row."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(part.num_rows, lanes, 2, NEAREST).astype(np.uint64)
                pairs = codes[:, :, 0, :, None] << np.uint64(12) | codes[:, :, 1, None, :]
                keys = _mix(0, (pairs | np.arange(lanes, dtype=np.uint64)[None, :, None, None] << np.uint64(24)).reshape(-1))
                rows = pa.array(np.repeat(np.arange(part.num_rows), len(keys) // max(part.num_rows, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), part.column(0).take(rows), part.column(1).take(rows)], ["key", "node", "mark"])

    return nodes.select("node", "mark", "codes").mapInArrow(explode, "key long, node long, mark binary")


def shingle_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int = 5, text: str = "text", longest: int | None = None) -> DataFrame:
    """(node, shingles): the sorted hashes of the shingles of the texts of some nodes, as bytes; of those with at most
    ``longest`` shingles, if given."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in as_bytes(batch.column(1))]
            short = pa.array([longest is None or len(x) <= longest for x in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(short) for c in (batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary()))], ["node", "shingles"])

    wanted = wanted.join(nodes.select("node", "text_key"), "node")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.xxhash64(whole).alias("text_key"), whole.alias("text"))
    texts = texts.join(wanted, ["node", "text_key"]).dropDuplicates(["node", "text_key"]).select("node", "text")
    return texts.mapInArrow(hashed, "node long, shingles binary")


def resembling(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int = 5, least: float = RESEMBLANCE, text: str = "text") -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have a Jaccard resemblance of at least ``least``, by the hashes
    of all shingles of either text."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                keep += resembles(np.frombuffer(x.as_py(), np.uint64), [np.frombuffer(y.as_py(), np.uint64)], least).tolist()
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    pairs = materialize(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = materialize(shingle_sets(wanted, nodes, docs, shingle, text), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def near_classes(
    docs: DataFrame, shingle: int = 5, most: int = DIFFERING, lanes: int = LANES, text: str = "text", least: float = RESEMBLANCE, block: int = BLOCK
) -> DataFrame:
    """One row per class of texts with one set of shingles: node (its smallest doc_id), text_key (of one text there), mark,
    digest (of the set), and root (the smallest doc_id that the class reaches through links).

    Texts are linked if the Jaccard resemblance of the sets of their five-word shingles is at least ``least``. Candidates
    are pairs whose marks differ in at most ``most`` of 64 * ``lanes`` bits, and of which a segment pair of some lane
    decodes to common codewords; each is verified by all shingles of both texts. The codewords are found with the margins
    of the bits, which says which bits are likely to differ in a near copy: at a resemblance of 0.8, 99 % share a key.
    Rows without doc_id take no part. Blank texts are copies of each other. An empty table gives no rows.
    """
    docs = docs.filter("doc_id IS NOT NULL")
    marked = sketches(docs, shingle, lanes, text=text)
    first = marked.groupBy("mark", "digest").agg(F.min(F.struct("doc_id", "text_key", "codes")).alias("least"))
    nodes = materialize(first.select(F.col("least.doc_id").alias("node"), "least.text_key", "mark", "digest", "least.codes"), "nodes")
    confirm = lambda pairs: resembling(pairs, nodes, docs, shingle, least, text)
    sets = lambda wanted: shingle_sets(wanted, nodes, docs, shingle, text, CARRIED)
    roots = connected(nodes.select("node", "mark"), sketch_keys(nodes, lanes), most, confirm, sets, least, block)
    return nodes.join(roots, "node", "left").select("node", "text_key", "mark", "digest", F.coalesce("root", "node").alias("root"))


def first_of_each(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without near copies of a document with a smaller doc_id; all columns.

    Rows without doc_id stay. A text goes if its class has a smaller doc_id, so rows that share a doc_id are judged each
    by its own text; rows equal in doc_id and text stay or go together.
    """
    first = near_classes(docs, text=text, **options).filter("node = root")
    first = first.select(F.col("node").alias("__id"), F.col("text_key").alias("__text"))
    key = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    whole = docs.filter("doc_id IS NOT NULL")
    kept = whole.join(first, (whole["doc_id"].cast("long") == first["__id"]) & (key == first["__text"]), "left_semi")
    return kept.union(docs.filter("doc_id IS NULL"))


@query("op9_simhash_components")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder, "doc_id", "text"))
