"""Sparse suffix arrays."""

import pickle
import random

import numpy as np
import zstandard

from foliary.llm import substrings
from foliary.llm.suffix_array import sparse_suffix_array


def test_sparse_suffix_array():
    rng = np.random.default_rng(3)
    for n, letters, depth in ((1, 2, 50), (400, 2, 12), (3000, 3, 50), (3000, 2, 5)):
        data = rng.integers(0, letters, n).astype(np.uint8)
        data[n // 2 :] = data[: n - n // 2]
        positions = rng.permutation(n)[: max(1, n // 3)]
        order, new = sparse_suffix_array(data, positions, depth)
        raw = data.tobytes() + bytes(depth)
        keys = [raw[p : p + depth] for p in positions[order].tolist()]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(positions)))
        assert new.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]


def test_only_windows_are_sorted(monkeypatch):
    """A string of 65 bytes has 16 windows of 50; the 49 places where none starts are not sorted."""
    sorted_places = []
    sort = substrings.sparse_suffix_array
    monkeypatch.setattr(substrings, "sparse_suffix_array", lambda data, positions, depth: sorted_places.append(len(positions)) or sort(data, positions, depth))
    rng = random.Random(1)
    common = rng.randbytes(60)
    strings = [common + rng.randbytes(5), rng.randbytes(5) + common, rng.randbytes(65)]
    first = substrings.first_documents(strings, np.array([7, 3, 5]))
    assert sorted_places == [48]
    assert first.tolist() == [3] * 11 + [7] * 5 + [3] * 16 + [5] * 16


def test_anchors_of_any_block_size(monkeypatch):
    """Windows are taken in blocks, and no array is as long as the text."""
    data = np.frombuffer(random.Random(2).randbytes(1000), np.uint8)
    whole = substrings.window_anchors(data)
    taken = []
    work = substrings._anchors_of
    monkeypatch.setattr(substrings, "_anchors_of", lambda part, *x: taken.append(len(part)) or work(part, *x))
    for block in (1, 7, 64, 951):
        monkeypatch.setattr(substrings, "BLOCK", block)
        assert (substrings.window_anchors(data) == whole).all() and max(taken) == block + 49
        taken.clear()
    assert len(substrings.window_anchors(data[:49])) == 0


def test_shards_answer_with_the_first_document(monkeypatch):
    """Runs of each string of each request, as brute force finds them, however small the shards are."""
    rng = random.Random(3)
    common = rng.randbytes(60)
    groups = {9: [common + rng.randbytes(5), rng.randbytes(5) + common, common], 4: [rng.randbytes(70)], 6: [rng.randbytes(55), rng.randbytes(50)]}
    requests = []
    for number in range(4):
        some = rng.sample([(m, s) for m, strings in groups.items() for s in strings], 4)
        requests.append((number, [s for _, s in some], [m for m, _ in some], [rng.randrange(100) for _ in some]))
    least = {}
    for _, strings, _, ids in requests:
        for s, d in zip(strings, ids):
            for k in range(len(s) - 49):
                least[s[k : k + 50]] = min(d, least.get(s[k : k + 50], d))
    rows = [(3, n, zstandard.compress(pickle.dumps((s, np.array(m, np.uint32), np.array(d)))), None) for n, s, m, d in requests]
    for size in (1, 4_000_000):
        monkeypatch.setattr(substrings, "SHARD_BYTES", size)
        out = [r for batch in substrings._sort_shards(iter([substrings._rows(rows)])) for r in batch.to_pylist()]
        assert [r["batch"] for r in out] == [0, 1, 2, 3]
        for r, (_, strings, _, _) in zip(out, requests):
            raw, (n, m) = zstandard.decompress(r["a"]), np.frombuffer(r["b"], np.int64).tolist()
            count, width, value = np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.int32, m, 4 * n), np.frombuffer(raw[4 * (n + m) :], np.int64)
            assert n == len(strings) and m == len(value)
            assert np.repeat(value, width).tolist() == [least[s[k : k + 50]] for s in strings for k in range(len(s) - 49)]
            assert [x.sum() for x in np.split(width, np.cumsum(count)[:-1])] == [len(s) - 49 for s in strings]
