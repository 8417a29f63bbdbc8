"""Near copies that are judged where they meet."""

import random

import numpy as np

from foliary.llm import simhash


def test_unlike_texts_with_near_marks_give_no_rows():
    n = 300
    nodes, marks = np.arange(n), np.zeros((n, 6), np.uint64)
    apart = [np.arange(10, dtype=np.uint64) + np.uint64(20 * i) for i in range(n)]
    given = lambda sets: list(simhash.pairs_in_groups(np.zeros(n, np.int64), nodes, nodes, marks, sets, 92, 0.8))
    assert given(apart) == []
    # a chain: each shares nine of eleven with the next; links found are enough to connect it
    chain = [np.arange(i, i + 10, dtype=np.uint64) for i in range(n)]
    found = given(chain)
    assert all(known for _, _, known in found)
    node, root = simhash.stars(*(np.concatenate(x) for x in list(zip(*found))[:2]))
    assert len(node) == n - 1 and set(root.tolist()) == {0}
    # without a set a pair is not judged here
    assert sum(len(a) for a, _, known in given([None, *apart[1:]]) if not known) == n - 1


def test_rows_without_near_company_end(spark, monkeypatch):
    far = bytes([255]) * 48
    rows = [(1, 10, bytes(48)), (1, 11, far), (2, 20, bytes(48)), (2, 21, far), (2, 22, bytes(47) + b"\1"), (3, 30, far)]
    rows += [(4, i, bytes(48) if i % 2 else far) for i in range(100, 300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = {tuple(r) for r in simhash._in_company(spark.createDataFrame(rows, "key long, node long, mark binary"), 92).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {(2, 20, 20), (2, 22, 20), *((4, i, 100) for i in range(100, 300))}


def test_long_texts_are_asked_for(spark, monkeypatch):
    """Whether sets travel or pairs are asked for, the classes are the same."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate([*texts, "", None])), "doc_id long, text string")
    classes = lambda: sorted((r["node"], r["root"]) for r in simhash.near_classes(docs).collect())
    carried = classes()
    monkeypatch.setattr(simhash, "CARRIED", 110)
    assert classes() == carried
    monkeypatch.setattr(simhash, "CARRIED", 0)
    assert classes() == carried
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    near = {(i, j) for i in range(90) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    root = dict(carried)
    assert sum(root[i] == root[j] for i, j in near) >= 0.99 * len(near)
