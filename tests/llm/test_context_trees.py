"""Context trees of several depths against brute force."""

import collections
import math
import zlib

import pytest

from foliary.llm import context_tree


def brute_tree_score(texts, text, depth):
    """log10 probability of a text under context-tree weighting over depths 0 to ``depth``, node by node."""
    seen = collections.defaultdict(lambda: [0, 0])  # (context, decision) -> zeros, ones
    marked = lambda t: [255] * depth + list(t) + [255]
    bits = lambda byte: [((1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1) for k in range(8)]
    for t in texts:
        s = marked(t)
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                for decision, bit in bits(s[i]):
                    seen[(*s[i - d : i],), decision][bit] += 1
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)
    whole = {}
    for (context, decision), (z, o) in sorted(seen.items(), key=lambda x: -len(x[0][0])):
        below = sum(whole.get(((c, *context), decision), 0.0) for c in range(256)) if len(context) < depth else 0.0
        whole[context, decision] = kt(z, o) if len(context) == depth else math.log(0.5 * math.exp(kt(z, o)) + 0.5 * math.exp(below))
    score, s = 0.0, marked(text)
    for i in range(depth, len(s)):
        for decision, bit in bits(s[i]):
            p = 0.5
            for d in range(depth, -1, -1):
                node = ((*s[i - d : i],), decision)
                if node not in seen:
                    continue
                z, o = seen[node]
                weight = 1.0 if d == depth else 0.5 * math.exp(kt(z, o) - whole[node])
                p = weight * (o + 0.5) / (z + o + 1) + (1 - weight) * p
            score += math.log10(p if bit else 1 - p)
    return score


@pytest.mark.parametrize("depth", [3, 5])
def test_context_trees_of_all_depths_equal_brute_force(spark, depth):
    texts = [b"the red fox", b"the red hen Saw the fox", b"", "été".encode(), b"xyzzy plugh", b"the red fox", b"red den", b"saw", b"unheard #"]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    assert True in held
    learnt = [t.lower() for t, h in zip(texts, held) if not h]
    got = {r["doc_id"]: r["score"] for r in context_tree.score_documents(docs, depth=depth).collect()}
    assert got == pytest.approx({i: brute_tree_score(learnt, t.lower(), depth) for i, t in enumerate(texts)})


def test_long_contexts_tell_what_short_ones_cannot(spark):
    words = ["abcdx", "bbcdy"]  # what follows "bcd" depends on a byte four back
    docs = spark.createDataFrame([(i, " ".join([*words * 20, "q"])) for i in range(20)], "doc_id long, text string").coalesce(1)
    short, long = ([r["score"] for r in context_tree.score_documents(docs, depth=d).collect()] for d in (3, 5))
    assert min(long) > max(short) + 40 * 0.25  # a bit for each word but the first
    assert context_tree.score_documents(docs.filter("false")).collect() == []
