"""Operators mended after review: random-walk candidates, columns that clash, words encoded in lines."""

from itertools import repeat

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliary.llm import contamination, packing, quality

FOLDER = "/root/testdata/sf0.001"


def _exact(index, symbols, offsets):
    """Matches by verifying every place that may hold one, without walks and keys."""
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

    def everywhere():
        for m, docs, items, places in index.places(symbols, document):
            wide = 2 * contamination.edits(m, index.similarity) + 1
            found = np.unique(np.stack((docs, items, places // wide)), axis=1)
            yield m, found[0], found[1], found[2] * wide

    return index.verified(everywhere(), symbols, offsets)


def test_walks_find_what_the_exact_search_finds(spark):
    texts = [(r["text"] or "").lower().encode().split() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    items = [(r["item_id"], r["text"].lower().encode().split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    index = contamination.Index.build([i for i in items if len(i[1]) >= 5], 0.8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    symbols = np.fromiter((s for t in texts for s in map(index.vocabulary.get, t, repeat(0))), np.int64)
    found = index.search(symbols, offsets)
    assert found == _exact(index, symbols, offsets)


def test_a_walk_maps_few_edits_to_few_differences():
    rng = np.random.default_rng(3)
    items = rng.integers(1, 1 << 40, (50, 100))
    edited = np.concatenate((items[:, :30], items[:, 33:], items[:, :3]), axis=1)  # three words deleted
    others = rng.integers(1, 1 << 40, (50, 100))
    every = np.arange(200)
    near = (contamination.embed(items, every, 0) == contamination.embed(edited, every, 0)).mean()
    far = (contamination.embed(items, every, 0) == contamination.embed(others, every, 0)).mean()
    assert near > 0.5 and far < 0.05


@pytest.mark.parametrize("words", [5, 20, 60, 250])
def test_more_recall_needs_more_walks(words):
    assert 1 <= contamination.walks(words, recall=0.9) <= contamination.walks(words, recall=0.999)
    assert contamination.walks(words, similarity=1.0) == 1


def test_items_shorter_than_five_words_are_searched_for_exactly_where_asked(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b x c d"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "B c"), (8, "")], "item_id long, text string")
    assert contamination.contaminated(docs, bench).count() == 0
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in contamination.contaminated(docs, bench, least=1).collect()] == [(1, 7, 0)]


@pytest.mark.parametrize("unlisted", [False, True])
def test_quality_rules_keep_columns_called_like_their_own(spark, unlisted):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    if unlisted:
        docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.lit("xx")).otherwise(F.col("lang")))
    names = "own_words own_lang row words lowered common own lines grams ordered kept ref_lang ref_c classes n_words mine rank".split()
    more = docs.select("*", *(F.lit(f"of the input: {n}").alias(n) for n in names))
    want = {r["doc_id"] for r in quality.good_documents(docs).collect()}
    found = quality.good_documents(more)
    assert found.columns == more.columns
    rows = found.collect()
    assert {r["doc_id"] for r in rows} == want
    assert all(r[n] == f"of the input: {n}" for r in rows for n in names)
    assert sorted(map(str, quality.quality_rules(more).collect())) == sorted(map(str, quality.quality_rules(docs).collect()))


def test_words_encoded_in_lines_are_those_of_whole_texts():
    odd = [
        "é ́x ạ́", "<|endoftext|> <|endoftext|>x   　x", "ΣΑΣ İI ß ﬁ", "\x00 \x1c \x85 a\x1eb", "한국어 각 한",
        "'s it's 's", "", "​ ‍ ﻿", "x" * 5000 + " y", "½ ² ㍿", "ᄀ ᅡ ᆨ 가 ᆨ", " ".join(f"w{i} {i}!" for i in range(300)),
    ]
    path = public_tokenizers.path(packing.TOKENIZER)
    whole = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(odd, add_special_tokens=False)]
    assert list(packing.token_bytes([t.encode() for t in odd], path)) == whole
