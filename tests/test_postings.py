"""Block postings as bytes."""

import numpy as np

from foliary.operators import postings, search


def test_numbers_survive_their_encoding():
    numbers = np.array([0, 1, 127, 128, 300, 2**31, 2**63 - 1, 2**64 - 1], np.uint64)
    data, ends = postings.encoded(numbers)
    assert postings.decoded(data).tolist() == numbers.tolist()
    assert ends[:5].tolist() == [1, 2, 3, 5, 7]
    signed = np.array([0, -1, 1, -(2**63), 2**63 - 1])
    assert postings._unsigned(postings._signed(signed)).tolist() == signed.tolist()


def test_postings_are_small_and_whole(spark):
    rows = [(n * 100_000 + 1, None if n % 7 == 0 else n * (-1) ** n, f"the number w{n % 50} and the end") for n in range(3000)]
    texts = spark.createDataFrame(rows, "page_id bigint, document_id bigint, text string").coalesce(1)
    index = search.build_index(texts)
    assert index.blocks.filter("term IS NOT NULL").selectExpr("sum(octet_length(entries) + octet_length(positions)) / sum(n_tokens) AS n").first()["n"] < 12
    got = sorted((r["row_id"], r["position"], r["term"], r["document_id"], r["row_len"]) for r in index.postings.collect())
    assert got == sorted((i, k, word, d, 6) for i, d, text in rows for k, word in enumerate(text.split()))
