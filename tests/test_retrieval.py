import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.functions import text as tx
from foliary.operators import chunking, retrieval, vectors
from foliary.plans.tables import Tables


def chunks_of(spark, *texts, target=512, overlap=64):
    pages = spark.createDataFrame([(10, 20 + n, t) for n, t in enumerate(texts)], "document_id bigint, page_id bigint, text string")
    return chunking.chunk_documents(pages, target, overlap).orderBy("page_id", "chunk_no").collect()


def test_short_pages_are_skipped(spark):
    assert chunks_of(spark, "short") == []


def test_pages_are_not_mixed(spark):
    rows = chunks_of(spark, "alpha " * 700, "beta " * 700, target=64, overlap=8)
    assert {r["page_id"] for r in rows} == {20, 21}
    assert all(("alpha" in r["text"]) != ("beta" in r["text"]) or len(r["text"]) <= 5 for r in rows)


def test_neighbours_overlap(spark):
    rows = chunks_of(spark, " ".join(f"word{n}" for n in range(260)), target=64, overlap=8)
    assert len(rows) > 1 and set(rows[0]["text"].split()) & set(rows[1]["text"].split())


def test_blank_line_beats_a_later_newline(spark):
    text = "a" * 300 + "\n\n" + "b" * 200 + "\n" + "c" * 3000
    rows = chunks_of(spark, text)
    assert rows[0]["text"] == "a" * 300 and rows[0]["char_end"] == 300


def test_delimiter_near_the_start_is_ignored(spark):
    rows = chunks_of(spark, "a" * 100 + "\n" + "b" * 3000)
    assert rows[0]["char_end"] == 2048


def test_chunk_invariants(spark):
    text = " " + "".join(f"Sentence {n} has words.{' ' if n % 7 else chr(10) * 2}" for n in range(900)) + "\x85 "
    rows = chunks_of(spark, text)
    covered = 0
    for row in rows:
        assert row["text"] == text[row["char_start"] : row["char_end"]] == row["text"].strip(tx.WHITESPACE_CHARS)
        assert len(row["text"]) <= 2048 and row["token_count"] == -(-len(row["text"]) // 4)
        assert row["char_start"] <= covered or not text[covered : row["char_start"]].strip(tx.WHITESPACE_CHARS)
        covered = row["char_end"]
    assert not text[covered:].strip(tx.WHITESPACE_CHARS)


def test_token_estimate(spark):
    assert [r[0] for r in spark.createDataFrame([("",), ("   ",), ("abcde",)], "t string").select(chunking.estimate_tokens(F.col("t"))).collect()] == [0, 0, 2]


def test_nearest_of_three(spark):
    library = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "chunk_id bigint, embedding array<float>")
    query = spark.createDataFrame([(7, [0.9, 0.1, 0.0])], "query_id bigint, embedding array<float>").withColumn("embedding", vectors.l2_normalize(F.col("embedding")))
    assert vectors.knn_join(query, library, 1).first()["chunk_id"] == 1


@pytest.mark.parametrize("block_bytes", [32 << 20, 256])
def test_nearest_equal_brute_force(spark, block_bytes):
    rng = np.random.default_rng(5)
    library = rng.integers(-2, 3, (400, 4)).astype(float)  # many equal distances
    asked = rng.integers(-2, 3, (23, 4)).astype(float)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(library)], "chunk_id bigint, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id bigint, embedding array<double>")
    admitted = frame.filter("chunk_id % 3 = 0").select("chunk_id")
    for mode in ("post", "pre"):
        got = {}
        for r in vectors.knn_join(queries, frame, 6, admitted, mode, block_bytes).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["chunk_id"])
        for q, v in enumerate(asked):
            order = sorted(range(400), key=lambda i: (round(float(np.linalg.norm(library[i] - v)), 6), i))
            want = [i for i in order[:6] if i % 3 == 0] if mode == "post" else [i for i in order if i % 3 == 0][:6]
            assert got.get(q, []) == want


def test_embedder_is_batched_and_checked(spark):
    chunks = spark.createDataFrame([(n, "x" * (n + 1)) for n in range(10)], "chunk_id bigint, text string").coalesce(1)

    def embedder(texts):
        assert len(texts) <= 4
        return np.array([[len(t), 0.0] for t in texts])

    rows = vectors.embed_chunks(chunks, embedder, dim=2, batch=4).collect()
    assert len(rows) == 10 and all(r["embedding"] == [1.0, 0.0] for r in rows)
    with pytest.raises(Exception, match="dimension mismatch"):
        vectors.embed_chunks(chunks, embedder, dim=3, batch=4).collect()
    with pytest.raises(Exception, match="vectors for"):
        vectors.embed_chunks(chunks, lambda texts: np.zeros((1, 2)), dim=2, batch=4).collect()


def test_vector_text_and_dimension(spark):
    df = spark.createDataFrame([([0.5, -1.0],)], "embedding array<float>")
    assert df.select(vectors.vector_text(F.col("embedding"))).first()[0] == "[0.50000000,-1.00000000]"
    with pytest.raises(Exception, match="expected 3"):
        vectors.checked_dimension(df, 3).collect()


def test_fusion_ties_go_by_chunk(spark):
    schema = "query_id bigint, chunk_id bigint, {} double, rank bigint"
    lexical = spark.createDataFrame([(1, 9, -2.0, 1), (1, 5, -1.0, 2)], schema.format("bm25_score"))
    vector = spark.createDataFrame([(1, 5, 0.0, 1), (1, 7, 3.0, 2)], schema.format("distance"))
    rows = retrieval.rrf_fuse(retrieval.candidate_union(lexical, vector)).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == [5, 7, 9]
    assert rows[0]["combined_score"] == round(0.4 / 62 + 0.6 / 61, 8) and rows[0]["vec_score"] == 1.0
    equal = spark.createDataFrame([(1, 8, None, None, 0.5, 3), (1, 4, None, None, 0.5, 3)], "query_id bigint, chunk_id bigint, fts_score double, fts_rank bigint, vec_score double, vec_rank bigint")
    assert [r["chunk_id"] for r in retrieval.rrf_fuse(equal).orderBy("rank").collect()] == [4, 8]


@pytest.mark.parametrize(
    "answer, retrieved, content, indices",
    [("Use [1] but not [99].", 3, "Use [1] but not [?].", [1]), ("A [2] B [1] C [2]", 2, "A [2] B [1] C [2]", [2, 1]), ("[0] [007] [12345]", 8, "[?] [7] [12345]", [7]), ("none", 0, "none", [])],
)
def test_citation_markers(spark, answer, retrieved, content, indices):
    found = spark.createDataFrame([(1, n, n * 10, n * 100, n) for n in range(1, retrieved + 1)], "query_id bigint, rank bigint, chunk_id bigint, page_id bigint, document_id bigint")
    row = retrieval.ground_citations(spark.createDataFrame([(5, 1, answer)], "answer_id bigint, query_id bigint, answer string"), found).first()
    assert row["content"] == content and [c["index"] for c in row["citations"]] == indices
    assert all(c["chunk_id"] == c["index"] * 10 for c in row["citations"])


def test_thread_titles(spark):
    rows = [(1, 0, "user", "word " * 40, None, 5), (2, 0, "assistant", "hi", None, 6), (3, 0, "user", "  ", None, 7)]
    threads = {r["thread_id"]: r for r in retrieval.thread_list(spark.createDataFrame(rows, "thread_id bigint, turn bigint, role string, content string, citations string, created_at bigint")).collect()}
    assert len(threads[1]["title"]) == 65 and threads[2]["title"] == threads[3]["title"] == "New thread" and threads[2]["preview"] is None


def test_chunks_of_one_file_are_cut_in_many_tasks(spark, tmp_path):
    # All documents with a vector lie in one part of the table, as they do where ids grow.
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(500)), lambda n: F.md5(F.concat_ws("-", "doc_id", n))))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 500, text).otherwise("short").alias("text"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = spark.range(500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    found.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    index = Tables(spark, str(tmp_path)).chunk_index
    cut = index.blocks.filter("term IS NULL").select("n_rows").collect()
    assert sum(r["n_rows"] for r in cut) == 500 and len(cut) >= 4 and max(r["n_rows"] for r in cut) <= 250
    assert (index.corpus.first()["total_len"], index.terms.agg(F.sum("occurrences")).first()[0]) == (250_000, 250_000)
