import random

import pytest
from pyspark.sql import functions as F

from foliary.functions.grouping import previous_row, streak_since
from foliary.operators import intake, library
from foliary.sources.files import list_folder, read_files, write_bucketed

HOUR = 3_600_000_000


@pytest.mark.parametrize(
    "name, accepted",
    [(".tmp.pdf", False), ("~$foo.pdf", False), ("scan.tmp.pdf", False), ("download.crdownload", False), ("normal PDF.PDF", True), ("notes.txt", False), ("pdf", False)],
)
def test_candidate_names(spark, name, accepted):
    assert spark.createDataFrame([(name,)], "n string").filter(intake.is_candidate_name(F.col("n"))).count() == accepted


def test_excluded_and_recursive(spark):
    files = spark.createDataFrame(
        [(r"C:\in\Processed\nested\done.pdf",), (r"C:\in\Processed",), (r"C:\in\done.pdf",), (r"\\?\C:\in\sub\x.pdf",), ("C:/in/Processed2/y.pdf",)], "path string"
    )
    kept = lambda **k: {r["path"] for r in intake.folder_candidates(files, **k).collect()}
    assert kept(excluded=[r"C:\in\Processed"]) == {r"C:\in\done.pdf", r"\\?\C:\in\sub\x.pdf", "C:/in/Processed2/y.pdf"}
    assert kept(root=r"C:\in", recursive=False) == {r"C:\in\done.pdf"}
    assert len(kept(root="C:/in/")) == 4


def test_reading_real_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.pdf", b"one"), ("sub/b.PDF", b"two"), ("c.txt", b"no"), (".tmp.pdf", b"no"), ("~$d.pdf", b"no")):
        (tmp_path / name).write_bytes(body)
    rows = library.content_fingerprint(read_files(spark, str(tmp_path)), "content").collect()
    assert {r["path"].rsplit("/", 1)[1]: r["sha8"] for r in rows} == {"a.pdf": "7692c3ad", "b.PDF": "3fc4ccfe"}
    assert list_folder(spark, str(tmp_path), recursive=False).count() == 1


def test_stability_thresholds(spark):
    rows = [("a", 1, 42, 10, 0), ("a", 2, 42, 10, 1_000_000), ("a", 3, 42, 10, 1_999_999), ("a", 4, 43, 10, 5_000_000), ("b", 5, 42, 11, 6_000_000)]
    df = spark.createDataFrame(rows, "path string, listing_id bigint, size bigint, mtime bigint, seen_at bigint")
    for width in (86_400_000_000, 700_000):
        assert [r["stable"] for r in intake.stable_files(df, slice_width=width).orderBy("listing_id").collect()] == [False, True, False, False, False]


def test_sliced_sequences_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = sorted((rng.choice("ab"), rng.randrange(3000), n, rng.random() < 0.3) for n in range(300))
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint, hit boolean")
    want_prev, want_streak, last, run = {}, {}, {}, {}
    for k, t, n, hit in rows:
        want_prev[n], last[k] = last.get(k), n
        run[k] = 0 if hit else run.get(k, 0) + 1
        want_streak[n] = run[k]
    for width in (1, 50, 10_000):
        assert {r["id"]: r["prev_id"] for r in previous_row(df, "k", ["t", "id"], ["id"], width).collect()} == want_prev
        assert {r["id"]: r["s"] for r in streak_since(df, "k", ["t", "id"], F.col("hit"), "s", width).collect()} == want_streak


def brute(events, window, inclusive):
    passed, last = set(), {}
    for key, t in sorted(set(events)):
        if key not in last or (t - last[key] >= window if inclusive else t - last[key] > window):
            last[key] = t
            passed.add((key, t))
    return passed


@pytest.mark.parametrize("inclusive", [False, True])
def test_anchored_dedup(spark, inclusive):
    rng = random.Random(7)
    window = 90_000_000
    events = [("edge", 0), ("edge", window), ("edge", window + 1), ("edge", 2 * window + 1), ("one", 5), ("one", 5)]
    events += [("hot", rng.randrange(0, 40 * window, 1000)) for _ in range(1500)] + [("sparse", rng.randrange(0, 10**12)) for _ in range(60)]
    df = spark.createDataFrame(events, "k string, t bigint")
    got = {tuple(r) for r in intake.anchored_dedup(df, ["k"], "t", window, inclusive).collect()}
    assert got == brute(events, window, inclusive)


def versions(spark, *names):
    rows = [(n, *row) for n, row in enumerate(names)]
    return {r["root"]: r["next_version"] for r in intake.next_versions(spark.createDataFrame(rows, "document_id bigint, display_name string, original_path string, deleted_at bigint")).collect()}


def test_next_versions(spark):
    assert versions(spark, ("report.pdf", "/x", None)) == {"report": 2}
    assert versions(spark, ("Report.pdf", "/x", None), ("report (v2).pdf", "/x", None)) == {"report": 3}
    assert versions(spark, ("report.pdf", "/x", 5)) == {}
    assert versions(spark, (" ", "/in/Scan (v9) .pdf", None)) == {"scan": 10}
    assert versions(spark, ("a (v99999999999999999999).pdf", "/x", None)) == {"a (v99999999999999999999)": 2}


def test_triage_prefers_content(spark):
    documents = spark.createDataFrame([(1, "h1", "a.pdf", "/in/a.pdf", None), (2, "h2", "gone.pdf", "/in/gone.pdf", 9)], "document_id bigint, sha256 string, display_name string, original_path string, deleted_at bigint")
    jobs = spark.createDataFrame([(7, 1, "running", 1), (8, 1, "queued", 5), (9, 1, "done", 9)], "job_id bigint, document_id bigint, status string, created_at bigint")
    incoming = spark.createDataFrame([(1, "/d/A.pdf", "h1"), (2, "/d/A.pdf", "zz"), (3, "/d/gone.pdf", "h2"), (4, "/d/a", "yy")], "file_id bigint, path string, sha256 string")
    rows = {r["file_id"]: r for r in intake.duplicate_triage(incoming, documents, jobs).collect()}
    assert (rows[1]["kind"], rows[1]["existing_id"], rows[1]["active_job_id"], rows[1]["suggested_name"]) == ("content_duplicate", 1, 8, None)
    assert (rows[2]["kind"], rows[2]["suggested_name"]) == ("name_collision", "A (v2).pdf")
    assert rows[3]["kind"] == "new" and rows[4]["suggested_name"] == "a (v2)"
    known = lambda mode: {r["file_id"] for r in intake.known_content(incoming, documents, mode).collect()}
    assert known("watch") == known("enqueue") == {1, 3} and known("interactive") == {1}


def test_like_semantics(spark):
    rows = [(n, name, "/p", None, "/out", 0, n, n, None, None, "done") for n, name in enumerate(["A_B.pdf", "AxB.pdf", "É%.pdf", r"c\d.pdf", "cd.pdf", None])]
    docs = spark.createDataFrame(rows, "document_id bigint, display_name string, original_path string, deleted_at bigint, output_path string, page_count bigint, ingested_at bigint, updated_at bigint, ocr_engine string, ai_provider string, status string")
    found = lambda q: {r["document_id"] for r in library.library_list(docs, q).collect()}
    assert found("a_b") == {0} and found("%") == {2} and found("é") == set() and found("É") == {2}
    assert found(r"c\d") == {4} and found("/P") == {0, 1, 2, 3, 4, 5} and found("") == {0, 1, 2, 3, 4, 5}


def test_output_names(spark):
    docs = spark.createDataFrame([(1, "/in/My Report.pdf", "abc123def456"), (2, "/x/a<b>c:d*e?.pdf", "ffffffffffff"), (3, "/y/My Report.pdf", "abc123def999"), (4, "/z/...", "abc")], "document_id bigint, original_path string, sha256 string")
    names = {r["document_id"]: r["output_name"] for r in library.assign_output_names(docs).collect()}
    assert names[1] == "My Report-abc123de-searchable.pdf" and names[3] == "My Report-abc123de-1-searchable.pdf"
    assert names[2] == "a_b_c_d_e_-ffffffff-searchable.pdf" and names[4].startswith("document-")


def test_bucketed_rows_are_replaced_in_place(spark, tmp_path):
    path = str(tmp_path / "pages")
    pages = spark.range(200).select(F.col("id").alias("document_id"), F.lit("old").alias("text"))
    write_bucketed(pages, path, buckets=16)
    stored = spark.read.parquet(path)
    fresh = spark.createDataFrame([(5, "new"), (5, "new too")], "document_id bigint, text string")
    bucket = stored.filter("document_id = 5").first()["bucket"]
    touched = stored.filter(F.col("bucket") == bucket).select("document_id", "text")
    kept = spark.createDataFrame(library.replace_document_rows(touched, fresh).collect(), touched.schema)
    write_bucketed(kept, path, buckets=16)
    after = spark.read.parquet(path)
    assert after.count() == 201 and {r["text"] for r in after.filter("document_id = 5").collect()} == {"new", "new too"}
