import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from foliary.operators import search
from foliary.session import materialize, shared_folder
from foliary.streaming import jobs
from foliary.sources.files import BucketedRows
from foliary.streaming.run import late_rows, run_batches, run_to_files
from tests.test_intake import brute


@pytest.mark.parametrize("setting, seconds", [(None, 300), ("600", 600), ("10", 30), ("abc", 300), ("0", 30), (" 99999999 ", 86400), ("-5", 300)])
def test_rescan_interval(setting, seconds):
    assert jobs.rescan_seconds(setting) == seconds


def test_watched_folder_hands_out_a_file_once(spark, tmp_path):
    inbox, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(b"one")
    (tmp_path / "in" / "b.tmp.pdf").write_bytes(b"no")
    (tmp_path / "in" / "sub" / "c.PDF").write_bytes(b"two")
    scan = lambda: run_to_files(jobs.ingest_stream(jobs.watch_folder(spark, inbox)), out, log)
    scan()
    (tmp_path / "in" / "d.pdf").write_bytes(b"three")
    scan()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in rows) == ["a.pdf", "c.PDF", "d.pdf"]


def test_rescans_hand_out_every_stable_version_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def write(name, content, age):
        (folder / name).write_bytes(content)
        os.utime(folder / name, (1_700_000_000 + age,) * 2)

    rescans = jobs.rescan_folder(spark, str(folder), str(tmp_path / "state"))
    second = 1_000_000
    write("a.pdf", b"one", 0)
    write("b.PDF", b"half", 0)
    write("c.txt", b"no", 0)
    rescans.scan(0, 0)
    write("b.PDF", b"whole", 1)
    for _ in range(2):  # a scan that is repeated after a failure hands out nothing twice
        rescans.scan(1, 2 * second)
    assert [r["path"].rsplit("/", 1)[1] for r in rescans.files().collect()] == ["a.pdf"]
    rescans.scan(2, 4 * second)
    write("a.pdf", b"two", 5)
    rescans.scan(3, 6 * second)
    rescans.scan(4, 6 * second + 10)  # too soon after the change was noted
    rescans.scan(5, 8 * second)
    rescans.scan(6, 10 * second)
    got = sorted((r["path"].rsplit("/", 1)[1], r["sha256"]) for r in rescans.files().collect())
    hashed = lambda content: hashlib.sha256(content).hexdigest()
    assert got == sorted([("a.pdf", hashed(b"one")), ("a.pdf", hashed(b"two")), ("b.PDF", hashed(b"whole"))])


def test_buckets_replace_and_replay(spark, tmp_path):
    table = BucketedRows(spark, str(tmp_path / "t"), "k", "k bigint, v string", buckets=4)
    make = lambda *rows: spark.createDataFrame(rows, "k bigint, v string")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k bigint")
    assert table.read().count() == 0
    table.replace(make((1, "a"), (1, "b"), (2, "c"), (3, "d")))
    for _ in range(2):  # a batch that is written again counts once
        table.replace(make((1, "z")), keys(1, 2))
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "z"), (3, "d")]
    table.replace(make((9, "x")).limit(0), keys(1, 3))
    assert table.read().count() == 0


START = 1_700_000_000_000_000  # microseconds


def feed(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_dedup_across_batches(spark, tmp_path):
    rng, window = random.Random(1), 100
    events = sorted({(rng.choice("ab"), rng.randrange(2000)) for _ in range(200)}, key=lambda e: e[1])
    batches = [events[n : n + 50] for n in range(0, len(events), 50)]
    shifted = [[(k, START + t) for k, t in batch] for batch in batches]
    stream = feed(spark, str(tmp_path / "f"), shifted, "k string, t bigint")
    run_to_files(jobs.dedup_stream(stream, ["k"], "t", window), str(tmp_path / "out"), str(tmp_path / "log"))
    assert {(r["k"], r["t"] - START) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == brute(events, window, False)


def test_dedup_goes_on_after_a_restart_and_forgets_old_keys(spark, tmp_path):
    schema, second = "k string, t bigint", 1_000_000
    make = lambda *rows: [(k, START + t * second) for k, t in rows]
    inbox, out, log = (str(tmp_path / n) for n in ("f", "out", "log"))
    run = lambda batches: run_to_files(jobs.dedup_stream(feed(spark, inbox, batches, schema), ["k"], "t", 100 * second), out, log)
    run([make(("a", 0), ("a", 50), ("x", 1))])
    run([make(("a", 101), ("b", 60), ("a", 90))])
    query = run([make(("b", 150), ("b", 161)), make(("c", 9000)), make(("c", 9050))])
    got = {(r["k"], (r["t"] - START) // second) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 0), ("x", 1), ("a", 101), ("b", 60), ("b", 161), ("c", 9000)}
    live = [state["customMetrics"].get("numValueStateVars") for state in query.lastProgress["stateOperators"]]
    rows = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert live and rows <= 4  # the anchor of c and its timer; a, b and x are gone


def test_dedup_keeps_a_few_timers_for_many_keys(spark, tmp_path):
    schema, window = "k string, n double, t bigint", 100
    rng, nan = random.Random(2), float("nan")
    keys = [(None, 0.5), ("nan", nan), *((f"k{n}", float(n)) for n in range(400))]
    events = sorted(((key, rng.randrange(1000)) for key in keys for _ in range(6)), key=lambda e: e[1])
    events += events[-5:]
    batches = [[(*key, START + t) for key, t in events[n : n + 900]] for n in range(0, len(events), 900)]
    out = str(tmp_path / "out")
    query = run_to_files(jobs.dedup_stream(feed(spark, str(tmp_path / "f"), batches, schema), ["k", "n"], "t", window, buckets=8), out, str(tmp_path / "log"))
    got = sorted((str(r["k"]), str(r["n"]), r["t"] - START) for r in spark.read.parquet(out).collect())
    shown = [((str(k), str(n)), t) for (k, n), t in events]
    assert got == sorted((k, n, t) for (k, n), t in brute(shown, window, False))
    assert max(p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress) <= 8


def test_failures_carry_over_batches(spark, tmp_path):
    rows = [("p", n, 100 + n, 1, n * 2_000_000) for n in range(4)] + [("p", 4, 103, 1, 8_000_000), ("p", 5, 9, 1, 10_000_000)]
    inbox, out, log = (str(tmp_path / n) for n in ("f", "out", "log"))
    for batches in ([rows[:2], rows[2:3]], [rows[3:5], rows[5:]]):  # the second run goes on from the state of the first
        run_to_files(jobs.stability_stream(feed(spark, inbox, batches, jobs.LISTING)), out, log)
    got = [(r["failures"], r["stable"], r["alert"]) for r in spark.read.parquet(out).orderBy("listing_id").collect()]
    assert got == [(1, False, False), (2, False, False), (3, False, True), (4, False, True), (0, True, False), (1, False, False)]


def test_a_path_that_is_not_listed_any_more_is_forgotten(spark, tmp_path):
    rows = [[("p", 0, 5, 1, START)], [("q", 1, 5, 1, START + 60_000_000)], [("q", 2, 6, 1, START + 61_000_000)], [("p", 3, 5, 1, START + 70_000_000)]]
    checks = jobs.stability_stream(feed(spark, str(tmp_path / "f"), rows, jobs.LISTING), forget=10_000_000)
    run_to_files(checks, str(tmp_path / "out"), str(tmp_path / "log"))
    got = {r["listing_id"]: (r["stable"], r["failures"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (False, 1), 1: (False, 1), 2: (False, 2), 3: (False, 1)}


def test_index_follows_changes(spark, tmp_path):
    schema = "op string, seq bigint, page_id bigint, document_id bigint, text string"
    batches = [
        [("insert", 1, 1, 1, "red fox"), ("insert", 2, 2, 1, "red hen"), ("insert", 3, 3, 2, "blue jay")],
        [("update", 4, 2, 1, "green hen"), ("delete", 5, 3, 2, None), ("insert", 6, 4, 2, "red red owl"), ("delete", 7, 4, 2, None), ("insert", 8, 4, 2, "owl")],
    ]
    sink = jobs.IndexStream(spark, str(tmp_path / "i"))
    run_batches(feed(spark, str(tmp_path / "f"), batches, schema), str(tmp_path / "log"), sink.on_batch)
    now = spark.createDataFrame([(1, 1, "red fox"), (2, 1, "green hen"), (4, 2, "owl")], "page_id bigint, document_id bigint, text string")
    rebuilt = search.build_index(now)
    assert sorted(sink.index().postings.collect()) == sorted(rebuilt.postings.collect())
    assert sink.index().corpus.first() == rebuilt.corpus.first()


def test_job_states_keep_progress(spark):
    rows = [(1, 1, "ocr", 40.0, None), (1, 2, None, None, "paused"), (2, 1, "ocr", 10.0, None), (2, 2, None, None, "error"), (3, 1, None, None, "queued"), (4, 1, "naming", 140.0, None)]
    df = spark.createDataFrame(rows, "job_id bigint, seq bigint, stage string, progress_pct double, status string")
    got = {r["job_id"]: (r["status"], r["stage"], r["progress_pct"]) for r in jobs.job_states(df).collect()}
    assert got == {1: ("paused", "ocr", 40.0), 2: ("error", "ocr", 100.0), 3: ("queued", None, 0.0), 4: ("done", "naming", 100.0)}


def test_embedding_replaces_and_skips_unfinished(spark, tmp_path):
    pages = spark.createDataFrame([(11, 1, "some words that are long enough"), (21, 2, "another page with enough text")], "page_id bigint, document_id bigint, text string")
    sink = jobs.EmbedStream(spark, str(tmp_path / "e"), pages, dim=8)
    events = lambda *rows: spark.createDataFrame(rows, "document_id bigint, status string")
    sink.on_batch(events((1, "done"), (2, "ocr")), 0)
    sink.on_batch(events((1, "partial_success"), (2, "done")), 1)
    assert sorted(r["document_id"] for r in sink.chunks.read().collect()) == [1, 2]


def test_enqueue_uses_earlier_batches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "h1"), (2, "h2")], "document_id bigint, sha256 string")
    ledger = spark.createDataFrame([(7, 1, "running", 5)], "job_id bigint, document_id bigint, status string, created_at bigint")
    sink = jobs.EnqueueStream(spark, str(tmp_path / "q"), docs, ledger)
    files = lambda *rows: spark.createDataFrame(rows, "file_id bigint, path string, sha256 string")
    sink.on_batch(files((10, "a", "h1"), (11, "b", "h2"), (12, "c", "h3"), (13, "c", "h3")), 0)
    sink.on_batch(files((14, "d", "h3"), (15, "e", "h2"), (16, "f", "h4")), 1)
    got = {r["file_id"]: r["action"] for r in sink.actions().collect()}
    assert got == {10: "reuse_job", 11: "reset_document", 12: "new_document", 13: "reuse_job", 14: "reuse_job", 15: "reuse_job", 16: "new_document"}


def test_content_whose_job_has_ended_is_queued_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "h1")], "document_id bigint, sha256 string")
    rows = [(7, 1, "done", 5)]
    ledger = lambda: spark.createDataFrame(rows, "job_id bigint, document_id bigint, status string, created_at bigint")
    sink = jobs.EnqueueStream(spark, str(tmp_path / "q"), docs, ledger)
    files = lambda *f: spark.createDataFrame(f, "file_id bigint, path string, sha256 string")
    sink.on_batch(files((10, "a", "h1")), 0)
    sink.on_batch(files((11, "b", "h1")), 1)
    rows.append((-11, 1, "done", 6))
    sink.on_batch(files((12, "c", "h1")), 2)
    got = {r["file_id"]: r["action"] for r in sink.actions().collect()}
    assert got == {10: "reset_document", 11: "reuse_job", 12: "reset_document"}


def test_old_files_are_read(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, age in (("new.pdf", 0), ("old.PDF", 400 * 86_400)):
        (folder / name).write_bytes(name.encode())
        os.utime(folder / name, (1_700_000_000 - age,) * 2)
    run_to_files(jobs.ingest_stream(jobs.watch_folder(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_an_end_mark_closes_what_is_open_and_late_rows_are_counted(spark, tmp_path):
    at = lambda *rows: spark.createDataFrame(rows, "user_id bigint, t bigint").select("user_id", F.timestamp_seconds("t").alias("ts"))
    rows, ends = at((1, 0), (1, 1), (1, 60), (2, 61)), at((0, 10_000)).select("ts")
    rows.write.parquet(str(tmp_path / "in" / "first"))
    ends.write.parquet(str(tmp_path / "end"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    both = jobs.with_end(stream, spark.readStream.schema(ends.schema).parquet(str(tmp_path / "end")))
    bursts = jobs.debounce_stream(both, "user_id", "ts")
    run_to_files(bursts, str(tmp_path / "out"), str(tmp_path / "log"))
    got = {(r["user_id"], r["events"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 2), (1, 1), (2, 1)}
    at((1, 5)).write.parquet(str(tmp_path / "in" / "late"))
    query = run_to_files(bursts, str(tmp_path / "out"), str(tmp_path / "log"))
    assert late_rows(query) == 1


def test_materialize_uses_the_shared_folder(spark):
    kept = materialize(spark.range(5).withColumn("x", F.col("id") * 2), "probe")
    assert kept.count() == 5 and all(shared_folder(spark) in f for f in kept.inputFiles())
