from foliary.operators import ledger

JOBS = "job_id bigint, document_id bigint, kind string, status string, error_message string, created_at bigint, origin string, engine string, progress_pct double"


def jobs(spark, *rows):
    base = {"document_id": None, "kind": "ingest", "status": "queued", "error_message": None, "created_at": 1, "origin": None, "engine": None, "progress_pct": 0.0}
    return spark.createDataFrame([tuple({**base, **r}[c.split()[0]] for c in JOBS.split(", ")) for r in rows], JOBS)


def ids(df):
    return {r["job_id"] for r in df.collect()}


def test_terminal_jobs_are_cleared(spark):
    table = jobs(spark, *[{"job_id": n, "status": s} for n, s in enumerate(ledger.STATUSES)])
    assert ledger.cleared_count(table).first()["removed"] == 3
    assert {r["status"] for r in ledger.clear_completed(table).collect()} == set(ledger.ACTIVE)
    summary = ledger.job_summary(table).first()
    assert (summary["active"], summary["clearable"], summary["failed"]) == (3, 3, 1)


def test_latest_job_and_hidden_kinds(spark):
    table = jobs(spark, {"job_id": 1, "document_id": 5}, {"job_id": 2, "document_id": 5}, {"job_id": 3, "document_id": 5, "kind": "embed"}, {"job_id": 4}, {"job_id": 5})
    assert ids(ledger.latest_job_per_document(table)) == {2, 4, 5}


def test_listing_defaults(spark):
    docs = spark.createDataFrame([(5, "/in/a.pdf", "ocr", None)], "document_id bigint, original_path string, status string, page_count bigint")
    table = jobs(spark, {"job_id": 1, "document_id": 5, "status": "odd"}, {"job_id": 2, "status": "error"})
    rows = {r["job_id"]: r for r in ledger.jobs_with_documents(table, docs).collect()}
    assert (rows[1]["filename"], rows[1]["status"], rows[1]["stage"], rows[1]["page_count"], rows[1]["source"]) == ("a.pdf", "queued", "ocr", 0, "manual")
    assert (rows[2]["filename"], rows[2]["stage"], rows[2]["progress_pct"]) == ("PDF", "error", 100.0)


def test_merge_never_lowers_progress(spark):
    schema = "job_id bigint, status string, progress_pct double"
    mine = spark.createDataFrame([(1, "running", 60.0), (2, "done", 100.0), (3, "paused", None), (5, None, 1.0)], schema)
    server = spark.createDataFrame([(1, "running", 10.0), (4, "queued", None)], schema)
    rows = {r["job_id"]: (r["status"], r["progress_pct"]) for r in ledger.merge_queue_snapshot(mine, server).collect()}
    assert rows == {1: ("running", 60.0), 3: ("paused", None), 4: ("queued", 0.0), 5: (None, 1.0)}


def test_progress_of_active_jobs(spark):
    table = jobs(spark, {"job_id": 1, "progress_pct": 150.0}, {"job_id": 2, "status": "running", "progress_pct": None}, {"job_id": 3, "status": "done", "progress_pct": 7.0})
    assert ledger.overall_progress(table).first()[0] == 50.0
    assert ledger.overall_progress(table.filter("job_id = 3")).first()[0] == 0.0


def test_banner_looks_at_all_messages(spark):
    table = jobs(spark, {"job_id": 1, "error_message": "Ollama said no"}, {"job_id": 2, "error_message": "connection lost"}, {"job_id": 3, "error_message": "RapidOCR file MISSING"})
    rows = {r["issue"]: (r["jobs"], r["is_banner"]) for r in ledger.issue_report(table).collect()}
    assert rows == {"other": (2, False), "rapidocr": (1, False)}
    rows = {r["issue"]: r["is_banner"] for r in ledger.issue_report(table.filter("job_id <> 2")).collect()}
    assert rows == {"other": False, "rapidocr": True}


def test_filter_applies_after_the_limit(spark):
    listing = spark.createDataFrame([(n, "done" if n < 3 else "queued", n) for n in range(5)], "job_id bigint, status string, created_at bigint")
    assert ids(ledger.job_filter(listing, statuses=["done"], limit=3)) == {2}
    assert ids(ledger.job_filter(listing, tab="running", since=4)) == {4}
