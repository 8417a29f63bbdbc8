"""Intake of files: candidates, stability, de-duplication against events and against the library, versioned names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliary.functions import text as tx
from foliary.functions.grouping import previous_row, streak_since
from foliary.operators.ledger import active_job_per_document
from foliary.session import materialize

# Fixed values.
IGNORED_NAME = r"(?i)(^\.|^~\$|\.tmp$|\.crdownload$|\.part$|\.tmp\.pdf$)"
STABLE_MICROS = 1_000_000
ALERT_AFTER = 3
DEDUP_MICROS = 3600 * 1_000_000
UI_DEDUP_MICROS = 1_500_000


def path_key(path: Column) -> Column:
    """Comparable form of a path: forward slashes, no verbatim prefix, no trailing slash."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"^//\?/", ""), "/+$", "")


def ancestors(path: Column) -> Column:
    """A path and every folder above it, as an array."""
    parts = F.split(path_key(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def is_candidate_name(name: Column) -> Column:
    return (F.lower(tx.file_extension(name)) == "pdf") & ~name.rlike(IGNORED_NAME)


def folder_candidates(files: DataFrame, root: str | None = None, recursive: bool = True, excluded: Sequence[str] = ()) -> DataFrame:
    """Files of a listing that may be taken in: right extension, no temporary name, not below an excluded folder.

    Exclusion compares folders by equality on the chain of ancestors, so no prefix join is needed."""
    name = tx.basename(F.col("path"))
    kept = files.filter(is_candidate_name(name))
    if root is not None:
        base = root.replace("\\", "/").rstrip("/")
        parent = F.regexp_replace(path_key(F.col("path")), "/[^/]*$", "")
        kept = kept.filter(F.array_contains(ancestors(F.col("path")), base) if recursive else parent == base)
    if excluded:
        folders = F.array(*[F.lit(e.replace("\\", "/").removeprefix("//?/").rstrip("/")) for e in excluded])
        kept = kept.filter(~F.arrays_overlap(ancestors(F.col("path")), folders))
    return kept


def folder_counts(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Candidate files per watched folder; a folder that is not recursive counts only its direct children.

    Each file meets its folders through its ancestors: an equi-join whose fan-out is the depth of the path."""
    above = folder_candidates(files).select(path_key(F.col("path")).alias("file"), F.posexplode(F.reverse(ancestors(F.col("path")))).alias("depth", "folder"))
    pairs = above.filter(F.col("depth") >= 1).groupBy("folder").agg(
        F.count(F.lit(1)).alias("all_files"), F.count_if(F.col("depth") == 1).alias("direct_files")
    )
    watched = folders.select("path", "recursive", path_key(F.col("path")).alias("folder"))
    counted = F.when(F.col("recursive"), F.col("all_files")).otherwise(F.col("direct_files"))
    return watched.join(pairs, "folder", "left").select("path", "recursive", F.coalesce(counted, F.lit(0)).cast("bigint").alias("file_count"))


def distinct_drops(drops: DataFrame) -> DataFrame:
    """Dropped paths with the right extension, exact repeats removed, first position kept."""
    return drops.filter(F.lower("path").endswith(".pdf")).groupBy("batch", "path").agg(F.min("position").alias("position"))


# ---- sequences of listings and events --------------------------------------------------------------------------------


def stable_files(listings: DataFrame, required: int = STABLE_MICROS, slice_width: int = 86_400_000_000) -> DataFrame:
    """Every listing row with whether it confirms that the file is no longer changing: same size and modification
    time as in the listing before, at least ``required`` microseconds earlier."""
    seen = previous_row(listings, "path", ["seen_at", "listing_id"], ["size", "mtime", "seen_at"], slice_width)
    same = (F.col("size") == F.col("prev_size")) & (F.col("mtime") == F.col("prev_mtime"))
    stable = same & (F.col("seen_at") - F.col("prev_seen_at") >= required)
    return seen.select(*listings.columns, F.coalesce(stable, F.lit(False)).alias("stable"), F.col("prev_seen_at").isNull().alias("first_seen"))


def instability_streaks(checks: DataFrame, slice_width: int = 86_400_000_000) -> DataFrame:
    """Length of the run of failed checks at every check of a path, and whether it calls for an alert."""
    streaks = streak_since(checks, "path", ["seen_at", "listing_id"], F.col("stable"), "failures", slice_width)
    return streaks.withColumn("alert", F.col("failures") >= ALERT_AFTER)


def anchored_dedup(events: DataFrame, keys: Sequence[str], ts: str, window: int = DEDUP_MICROS, inclusive: bool = False) -> DataFrame:
    """Moments at which an event of a key passes: the first one, then each first one after ``window`` measured from
    the last that *passed*. With ``inclusive`` an event exactly ``window`` later passes too. Events of a key at the
    same moment count once.

    Every moment points to the one that would pass next if it passed itself. Following pointers from the first moment
    is sequential, but doubling them (a pointer over 1, 2, 4 ... passes) reaches all passed moments in a logarithmic
    number of equi-joins on (key, moment), none of which is skewed: the rounds end when no chain of passes is as long
    as the pointers.

    Pointers are found inside narrow time slices; where a slice has no later moment, a per-slice minimum supplies it."""
    moments = events.select(*keys, F.col(ts).cast("bigint").alias("__t")).distinct()
    if window <= 0:
        return moments.withColumnRenamed("__t", ts)
    keys, moments = list(keys), materialize(moments, "dedup-moments")
    width = max(1, min(window, 60_000_000))
    probe_at = F.col("__t") + F.lit(window)
    both = moments.select(*keys, F.col("__t").alias("at"), F.lit(1).alias("is_event"), F.lit(None).cast("bigint").alias("__t")).unionByName(
        moments.select(*keys, probe_at.alias("at"), F.lit(0).alias("is_event"), "__t")
    )
    both = both.withColumn("slice", F.floor(F.col("at") / F.lit(width)).cast("bigint"))
    # In descending order the rows before a probe are the later moments; an equal moment counts only when inclusive.
    tie = F.col("is_event").desc() if inclusive else F.col("is_event").asc()
    later = W.partitionBy(*keys, "slice").orderBy(F.desc("at"), tie).rowsBetween(W.unboundedPreceding, -1)
    near = F.min(F.when(F.col("is_event") == 1, F.col("at"))).over(later)
    slices = both.groupBy(*keys, "slice").agg(F.min(F.when(F.col("is_event") == 1, F.col("at"))).alias("first_at"))
    after = W.partitionBy(*keys).orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("far", F.min("first_at").over(after)).select(*keys, "slice", "far")
    pointers = (
        both.withColumn("near", near)
        .filter(F.col("is_event") == 0)
        .join(slices, [*keys, "slice"])
        .select(*keys, "__t", F.coalesce("near", "far").alias("next"))
        .filter("next IS NOT NULL")
    )
    jumps = materialize(pointers, "dedup-jumps")
    reached = moments.groupBy(*keys).agg(F.min("__t").alias("__t"))
    while not jumps.isEmpty():
        landed = reached.join(jumps, [*keys, "__t"]).select(*keys, F.col("next").alias("__t"))
        reached = materialize(reached.unionByName(landed), "dedup-reached")
        second = jumps.select(*keys, F.col("__t").alias("next"), F.col("next").alias("over"))
        jumps = materialize(jumps.join(second, [*keys, "next"]).select(*keys, "__t", F.col("over").alias("next")), "dedup-jumps")
    return reached.withColumnRenamed("__t", ts)


# ---- against the library ---------------------------------------------------------------------------------------------


def known_content(incoming: DataFrame, documents: DataFrame, mode: str = "watch", known: bool = True) -> DataFrame:
    """Incoming files (with ``sha256``) whose content the library already has, or with ``known=False`` has not.

    ``watch`` and ``enqueue`` compare with every document, ``interactive`` leaves out the deleted ones."""
    if mode not in ("watch", "enqueue", "interactive"):
        raise ValueError(f"unknown mode: {mode}")
    library = documents if mode != "interactive" else documents.filter(F.col("deleted_at").isNull())
    hashes = library.select("sha256").distinct()
    return incoming.join(hashes, "sha256", "left_semi" if known else "left_anti")


def split_version(stem: Column) -> tuple[Column, Column]:
    """Root of a name stem and its version: ``report (v2)`` is version 2 of ``report``."""
    pattern = r"(?s)^(.*) \(v([0-9]+)\)$"
    trimmed = F.regexp_replace(stem, f"[{tx.WHITESPACE}]+$", "")
    version = F.regexp_extract(trimmed, pattern, 2).try_cast("bigint")
    valid = trimmed.rlike(pattern) & F.coalesce(version <= 4294967295, F.lit(False))
    return F.when(valid, F.regexp_extract(trimmed, pattern, 1)).otherwise(trimmed), F.when(valid, version)


def next_versions(documents: DataFrame) -> DataFrame:
    """Per name root, without regard to case, the highest version among live documents and the next free one."""
    shown = F.coalesce(F.nullif(F.trim("display_name"), F.lit("")), F.col("original_path"))
    root, version = split_version(tx.file_stem(tx.basename(shown)))
    return (
        documents.filter(F.col("deleted_at").isNull())
        .select(F.lower(root).alias("root"), F.coalesce(version, F.lit(1)).cast("bigint").alias("version"))
        .groupBy("root")
        .agg(F.max("version").alias("max_version"), F.count(F.lit(1)).alias("documents"))
        .withColumn("next_version", F.col("max_version") + 1)
    )


def duplicate_triage(incoming: DataFrame, documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Classify incoming files (``file_id, path, sha256``): same content first, then same name, else new.

    The library side is reduced to one row per hash and one per name root before it is joined, so a hash or name
    shared by very many incoming rows meets one partner only; the join's skew handling may split those rows freely."""
    by_hash = (
        documents.filter(F.col("deleted_at").isNull())
        .groupBy("sha256")
        .agg(F.min("document_id").alias("document_id"))
        .join(active_job_per_document(jobs).select("document_id", F.col("job_id").alias("active_job_id")), "document_id", "left")
        .withColumnRenamed("document_id", "existing_id")
    )
    by_name = next_versions(documents).select("root", "next_version")
    name = tx.basename(F.col("path"))
    root, _ = split_version(tx.file_stem(name))
    suffix = F.coalesce(F.concat(F.lit("."), tx.file_extension(name)), F.lit(""))
    same_content, same_name = F.col("existing_id").isNotNull(), F.col("next_version").isNotNull()
    suggestion = F.concat(F.col("shown_root"), F.lit(" (v"), F.col("next_version").cast("string"), F.lit(")"), F.col("suffix"))
    return (
        incoming.select("file_id", "path", "sha256", root.alias("shown_root"), F.lower(root).alias("root"), suffix.alias("suffix"))
        .join(by_hash, "sha256", "left")
        .join(by_name, "root", "left")
        .select(
            "file_id",
            F.when(same_content, "content_duplicate").when(same_name, "name_collision").otherwise("new").alias("kind"),
            "existing_id",
            "active_job_id",
            F.when(~same_content & same_name, suggestion).alias("suggested_name"),
        )
    )


def triage_summary(triaged: DataFrame) -> DataFrame:
    """Per batch: files added, added under a versioned name, and skipped as duplicates."""
    return triaged.groupBy("batch").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("kind") == "new").alias("added"),
        F.count_if(F.col("kind") == "name_collision").alias("versioned"),
        F.count_if(F.col("kind") == "content_duplicate").alias("duplicates"),
    )


def enqueue_files(incoming: DataFrame, documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """What enqueuing each incoming file (``file_id, path, sha256``) does.

    Content with an active job reuses that job; known content resets its document; anything else becomes a new
    document. Copies that arrive together are one document: the first file creates it, the others reuse its job."""
    library = documents.groupBy("sha256").agg(F.min("document_id").alias("document_id"))
    active = active_job_per_document(jobs).select("document_id", F.col("job_id").alias("active_job_id"))
    known = library.join(active, "document_id", "left")
    first = incoming.groupBy("sha256").agg(F.min("file_id").alias("first_file_id"))
    facts = first.join(known, "sha256", "left")
    is_first = F.col("file_id") == F.col("first_file_id")
    action = (
        F.when(F.col("active_job_id").isNotNull() | ~is_first, "reuse_job")
        .when(F.col("document_id").isNotNull(), "reset_document")
        .otherwise("new_document")
    )
    return incoming.select("file_id", "sha256").join(facts, "sha256").select(
        "file_id", "sha256", action.alias("action"), "document_id", "active_job_id", "first_file_id"
    )
