"""Safe file names, naming proposals from model replies, and log redaction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliary.functions import text as tx
from foliary.functions.grouping import rank_up_to
from foliary.sources import schemas

# Fixed values.
MAX_NAME_CHARS = 80
MAX_SUFFIX = 999
FALLBACK_NAME = "pdf_parser_file.pdf"
RESERVED_STEM = "^(con|prn|aux|nul|com[1-9]|lpt[1-9])($|[._-])"
PROMPT_CHARS = 4000
SUMMARY_CHARS = 500
NO_SUMMARY = "No reliable summary was returned."
UNREADABLE_SUMMARY = "The AI response could not be parsed safely, so the original filename is suggested."

# What a log line must not show, with the replacement for each.
VERBATIM_PREFIX = "\\\\?\\"
API_KEY = r"\b(?:sk-or-v1-[A-Za-z0-9._-]+|sk-ant-[A-Za-z0-9._-]+|sk-[A-Za-z0-9._-]{12,})\b"
WINDOWS_PATH = r'(?i)\b[A-Z]:\\(?:[^\\/:*?"<>|\r\n]+\\)+([^\\/:*?"<>|\r\n]+)'
UNC_PATH = r'\\\\(?:[^\\/:*?"<>|\r\n]+\\)+([^\\/:*?"<>|\r\n]+)'
UNIX_PATH = r"(^|[\s=:'\"(\[])/(?:[^/\s]+/)+([^/\s]+)"
MAX_LOG_CHARS = 200


def safe_stem(name: Column) -> Column:
    """Lower-case stem made of letters, digits, ``_`` and ``-``; NULL when nothing usable is left."""
    stem = F.regexp_replace(F.lower(tx.trim(name)), r"(?s)\.pdf$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9_-]", "_"), "_+", "_")
    edge = "^[_.-]+|[_.-]+$"
    stem = F.regexp_replace(stem, edge, "")
    stem = F.regexp_replace(F.substring(stem, 1, MAX_NAME_CHARS), edge, "")
    return F.when(stem != "", F.when(stem.rlike(RESERVED_STEM), F.concat(F.lit("doc_"), stem)).otherwise(stem))


def safe_name(name: Column) -> Column:
    return F.concat(safe_stem(name), F.lit(".pdf"))


def fallback_name(original_filename: Column) -> Column:
    """Safe name from the source file's stem, or the fixed name when that gives nothing."""
    return F.coalesce(safe_name(tx.file_stem(original_filename)), F.lit(FALLBACK_NAME))


def normalize_names(documents: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Safe, unique file names for a whole table (``document_id, name, original_path``).

    The first taker of a stem, by id, gets it bare, the next ones ``_2``, ``_3`` ...; a numbered name that another row
    asks for literally, or that ``existing`` (column ``file_name``) holds, is skipped. Rows beyond the last number get
    NULL, the error case."""
    stem = F.coalesce(safe_stem(F.col("name")), F.regexp_replace(fallback_name(tx.basename(F.col("original_path"))), r"\.pdf$", ""))
    wanted = documents.select("document_id", stem.alias("stem"))
    taken = wanted.select("stem").distinct().withColumn("on_disk", F.lit(False))
    if existing is not None:
        on_disk = existing.select(F.regexp_replace("file_name", r"\.pdf$", "").alias("stem"), F.lit(True).alias("on_disk"))
        taken = taken.unionByName(on_disk.distinct())
    # A name such as a_2 blocks number 2 of a; a name found on disk blocks also its own number 1.
    numbered = F.regexp_extract("stem", "^(.+)_([0-9]{1,3})$", 1)
    number = F.regexp_extract("stem", "^(.+)_([0-9]{1,3})$", 2)
    blocked = (
        taken.filter(number.rlike("^([2-9]|[1-9][0-9]{1,2})$"))
        .select(numbered.alias("stem"), number.try_cast("int").alias("n"))
        .unionByName(taken.filter("on_disk").select("stem", F.lit(1).alias("n")))
        .distinct()
        .groupBy("stem")
        .agg(F.collect_set("n").alias("blocked"))  # at most MAX_SUFFIX numbers
    )
    ranked = rank_up_to(wanted, ["stem"], "document_id", MAX_SUFFIX, "taker").join(blocked, "stem", "left")
    none = F.array().cast("array<int>")
    free = F.array_except(F.sequence(F.lit(1), F.lit(MAX_SUFFIX)), F.coalesce("blocked", none))
    position = F.when(F.col("blocked").isNull(), F.col("taker")).otherwise(F.get(free, F.col("taker").cast("int") - 1))
    suffix = F.when(position == 1, F.lit("")).otherwise(F.concat(F.lit("_"), position.cast("string")))
    return ranked.select("document_id", F.concat("stem", suffix, F.lit(".pdf")).alias("file_name"))


def strip_fences(content: Column) -> Column:
    """A model reply without the Markdown code fence around it."""
    trimmed = tx.trim(content)
    inner = F.regexp_replace(trimmed, r"^```[^\n]*(\n|$)", "")
    inner = F.regexp_replace(inner, r"(^|\n)[ \t\r]*```[ \t\r]*$", "")
    return F.when(F.startswith(trimmed, F.lit("```")), tx.trim(inner)).otherwise(trimmed)


def naming_proposals(replies: DataFrame) -> DataFrame:
    """Name and summary proposed by each model reply (``document_id, original_filename, reply``)."""
    # Each step is a column of its own, so a reply is stripped and parsed once, however many results read it.
    cut = replies.select("document_id", fallback_name(F.col("original_filename")).alias("fallback"), strip_fences(F.col("reply")).alias("body"))
    told = cut.withColumn("readable", F.when(F.col("body").rlike(r"(?s)^\{.*\}$"), F.try_parse_json("body").isNotNull()).otherwise(False))
    parsed = F.from_json("body", schemas.MODEL_REPLY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    told = told.withColumn("parsed", F.when(F.col("readable"), parsed)).drop("body")
    flat = F.when(F.col("readable"), tx.squeeze(F.coalesce(F.col("parsed")["summary"], F.lit(NO_SUMMARY))))
    told = told.select("document_id", "readable", "fallback", F.col("parsed")["filename_base"].alias("base"), flat.alias("flat"))
    return told.select(
        "document_id",
        F.coalesce(safe_name(F.col("base")), F.col("fallback")).alias("proposed_name"),
        F.when(F.col("readable"), F.when(F.col("flat") == "", NO_SUMMARY).otherwise(F.left("flat", F.lit(SUMMARY_CHARS)))).otherwise(UNREADABLE_SUMMARY).alias("summary"),
    )


def naming_inputs(pages: DataFrame, documents: DataFrame, pages_per_part: int = 64) -> DataFrame:
    """Model prompt per document: its file name and the first characters of its text.

    Pages are joined in parts of consecutive pages, each cut to what a prompt can hold, and then the parts; so no task
    ever holds more than a part of a very long document."""

    def joined(rows: DataFrame, keys: list[str], order: str, text: Column) -> DataFrame:
        texts = F.transform(F.sort_array(F.collect_list(F.struct(order, text.alias("text")))), lambda page: page["text"])
        return rows.groupBy(*keys).agg(F.left(F.array_join(texts, "\n"), F.lit(PROMPT_CHARS)).alias("text"))

    text = F.left("text", F.lit(PROMPT_CHARS))
    parts = joined(pages.withColumn("part", F.floor(F.col("page_number") / pages_per_part)), ["document_id", "part"], "page_number", text)
    # A second, coarser round keeps even millions of pages to a few parts per task.
    parts = joined(parts.withColumn("group", F.floor(F.col("part") / pages_per_part)), ["document_id", "group"], "part", F.col("text"))
    whole = joined(parts, ["document_id"], "group", F.col("text"))
    name = tx.basename(F.col("original_path"))
    prompt = F.concat(F.lit("Original filename: "), name, F.lit("\n\nDocument text (truncated):\n"), F.coalesce("text", F.lit("")))
    return documents.select("document_id", "original_path").join(whole, "document_id", "left").select(
        "document_id", name.alias("original_filename"), prompt.alias("prompt"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("sample_chars")
    )


Namer = Callable[[list[str]], list[str]]


def model_replies(inputs: DataFrame, namer: Namer, batch: int = 16) -> DataFrame:
    """Run a naming model over the prompts in batches inside the tasks; its replies feed :func:`naming_proposals`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                replies = namer(part["prompt"].tolist())
                if len(replies) != len(part):
                    raise ValueError(f"model returned {len(replies)} replies for {len(part)} prompts")
                yield part[["document_id", "original_filename"]].assign(reply=replies)

    return inputs.select("document_id", "original_filename", "prompt").mapInPandas(run, "document_id bigint, original_filename string, reply string")


# ---- logs ------------------------------------------------------------------------------------------------------------


def redacted(message: Column) -> Column:
    """A log message without keys, folders or long text."""
    text = F.replace(message, F.lit(VERBATIM_PREFIX), F.lit(""))
    text = F.regexp_replace(text, API_KEY, "<API_KEY>")
    text = F.regexp_replace(F.regexp_replace(text, WINDOWS_PATH, "$1"), UNC_PATH, "$1")
    text = F.regexp_replace(text, UNIX_PATH, "$1$2")
    long = F.concat(F.lit("<TEXT len="), F.length(text).cast("string"), F.lit(">"))
    return F.when(F.length(text) > MAX_LOG_CHARS, long).otherwise(text)


def redact_log(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.withColumn("redacted", redacted(F.col(column)))


def redaction_counts(lines: DataFrame, column: str = "line") -> DataFrame:
    """How often each redaction rule applies over a whole log."""
    plain = F.replace(F.col(column), F.lit(VERBATIM_PREFIX), F.lit(""))
    without_keys = F.regexp_replace(plain, API_KEY, "<API_KEY>")
    return lines.agg(
        F.sum(F.regexp_count(plain, F.lit(API_KEY))).alias("api_keys"),
        F.sum(F.regexp_count(without_keys, F.lit(WINDOWS_PATH))).alias("windows_paths"),
        F.sum(F.regexp_count(without_keys, F.lit(UNIX_PATH))).alias("unix_paths"),
        F.count_if(redacted(F.col(column)).startswith("<TEXT len=")).alias("elided"),
    )


LEVELS = {"INFO": " INFO ", "WARN": " WARN ", "ERROR": " ERROR"}
TAIL_LINES = (50, 500, 5000)


def log_tail(lines: DataFrame, level: str | None = None, max_lines: int | None = None) -> DataFrame:
    """The last lines of each log file (``file, line_no, line``), optionally of one level, in order.

    Lines are ranked in blocks of consecutive line numbers first, so one huge file is not sorted in one task."""
    low, default, high = TAIL_LINES
    wanted = min(max(default if max_lines is None else max_lines, low), high)
    mark = LEVELS.get((level or "").strip().upper())
    kept = lines.filter(F.contains("line", F.lit(mark))) if mark else lines
    from_end = F.row_number().over(W.partitionBy("file", F.floor(F.col("line_no") / 1_000_000)).orderBy(F.desc("line_no")))
    nearby = kept.withColumn("rank", from_end).filter(F.col("rank") <= wanted).drop("rank")
    last = F.row_number().over(W.partitionBy("file").orderBy(F.desc("line_no")))
    return nearby.withColumn("rank", last).filter(F.col("rank") <= wanted).drop("rank")
