"""Quality rules: repetition, and how far a document's characters and common words are from its language's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.llm.common import documents, materialize, query

# Frequent words by language; those of any other language of a table are learnt from it.
COMMON = {
    "en": "the of and to in a is that for it was with on as be".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im".split(),
    "fr": "de la le et les des en un une du dans que est pour qui".split(),
    "es": "de la que el en y a los del se las por un para con".split(),
}
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50  # fewer fail the base rules
LEAST_CHARS = 200  # fewer characters give no verdict on characters
LEAST_COMMON = 50  # fewer words give no verdict on common words
# Jensen-Shannon distances (base 2, 0 to 1) from the nearest language: of characters, and of characters and words together.
CHARACTER_LIMIT, TOTAL_LIMIT = 0.30, 0.46


def _words(text: Column) -> Column:
    body = F.btrim(text, F.lit(SPACE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))


def _repeated(ordered: Column) -> Column:
    """Number of words that lie in a window of three that occurs twice or more; ``ordered`` has the windows (g: hash,
    i: first word) sorted, as a column of its own, because a lambda would evaluate an expression for every element."""
    twice = F.filter(ordered, lambda s, k: s["g"].eqNullSafe(F.get(ordered, k - 1)["g"]) | s["g"].eqNullSafe(F.get(ordered, k + 1)["g"]))
    # each window adds the words that the one before does not cover
    return F.aggregate(
        F.array_sort(F.transform(twice, lambda s: s["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def frequent_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame | None:
    """(own_lang, own_words): the most frequent words of every language of the table that isn't listed, from its documents
    that are long enough; None if there is no such language."""
    if lang not in docs.columns:
        return None
    name, whole = F.col(lang).cast("string"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    others = docs.filter(name.isNotNull() & ~name.isin(list(COMMON)))
    if not others.limit(1).count():
        return None
    words = others.filter(F.length(whole) >= LEAST_CHARS).select(name.alias("own_lang"), _words(F.lower(whole)).alias("words"))
    counted = words.filter(F.size("words") >= LEAST_COMMON).select("own_lang", F.explode("words").alias("word")).groupBy("own_lang", "word").count()
    order = Window.partitionBy("own_lang").orderBy(F.desc("count"), "word")
    top = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= len(COMMON["en"]))
    return materialize(top.groupBy("own_lang").agg(F.sort_array(F.collect_list("word")).alias("own_words")), "frequent")


def features(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts of each document, its character classes, the counts of common words by language and of those of its own
    language if that isn't listed, and the row itself (dropped by the optimizer where it isn't asked for)."""
    # the row goes into one column first, so whatever its columns are called, they meet none of those made here
    cell = lambda name: F.col("row").getField(name).cast("string")
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select(
        "row", F.col("row").getField("doc_id").cast("long").alias("doc_id"),
        (cell(lang) if lang in docs.columns else F.lit(None).cast("string")).alias("lang"), F.coalesce(cell(text), F.lit("")).alias("text"),
    )
    own = frequent_words(docs, text, lang)
    if own is None:
        base = base.withColumn("own_words", F.lit(None).cast("array<string>"))
    else:
        base = base.join(own, F.col("lang") == F.col("own_lang"), "left").drop("own_lang")
    split = base.select("row", "doc_id", "lang", "text", "own_words", _words(F.col("text")).alias("words"), _words(F.lower("text")).alias("lowered"))
    n = F.size("words")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    listed = sorted({w for words in COMMON.values() for w in words})
    counted = split.select(
        "row", "doc_id", "lang", "text", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).alias("grams"),
        F.filter("lowered", lambda w: w.isin(listed)).alias("common"),
        F.transform("own_words", lambda o: F.size(F.filter("lowered", lambda w: w == o)).cast("double")).alias("own"),
    )
    windows = F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    counted = counted.withColumn("ordered", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), windows))
    repeated = F.when(F.col("ordered").isNotNull(), _repeated(F.col("ordered"))).otherwise(0)
    count = lambda pattern: F.regexp_count("text", F.lit(pattern))
    upper, digit, foreign = count("[A-Z]"), count("[0-9]"), count(r"[^\x00-\x7F]")
    marks = count(r"[!-/:-@\[-`{-~]") - F.col("n_symbols")
    size = F.length("text")
    space = size - F.col("word_chars")
    classes = F.array(
        *(c.cast("double") for c in (upper, digit, foreign, space, marks, F.col("n_symbols"), F.col("word_chars") - upper - digit - foreign - marks - F.col("n_symbols")))
    )
    per_language = {
        name: F.transform(F.array(*map(F.lit, words)), lambda w: (F.size("common") - F.size(F.array_remove("common", w))).cast("double"))
        for name, words in COMMON.items()
    }
    return counted.select(
        "row", "doc_id", "lang", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        size.alias("n_chars"), classes.alias("classes"),
        F.struct(*(c.alias(k) for k, c in per_language.items())).alias("common"), "own",
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _shares(values: Column, of: Column) -> Column:
    return F.transform(values, lambda v: v / of)


def _with_rest(counts: Column, words: Column) -> Column:
    """Common words as shares of all words, and the share of all others."""
    shares = _shares(counts, words)
    return F.concat(shares, F.array(F.greatest(F.lit(0.0), 1.0 - _total(shares))))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two distributions: the root of the divergence to base 2, from 0 to 1."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    return F.sqrt(F.greatest(F.lit(0.0), _total(F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2))))


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Mean character classes and common words per language, over its documents that are long enough (at most one row
    per listed language is collected)."""
    # not a filter: Spark would push it down and evaluate what it is computed from a second time
    long_enough = (F.col("n_words") >= LEAST_COMMON) & (F.col("n_chars") >= LEAST_CHARS)
    words = len(next(iter(COMMON.values())))
    own = F.coalesce(*(F.when(F.col("lang") == name, F.col("common")[name]) for name in COMMON))
    shares = rows.filter(F.col("lang").isin(list(COMMON))).select(
        "lang",
        F.when(long_enough, _shares(F.col("classes"), F.col("n_chars"))).alias("c"),
        F.when(long_enough, _with_rest(own, F.col("n_words"))).alias("w"),
    )
    means = shares.groupBy("lang").agg(
        F.array(*(F.avg(F.get("c", F.lit(i))) for i in range(7))).alias("c"), F.array(*(F.avg(F.get("w", F.lit(i))) for i in range(words + 1))).alias("w")
    )
    return {r["lang"]: (list(r["c"]), list(r["w"])) for r in means.collect() if r["c"][0] is not None}


def own_references(rows: DataFrame) -> DataFrame:
    """(ref_lang, ref_c, ref_w): mean character classes and common words of every language that isn't listed, over its
    documents that are long enough."""
    long_enough = (F.col("n_words") >= LEAST_COMMON) & (F.col("n_chars") >= LEAST_CHARS) & F.col("own").isNotNull()
    words = len(COMMON["en"])
    shares = rows.select(
        F.when(~F.col("lang").isin(list(COMMON)), F.col("lang")).alias("ref_lang"),
        F.when(long_enough, _shares(F.col("classes"), F.col("n_chars"))).alias("c"),
        F.when(long_enough, _with_rest(F.col("own"), F.col("n_words"))).alias("w"),
    )
    means = shares.groupBy("ref_lang").agg(
        F.array(*(F.avg(F.get("c", F.lit(i))) for i in range(7))).alias("ref_c"), F.array(*(F.avg(F.get("w", F.lit(i))) for i in range(words + 1))).alias("w")
    )
    means = means.select("ref_lang", "ref_c", F.filter("w", lambda x: x.isNotNull()).alias("ref_w"))
    return materialize(means.filter(F.col("ref_lang").isNotNull() & F.get("ref_c", F.lit(0)).isNotNull()), "references")


def judge(rows: DataFrame, learnt: dict[str, tuple[list[float], list[float]]], own: DataFrame | None = None) -> DataFrame:
    """Add character_distance, common_distance, base_failed and kept to the features."""
    array = lambda values: F.array(*(F.lit(float(v)) for v in values))
    nearest = lambda found: F.least(*found, F.lit(None).cast("double"), F.lit(None).cast("double"))
    mine = _shares(F.col("classes"), F.greatest(F.col("n_chars"), F.lit(1)))
    characters = [divergence(F.col("mine"), array(c)) for c, _ in learnt.values()]
    n_words = F.greatest(F.col("n_words"), F.lit(1))
    common = [divergence(_with_rest(F.col("common")[k], n_words), array(w)) for k, (_, w) in learnt.items()]
    known = F.lit(True)
    if own is not None:
        rows = rows.join(own, rows["lang"] == own["ref_lang"], "left")
        characters.append(F.when(F.col("ref_lang").isNotNull(), divergence(F.col("mine"), F.col("ref_c"))))
        common.append(F.when(F.col("ref_lang").isNotNull(), divergence(_with_rest(F.col("own"), n_words), F.col("ref_w"))))
        known = F.col("lang").isNull() | F.col("ref_lang").isNotNull() | F.col("lang").isin(list(learnt))
    rows = rows.withColumn("mine", mine).select(
        "*",
        F.when((F.col("n_chars") >= LEAST_CHARS) & known, nearest(characters)).alias("character_distance"),
        F.when((F.col("n_words") >= LEAST_COMMON) & known, nearest(common)).alias("common_distance"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    characters, common = (F.coalesce(c, F.lit(0.0)) for c in ("character_distance", "common_distance"))
    near = (characters <= CHARACTER_LIMIT) & (characters + common <= TOTAL_LIMIT)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & near)


def _others(rows: DataFrame) -> DataFrame | None:
    """The references of the languages that aren't listed, if the table has any such language."""
    return own_references(rows) if rows.filter(~F.col("lang").isin(list(COMMON))).select("lang").limit(1).count() else None


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    character_distance, common_distance and kept.

    References are the mean distributions of each language of the table, learnt from the documents of that language; the
    common words of a language that isn't listed are the most frequent ones of its documents. A document is compared with
    the listed languages and its own, and the nearest counts, so among the listed ones a wrong or missing ``lang`` does no
    harm. Where a language has no reference, because none of its documents is long enough, there is no verdict beyond
    the base rules; a document of another language that is said to be in a listed one is judged by the listed ones.
    A language of few documents is hardly judged, as they are its reference. Documents with
    fewer than LEAST_CHARS characters or LEAST_COMMON words get no distance of that kind (null) and are not rejected by
    it, nor are any if no reference could be learnt. A null text counts as empty and fails the base rules. Rows that
    repeat a doc_id or have none are judged by themselves; further columns are ignored; no rows give no rows.

    Everything is built-in functions on one row; only means, and the words of languages not listed, are aggregated.
    """
    rows = materialize(features(docs, text, lang).drop("row"), "features")
    return judge(rows, references(rows), _others(rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "character_distance", "common_distance", "kept",
    )


def good_documents(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that ``quality_rules`` keeps, with all their columns; rows are judged where they are read."""
    rows = features(docs, text, lang)
    judged = judge(rows, references(rows), _others(rows))
    # inline drops the rows without an array; a filter on the verdict would be pushed down into copies of all of the above
    return judged.select(F.inline(F.when(F.col("kept"), F.array("row"))))


@query("op4_divergence_rules")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(documents(spark, folder, "doc_id", "text", "lang"))
