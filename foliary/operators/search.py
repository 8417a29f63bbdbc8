"""Full-text search: a positional inverted index, and ranked matching of whole tables of queries against it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window as W

from foliary.functions import text as tx
from foliary.operators.library import ENGINES, visible_documents
from foliary.operators.postings import BLOCKS, corpus_totals, cut_blocks, phrases_in_blocks, scores_in_blocks, term_totals, tokens_of
from foliary.sources import schemas
from foliary.session import materialize, scratch_path

# Fixed values.
MAX_QUERY_CHARS = 256
DEFAULT_LIMIT = 50
MAX_LIMIT = 200
IN_DOCUMENT_LIMIT = 100
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6
SNIPPET_TOKENS = 16
SNIPPET_SENTENCE_BONUS = 100
SNIPPET_OPENING_BONUS = 120
SORTS = ("relevance", "newestFirst", "oldestFirst")

# Folders of a stored index, unless its maker says otherwise.
BUCKETS = 64

# Parts that the rows of one query are ranked in before its best rows are chosen.
RANK_PARTS = 64
SCORE_DIGITS = 8

# Array of 64-bit words in which the ids of hits are marked.
MARK_WORDS = 1 << 17


@dataclass(frozen=True)
class Index:
    """``blocks``: postings in blocks of rows (:mod:`foliary.operators.postings`). ``terms``: rows and occurrences of every term.
    ``corpus``: one row of totals.

    A stored index also has a ``bucket`` column, a hash of the term by which its files are partitioned."""

    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame
    buckets: int = 0

    @property
    def postings(self) -> DataFrame:
        return tokens_of(self.blocks)

    def row_count(self) -> Column:
        return self.corpus.select("n_rows").scalar()

    def average_length(self) -> Column:
        return self.corpus.select(F.col("total_len") / F.col("n_rows")).scalar()

    def narrowed(self, terms: DataFrame) -> Index:
        """The part of the index that may hold the terms of a table. Of a stored index only their folders are listed from then on;
        the numbers collected for this are at most one per folder."""
        if not self.buckets:
            return self
        wanted = [row["bucket"] for row in terms.select(bucket_of(F.col("term"), self.buckets).alias("bucket")).distinct().collect()]
        inside = F.col("bucket").isin(wanted)
        return Index(self.blocks.filter(inside).drop("bucket"), self.terms.filter(inside).drop("bucket"), self.corpus)

    def statistics(self, terms: DataFrame) -> DataFrame:
        return self.terms.join(terms.select("term").distinct(), "term").select("term", "df")


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(term, F.lit(""))), F.lit(buckets)).cast("int")


def index_of(blocks: DataFrame) -> Index:
    return Index(blocks, term_totals(blocks), corpus_totals(blocks))


def build_index(rows: DataFrame, row_id: str = "page_id", text: str = "text") -> Index:
    """Index the text of ``rows``. Row-local: nothing is shuffled until the index is stored or asked."""
    return index_of(cut_blocks(rows, row_id, text))


def store_index(index: Index, path: str | None = None, buckets: int = BUCKETS) -> Index:
    """Write an index and return it reading from storage.

    Texts are tokenised once, for the blocks; terms and totals are then counted from the numbers stored with these. Folders are
    term buckets, so a search lists only those of its own terms. Spark sizes the files by what is in a bucket, so a stop word
    spans many, and in a file the terms lie in order."""
    spark = index.blocks.sparkSession
    path = path or scratch_path(spark, "index")
    blocks = index.blocks.withColumn("bucket", bucket_of(F.col("term"), buckets))
    blocks = blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block")
    blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    written = spark.read.schema(f"{BLOCKS}, bucket int").parquet(f"{path}/blocks")
    terms = term_totals(written).withColumn("bucket", bucket_of(F.col("term"), buckets))
    terms.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    corpus = corpus_totals(written).withColumn("buckets", F.lit(buckets))
    corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    return load_index(spark, path)


def load_index(spark, path: str) -> Index:
    corpus = spark.read.schema("n_rows bigint, total_len bigint, buckets int").parquet(f"{path}/corpus")
    blocks = spark.read.schema(f"{BLOCKS}, bucket int").parquet(f"{path}/blocks")
    terms = spark.read.schema("term string, df bigint, occurrences bigint, bucket int").parquet(f"{path}/terms")
    return Index(blocks, terms, corpus.select("n_rows", "total_len"), corpus.first()["buckets"])


def term_stats(index: Index) -> DataFrame:
    """Document frequency and occurrences per term, with the corpus totals that BM25 needs."""
    return index.terms.select("term", "df", "occurrences").withColumn("n_rows", index.row_count()).withColumn("avg_len", F.round(index.average_length(), 4))


# ---- queries ---------------------------------------------------------------------------------------------------------


def query_terms(q: Column) -> Column:
    """Ordered terms and phrases of a query text: ASCII words are terms, a quoted run is one phrase, and a quote that is
    never closed runs to the end. Everything else separates words."""
    plain = F.regexp_replace(F.substring(tx.trim(q), 1, MAX_QUERY_CHARS), '[^A-Za-z0-9"]', " ")

    def section(part: Column, number: Column) -> Column:
        words = F.trim(F.regexp_replace(part, " +", " "))
        return F.when(number % 2 == 0, F.split(words, " ")).otherwise(F.array(words))

    return F.filter(F.flatten(F.transform(F.split(plain, '"'), section)), lambda term: term != "")


def match_expressions(queries: DataFrame) -> DataFrame:
    """Parse the ``q`` column: terms, the quoted match expression, a warning when cut, an error when nothing is left."""
    quoted = F.transform("terms", lambda term: F.concat(F.lit('"'), term, F.lit('"')))
    return (
        queries.withColumn("terms", query_terms(F.coalesce("q", F.lit(""))))
        .withColumn("match_expr", F.when(F.size("terms") > 0, F.array_join(quoted, " ")))
        .withColumn("warning", F.when(F.length(tx.trim(F.col("q"))) > MAX_QUERY_CHARS, "Query truncated to 256 chars"))
        .withColumn("error", F.when(F.size("terms") == 0, "Search query is empty after sanitization"))
    )


def phrases_of(queries: DataFrame) -> DataFrame:
    """One row per phrase of a query (a repeated phrase counts again, as it does in the score)."""
    folded = F.transform(query_terms(F.coalesce("q", F.lit(""))), F.lower)
    parsed = queries.select("query_id", folded.alias("phrases"))
    return parsed.select("query_id", "phrases", F.posexplode("phrases").alias("phrase_no", "phrase"))


# ---- matching --------------------------------------------------------------------------------------------------------


def rarest_first(index: Index, phrases: DataFrame) -> DataFrame:
    """The distinct phrases all of whose words occur: ``parts`` has their words (df, term, offset), the rarest first. Known from the
    stored statistics alone, before any postings are read."""
    words = phrases.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    counted = words.join(index.statistics(words), "term", "left")
    # One row per phrase; its words are few, since the query text is bounded.
    parts = counted.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "offset"))).alias("parts"))
    return parts.filter(F.col("parts")[0]["df"] > 0)


def lead_blocks(index: Index, leads: DataFrame, *keys: str) -> DataFrame:
    """The blocks that hold the rarest word of each phrase or query; no other block can hold all of its words."""
    return index.blocks.select("term", "block").join(leads, "term").select(*keys, "block")


def phrase_hits(index: Index, ordered: DataFrame) -> DataFrame:
    """Postings of each phrase of several words, in blocks: of its other words only the blocks of its rarest one are joined."""
    leads = lead_blocks(index, ordered.select("phrase", F.col("parts")[0]["term"].alias("term")), "phrase")
    words = ordered.select("phrase", F.size("parts").alias("n_words"), F.explode("parts").alias("part")).select("phrase", "n_words", "part.term", "part.offset")
    # A stored table has a known size, so Spark sends it to the postings when it is small instead of shuffling these.
    wanted = materialize(leads.join(words, "phrase"), "wanted-words")
    found = F.collect_list(F.struct("offset", "n_rows", "entries", "positions")).alias("found")
    met = wanted.join(index.blocks.select("term", "block", "n_rows", "entries", "positions"), ["term", "block"])
    grouped = met.groupBy("phrase", "block", "n_words").agg(found).filter(F.size("found") == F.col("n_words"))
    return phrases_in_blocks(grouped.withColumnRenamed("phrase", "term"))


def matches(queries: DataFrame, index: Index, within: DataFrame | None = None) -> DataFrame:
    """Rows that hold every phrase of a query, with their BM25 score (negative, lower is better).

    The frequency of a word is stored, that of a longer phrase is counted from its occurrences. The rarest phrase of a query says
    which blocks of rows it can match in; only these blocks of its other phrases are joined, so of a stop word beside a rare word
    little is read into the join, and positions only for phrases. A query meets a block in one step, over at most the words of
    one query times the rows of one block. ``within`` (query_id, document_id) limits queries to documents; the statistics
    stay those of all rows."""
    phrases = phrases_of(queries)
    index = index.narrowed(phrases.select(F.explode(F.split("phrase", " ")).alias("term")))
    ordered = materialize(rarest_first(index, phrases), "phrases")
    hits = materialize(phrase_hits(index, ordered.filter(F.size("parts") > 1)), "phrase-hits")
    words = ordered.filter(F.size("parts") == 1).select("phrase", F.col("parts")[0]["df"].alias("df"))
    counted = hits.groupBy(F.col("term").alias("phrase")).agg(F.sum("n_rows").alias("df"))
    n_rows = index.row_count()
    idf = F.log((n_rows - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = phrases.join(words.unionByName(counted), "phrase").withColumn("idf", F.when(idf > 0, idf).otherwise(IDF_FLOOR))
    # One row per query: at most a few dozen phrases, since the query text is bounded. A phrase that is repeated counts again.
    terms = weighted.groupBy("query_id", F.size("phrases").alias("n_phrases"), F.col("phrase").alias("term"), "df").agg(F.sum("idf").alias("weight"), F.count(F.lit(1)).alias("times"))
    plans = terms.groupBy("query_id", "n_phrases").agg(F.sort_array(F.collect_list(F.struct("df", "term", "weight"))).alias("parts"), F.sum("times").alias("times"))
    plans = materialize(plans.filter(F.col("times") == F.col("n_phrases")).select("query_id", "parts"), "query-plans")
    wanted = plans.select("query_id", F.size("parts").alias("n_terms"), F.explode("parts").alias("part")).select("query_id", "n_terms", "part.term", "part.weight")
    columns = ["term", "block", "n_rows", "entries"]
    both = Index(index.blocks.select(*columns).unionByName(hits.select(*columns)), index.terms, index.corpus)
    found = F.collect_list(F.struct("weight", "n_rows", "entries")).alias("found")
    # What meets alone needs no other block, so it is not grouped.
    alone = both.blocks.join(wanted.filter("n_terms = 1"), "term").select("query_id", "block", F.array(F.struct("weight", "n_rows", "entries")).alias("found"))
    several = lead_blocks(both, plans.filter(F.size("parts") > 1).select("query_id", F.col("parts")[0]["term"].alias("term")), "query_id").join(wanted, "query_id")
    met = materialize(several, "wanted-terms").join(both.blocks, ["term", "block"]).groupBy("query_id", "block", "n_terms").agg(found).filter(F.size("found") == F.col("n_terms"))
    grouped = alone.unionByName(met.select("query_id", "block", "found")).withColumn("avg_len", index.average_length())
    scored = scores_in_blocks(grouped, BM25_K1, BM25_B)
    if within is not None:
        scored = scored.join(within, ["query_id", "document_id"], "left_semi")
    return scored.select("query_id", "row_id", "document_id", (F.lit(0.0) - F.round("score", SCORE_DIGITS)).alias("bm25_score"))


def page_bounds(queries: DataFrame) -> DataFrame:
    """Normalise paging: a limit of 0 means the default, and it never exceeds the maximum."""
    lim = F.coalesce("lim", F.lit(DEFAULT_LIMIT))
    return queries.withColumn("lim", F.when(lim == 0, DEFAULT_LIMIT).otherwise(F.least(lim, F.lit(MAX_LIMIT)))).withColumn(
        "off", F.coalesce("off", F.lit(0))
    )


def page_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Order each query's hits, number them, count them, and keep the requested page.

    ``hits`` needs ``query_id, row_id, bm25_score, ingested_at``. Hits are counted per query and ranked in two levels: first in parts
    of a query, of which every task sends on the best rows alone (Spark limits each group before the shuffle), then the best of all
    parts. Past the first level a query keeps no more rows than its own page reaches, however deep that of another one is."""
    paging = page_bounds(queries).select("query_id", F.coalesce("sort", F.lit("relevance")).alias("sort"), "lim", "off")
    deepest = paging.agg(F.max(F.col("lim") + F.col("off")).alias("n")).first()["n"] or 0
    time_key = F.when(F.col("sort") == "newestFirst", -F.col("ingested_at")).when(F.col("sort") == "oldestFirst", F.col("ingested_at"))
    order = [F.coalesce(time_key, F.lit(0)).alias("time_key"), F.col("bm25_score"), F.col("row_id")]
    stored = materialize(hits, "scored-hits")
    totals = stored.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_hits"))
    spread = stored.join(paging, "query_id").withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(RANK_PARTS)))
    best = spread.withColumn("part_rank", F.row_number().over(W.partitionBy("query_id", "part").orderBy(*order))).filter(F.col("part_rank") <= deepest)
    best = best.filter(F.col("part_rank") <= F.col("off") + F.col("lim")).drop("part", "part_rank")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= deepest)
    page = ranked.filter((F.col("rank") > F.col("off")) & (F.col("rank") <= F.col("off") + F.col("lim")))
    return page.join(totals, "query_id").withColumn("rank", F.col("rank").cast("bigint")).drop("sort", "lim", "off")


def scoped(found: DataFrame, queries: DataFrame, documents: DataFrame, mode: str = "search") -> DataFrame:
    """Keep matches in visible documents that also satisfy the query's own date range and engine."""
    facts = visible_documents(documents, mode).select("document_id", "ingested_at", "ocr_engine")
    engine = F.nullif(F.trim("engine"), F.lit(""))
    valid = F.when(engine.isNull() | engine.isin(*ENGINES), engine).otherwise(
        F.raise_error(F.concat(F.lit("invalid OCR engine filter: "), engine)).cast("string")
    )
    limits = queries.select("query_id", "date_from", "date_to", valid.alias("wanted"))
    inside = (
        (F.col("date_from").isNull() | (F.col("ingested_at") >= F.col("date_from")))
        & (F.col("date_to").isNull() | (F.col("ingested_at") <= F.col("date_to")))
        & (F.col("wanted").isNull() | (F.col("ocr_engine") == F.col("wanted")))
    )
    return found.join(facts, "document_id").join(limits, "query_id").filter(inside).drop("date_from", "date_to", "wanted")


def describe_hits(page: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Add page number and document name to the few hits that are shown."""
    numbers = pages.select(F.col("page_id").alias("row_id"), "page_number")
    names = documents.select("document_id", tx.document_name(F.col("display_name"), F.col("original_path")).alias("display_name"))
    return (
        page.join(numbers, "row_id")
        .join(names, "document_id")
        .select(
            "query_id", "rank", "total_hits", "document_id", "display_name", F.col("row_id").alias("page_id"), "page_number",
            "bm25_score", "ingested_at", "ocr_engine",
        )
    )


def search(queries: DataFrame, index: Index, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Answer a table of queries: ranked page hits with totals. Queries without terms give no rows
    (:func:`match_expressions` reports them)."""
    found = scoped(matches(queries, index), queries, documents)
    return describe_hits(page_hits(found, queries), pages, documents)


def search_in_document(queries: DataFrame, index: Index, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Answer queries that each name one document: its matching pages in page order."""
    targets = materialize(queries.select("query_id", "document_id"), "targets")
    found = matches(queries, index, targets)
    facts = visible_documents(documents).select("document_id")
    numbers = pages.select(F.col("page_id").alias("row_id"), "page_number")
    ranked = (
        found.join(facts, "document_id", "left_semi")
        .join(numbers, "row_id")
        .withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("page_number")))
        .filter(F.col("rank") <= IN_DOCUMENT_LIMIT)
    )
    return ranked.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "document_id", F.col("row_id").alias("page_id"), "page_number", "bm25_score"
    )


def group_hits(hits: DataFrame) -> DataFrame:
    """Fold the page hits of a query into one row per document, groups and pages in rank order.

    Input is a result page, at most ``MAX_LIMIT`` hits per query, so groups are small."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "page_number")))
    groups = hits.groupBy("query_id", "document_id", "display_name").agg(
        F.min("rank").alias("first_rank"),
        F.count(F.lit(1)).alias("hits"),
        F.array_join(F.transform(ordered, lambda hit: hit["page_number"].cast("string")), ",").alias("page_numbers"),
    )
    position = F.row_number().over(W.partitionBy("query_id").orderBy("first_rank"))
    return groups.withColumn("group_no", position.cast("bigint"))


def parse_saved_searches(saved: DataFrame) -> DataFrame:
    """Saved searches (``query_id``, JSON ``query``) as a query table; text that is not JSON gives an empty query."""
    parsed = F.from_json("query", schemas.SAVED_QUERY)
    sort = F.lower(F.left(parsed["sort"], F.lit(1)))
    return saved.select(
        "query_id",
        F.coalesce(parsed["q"], F.lit("")).alias("q"),
        F.when(F.concat(sort, F.substring(parsed["sort"], 2, 99)).isin(*SORTS), F.concat(sort, F.substring(parsed["sort"], 2, 99)))
        .otherwise("relevance")
        .alias("sort"),
        F.coalesce(parsed["limit"], F.lit(DEFAULT_LIMIT)).alias("lim"),
        F.coalesce(parsed["offset"], F.lit(0)).alias("off"),
        parsed["dateFrom"].alias("date_from"),
        parsed["dateTo"].alias("date_to"),
        parsed["engine"].alias("engine"),
    )


def run_saved_searches(saved: DataFrame, index: Index, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Run every saved search in one job."""
    return search(parse_saved_searches(saved), index, pages, documents)


# ---- snippets --------------------------------------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def that_may_meet(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is among those of ``keys``, and a few others where there are many keys.

    The keys set bits in an array of fixed size, which reaches the rows where they are read: what is left out of a join never reaches its shuffle.
    Only whole numbers of one type are looked up so; with others all rows are kept."""
    kind = rows.schema[column].dataType
    if not isinstance(kind, IntegralType) or keys.schema[column].dataType != kind:
        return rows
    spot = F.pmod(F.xxhash64(column), F.lit(64 * MARK_WORDS))
    word, bit = F.shiftright(spot, 6).cast("int"), spot.bitwiseAND(63).cast("int")
    none = keys.sparkSession.range(MARK_WORDS).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    marks = keys.filter(F.col(column).isNotNull()).select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("mask"))
    masks = marks.unionByName(none).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    array = masks.agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("found")).select(F.col("found.mask"))
    mask = F.get(array.scalar(), word)
    return rows.filter(F.call_function("shiftrightunsigned", mask, bit).bitwiseAND(1) == 1)


def snippets(hits: DataFrame, queries: DataFrame, texts: DataFrame, row_id: str = "page_id") -> DataFrame:
    """The best window of each hit's text, HTML-escaped, with the matched phrases marked.

    Windows start so that the first match sits in the middle, or at the start of the sentence before a match. A new
    phrase in a window counts far more than a repeated one, and a window at a sentence start gets a bonus."""
    phrases = queries.select("query_id", F.transform(query_terms(F.col("q")), lambda t: F.split(F.lower(t), " ")).alias("phrases"))
    # Few short rows carry much work, so they are spread with their texts. Texts that no hit asks for stay where they are.
    width_of_shuffle = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = materialize(hits.select("query_id", row_id), "hits")
    shown = that_may_meet(texts.select(row_id, "text"), hits, row_id).repartition(width_of_shuffle, row_id)
    rows = hits.repartition(width_of_shuffle, row_id).join(phrases, "query_id").join(shown, row_id)
    width = F.lit(SNIPPET_TOKENS)
    token, zero = F.lit(tx.TOKEN), F.lit(0)
    cut = rows.select(
        "query_id",
        row_id,
        "phrases",
        F.regexp_extract_all("text", token, zero).alias("words"),
        F.split("text", tx.TOKEN).alias("gaps"),
    )
    cut = cut.withColumn("keys", F.transform("words", tx.fold)).withColumn("n", F.size("words"))

    def occurrences(phrase: Column, number: Column) -> Column:
        length = F.size(phrase)
        places = F.sequence(F.lit(0), F.greatest(F.col("n") - length, F.lit(-1)), F.lit(1))
        places = F.when(F.col("n") >= length, places).otherwise(F.array().cast("array<int>"))
        first = F.get(phrase, F.lit(0))
        same = F.filter(places, lambda p: (F.col("keys")[p] == first) & (F.slice(F.col("keys"), p + 1, length) == phrase))
        return F.transform(same, lambda p: F.struct(p.alias("at"), number.alias("phrase"), length.alias("len")))

    cut = cut.withColumn("found", F.array_sort(F.flatten(F.transform("phrases", occurrences))))
    numbers = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    starts_sentence = lambda p: (p == 0) | F.col("gaps")[p].rlike(r"[.:][ \t\r\n]+$")
    cut = cut.withColumn("sentences", F.filter(numbers, starts_sentence))

    def within(at: Column) -> Column:
        return F.filter("found", lambda m: (m["at"] >= at) & (m["at"] < at + width))

    def worth(inside: Column) -> Column:
        different = F.size(F.array_distinct(F.transform(inside, lambda m: m["phrase"])))
        return different * 1000 + F.size(inside) - different

    def centred(inside: Column) -> Column:
        first, last = F.get(inside, F.lit(0)), F.try_element_at(inside, F.lit(-1))
        span = last["at"] + last["len"] - first["at"]
        start = first["at"] - ((width - span) / 2).cast("int")
        return F.greatest(F.when(start + width > F.col("n"), F.col("n") - width).otherwise(start), F.lit(0))

    def option(score: Column, start: Column) -> Column:
        return F.struct(score.cast("int").alias("score"), start.cast("int").alias("start"))

    def candidates(match: Column) -> Column:
        sentence = F.array_max(F.filter("sentences", lambda s: s <= match["at"]))
        bonus = lambda s: F.when(s == 0, SNIPPET_OPENING_BONUS).otherwise(SNIPPET_SENTENCE_BONUS)
        usable = lambda s: (s < match["at"]) & (F.col("n") > width)
        here = let(within(match["at"]), lambda inside: option(worth(inside), centred(inside)))
        there = let(sentence, lambda s: option(F.when(usable(s), worth(within(s)) + bonus(s)).otherwise(-1), s))
        return F.array(here, there)

    nothing = F.struct(F.lit(0).alias("score"), F.lit(0).alias("start"))
    better = lambda best, c: F.when(c["score"] > best["score"], c).otherwise(best)
    cut = cut.withColumn("start", F.aggregate(F.flatten(F.transform("found", candidates)), nothing, better)["start"])
    cut = cut.withColumn("end", F.col("start") + width - 1)

    def merge(runs: Column, match: Column) -> Column:
        run, last = F.try_element_at(runs, F.lit(-1)), match["at"] + match["len"] - 1
        new = F.struct(match["at"].alias("first"), last.alias("last"))
        longer = F.struct(run["first"].alias("first"), F.greatest(run["last"], last).alias("last"))
        joined = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(longer))
        return F.when(F.size(runs) == 0, F.array(new)).when(match["at"] <= run["last"], joined).otherwise(F.concat(runs, F.array(new)))

    none = F.array().cast("array<struct<first:int,last:int>>")
    cut = cut.withColumn("runs", F.filter(F.aggregate("found", none, merge), lambda r: (r["first"] >= F.col("start")) & (r["first"] <= F.col("end"))))

    def piece(p: Column) -> Column:
        opens = F.exists("runs", lambda r: r["first"] == p)
        closes = F.exists("runs", lambda r: (r["last"] == p) | ((p == F.col("end")) & (r["first"] <= p) & (r["last"] > p)))
        gap = F.when(p > F.col("start"), tx.escape_html(F.col("gaps")[p])).otherwise("")
        return F.concat(
            gap, F.when(opens, "<mark>").otherwise(""), tx.escape_html(F.col("words")[p]), F.when(closes, "</mark>").otherwise("")
        )

    shown = F.filter(numbers, lambda p: (p >= F.col("start")) & (p <= F.col("end")))
    ellipsis = F.lit("…")
    head = F.when(F.col("start") > 0, ellipsis).otherwise(tx.escape_html(F.col("gaps")[0]))
    tail = F.when(F.col("end") >= F.col("n") - 1, tx.escape_html(F.try_element_at(F.col("gaps"), F.lit(-1)))).otherwise(ellipsis)
    body = F.array_join(F.transform(shown, piece), "")
    return cut.select("query_id", row_id, F.when(F.col("n") > 0, F.concat(head, body, tail)).otherwise("").alias("snippet_html"))
