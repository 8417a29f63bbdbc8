"""Personal data replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import documents, materialize, query

KEY = "foliary"

# Given names by script and gender; a name is one of them followed by a capitalised surname.
GIVEN = {
    ("latin", "f"): "Alice Anna Clara Emily Emma Julia Laura Linda Maria Mary Nina Sarah Sofia Susan".split(),
    ("latin", "m"): "Adam Daniel David James John Lucas Mark Martin Michael Paul Peter Robert Simon Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Наталья Ольга Светлана".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Сергей".split(),
}
SYLLABLES = {
    "latin": "bal cor den fel gar hol jen kel lor mar nor pel ras sten tol ver".split(),
    "cyrillic": "бал вор ден зор кал лан мар нов пол рев сан тур фед хор шел яр".split(),
}
ENDING = {("latin", "f"): "", ("latin", "m"): "", ("cyrillic", "f"): "ова", ("cyrillic", "m"): "ов"}
CYRILLIC, GREEK = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
LABEL = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?[\"']?"
#: Kind and pattern, in order of precedence; each is tried where no letter, digit or underscore stands before. What stands before a secret's value is matched with it and kept.
KINDS = {
    "email": r"[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})",
    "access_key": r"AKIA[0-9A-Z]{16}(?!\w)",
    "secret": LABEL + r"[^\s\"',;]{6,}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){3}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?!\w)",
    "ip": r"(?<![\w.])(?:" + OCTET + r"\.){3}" + OCTET + r"(?!\.?\w)",
    "name": r"(?:" + "|".join(n for names in GIVEN.values() for n in names) + r") \p{Lu}\p{Ll}+(?!\p{L})",
}
#: First characters of the kinds that have few: the others of a branch are not tried at any other character.
STARTS = {
    r"(?=[\w.%+-]++@)": ("email",),
    r"(?=[A-Z])": ("access_key", "iban"),
    r"(?=[PpSsTtAa])": ("secret",),
    r"(?=[0-9(+])": ("card", "ssn", "phone", "ip"),
    r"(?=\p{Lu})": ("name",),
}
#: Everything starts where a word does, or at a bracket or plus sign.
PATTERN = r"(?<![\w\p{L}])(?:" + "|".join(f"{start}(?:{'|'.join(KINDS[k] for k in kinds)})" for start, kinds in STARTS.items()) + ")"


def _parse(surface: Column) -> tuple[Column, Column, Column]:
    """Kind of a match, the part of it that is kept in front, and the canonical form of the rest: what two mentions of
    one thing have in common."""
    whole = lambda pattern: surface.rlike(f"^(?:{pattern})$")
    kind = reduce(lambda rest, k: F.when(whole(KINDS[k]), F.lit(k)).otherwise(rest), reversed(KINDS), F.lit("other"))
    front = F.regexp_extract(surface, f"^({LABEL}|AKIA(?=[0-9A-Z]{{16}}$))", 1)
    return kind, front, kind


def _number(stream: Column, at: Column | int) -> Column:
    """The two bytes at a place of a hexadecimal stream, as a number."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(stream, at * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(number, F.lit(len(alphabet))) + 1, F.lit(1))


def _choose(words: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.pmod(number, F.lit(len(words))) + 1)


def _stream(*seed: Column, length: Column | None = None) -> Column:
    """Keyed hexadecimal digits, 64 or as many as ``length`` characters need (4 each)."""
    text = F.concat_ws("\x1f", *(s.cast("string") for s in seed))
    if length is None:
        return F.sha2(text, 256)
    blocks = F.sequence(F.lit(0), F.floor(length / 16).cast("int"))
    return F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat(text, F.lit("\x1f"), i.cast("string")), 256)), "")


def _masked(canonical: Column, stream: Column, hexadecimal: Column) -> Column:
    """Each letter or digit replaced by one of its kind and script."""

    def one(i: Column) -> Column:
        c, n = F.substring(canonical, i + 1, F.lit(1)), _number(stream, i)
        return (
            F.when(c.rlike("[0-9]"), _pick("0123456789", n))
            .when(hexadecimal, _pick("abcdef", n))
            .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", n))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(CYRILLIC, n))
            .when(c.rlike(r"\p{IsGreek}"), _pick(GREEK, n))
            .otherwise(_pick("abcdefghijklmnopqrstuvwxyz", n))
        )

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(canonical) - 1), one), "")


def _check_digit(digits: Column) -> Column:
    """The digit that makes a card number of these 15 digits and itself valid (Luhn)."""
    value = lambda i: F.substring(digits, i + 1, F.lit(1)).cast("int")
    total = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.when(i % 2 == 0, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))),
        F.lit(0), lambda a, b: a + b,
    )
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _surrogate(key: str) -> Column:
    """Surrogate of (kind, canonical) at the given attempt: letters and digits only, except for names and addresses."""
    kind, canonical, k = F.col("kind"), F.col("canonical"), F.lit(key)
    stream = _stream(k, kind, canonical, F.col("attempt"), length=F.length(canonical))
    masked = _masked(canonical, stream, canonical.rlike("^[0-9a-f]{12,}$"))
    # an address keeps its top-level domain, and its domain has one surrogate wherever it occurs
    user, host = F.split_part(canonical, F.lit("@"), F.lit(1)), F.split_part(canonical, F.lit("@"), F.lit(2))
    top = F.regexp_extract(host, r"\.([^.]+)$", 1)
    plain = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    domain = plain(F.substring(host, F.lit(1), F.length(host) - F.length(top)))
    never = F.lit(False)
    email = F.concat(
        _masked(plain(user), stream, never), _masked(domain, _stream(k, F.lit("domain"), domain, length=F.length(domain)), never), top
    )
    ip = F.concat_ws(".", *((F.pmod(_number(stream, i), F.lit(254)) + 1).cast("string") for i in range(4)))
    # the first digit tells the card's brand; a valid number gets a valid surrogate
    body = F.concat(F.substring(canonical, 1, 1), F.substring(masked, 2, 14))
    valid = _check_digit(F.substring(canonical, 1, 15)) == F.substring(canonical, 16, 1)
    card = F.concat(body, F.when(valid, _check_digit(body)).otherwise(F.substring(masked, 16, 1)))
    local = F.greatest(F.length(canonical) - 10, F.lit(0))  # digits of the country code stay
    phone = F.concat(
        F.expr("substring(canonical, 1, greatest(length(canonical) - 10, 0))"),
        _pick("23456789", _number(stream, 0)), F.substring(masked, local + 2, F.lit(2)), _pick("23456789", _number(stream, 3)), F.substring(masked, local + 5, F.lit(6)),
    )
    iban = F.concat(F.substring(canonical, 1, 2), F.substring(masked, F.lit(3), F.length(canonical)))
    given, family = F.split_part(canonical, F.lit(" "), F.lit(1)), F.split_part(canonical, F.lit(" "), F.lit(2))
    first, last = _stream(k, F.lit("given"), given, F.col("attempt")), _stream(k, F.lit("family"), family, F.col("attempt"))
    name = F.lit(None).cast("string")
    for (script, gender), names in GIVEN.items():
        syllables = SYLLABLES[script]
        made = F.initcap(F.concat(*(_choose(syllables, _number(last, i)) for i in range(4)), F.lit(ENDING[script, gender])))
        name = F.when(given.isin([n.lower() for n in names]), F.concat_ws(" ", _choose(names, _number(first, 0)), made)).otherwise(name)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card)
        .when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "name", name).otherwise(masked)
    )


def _render(surface: Column, front: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate in the format of one mention: its separators and capitals, and what is kept in front."""
    rest = F.substring(surface, F.length(front) + 1, F.length(surface))

    def one(i: Column) -> Column:
        c = F.substring(rest, i + 1, F.lit(1))
        at = F.length(F.regexp_replace(F.substring(rest, F.lit(1), i), r"[^\p{L}\p{N}]", "")) + 1
        mine = F.substring(surrogate, at, F.lit(1))
        return F.when(c.rlike(r"\p{Lu}"), F.upper(mine)).when(c.rlike(r"[\p{L}\p{N}]"), mine).otherwise(c)

    overlaid = F.array_join(F.transform(F.sequence(F.lit(0), F.length(rest) - 1), one), "")
    return F.concat(front, F.when(kind.isin("name", "ip"), surrogate).otherwise(overlaid))


def surrogate_table(surfaces: DataFrame, key: str = KEY) -> DataFrame:
    """(surface, kind, replacement) for distinct matches.

    Equal things get equal surrogates, also in other formats. Two things of a kind never share one, and no surrogate is
    a thing that occurs: where a check finds a collision, all but the first of the things involved try again, until
    none is left. Of a card, say, there are 10^14 surrogates, so a second round is rare and small.
    """
    s = F.col("surface")
    kind, front, _ = _parse(s)
    parsed = surfaces.select("surface", kind.alias("kind"), front.alias("front"))
    rest = F.expr("substring(surface, length(front) + 1)")
    letters = F.lower(F.regexp_replace(rest, r"[^\p{L}\p{N}]", ""))
    canonical = F.when(F.col("kind").isin("email", "name", "ip"), F.lower(rest)).otherwise(F.when(letters == "", rest).otherwise(letters))
    parsed = materialize(parsed.withColumn("canonical", canonical), "surfaces")
    things = parsed.select("kind", "canonical").distinct().withColumn("attempt", F.lit(0))
    taken = parsed.select("kind", F.when(F.col("kind") == "email", F.regexp_replace("canonical", r"[^\p{L}\p{N}]", "")).when(F.col("kind") == "name", F.initcap("canonical")).otherwise(F.col("canonical")).alias("surrogate")).distinct()
    while True:
        things = materialize(things.withColumn("surrogate", _surrogate(key)), "surrogates")
        first = things.groupBy("kind", "surrogate").agg(F.min("canonical").alias("first"))
        checked = things.join(first, ["kind", "surrogate"]).join(taken.withColumn("occurs", F.lit(True)), ["kind", "surrogate"], "left")
        again = F.coalesce("occurs", F.lit(False)) | (F.col("first") != F.col("canonical"))
        checked = materialize(checked.select("kind", "canonical", "surrogate", "attempt", again.alias("again")), "checked")
        if not checked.filter("again").limit(1).count():
            break
        things = checked.select("kind", "canonical", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    return parsed.join(things.select("kind", "canonical", "surrogate"), ["kind", "canonical"]).select(
        "surface", "kind", _render(F.col("surface"), F.col("front"), F.col("kind"), F.col("surrogate")).alias("replacement")
    )


def pseudonymize(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """The documents with all columns, personal data in ``text`` replaced, and n_replaced (long).

    Found are e-mail and IP addresses, phone, card, bank and social security numbers, access keys, labelled secrets and
    full names with a listed given name. Texts without any, null ones and all other columns stay as they are (a column
    called n_replaced is overwritten). Rows need no unique id; equal rows give equal results; no rows give no rows.

    Only texts that hold something are joined with their replacements; mentions meet the table of surrogates in an
    equi-join on the mention, which adaptive execution splits where one mention fills a large part of the input.
    """
    key_columns = [F.col("__id"), F.col("__text")]
    whole = F.col(text).cast("string")
    has = F.coalesce(whole.rlike(PATTERN), F.lit(False))
    tagged = docs.filter(has).withColumn("__text", F.xxhash64(whole)).withColumn("__id", F.xxhash64(F.lit("id"), whole))
    found = tagged.select(*key_columns, F.posexplode(F.regexp_extract_all(whole, F.lit(PATTERN), F.lit(0))).alias("__at", "surface")).distinct()
    found = materialize(found, "mentions")
    table = materialize(surrogate_table(found.select("surface").distinct(), key), "replacements")
    lists = (
        found.join(table, "surface")
        .groupBy("__id", "__text")
        .agg(F.array_sort(F.collect_list(F.struct("__at", "replacement"))).alias("__found"))
    )
    gaps = F.split(whole, PATTERN, -1)
    new = F.array_join(
        F.concat(
            F.flatten(F.zip_with(F.slice(F.col("__gaps"), F.lit(1), F.size("__found")), F.col("__found"), lambda g, r: F.array(g, r["replacement"]))),
            F.slice(F.col("__gaps"), F.size("__found") + 1, F.lit(1)),
        ),
        "",
    )
    changed = tagged.join(lists, ["__id", "__text"]).withColumn("__gaps", gaps)
    changed = changed.withColumn(text, new).withColumn("n_replaced", F.size("__found").cast("long"))
    columns = [c for c in docs.columns if c != "n_replaced"] + ["n_replaced"]
    same = docs.filter(~has).withColumn("n_replaced", F.lit(0).cast("long"))
    return changed.select(*columns).unionByName(same.select(*columns))


@query("op1_keyed_surrogates")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymize(documents(spark, folder, "doc_id", "text"))
