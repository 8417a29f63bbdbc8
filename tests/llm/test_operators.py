"""The training-text operators against brute force, and on rows that are null, empty, repeated or missing."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import chunks, compression, contamination, context_tree, golay, packing, quality, sharding, simhash, substrings, surrogates
from foliary.llm.suffix_array import permuted_common_prefixes, suffix_array

FOLDER = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, shard int, n_replaced string"
ODD = [
    (1, None, None, 1, "x"),
    (2, "", "en", 1, "x"),
    (None, "a row without an id " * 20, "en", 1, "x"),
    (3, "The same words again and again in a line.\n" * 30, "de", 1, None),
    (4, "The same words again and again in a line.\n" * 30, "xx", 1, None),
    (4, "The same words again and again in a line.\n" * 30, "xx", 1, None),
    (5, " \t\n ", "fr", 1, None),
    (6, "one", "fr", 1, None),
    (7, "word " * 30_000, "en", 1, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: (r["text"] or "") for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SHAPE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


OPERATORS = {
    "surrogates": surrogates.pseudonymize,
    "substrings": substrings.repeated_spans,
    "shards": sharding.shard_documents,
    "quality": quality.quality_rules,
    "context tree": context_tree.score_documents,
    "chunks": chunks.dedup_chunks,
    "simhash": simhash.near_duplicates,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_and_empty_tables(odd, none, name):
    rows = OPERATORS[name](odd).collect()
    assert len(rows) == len(ODD)
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r[0] for r in ODD)
    assert OPERATORS[name](none).count() == 0


def test_odd_rows_of_the_others(spark, odd, none):
    pieces = packing.pack_documents(odd).collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in ODD}
    assert sum(r["length"] for r in pieces if r["start"] == 0 and r["doc_id"] in (1, 2, 5)) == 3  # the end id alone
    assert packing.pack_documents(none).count() == 0
    labels = spark.createDataFrame([(1, 1), (3, 0), (99, None), (None, 1)], "doc_id long, quality int")
    model = compression.fit(odd, labels)
    assert all(0 <= r["score"] <= 1 for r in compression.score(odd, model).collect())
    assert compression.score(none, compression.fit(none, labels.limit(0))).count() == 0
    bench = spark.createDataFrame([(1, None), (None, "a b c d e f"), (2, ""), (3, "again in a line. the same words")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(odd, bench).collect()} == {(3, 3), (4, 3)}
    assert contamination.contaminated(none, bench).count() == 0
    assert contamination.contaminated(odd, bench.limit(0)).count() == 0
    assert contamination.decontaminate(odd, bench).count() == len(ODD) - 3
    assert simhash.first_of_each(odd).columns == odd.columns
    assert simhash.first_of_each(none).count() == 0
    assert quality.good_documents(none).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, a = int(rng.integers(1, 70)), int(rng.integers(1, 6))
        s = np.concatenate((rng.integers(1, a + 1, n), [0]))
        sa = suffix_array(s, a + 1)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())
        data, raw = s.astype(np.uint8), s.astype(np.uint8).tobytes()
        common = permuted_common_prefixes(data, sa, 10)
        for x, y in zip(sa[:-1], sa[1:]):
            k = 0
            while k < min(10, len(raw) - max(x, y)) and raw[x + k] == raw[y + k]:
                k += 1
            assert common[y] == k


@pytest.mark.parametrize("frequent", [1, 4096])
def test_repeated_strings_are_those_of_brute_force(docs, texts, frequent):
    first = {}
    for i in sorted(texts):
        t = texts[i].encode()
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for r in substrings.repeated_spans(docs, frequent=frequent).collect():
        t = texts[r["doc_id"]].encode()
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < r["doc_id"]:
                gone[k : k + 50] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert (r["n_bytes"], r["n_removed"], bytes(r["kept"])) == (len(t), int(gone.sum()), kept)
        assert r["n_spans"] == int((gone & ~np.concatenate(([False], gone[:-1]))).sum())


def test_golay_neighbours():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    near, count = golay.nearby(words)
    flipped, count2 = golay.nearby(words ^ (1 << rng.integers(0, 23, 500)))
    assert set(count.tolist()) == {1, 6}
    assert all(set(near[i, : count[i]]) & set(flipped[i, : count2[i]]) for i in range(500))


def test_values_within_three_bits_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    sets = []
    for values in (a, b):
        keys, rows = simhash.golay_keys(values)
        mine = collections.defaultdict(set)
        for k, r in zip(keys.tolist(), rows.tolist()):
            mine[r].add(k)
        sets.append(mine)
    assert all(sets[0][i] & sets[1][i] for i in range(len(a)))


def test_components_are_those_of_brute_force(docs):
    rows = simhash.near_duplicates(docs).collect()
    f = np.array([int(r["fingerprint"], 16) for r in rows], np.uint64)
    close = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    label = np.array([r["doc_id"] for r in rows])
    while True:
        new = np.array([label[close[i]].min() for i in range(len(f))])
        if (new == label).all():
            break
        label = new
    assert label.tolist() == [r["component_id"] for r in rows]


def test_large_groups_give_a_forest():
    rng = np.random.default_rng(3)
    base = np.uint64(rng.integers(0, 1 << 63))
    values = np.unique([base ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for i in range(12) for j in range(12)])
    a, b = simhash.links_in_groups(np.zeros(len(values), np.uint64), values, 3)
    assert len(a) == len(values) - 1
    node, root = simhash.stars(a, b)
    assert set(root.tolist()) == {values.min()} and len(node) == len(values) - 1


def test_near_copies_leave_one_document(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choice(words, 400).tolist()
    near = [base[:i] + ["changed"] + base[i + 1 :] for i in range(0, 400, 40)]
    other = [rng.choice(words, 400).tolist() for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate([base, *near, *other])]
    kept = {r["doc_id"] for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, *range(len(near) + 1, len(rows))}


def test_soft_decoding_gives_the_codewords_that_agree_best():
    rng = np.random.default_rng(5)
    weights = rng.integers(-9, 10, (50, 23))
    signs = golay._signs()
    assert {golay._remainder(int(sum(1 << i for i in range(23) if column[i] > 0))) for column in signs.T[:200]} == {0}
    found = golay.nearest(weights, 3, block=7)
    for row, best in zip(weights, found):
        score = row @ signs
        assert best.tolist() == sorted(range(4096), key=lambda c: (-score[c], c))[:3]


def test_near_classes_against_resemblance(spark):
    """Random near copies at every resemblance: nearly all pairs at 0.85 and above are linked, none below 0.6."""
    rng = np.random.default_rng(6)
    rows, like = [], {}
    for pair in range(600):
        words = rng.integers(0, 10**6, 300)
        other = words.copy()
        other[rng.choice(300, pair % 20 + 1, replace=False)] = rng.integers(0, 10**6, pair % 20 + 1)
        a, b = ({tuple(w[i : i + 5]) for i in range(296)} for w in (words.tolist(), other.tolist()))
        like[pair] = len(a & b) / len(a | b)
        rows += [(2 * pair, " ".join(map(str, words))), (2 * pair + 1, " ".join(map(str, other)))]
    found = simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = {r["node"] // 2 for r in found if r["root"] != r["node"]}
    assert all(r["node"] // 2 == r["root"] // 2 for r in found)
    high = [p for p, j in like.items() if j >= 0.85]
    at = [p for p, j in like.items() if 0.8 <= j < 0.85]
    assert len(linked & set(high)) >= 0.98 * len(high) and len(high) > 50
    assert len(linked & set(at)) >= 0.75 * len(at) and len(at) > 20
    assert not [p for p in linked if like[p] < 0.6]


def test_near_copies_are_those_of_brute_force(spark):
    """Pairs about a resemblance of 0.8: practically all at 0.8 and above are linked, and none below."""
    rng = np.random.default_rng(16)
    rows, like = [], {}
    for pair in range(600):
        size = int(rng.integers(60, 400))
        words = rng.integers(0, 10**6, size)
        other = words.copy()
        at = rng.choice(size, max(1, int(size * rng.uniform(0.01, 0.035))), replace=False)
        other[at] = rng.integers(0, 10**6, len(at))
        a, b = ({tuple(w[i : i + 5]) for i in range(size - 4)} for w in (words.tolist(), other.tolist()))
        like[pair] = len(a & b) / len(a | b)
        rows += [(2 * pair, " ".join(map(str, words))), (2 * pair + 1, " ".join(map(str, other)))]
    found = simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = {r["node"] // 2 for r in found if r["root"] != r["node"]}
    high, at, low = ({p for p, j in like.items() if a <= j < b} for a, b in ((0.8, 1.1), (0.8, 0.85), (0.5, 0.8)))
    assert len(at) > 50 and len(low) > 100
    assert len(linked & high) >= 0.98 * len(high) and len(linked & at) >= 0.97 * len(at)
    assert not linked & low


@pytest.mark.parametrize("number", [2, 47, 49, 300])
def test_a_key_of_many_batches_is_one_group(spark, number):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
    rows = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :])) for i in range(number)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        kept = [r["doc_id"] for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert kept == [0]


@pytest.mark.parametrize("block", [3, 2000])
def test_keys_cut_into_cells_lose_no_link(spark, block):
    """A family around one fingerprint, all on few keys, and a chain of texts: as brute force has it for cells of any size."""
    rng = np.random.default_rng(8)
    base, values = rng.integers(0, 1 << 63, dtype=np.uint64), set()
    for _ in range(400):
        x = base
        for bit in rng.choice(12, int(rng.integers(0, 12)), replace=False):
            x ^= np.uint64(1) << np.uint64(5 * bit)
        values.add(int(x))
    f = np.array(sorted(values), np.uint64)
    close = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    label = f.copy()
    while True:
        new = np.array([label[close[i]].min() for i in range(len(f))])
        if (new == label).all():
            break
        label = new
    found = simhash.fingerprint_components(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"), block=block)
    roots = {r["node"]: r["root"] for r in found.collect()}
    assert [roots.get(int(x), int(x)) for x in f] == label.tolist()
    # a pair of one root is in no cell; a pair of two roots of one key is in one, which is small
    shared = spark.createDataFrame([(1, i) for i in range(60)] + [(2, i) for i in range(9)], "key long, node long")
    placed = spark.createDataFrame([(i, bytes(8), 0 if i < 40 else i) for i in range(60)], "node long, mark binary, root long")
    cells = collections.defaultdict(set)
    for r in simhash._dealt(shared, placed, block).collect():
        cells[r["cell"]].add(r["node"])
    met = {(a, b) for nodes in cells.values() for a in nodes for b in nodes if a < b}
    assert {(a, b) for a in range(60) for b in range(a + 1, 60) if b >= 40} <= met
    assert max(map(len, cells.values())) <= (20 if block == 3 else 60)


def test_null_ids_stay_and_texts_of_one_id_are_judged_apart(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long), (5, long), (5, long.replace("w", "v")), (None, long), (7, ""), (8, None), (8, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit(1)).withColumn("node", F.lit(2))
    kept = [(r["doc_id"], r["text"]) for r in simhash.first_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, long), (5, long.replace("w", "v")), (None, long), (7, "")], key=str)


def test_base_counts_are_those_of_brute_force(docs, texts):
    for r in quality.quality_rules(docs).collect():
        t = texts[r["doc_id"]]
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_divergence(spark):
    row = spark.range(1).select(quality.divergence(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"), quality.divergence(F.array(F.lit(0.3), F.lit(0.7)), F.array(F.lit(0.3), F.lit(0.7))).alias("same")).first()
    assert (row["far"], row["same"]) == (1.0, 0.0)


def test_languages_that_are_not_listed_are_judged_by_themselves(spark, docs):
    rng = np.random.default_rng(9)
    frequent = "и в не на я быть он с что а по это она этот".split()
    rare = ["".join(rng.choice(list("абвгдежзиклмнопрстуя"), 7)) for _ in range(600)]
    clean = [(10**6 + i, " ".join(rng.choice(frequent if rng.random() < 0.4 else rare) for _ in range(120)), "ru") for i in range(60)]
    junk = [(2 * 10**6 + i, " ".join("".join(rng.choice(list("0123456789"), 6)) for _ in range(120)), "ru") for i in range(3)]
    short = [(3 * 10**6, "λόγος " * 3, "el")]
    more = spark.createDataFrame(clean + junk + short, "doc_id long, text string, lang string")
    given = docs.select("doc_id", "text", "lang")
    rows = {r["doc_id"]: r for r in quality.quality_rules(given.union(more)).collect()}
    assert all(rows[i]["kept"] for i, _, _ in clean)
    assert not any(rows[i]["kept"] for i, _, _ in junk)
    assert rows[3 * 10**6]["character_distance"] is None and rows[3 * 10**6]["base_failed"]
    alone = {r["doc_id"]: r["kept"] for r in quality.quality_rules(given).collect()}
    assert {i: rows[i]["kept"] for i in alone} == alone
    kept = {r["doc_id"] for r in quality.good_documents(given.union(more)).collect()}
    assert kept == {i for i, r in rows.items() if r["kept"]}


def test_surrogates(spark):
    rows = [
        (1, "mail Bob.X1@mail7.test.com, call +1 (375) 555-4393; card 4111 1111 1111 1111 and 4111111111111111."),
        (2, "bob.x1@MAIL7.test.com from 10.2.3.4. password=abcdef123456 Anna Smith met Иван Петров; version 2.0 of 2024"),
        (3, "no data here, 12 of 30."),
    ]
    out = {r["doc_id"]: r for r in surrogates.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[3]["text"] == rows[2][1] and out[3]["n_replaced"] == 0
    for gone in ("Bob", "mail7", "555-4393", "4111 1111", "abcdef123456", "10.2.3.4", "Anna Smith", "Петров"):
        assert gone not in out[1]["text"] + out[2]["text"]
    address = re.search(r"mail (\S+@\S+),", out[1]["text"])[1]
    assert out[2]["text"].lower().startswith(address.lower())  # one thing, one surrogate, each in its own format
    first, second = re.search(r"card ([\d ]{19}) and (\d{16})", out[1]["text"]).groups()
    assert first.replace(" ", "") == second
    digits = [int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(second)]
    assert sum(d - 9 if d > 9 else d for d in digits) % 10 == 0
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4};", out[1]["text"]) and "version 2.0 of 2024" in out[2]["text"]
    name = re.search(r"password=\S{12} (\w+) \w+ met (\w+) ", out[2]["text"]).groups()
    assert name[0] in surrogates.GIVEN["latin", "f"] and name[1] in surrogates.GIVEN["cyrillic", "m"]


def test_surrogates_stay_distinct_after_collisions(spark, monkeypatch):
    # only 26 surrogates for one letter: collisions are certain
    things = [(f"password=aaaaa{c}",) for c in "abcdefghij"]
    monkeypatch.setattr(surrogates, "_masked", lambda canonical, stream, h: F.concat(F.lit("zzzzz"), F.substring(stream, 1, 1)))
    found = surrogates.surrogate_table(spark.createDataFrame(things, "surface string")).collect()
    assert len({r["replacement"] for r in found}) == len(things)


def test_shards(docs, texts):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts)
    slots, bytes_ = collections.defaultdict(list), collections.Counter()
    groups = collections.defaultdict(set)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        slots[r["shard"]].append(r["slot"])
        bytes_[r["shard"]] += r["size"]
        groups[texts[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, groups.values())) == 1
    assert max(bytes_.values()) < 1.1 * sum(bytes_.values()) / 24


def test_a_group_larger_than_a_shard_is_divided(spark):
    rows = [(i, "copy of one text" if i < 300 else f"text number {i:05d}") for i in range(600)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert sizes.max() < 1.1 * sizes.mean()


def test_classifier_tells_the_labels_apart(spark):
    folder = FOLDER.replace("0.001", "0.1")
    found = compression.op5(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = found.filter("held_out").join(labels, "doc_id").toPandas()
    good, bad = (held["score"][held["quality"] == q].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert (held["predicted"][held["quality"] == 1] == 1).mean() > 0.97


def test_verbatim_and_edited_passages_are_found(spark, docs, texts):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    plain = {i: " ".join(t.lower().split()) for i, t in texts.items()}
    want = {(i, r["item_id"]) for r in bench.collect() for i, t in plain.items() if " ".join(r["text"].lower().split()) in t}
    assert want <= {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(docs, bench).collect()}
    rng = np.random.default_rng(1)
    words = [f"w{i}".encode() for i in range(400)]
    items = [(i, rng.choice(words, int(rng.integers(12, 60))).tolist()) for i in range(60)]
    index, found = contamination.Index.build(items, 0.8, 0.99), 0
    for i, item in items:
        item = list(item)
        for _ in range(int(len(item) * 0.15)):
            item[int(rng.integers(len(item)))] = b"other"
        doc = [b"x"] * 20 + item + [b"y"] * 20
        symbols = np.array([index.vocabulary.get(w, 0) for w in doc])
        found += (0, i) in index.search(symbols, np.array([0, len(doc)]))
    assert found >= 0.95 * len(items)


@pytest.mark.parametrize("kind", ["replace", "insert", "delete", "mixed"])
@pytest.mark.parametrize("size", [5, 10, 12, 20, 60, 100, 150, 250])
def test_passages_at_the_full_edit_allowance_are_found(kind, size):
    rng = np.random.default_rng(size)
    words = [f"w{i}".encode() for i in range(400)]
    items = [(i, rng.choice(words, size).tolist()) for i in range(40)]
    index, texts = contamination.Index.build(items, 0.8, 0.99), []
    for _, item in items:
        item = list(item)
        for at in sorted(rng.choice(size, contamination.edits(size), replace=False).tolist(), reverse=True):
            way = kind if kind != "mixed" else rng.choice(["replace", "insert", "delete"])
            item[at : at + (way != "insert")] = [] if way == "delete" else [b"other"]
        texts.append([b"x"] * 20 + item + [b"y"] * 20)
    symbols = np.array([index.vocabulary.get(w, 0) for t in texts for w in t])
    found = index.search(symbols, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    assert {(i, i) for i, _ in items} <= set(found)
    assert all(cost <= contamination.edits(size) for cost, _, _ in found.values())


def test_word_scores_are_those_of_brute_force(docs, texts):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    words = {i: t.encode().lower().split() + [None] for i, t in texts.items()}
    count = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, distinct = sum(count.values()), len(count)
    for r in context_tree.score_documents(docs).collect():
        mine = words[r["doc_id"]]
        score = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in mine)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(mine), sum(count[w] > 0 for w in mine), total)
        assert r["base_score"] == pytest.approx(score)
        assert r["score"] < 0


def test_copies_of_a_text_of_many_words(spark):
    text = " ".join(f"{i:x}" if i % 3 else f"{i:x} {i:x}" for i in range(70_000))
    docs = spark.createDataFrame([(i, text) for i in range(8)], "doc_id long, text string").coalesce(1)
    learnt = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(8))
    count = collections.Counter(text.split())
    count[None] = 1
    total = learnt * count.total()
    score = sum(n * math.log10((learnt * n + 0.5) / (total + 0.5 * (len(count) + 1))) for n in count.values())
    for r in context_tree.score_documents(docs).collect():
        assert (r["n_known"], r["train_tokens"]) == (count.total(), total)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)


def test_context_tree_is_normalised_and_weighted():
    stream, starts = context_tree._stream([b"abab abba", b"cab"])
    keep = np.ones(len(stream), bool)
    keep[starts] = keep[starts + 1] = False
    s = stream.astype(np.int64)
    grams, n = np.unique((s[:-2] << 16 | s[1:-1] << 8 | s[2:])[keep[2:]], return_counts=True)
    model = context_tree.weigh(grams, n)
    assert np.abs((10.0**model.logs).sum(axis=1) - 1).max() < 1e-5
    seen, unseen = model.text_scores([b"abab", b"zqzq"])
    assert seen > unseen
    assert context_tree.estimate(np.array([1.0]), np.array([1.0]))[0] == pytest.approx(math.log(1 / 8))


def test_chunks_resist_shifts(spark):
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefgh é"), 3000))
    rows = [(1, passage), (2, "inserted " + passage[:1500] + "!" + passage[1500:])]
    found = {r["doc_id"]: r for r in chunks.dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["n_removed"] == 0 and bytes(found[1]["kept"]).decode() == passage
    assert found[2]["n_removed"] > 0.85 * found[2]["n_bytes"]
    bytes(found[2]["kept"]).decode()  # whole characters


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = packing.pack_documents(docs).toPandas()
    for doc_id, rows in found.groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[doc_id], add_special_tokens=False).ids + [2], "<u4")
        rows = rows.sort_values("start")
        assert rows["length"].sum() == len(ids) == rows["doc_tokens"].iloc[0]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(rows["start"], rows["length"], rows["ids_crc32"]))
    for _, rows in found.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]] and rows["length"].sum() <= 4096
    assert found["length"].sum() / 4096 / found["sequence_id"].nunique() > 0.95


def test_plan_places_every_piece():
    rng = np.random.default_rng(6)
    histogram = np.concatenate(([0], rng.integers(0, 400, 256)))
    used = np.zeros(257, int)
    for shape, times in packing.plan(histogram):
        assert sum(shape) <= 256
        for c in shape:
            used[c] += times
    assert (used == histogram).all()


def test_pipeline_takes_effect(spark, docs):
    import corpus_pipeline

    folder, rows = FOLDER, docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, rows = rows, stage(spark, rows, folder)
        if number < 4:
            assert rows.columns == docs.columns and 0 < rows.count() <= before.count()
    assert rows.count() > 0
