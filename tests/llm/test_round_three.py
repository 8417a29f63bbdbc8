"""Conversation repair, importance resampling and bottom-k fingerprints against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import conversations, resampling, sketches
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_importance_resampling"])
def test_query_agrees_with_sql(spark, name):
    from foliary.llm.catalog import QUERIES, SQL

    assert difference(QUERIES[name](spark, FOLDER), SQL[name], connect(FOLDER)) is None


# ---- conversations ----------------------------------------------------------------------------------------------------


def cheapest(rows):
    """The least (cost, audit) by dynamic programming over (rows taken, state of the grammar)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def close(labels):
        waiting = list(labels)
        while waiting:
            state = waiting.pop()
            cost, audit = labels[state]
            to, label = ("a" if state == "u" else "u"), (cost + 3, audit + "I")
            if to not in labels or label < labels[to]:
                labels[to] = label
                waiting.append(to)
        return labels

    labels = close({"": (0, "")})
    for row in rows:
        after = {}
        for state, (cost, audit) in labels.items():
            ways = [(state, cost + 4, "D")]
            if row != "d":
                cut = 3 * row.isupper()
                ways.append(("a" if state == "u" else "u", cost + 3 + cut, "R"))
                if (state, row.lower()) in step:
                    ways.append((step[state, row.lower()], cost + cut, "K"))
            for to, total, letter in ways:
                after[to] = min(after.get(to, (math.inf, "")), (total, audit + letter))
        labels = close(after)
    return min(labels[s] for s in ("", "a") if s in labels)


ROLES = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}


def streamed(rows, block):
    repair = conversations.Repair(block)
    for i, row in enumerate(rows):
        repair.add(i, ROLES[row.lower()], str(i), "blank" if row == "d" else "truncated" if row.isupper() else "")
    return repair.finish()


def test_every_short_conversation_is_repaired_at_the_least_cost():
    for size in range(4):
        for rows in itertools.product("suaxSUAXd", repeat=size):
            assert conversations.repair_of("".join(rows)) == cheapest(rows), rows


def test_blocks_do_not_change_a_repair():
    rng = random.Random(4)
    for _ in range(250):
        letters = rng.choice(["ua", "uaUA", "suaxSUAXd", "u", "uU", "suad", "sS", "d", "x"])
        rows = "".join(rng.choice(letters) for _ in range(rng.choice([9, 40, 100])))
        for block in (1, 7, 32):
            found = streamed(rows, block)
            assert (found["cost"], found["audit"]) == cheapest(rows), (rows, block)


def test_long_conversations_take_linear_work_and_bounded_rows():
    rng, repair, most = random.Random(5), conversations.Repair(), 0
    for i in range(5000):
        row = rng.choice("suaxSUAXd")
        repair.add(i, ROLES[row.lower()], str(i), "blank" if row == "d" else "truncated" if row.isupper() else "")
        most = max(most, len(repair.waiting))
        repair.out.clear()
    assert repair.finish()["cost"] > 0 and most < 500


def test_stand_ins_compare_as_the_audits_do():
    rng = random.Random(6)
    for _ in range(300):
        base = "".join(rng.choice("DIKR") for _ in range(6))
        audits = list({base[: rng.randint(0, 6)] + "".join(rng.choice("DIKR") for _ in range(rng.randint(0, 5))) for _ in range(4)})
        short = conversations.shortened(audits)
        for i, j in itertools.permutations(range(len(audits)), 2):
            for x, y in (("D", "R"), ("R", "D"), ("I", "K"), ("II", "I")):
                if not audits[j].startswith(audits[i]) and not audits[i].startswith(audits[j]):
                    assert (audits[i] + x < audits[j] + y) == (short[i] + x < short[j] + y)


def test_odd_conversations(spark):
    shape = "conv_id long, turn long, role string, text string, fault string, nth string"
    rows = [
        (1, 0, "user", "Ask.", "", ""), (1, 1, "assistant", "Answer.", "", ""),
        (2, None, None, None, "x", "y"), (2, 3, "user", "No end", "", ""), (2, 3, "user", "No end", "", ""),
        (None, 0, "user", "A.", "", ""), (None, None, "", "", "", ""), (3, 5, "tool", "word " * 200_000, "", ""),
    ]
    faults = conversations.find_faults(conversations.damage(spark.createDataFrame(rows, shape)))
    report = {r["conv_id"]: r for r in conversations.repair_report(faults).collect()}
    assert set(report) == {1, 2, 3, None}
    turns = conversations.repaired_turns(faults).orderBy("conv_id", "position").collect()
    for conv_id, facts in report.items():
        own = [r for r in turns if r["conv_id"] == conv_id]
        text = "\n".join(f"{r['role']}:{r['text']}" for r in own)
        assert hashlib.sha256(text.encode()).hexdigest() == facts["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in own))
        assert facts["audit"].replace("D", "") == "".join(r["edit"] for r in own)
    nothing = conversations.find_faults(conversations.damage(spark.createDataFrame([], shape)))
    assert conversations.repair_report(nothing).count() == 0


# ---- resampling -------------------------------------------------------------------------------------------------------


def test_words_are_not_cut_by_slices(monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 7)
    text = "Ein großes Wort, ZWEI worte; drei-vier\x005 " * 9
    plain = text.translate({i: i + 32 for i in range(65, 91)})
    expected = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)
    assert [w.decode() for part in resampling.words(text.encode()) for w in part] == expected
    for longest in (1, 3):
        found, n = resampling.Hasher(50, longest)(text.encode())
        runs = [" ".join(expected[i : i + k]) for k in range(1, longest + 1) for i in range(len(expected) - k + 1)]
        assert n == len(expected) and sorted(found.tolist()) == sorted(zlib.crc32(r.encode()) % 50 for r in runs)


def test_draw_follows_the_full_order(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(40)]), rng.randint(-3, 3), rng.randint(18, 22)) for _ in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, score long, n_features long").repartition(7)
    eligible = sorted(((-s, math.inf if d is None else d, n) for d, s, n in rows if n >= 20))
    for wanted in (0, 1, 37, 200, len(eligible), len(eligible) + 5):
        got = resampling.draw(table, F.col("n_features") >= 20, wanted).collect()
        drawn = sorted((r["rank"], -r["score"], math.inf if r["doc_id"] is None else r["doc_id"], r["n_features"]) for r in got if r["rank"])
        assert len(got) == len(rows) and [r[0] for r in drawn] == list(range(1, min(wanted, len(eligible)) + 1))
        assert [r[1:] for r in drawn] == eligible[:wanted]


def test_resampling_of_odd_tables(spark):
    shape = "doc_id long, text string, score string, weight string, place string, eligible string, rank string"
    rows = [(1, None), (2, ""), (None, "w " * 30), (3, "one two " * 20), (3, "one two " * 20), (4, "zeta " * 300_000)]
    docs = spark.createDataFrame([(d, t, "x", "x", "x", "x", "x") for d, t in rows], shape)
    target = spark.createDataFrame([(None,), ("zeta zeta",)], "text string")
    got = resampling.resample(docs, target, percent=50).collect()
    assert sorted(r["n_features"] for r in got) == [0, 0, 30, 40, 40, 300_000]
    eligible = sorted((-r["score"] for r in got if r["n_words"] >= 20))
    assert sorted((r["rank"], -r["score"]) for r in got if r["rank"]) == [(1, eligible[0]), (2, eligible[1])]
    assert resampling.resample(docs.limit(0), target.limit(0)).count() == 0


# ---- fingerprints -----------------------------------------------------------------------------------------------------


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))
    return {" ".join(found[max(0, i - 4) : i + 1]) for i in range(len(found))}


def ratio(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_agree_with_whole_sets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in sketches.edit_report(docs).collect()}
    assert len(got) == len(rows)
    errors = []
    for i, (doc_id, text) in enumerate(rows):
        following, half, row = rows[(i + 1) % len(rows)][1], len(text) // 2, got[doc_id]
        changed = text[: len(text) - half] + following[:half]
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and row["n_chars"] == len(text)
        own, other, beside = shingles(text), shingles(changed), shingles(following)
        pairs = [(row["near_edited"], own, other), (row["near_next"], own, beside)]
        for near, a, b in pairs:
            errors.append(near - ratio(a, b))
            if len(a | b) <= sketches.SIZE:
                assert near == pytest.approx(ratio(a, b))
    assert max(map(abs, errors)) < 0.2 and abs(np.mean(errors)) < 0.01


def test_sketches_as_columns_and_merged(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "") for r in docs.collect()}
    prints = sketches.fingerprints(docs)
    whole = {r["g"]: r["fingerprint"] for r in sketches.merge(prints.withColumn("g", F.col("doc_id") % 3), "g").collect()}
    sketch = sketches.Sketcher()
    for g, found in whole.items():
        together = np.unique(np.concatenate([sketch(t.encode()) for d, t in texts.items() if d % 3 == g]))
        assert found == sketches.as_text(together[: sketches.SIZE])
    some = list(texts)[:40]
    pairs = spark.createDataFrame([(texts[a], texts[a] + " " + texts[b]) for a, b in zip(some, some[1:])], "x string, y string").withColumn("doc_id", F.monotonically_increasing_id())
    x = sketches.fingerprints(pairs, "x").withColumnRenamed("fingerprint", "a")
    y = sketches.fingerprints(pairs, "y").withColumnRenamed("fingerprint", "b")
    a, b = F.col("a"), F.col("b")
    rows = x.join(y, "doc_id").join(pairs, "doc_id").select("x", "y", sketches.resemblance(a, b).alias("r"), sketches.containment(a, b).alias("c"), sketches.distinct_shingles(b).alias("n"))
    for row in rows.collect():
        own, all_of = shingles(row["x"]), shingles(row["y"])
        assert abs(row["r"] - ratio(own, all_of)) < 0.2 and row["c"] > 0.6
        assert abs(row["n"] - len(all_of)) <= 0.35 * len(all_of)


def test_fingerprints_of_odd_tables(spark):
    shape = "doc_id long, text string, part string, tail string, hash string, body string"
    rows = [(1, None), (2, ""), (None, "no id here at all"), (None, "another without"), (3, "one"), (3, "one"), (5, "word " * 400_000), (6, "é" * 11)]
    docs = spark.createDataFrame([(d, t, "x", "x", "x", "x") for d, t in rows], shape)
    got = sketches.edit_report(docs).collect()
    assert sorted(r["n_chars"] for r in got) == sorted(len(t or "") for _, t in rows)
    empty = [r for r in got if r["n_chars"] == 0]
    assert len(empty) == 2 and all(r["fingerprint"] == "" for r in empty)
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 3}) == 1
    assert sketches.edit_report(docs.limit(0)).count() == 0
    single = sketches.edit_report(docs.filter("doc_id = 6")).collect()
    assert single[0]["edited_sha256"] == hashlib.sha256(("é" * 11).encode()).hexdigest() and single[0]["near_next"] == 1.0
