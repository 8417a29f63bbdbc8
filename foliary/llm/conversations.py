"""Repair of the turn structure of conversations at the least cost.

A conversation is well formed when its role initials are nothing, or an optional system turn and then pairs of user and
assistant. Every row is kept, given another role or deleted, and empty turns may be inserted; blank and repeated rows must
go. The cheapest edits are found by depth-first branch and bound: an explicit stack of prefixes, a lower bound of what
the rest must cost, the best whole repair so far (cost, then audit text), and per node (place, state of the grammar) a
table of the best prefix that came there, by which worse ones are dropped. When the stack is empty the best is proved.

Spark deals the rows by conversation and sorts them by turn; a task reads them as a stream. A conversation is searched in
blocks of rows. At the end of a block the tables hold the best prefix of each grammar state, the few that can still win
enter the next block, and what all of them agree on is decided: it is written out and forgotten. A task holds the rows that
are not decided yet: a block or two as a rule, more only where the cheapest start truly depends on the far end (such
as a long run of one role, which pairs up one way or the other by its length).
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliary.llm.common import query

# Edits and their costs, white space, ends of sentences.
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
BLANKS, ENDS = " \t\n\v\f\r", ".!?"
DAMAGES = 20

# States of the grammar: before everything, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FORCED = (USER, USER, ASSISTANT, USER)  # the state after a turn whose role may be chosen
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
CLOSED = (START, ASSISTANT)

# A prefix in one state can act as one in any other at this extra cost at most (system as start: insert a pair, delete a row).
DETOUR = 2 * INSERT + DELETE
BLOCK = 32  # rows that are searched at a time

FAULTS = ("", "truncated", "blank", "duplicate")
GONE, LOST = "d", "blank duplicate".split()


def code(initial: str, fault: str) -> str:
    """One letter for all that the search needs to know of a row: s, u, a, x (any other role), a capital where the text
    is cut short, d where the row must go."""
    if fault in LOST:
        return GONE
    letter = initial if initial in ("s", "u", "a") else "x"
    return letter.upper() if fault == "truncated" else letter


def lower_bounds(rows: str) -> list[int]:
    """What rows[i:] cost at least once the start is past. Every row costs its cheapest edit; two neighbours of one role cost an
    edit more, and no row is counted in two such pairs."""
    bounds, after, free = [0], "", False
    for row in reversed(rows):
        cut, kind = row.isupper(), row.lower()
        if kind == GONE:
            bounds.append(bounds[-1] + DELETE)
            continue
        if kind in "ua":
            least = KEEP + UNFINISHED * cut
        else:
            least = min(REROLE + UNFINISHED * cut, DELETE)
        clash = free and kind in "ua" and after.lower() == kind
        extra = (min(INSERT, DELETE - UNFINISHED) if cut or after.isupper() else min(INSERT, REROLE)) if clash else 0
        bounds.append(bounds[-1] + least + extra)
        after, free = row, not clash
    return bounds[::-1]


def search(rows: str, entries: list[tuple[int, int, str]], last: bool) -> list[tuple[int, int, str, int]]:
    """Best (state, cost, audit, number of its entry) at the end of ``rows``, from prefixes (state, cost, audit) that enter them.

    On the last block only the winner is returned. Before it all prefixes are returned that a later
    block may still turn into the winner. Of two prefixes of a node at one cost neither audit begins the other (they differ
    in inserts alone otherwise, and those cost), so comparing them decides whatever follows.
    """
    size, bounds = len(rows), lower_bounds(rows)
    past = max((i for i, row in enumerate(rows) if row in "sS"), default=-1)  # the last system turn, which the start may keep
    table: dict[tuple[int, int], tuple[int, str, int]] = {}
    best: tuple[int, str] | None = None
    slack = 0 if last else DETOUR

    def at_least(at: int, state: int, cost: int) -> int:
        return cost + bounds[at] - (REROLE if state == START and past >= at else 0)

    stack = [(at_least(0, state, cost), audit, 0, state, cost, number) for number, (state, cost, audit) in enumerate(entries)]
    stack.sort(reverse=True)
    while stack:
        least, audit, at, state, cost, number = stack.pop()
        known = table.get((at, state))
        if known is not None and known[:2] <= (cost, audit):
            continue
        if best is not None and (least > best[0] + slack or (last and least == best[0] and audit > best[1][: len(audit)])):
            continue
        table[at, state] = (cost, audit, number)
        if at == size and (not last or state in CLOSED) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        ways = [("I", cost + INSERT, at, FORCED[state])]
        if at < size:
            row = rows[at]
            ways.append(("D", cost + DELETE, at + 1, state))
            if row != GONE:
                whole = cost + UNFINISHED * row.isupper()
                ways.append(("R", whole + REROLE, at + 1, FORCED[state]))
                if (state, row.lower()) in AFTER:
                    ways.append(("K", whole + KEEP, at + 1, AFTER[state, row.lower()]))
        # What promises the lowest total lies on top, then the smaller letter: the first to come to a node is mostly the best.
        stack.extend(sorted(((at_least(to, reached, total), audit + letter, to, reached, total, number) for letter, total, to, reached in ways), reverse=True))
    ends = [(state, *table[size, state]) for state in range(4) if (size, state) in table]
    if last:
        return [end for end in ends if end[0] in CLOSED and end[1:3] == best]
    return [end for end in ends if end[1] <= best[0] + DETOUR]


def shortened(audits: list[str]) -> list[str]:
    """Short stand-ins for audits that go on: whatever follows, they compare as the audits do. What all share goes, and so does
    all after the letter in which one differs from the rest. An audit that begins others differs from them in inserts, so those
    stay whole."""
    if len(audits) < 2:
        return [""] * len(audits)
    shared = len(os.path.commonprefix(audits))
    rest = [audit[shared:] for audit in audits]
    if "" in rest:
        return rest
    groups: dict[str, list[int]] = {}
    for i, audit in enumerate(rest):
        groups.setdefault(audit[0], []).append(i)
    out = [""] * len(audits)
    for letter, members in groups.items():
        for i, short in zip(members, shortened([rest[i][1:] for i in members])):
            out[i] = letter + short
    return out


@lru_cache(maxsize=50_000)
def repair_of(rows: str) -> tuple[int, str]:
    """(cost, audit) of a conversation that fits a block; most conversations share their pattern with many others."""
    return search(rows, [(START, 0, "")], True)[0][1:3]


class Repair:
    """One conversation as a stream of rows; ``out`` collects the repaired turns as far as they are decided."""

    def __init__(self, block: int = BLOCK):
        self.block, self.rows, self.waiting, self.labels = block, [], [], [(START, 0, "", [])]
        self.count, self.illegal, self.turns, self.first, self.last, self.before = dict.fromkeys(FAULTS, 0), 0, 0, None, None, None
        self.audit, self.state, self.out = [], START, []

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        self.count[fault] += 1
        self.illegal += self.before is not None and (self.before, initial) not in LEGAL
        self.before = initial
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        if len(self.rows) == self.block:
            self._advance()
        self.rows.append(code(initial, fault))
        self.waiting.append((role, text))

    def _advance(self) -> None:
        ends = search("".join(self.rows), [(state, cost, short) for state, cost, short, _ in self.labels], False)
        parts = [self.labels[number][3] + [audit[len(self.labels[number][2]) :]] for _, _, audit, number in ends]
        agreed = 0
        while agreed < len(parts[0]) and all(p[agreed] == parts[0][agreed] for p in parts):
            agreed += 1
        self._decide("".join(parts[0][:agreed]))
        short = shortened([audit for _, _, audit, _ in ends])
        self.labels = [(end[0], end[1], s, part[agreed:]) for end, s, part in zip(ends, short, parts)]
        self.rows = []

    def _decide(self, edits: str) -> None:
        used = 0
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.waiting[used]
            used += edit != "I"
            if edit == "D":
                continue
            self.state = AFTER[self.state, role[:1]] if edit == "K" else FORCED[self.state]
            self.out.append((edit, role if edit == "K" else NAMES[self.state], text))
        del self.waiting[:used]
        self.audit.append(edits)

    def finish(self) -> dict:
        rows = "".join(self.rows)
        if self.labels == [(START, 0, "", [])] and not self.audit:
            cost, audit = repair_of(rows)
        else:
            _, cost, audit, number = search(rows, [label[:3] for label in self.labels], True)[0]
            _, _, short, parts = self.labels[number]
            audit = "".join(parts) + audit[len(short) :]
        self._decide(audit)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {
            "gaps": gaps, "blank": self.count["blank"], "duplicate": self.count["duplicate"], "truncated": self.count["truncated"],
            "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit),
        }


def damage(turns: DataFrame) -> DataFrame:
    """Damage every row by the CRC-32 of ``conv_id:turn``; nulls in that key, in roles and in texts count as one space.

    A dropped row stays as a mark (``alive`` false, no text), so its conversation is not forgotten. Extra columns go.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        (F.crc32(key.cast("binary")) % DAMAGES).alias("damage"),
    )
    text = F.when(F.col("damage") <= 1, "").when(F.col("damage") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("damage") != 0).alias("alive"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )


def find_faults(rows: DataFrame) -> DataFrame:
    """Add ``fault``, the first that holds of blank, duplicate and truncated (else empty), and ``nth``, which orders equal rows.

    Earlier rows are those of smaller (turn, nulls first; role; text). Copies are numbered by (conversation, role, text), so
    the rows of a long conversation are spread over tasks; blank rows and marks need no number and are spread by their turn.
    """
    ending = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.withColumn("blank", ending == "").withColumn("ended", F.substring(ending, -1, 1).isin(*ENDS))
    apart = F.when(F.col("blank"), F.struct("turn", "alive"))
    same = W.partitionBy("conv_id", "role", "text", apart).orderBy(F.col("turn").asc_nulls_first(), "copy")
    fault = F.when(F.col("blank"), "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("ended"), "truncated").otherwise("")
    return rows.withColumn("nth", F.row_number().over(same)).withColumn("fault", fault).drop("blank", "ended", "copy")


def by_conversation(rows: DataFrame) -> DataFrame:
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text", "nth"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "alive", "fault")


class Conversations:
    """The conversations of a sorted stream of rows: calls ``turns(conv_id, [(edit, role, text)])`` as turns are decided, and
    ``report(conv_id, facts)`` at the end of each conversation."""

    def __init__(self, turns, report, block: int = BLOCK):
        self.turns, self.report, self.block, self.repair, self.conv_id = turns, report, block, None, None

    def read(self, batch: pa.RecordBatch) -> None:
        for conv_id, turn, role, text, alive, fault in zip(*(column.to_pylist() for column in batch.columns)):
            if self.repair is None or conv_id != self.conv_id:
                self.close()
                self.repair, self.conv_id = Repair(self.block), conv_id
            if alive:
                self.repair.add(turn, role, text, fault)
                self._hand_over()

    def _hand_over(self) -> None:
        if self.repair.out:
            self.turns(self.conv_id, self.repair.out)
            self.repair.out = []

    def close(self) -> None:
        if self.repair is not None:
            facts = self.repair.finish()
            self._hand_over()
            self.report(self.conv_id, facts)
            self.repair = None


REPORT = pa.schema(
    [(name, pa.string() if name in ("audit", "repaired_sha256") else pa.int64()) for name in "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()]
)
TURNS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def repair_report(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of rows with faults (:func:`find_faults`): gaps in the turns, faults, illegal neighbours, cost
    and audit of the cheapest repair, and the SHA-256 of the repaired turns as ``role:text`` lines.

    Rows without a conversation form one. A conversation without rows has zeros, no audit and the hash of nothing; an empty table
    gives no rows. The text of a repaired conversation is hashed as it is decided and never held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, sha, started = [], hashlib.sha256(), False

        def turns(conv_id, decided):
            nonlocal started
            for _, role, text in decided:
                sha.update((f"\n{role}:{text}" if started else f"{role}:{text}").encode())
                started = True

        def report(conv_id, facts):
            nonlocal sha, started
            done.append({"conv_id": conv_id, **facts, "repaired_sha256": sha.hexdigest()})
            sha, started = hashlib.sha256(), False

        stream = Conversations(turns, report, block)
        for batch in batches:
            stream.read(batch)
            yield pa.RecordBatch.from_pylist(done, schema=REPORT)
            done.clear()
        stream.close()
        yield pa.RecordBatch.from_pylist(done, schema=REPORT)

    fields = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return by_conversation(rows).mapInArrow(run, fields)


def repaired_turns(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired conversations as rows: (conv_id, position from 0, edit, role, text), edit being K, R or I."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, at = [], 0

        def turns(conv_id, decided):
            nonlocal at
            for edit, role, text in decided:
                done.append({"conv_id": conv_id, "position": at, "edit": edit, "role": role, "text": text})
                at += 1

        def report(conv_id, facts):
            nonlocal at
            at = 0

        stream = Conversations(turns, report, block)
        for batch in batches:
            stream.read(batch)
            yield pa.RecordBatch.from_pylist(done, schema=TURNS)
            done.clear()
        stream.close()
        yield pa.RecordBatch.from_pylist(done, schema=TURNS)

    return by_conversation(rows).mapInArrow(run, "conv_id long, position long, edit string, role string, text string")


# Prefixes by (rows taken, state), and per node the least (cost, audit): the same optimum by dynamic programming.
SQL = """
WITH RECURSIVE bits(byte, step, c) AS (
    SELECT range, 0, range::BIGINT FROM range(256)
    UNION ALL SELECT byte, step + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE step < 8
),
crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE step = 8),
source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS damage
    FROM conversations, crc
),
damaged AS (
    SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN damage = 1 THEN '' WHEN damage = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN damage = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM source WHERE damage <> 0
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ending
    FROM damaged
),
faulty AS (
    SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN right(ending, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
    FROM placed
),
facts AS (
    SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
        count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
),
inserts(q, reached, cost, letters) AS (VALUES
    (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
edits(letter, q, initial, reached, cost) AS (
    VALUES ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 2, 'a', 3, 0), ('K', 3, 'u', 2, 0), ('R', 0, '*', 2, 3), ('R', 1, '*', 2, 3), ('R', 2, '*', 3, 3),
        ('R', 3, '*', 2, 3), ('D', 0, '*', 0, 4), ('D', 1, '*', 1, 4), ('D', 2, '*', 2, 4), ('D', 3, '*', 3, 4)),
moves AS (SELECT letter, e.q, initial, i.reached, e.cost + i.cost AS cost, letter || letters AS letters FROM edits e JOIN inserts i ON e.reached = i.q),
best(conv_id, i, q, label) AS (
    SELECT conv_id, 0::BIGINT, reached, {'cost': cost, 'audit': letters} FROM facts, inserts WHERE q = 0
    UNION ALL
    SELECT b.conv_id, b.i + 1, m.reached, min({'cost': b.label.cost + m.cost + CASE WHEN r.fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END, 'audit': b.label.audit || m.letters})
    FROM best b JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1
        JOIN moves m ON m.q = b.q AND (m.initial = '*' OR m.initial = left(r.role, 1)) AND (letter = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
    GROUP BY b.conv_id, b.i + 1, m.reached
),
repaired AS (
    SELECT f.conv_id, min(label) AS label FROM best b JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.i WHERE q IN (0, 3) GROUP BY f.conv_id
),
letters AS (SELECT conv_id, unnest(string_split(label.audit, '')) AS letter, unnest(range(1, strlen(label.audit) + 1)) AS nth FROM repaired WHERE label.audit <> ''),
steps AS (
    SELECT *, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY nth)
),
turns AS (
    SELECT s.conv_id, nth, letter, place, r.role, CASE WHEN letter = 'I' THEN '' ELSE r.text END AS text,
        bool_or(letter = 'K' AND place = 1 AND left(r.role, 1) = 's') OVER (PARTITION BY s.conv_id) AS led
    FROM steps s LEFT JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i WHERE letter <> 'D'
),
hashed AS (
    SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || text, chr(10) ORDER BY nth)) AS h
    FROM turns GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(label.cost, 0)::BIGINT AS cost,
    coalesce(label.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op11_conversation_repair", SQL)
def _conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_report(find_faults(damage(spark.read.parquet(f"{folder}/conversations.parquet"))))
