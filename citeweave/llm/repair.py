"""Conversation structure repair: the cheapest edits that make turns alternate, with their audit.

A repaired conversation's roles follow ``(s?(ua)+)?`` (initials of system, user, assistant).  Every turn is kept
(K, 0), given the other speaker (R, 2) or deleted (D, 3); an empty turn may be inserted before any turn and at the
end (I, 2).  Blank and duplicate turns have to go; a truncated turn that stays adds 1.  Of the cheapest edits the one
whose letters come first in ASCII is taken.

Method: scalar big-integer weights.  A path through the conversation is one integer: its high digits are the cost,
its low digits the letters.  Each turn owns a slot of two base-5 digits at a fixed position (D 1, I 2, K 3, R 4, an
unused last digit 0), as a turn takes one of D, ID, IK, IR, K, R.  No such code begins another, so integers compare
as (cost, audit) does, and an ordinary minimum over the four states (nothing yet, system, user, assistant) decides
both at once.  Two inserts in one place are never cheapest: without them the roles still follow the pattern, or
deleting the lone system turn costs less.

Scale: slots are counted in windows of 64 turns.  At a window's end only the order of the four paths matters, so
their letters are replaced by their rank, the integers stay short and work and memory grow as the turns do.
A conversation's turns come sorted from Spark's disk-backed shuffle, first as facts (no texts; 5 bytes each are
kept), then with their texts, which pass through one at a time: a conversation of any length takes one batch of
texts.  Its digest and its audit are one sequence each, so that one task reads it; nothing is held in groups.
Copies of a turn are found by a window over digests of (conversation, role, text).

Cases: a null role or text counts as one space; turns are ordered by (turn, role, digest of role and text), null
turns first; repeated rows are turns of their own, all but the first duplicates; null conversation ids are one
conversation; an empty role has an empty initial, which is in no legal pair.  Other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized

SPACE = " \t\n\x0b\f\r"
ENDINGS = (".", "!", "?")
SPEAKERS = {"u": "user", "a": "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
OPTIONS = ("D", "ID", "IK", "IR", "K", "R")
START, SYSTEM, USER, ASSISTANT = range(4)
TURN_OF = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}       # the speaker that may come next
INITIAL = {USER: "u", ASSISTANT: "a"}
WINDOW = 64                                                                   # turns whose letters one integer holds
TOP = 25 ** WINDOW                                                            # above the slots: rank, then cost
SCALE = 4 * TOP
ROWS_IN_TASK = 200_000
BATCH = 1024
REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
REPORT_TYPE = pa.struct([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in REPORT.split(", ")])


def after(state: int, initial: str, letter: str) -> int | None:
    """The state that a letter leads to, or None."""
    if letter == "D":
        return state
    if letter == "K" and initial == "s":
        return SYSTEM if state == START else None
    if letter == "K" and initial != INITIAL[TURN_OF[state]]:
        return None
    return TURN_OF[state]


def moves(initial: str, fault: str) -> list[list[tuple[int, int, int]]]:
    """For every state: (next state, cost, option) of what can be done with a turn."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(4)]
    for state in range(4):
        for k, option in enumerate(OPTIONS):
            letter = option[-1]
            if fault in ("blank", "duplicate") and letter != "D":
                continue
            to = after(TURN_OF[state] if len(option) > 1 else state, initial, letter)
            if to is not None:
                out[state].append((to, sum(COST[x] for x in option) + (fault == "truncated" and letter != "D"), k))
    return out


SLOT = [5 * DIGIT[o[0]] + (DIGIT[o[1]] if len(o) > 1 else 0) for o in OPTIONS]
PLACE = [25 ** (WINDOW - 1 - j) for j in range(WINDOW)]
MOVES = {(i, f): moves(i, f) for i in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}


class Conversation:
    """The paths through the turns of one conversation seen so far, and its counts."""

    def __init__(self) -> None:
        self.best: list[int | None] = [0, None, None, None]
        self.came = bytearray()                 # for each turn and state: option and state before
        self.n = self.illegal = self.distinct = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = self.initial = None

    def add(self, turn: int | None, role: str, fault: str) -> None:
        initial = role[:1]
        if self.n and (self.initial, initial) not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if fault:
            self.faults[fault] += 1
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        place = PLACE[self.n % WINDOW]
        new: list[int | None] = [None] * 4
        came = [255] * 4
        for state, options in enumerate(MOVES[initial if initial in ("s", "u", "a") else "", fault]):
            if (at := self.best[state]) is None:
                continue
            for to, cost, k in options:
                value = at + cost * SCALE + SLOT[k] * place
                if new[to] is None or value < new[to]:
                    new[to], came[to] = value, 4 * k + state
        self.best = new
        self.came.extend(came)
        self.n += 1
        if self.n % WINDOW == 0:                # letters become ranks: only their order counts from here on
            rank = {v: r for r, v in enumerate(sorted(v % SCALE for v in new if v is not None))}
            self.best = [None if v is None else v // SCALE * SCALE + rank[v % SCALE] * TOP for v in new]

    def finish(self) -> tuple[int, list[str], bool]:
        """Cost, the option of every turn, and whether a turn is inserted at the end."""
        ends = [(v * 5, s) for s in (START, ASSISTANT) if (v := self.best[s]) is not None]
        if (v := self.best[USER]) is not None:
            ends.append(((v + COST["I"] * SCALE) * 5 + DIGIT["I"], USER))
        value, state = min(ends)
        insert, options = state == USER, []
        for i in range(self.n - 1, -1, -1):
            k, state = divmod(self.came[4 * i + state], 4)
            options.append(k)
        return value // 5 // SCALE, [OPTIONS[k] for k in reversed(options)], insert

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.distinct


def facts(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text without nulls, digest) as facts: fault, and no text."""
    ending = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    copies = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first()))
    narrow = rows.select("conv_id", "turn", "role", "digest", ending.alias("ending")).withColumn("copy", copies)
    return narrow.select("conv_id", "turn", "role", "digest", "copy",
                         F.when(F.col("ending") == "", "blank").when(F.col("copy") > 1, "duplicate")
                         .when(~F.col("ending").isin(*ENDINGS), "truncated").otherwise("").alias("fault"))


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, edit, turn, role, text, report: a conversation's edits in order, a row for each letter, and after them
    one row whose edit is null and whose report has gaps, blank, duplicate, truncated, illegal, cost and audit.

    ``turns`` has conv_id, turn, role and text; ``conversations`` (conv_id) names conversations to report on, which
    may have no turns.  The repaired conversation is its rows with edit K, R or I.  Rows come partitioned by
    conversation and in order within a partition."""
    kind, order = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn(
        "digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))

    def null(t: str) -> Column:
        return F.lit(None).cast(t)
    ids = (turns if conversations is None else conversations).select("conv_id").distinct()
    heads = ids.select("conv_id", F.lit(0).alias("part"), null(order).alias("turn"), null("string").alias("role"),
                       null("string").alias("digest"), null("int").alias("copy"), null("string").alias("fault"), null("string").alias("text"))
    known = facts(rows).select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "copy", "fault", null("string").alias("text"))
    texts = rows.select("conv_id", F.lit(2).alias("part"), "turn", "role", "digest", null("int").alias("copy"), null("string").alias("fault"), "text")
    n = sized(turns.sparkSession, turns.count(), ROWS_IN_TASK)
    stream = heads.unionByName(known).unionByName(texts).repartition(n, "conv_id") \
        .sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "digest", "copy")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        types: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], types[0]), pa.array(cols[1], pa.string()), pa.array(cols[2], types[1]),
                 pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array(cols[5], REPORT_TYPE)],
                names=["conv_id", "edit", "turn", "role", "text", "report"])

        def end() -> None:
            if insert:
                out.append((conv_id, "I", None, SPEAKERS["a"], "", None))
            out.append((conv_id, None, None, None, None, {
                "gaps": talk.gaps(), **talk.faults, "illegal": talk.illegal, "cost": cost,
                "audit": "".join(options) + "I" * insert}))

        conv_id, talk, options, cost, insert, at, state = None, None, None, 0, False, 0, START
        for b in batches:
            types = [b.schema.field("conv_id").type, b.schema.field("turn").type]
            for r in b.to_pylist():
                if talk is None or r["conv_id"] != conv_id:
                    if talk is not None:
                        if options is None:
                            cost, options, insert = talk.finish()
                        end()
                    conv_id, talk, options, at, state, insert = r["conv_id"], Conversation(), None, 0, START, False
                if r["part"] == 1:
                    talk.add(r["turn"], r["role"], r["fault"])
                elif r["part"] == 2:
                    if options is None:
                        cost, options, insert = talk.finish()
                    option = options[at]
                    at += 1
                    if len(option) > 1:
                        state = TURN_OF[state]
                        out.append((conv_id, "I", None, SPEAKERS[INITIAL[state]], "", None))
                    state = after(state, r["role"][:1], option[-1])
                    said = SPEAKERS[INITIAL[state]] if option[-1] == "R" else r["role"]
                    out.append((conv_id, option[-1], r["turn"], said, r["text"], None))
                if len(out) >= BATCH:
                    yield flush()
        if talk is not None:
            if options is None:
                cost, options, insert = talk.finish()
            end()
        if out:
            yield flush()
    return stream.mapInArrow(edited, f"conv_id {kind}, edit string, turn {order}, role string, text string, report struct<{REPORT}>")


def read_back(repaired: DataFrame) -> DataFrame:
    """conv_id, the report's columns and repaired_sha256 (``role:text`` of the repaired turns, newline-joined) of every
    conversation, in one pass over the rows of ``repair`` as they come."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    names = [c.split()[0] for c in REPORT.split(", ")]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, begun = hashlib.sha256(), False
        for b in batches:
            ids, shas, reports = [], [], []
            for conv_id, edit, role, text, report in zip(*(b.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text", "report")),
                                                         strict=True):
                if edit is None:
                    ids.append(conv_id)
                    shas.append(running.hexdigest())
                    reports.append(report)
                    running, begun = hashlib.sha256(), False
                elif edit != "D":
                    running.update((("\n" if begun else "") + f"{role}:{text}").encode())
                    begun = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field("conv_id").type),
                 *[pa.array([r[c] for r in reports], REPORT_TYPE.field(c).type) for c in names], pa.array(shas, pa.string())],
                names=["conv_id", *names, "repaired_sha256"])
    return repaired.mapInArrow(digests, f"conv_id {kind}, {REPORT}, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Faults planted by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    sentence ends away, 3 repeats it, 4 gives it to the user; nulls become one space first."""
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    d = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("k")).filter("k <> 0")
    return d.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))).alias("_c")).drop("_c")
