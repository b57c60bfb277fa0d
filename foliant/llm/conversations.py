"""Repair of conversations: the cheapest edits after which roles read ``(s?(ua)+)?``.

A repaired conversation retains a subsequence of its turns, each as it is or with another role. What stands
between two retained turns follows from their roles: the turns between them are deleted, and a pair of
roles that may not meet takes one inserted turn. So the cheapest script that ends in a retained turn needs
only the cheapest one for each role that the turn before it may have, all turns since then deleted: four
running minima, which deletion raises alike. Scripts of equal cost are ordered by their letters.

Conversations are sorted inside partitions and read as a stream. A turn leaves as soon as all minima agree
on it, so texts are held for a few turns only, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import ASCII_SPACE, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
#: Turns to insert between a retained turn (or the start) and the next one, and after the last one.
BETWEEN = {("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "u"): 1, ("u", "a"): 0, ("a", "u"): 0, ("a", "a"): 1}
AFTER = {"": 0, "s": 2, "u": 1, "a": 0}
#: By how much the first one's script costs more at most, however the conversation goes on, if it takes the second one's place.
INSTEAD = {("u", "a"): 3, ("a", "u"): 3, ("a", "s"): 0, ("u", "s"): 3, ("a", ""): 4, ("u", ""): 7}
MEETS = {"su", "ua", "au"}
#: Bytes of text and rows that a worker hands on at once.
OUT_BYTES, OUT_ROWS = 4_000_000, 20_000


class Script:
    """The cheapest edits of one conversation so far.

    live: for each role (its initial, or '' before any) that the last retained turn may have, the cost and
    the letters since the last turn that is settled; rows: the turns since then.
    """

    def __init__(self) -> None:
        self.live = {"": (0, "")}
        self.rows: deque[tuple] = deque()
        self.forced = 0
        self.last = ""

    def add(self, row: tuple, initial: str, must_go: bool, more: int) -> Iterator[tuple]:
        """Take one turn; ``more`` is what it costs to leave it in. Yields (edit, row, role's initial) of what is settled."""
        self.rows.append(row)
        if must_go:
            self.forced += 1
            return
        self._delete()
        new = {}
        for to in NAMES:
            edit, cost = ("K", KEEP) if initial == to else ("R", REROLE)
            new[to] = min((c + cost + more + INSERT * (k := BETWEEN[at, to]), s + "I" * k + edit) for at, (c, s) in self.live.items())
        if initial == "s" and "" in self.live:
            c, s = self.live[""]
            new["s"] = (c + KEEP + more, s + "K")
        for at, (c, s) in self.live.items():
            gone = (c + DELETE, s + "D")
            new[at] = min(new.get(at, gone), gone)
        self.live = {at: v for at, v in new.items() if not any((y, at) in INSTEAD and new[y][0] + INSTEAD[y, at] < v[0] for y in new)}
        agreed = os.path.commonprefix([s for _, s in self.live.values()])
        if agreed:
            self.live = {at: (c, s[len(agreed) :]) for at, (c, s) in self.live.items()}
            yield from self._settle(agreed)

    def finish(self) -> Iterator[tuple]:
        self._delete()
        _, best = min((c + INSERT * AFTER[at], s + "I" * AFTER[at]) for at, (c, s) in self.live.items())
        yield from self._settle(best)

    def _delete(self) -> None:
        if self.forced:
            gone = "D" * self.forced
            self.live = {at: (c + DELETE * self.forced, s + gone) for at, (c, s) in self.live.items()}
            self.forced = 0

    def _settle(self, edits: str) -> Iterator[tuple]:
        for edit in edits:
            row = None if edit == "I" else self.rows.popleft()
            if edit != "D":
                self.last = row[2][:1] if edit == "K" else "a" if self.last == "u" else "u"
            yield edit, row, self.last


#: An edit: the turn (as it was) or nothing for an inserted one; role and text as they are afterwards, null for a deleted one.
EDITS = "nth long, edit string, turn long, was string, fault string, cost int, role string, text string"


def faults(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) plus ``fault``: the first of blank, duplicate, truncated that holds, or null; and ``seen``.

    Blank: nothing but ASCII white space. Duplicate: role and text stood earlier in the conversation; ``seen``
    counts how often. Truncated: the last character that is no white space is none of .!? Null roles and
    texts are one space; an empty role fits nowhere, as any but system, user and assistant. Order is by turn, null first, then role and text. Other columns are left out.
    Rows are dealt by conversation and stay so.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("text", "role"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text).repartition("conv_id")
    end = F.substring(F.btrim("text", F.lit(ASCII_SPACE)), -1, 1)
    same = ["conv_id", "role", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy(*same).orderBy(F.asc_nulls_first("turn"))) - 1).withColumn("end", end)
    fault = F.when(F.col("end") == "", "blank").when(F.col("seen") > 0, "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), "seen")


def edits(conversations: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation, in order: conv_id and the columns EDITS.

    An edit keeps a turn (K, cost 0), gives it the role user or assistant (R, 3), deletes it (D, 4; blank and
    duplicate turns must go) or inserts a turn without text (I, 3); a truncated turn that stays costs 3 more.
    Afterwards the roles' initials match ``(s?(ua)+)?``; of equally cheap scripts the letters that sort first.

    Turns are faults()' turns, in its order; a null conv_id is one conversation. Rows of one conversation stand
    together and in order in one partition. One task reads a conversation, however long, as a stream. Other
    columns are left out; an empty table gives an empty one.
    """
    rows = faults(conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "seen").drop("seen")
    schema = f"conv_id {kind}, {EDITS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        script, conv, nth, size, kinds = None, None, 0, 0, None

        def put(made: Iterator[tuple]) -> None:
            nonlocal nth, size
            for edit, row, last in made:
                _, turn, was, text, fault = row or (conv, None, None, "", None)
                cost = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if edit in "KR" and fault == "truncated" else 0)
                role, text = (None, None) if edit == "D" else (was if edit == "K" else NAMES[last], text)
                out.append((conv, nth, edit, turn, was, fault, cost, role, text))
                nth += 1
                size += len(text or "")

        def flush() -> pa.RecordBatch:
            nonlocal size
            cols = list(zip(*out, strict=True))
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        names = ["conv_id", *(c.split()[0] for c in EDITS.split(", "))]
        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if script is None or row[0] != conv:
                    if script is not None:
                        put(script.finish())
                    script, conv, nth = Script(), row[0], 0
                fault = row[4]
                must_go = fault in ("blank", "duplicate")
                put(script.add(row[:3] + (None if must_go else row[3],) + row[4:], row[2][:1], must_go, TRUNCATED if fault == "truncated" else 0))
                if size >= OUT_BYTES or len(out) >= OUT_ROWS:
                    yield flush()
        if script is not None:
            put(script.finish())
            if out:
                yield flush()

    return ordered.mapInArrow(run, schema)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def reports(script: DataFrame) -> DataFrame:
    """One row for each conversation of edits()' result, which must be as edits() returns it: conv_id and the columns REPORT.

    gaps: numbers missing between the least and the largest turn; blank, duplicate, truncated: turns with that
    first fault; illegal: neighbouring turns whose roles' initials are none of su, ua, au; cost and audit: the
    edits' costs and letters; repaired_sha256: of the repaired turns as role:text, joined by newline.
    """
    kind = script.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, kinds = None, None, None
        done: list[tuple] = []

        def close() -> None:
            gaps = now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0
            done.append((conv, gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], "".join(now["audit"]), now["hash"].hexdigest()))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["conv_id", *(c.split()[0] for c in REPORT.split(", "))])

        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for c, nth, edit, turn, was, fault, cost, role, text in zip(*batch.to_pydict().values(), strict=True):
                if nth == 0:
                    if now:
                        close()
                    if len(done) >= OUT_ROWS:
                        yield flush()
                    now, conv = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0), c
                    now |= {"first": turn, "last": None, "before": None, "audit": [], "hash": hashlib.sha256(), "any": False}
                now["audit"].append(edit)
                now["cost"] += cost
                if fault:
                    now[fault] += 1
                if edit != "I":
                    now["illegal"] += now["before"] is not None and now["before"] + was[:1] not in MEETS
                    now["before"] = was[:1]
                    if turn is not None and turn != now["last"]:
                        now["first"] = turn if now["last"] is None else now["first"]
                        now["last"] = turn
                        now["turns"] += 1
                if role is not None:
                    now["hash"].update((("\n" if now["any"] else "") + role + ":" + text).encode())
                    now["any"] = True
        if now:
            close()
        if done:
            yield flush()

    return script.mapInArrow(run, f"conv_id {kind}, {REPORT}")


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults put in by crc32 of ``conv_id:turn``, mod 20.

    0 drops the row, 1 empties its text, 2 takes its .!? away, 3 repeats it, 4 makes its role user. A null
    counts as one space. Other columns are left out.
    """
    kept = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = kept.withColumn("fate", F.crc32(key.cast("binary")) % 20).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = reports(edits(damaged(turns))).withColumnRenamed("conv_id", "id")
    every = turns.select("conv_id").distinct()
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    columns = [c.split()[0] for c in REPORT.split(", ")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select("conv_id", *[F.coalesce(F.col(c), F.lit(none.get(c, 0))).alias(c) for c in columns])
