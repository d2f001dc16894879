"""Repair of the role structure of conversations, by a dynamic programme over retained turns.

Which turns are kept or given another role is chosen turn by turn. The state is the last retained role; what lies between two
retained turns is deleted, and the pair of their roles says which empty turns have to be inserted. Costs are held less the
prefix sum of deletions, so that a turn passed over changes nothing and each state keeps a running minimum; equal costs are
settled by the edits' initials in order, where deletions come before insertions.

Conversations are repartitioned by id and sorted; the programme streams over their turns with at most four states, each with
its cost, the hash so far and those last edits in which the states still differ. Faults that need other turns of the
conversation come from a window over the same partitioning. A conversation is one sequence with one hash, so the turns of one are
worked through in one task, never held there.

Nulls: a null conv_id is a conversation of its own, null turns come first, null roles and texts count as one space. An empty role
can't be kept. Turns of
equal number are ordered by role and text; rows that repeat are duplicates. An empty table gives no rows. Columns besides
conv_id, turn, role, text aren't looked at.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_SPACE = " \t\n\v\f\r"
#: Turns to insert between the last retained role ("": none yet) and the next one ("": the end).
_BETWEEN = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "a"): "", ("u", "u"): "a", ("a", "u"): "", ("a", "a"): "u", ("", ""): "", ("s", ""): "ua", ("u", ""): "a", ("a", ""): ""}
_ROLE = {"u": "user", "a": "assistant"}
#: A state that costs so much more than another can't win: inserting two turns or deleting one and inserting one bridges them.
_HOPELESS = 10


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0: dropped) after damage by crc32(conv_id:turn) mod 20."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(how == 4, "user").otherwise(text_of("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"))


def _fault(text: Column, nth: Column) -> Column:
    """0 none, 1 blank, 2 duplicate, 3 truncated: the first that holds. nth: of the equal turns of the conversation."""
    solid = F.expr(f"rtrim('{_SPACE}', text)")
    return F.when(solid == "", 1).when(nth > 1, 2).when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)


class Repair:
    """The programme over one conversation; turns come in order."""

    def __init__(self) -> None:
        self.settled: list[str] = []  # edits on which all states agree
        #: By last retained role: cost less all deletions so far, edits, turns these cover, hash of the repaired lines.
        self.states: dict[str, tuple[int, str, int, object]] = {"": (0, "", 0, None)}
        self.seen = self.base = 0
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.low = self.high = self.turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int) -> None:
        if turn is not None:
            self.low, self.high = (turn, turn) if self.low is None else (self.low, turn)
            self.turns, self.turn = self.turns + (turn != self.turn), turn
        for k in range(copies):
            f = fault if not k or fault == 1 else 2
            self.faults[f] += 1
            self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
            self.last = role[:1]
            self._turn(role, text, f)

    def _turn(self, role: str, text: str, fault: int) -> None:
        if fault not in (1, 2):
            extra = TRUNCATED if fault == 3 else 0
            choices = [(role[:1], "K", KEEP, role)] if role[:1] in ("s", "u", "a") else []
            choices += [(r, "R", REROLE, name) for r, name in _ROLE.items() if r != role[:1]]
            found: dict[str, tuple] = {}
            for to, edit, price, name in choices:
                for state, (cost, edits, upto, digest) in self.states.items():
                    if (state, to) not in _BETWEEN:
                        continue
                    inserted = _BETWEEN[state, to]
                    new = cost + price + extra - DELETE + INSERT * len(inserted)  # less the deletion that all others pay for this turn
                    mine = edits + "D" * (self.seen - upto) + "I" * len(inserted) + edit
                    if to not in found or (new, mine) < found[to][:2]:
                        found[to] = (new, mine, digest, inserted, name)
            for to, (new, mine, digest, inserted, name) in found.items():
                old = self.states.get(to)
                if old is None or (new, mine) < (old[0], old[1] + "D" * (self.seen + 1 - old[2])):
                    found[to] = (new, mine, self.seen + 1, _with(digest, inserted, f"{name}:{text}"))
                else:
                    found[to] = old
            self.states |= found
        self.seen += 1
        least = min(s[0] for s in self.states.values())
        if len(self.states) > 1:
            self.states = {r: s for r, s in self.states.items() if s[0] <= least + _HOPELESS}
        if not self.seen % 64:
            self._settle()

    def _settle(self) -> None:
        """Edits common to all states move to the settled ones."""
        padded = {r: edits + "D" * (self.seen - upto) for r, (_, edits, upto, _) in self.states.items()}
        n = len(os.path.commonprefix(list(padded.values())))
        self.settled.append(next(iter(padded.values()))[:n])
        self.states = {r: (s[0], padded[r][n:], self.seen, s[3]) for r, s in self.states.items()}

    def row(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        ends = []
        for state, (cost, edits, upto, digest) in self.states.items():
            inserted = _BETWEEN[state, ""]
            ends.append((cost + DELETE * self.seen + INSERT * len(inserted), edits + "D" * (self.seen - upto) + "I" * len(inserted), digest, inserted))
        cost, edits, digest, inserted = min(ends, key=lambda e: e[:2])
        digest = _with(digest, inserted) or hashlib.sha256()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.faults[1:], self.illegal, cost, "".join(self.settled) + edits, digest.hexdigest())


def _with(digest, inserted: str, *lines: str):
    """The hash with empty turns of the inserted roles and then the lines added."""
    for line in (*(f"{_ROLE[r]}:" for r in inserted), *lines):
        if digest is None:
            digest = hashlib.sha256()
        else:
            digest = digest.copy()
            digest.update(b"\n")
        digest.update(line.encode())
    return digest


def repair(conversations: DataFrame) -> DataFrame:
    """A row per conversation after damage: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Conversations without a turn left have zeros, an empty audit and the hash of the empty text.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turns = damaged(conversations).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("copies") == 0, F.col("turn").asc_nulls_first()))
    judged = turns.withColumn("fault", _fault(F.col("text"), nth)).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "fault")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now: Repair | None = None
        current = None
        for batch in batches:
            for conv, turn, role, text, copies, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "fault"))):
                if now is None or conv != current:
                    if now is not None:
                        rows.append((current, *now.row()))
                    now, current = Repair(), conv
                if copies:
                    now.add(turn, role, text, copies, fault)
            if len(rows) > 4096:
                yield table(rows, batch.schema.field("conv_id").type)
                rows = []
        if now is not None:
            rows.append((current, *now.row()))
            yield table(rows, batch.schema.field("conv_id").type)

    def table(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (id_type, *[pa.int64()] * 6, pa.string(), pa.string()))], names=_COLUMNS)

    return judged.mapInArrow(work, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


_COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
