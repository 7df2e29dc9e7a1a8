"""Repair of the structure of conversations by depth-first branch-and-bound.

A conversation's rows become one code a row: who speaks, and whether the row may stay. The search
goes through the codes with an explicit stack and finds the cheapest edits after which roles run
`(s?(ua)+)?`; the edits are then applied to the rows as they stream by in order, so that no text
of a conversation is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadshelf.llm.common import SLICE_BYTES, type_of
from threadshelf.plans.lineage import cut

# Fixed value: what a word does not contain.
SPACE = " \t\n\x0b\f\r"
# Roles by their initial; any other is OTHER and can only be changed or deleted.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, TRUNCATED, DELETED = range(3)  # may stay, may stay at a price, has to go
# What has been said before a place: nothing, the system, the user, the assistant.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
# The state after a row by that role, where it may stand.
KEPT = (
    {SYSTEM: AFTER_SYSTEM, USER: AFTER_USER}, {USER: AFTER_USER}, {ASSISTANT: AFTER_ASSISTANT}, {USER: AFTER_USER},
)
# The state after a row whose role can be chosen.
CHOSEN = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
NAMES = {AFTER_USER: "user", AFTER_ASSISTANT: "assistant"}
COMPLETE = (START, AFTER_ASSISTANT)


@dataclass(frozen=True)
class Costs:
    """Prices of the edits. An insertion has to cost something; `truncated` is paid for every
    truncated row that stays, under its own role or another."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def code(role: int, fault: int) -> int:
    return 3 * role + fault


def suffix_bounds(codes: bytes, costs: Costs) -> list[tuple[int, int, int, int]]:
    """For every place and state the least cost of what follows, if it could end anywhere.

    Never more than the true cost, and at most two insertions less.
    """
    bounds = [(0, 0, 0, 0)]
    for one in reversed(codes):
        role, fault = divmod(one, 3)
        later = bounds[-1]
        price = costs.truncated if fault == TRUNCATED else 0
        here = []
        for state in range(4):
            least = later[state] + costs.delete
            if fault != DELETED:
                least = min(least, later[CHOSEN[state]] + costs.rerole + price)
                if role in KEPT[state]:
                    least = min(least, later[KEPT[state][role]] + price)
            here.append(least)
        after_user = min(here[AFTER_USER], costs.insert + here[AFTER_ASSISTANT])
        after_assistant = min(here[AFTER_ASSISTANT], costs.insert + here[AFTER_USER])
        bounds.append(
            (min(here[START], costs.insert + after_user), min(here[AFTER_SYSTEM], costs.insert + after_user), after_user, after_assistant)
        )
    bounds.reverse()
    return bounds


def cheapest_edits(codes: bytes, costs: Costs = Costs()) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, of equally cheap ones that with the least audit.

    The audit has one letter an edit: Delete, Insert, Keep, Rerole. Branches are tried in the
    order of these letters, so prefixes come in their own order: of two that reach the same place
    and state at the same cost the first is better, and one that costs no less than a place and
    state were reached for is dropped. The bounds are at most two insertions short, so the
    incumbent starts there and no place and state is opened more often than that gap has steps.
    """
    if costs.insert < 1:
        raise ValueError("an insertion has to cost at least 1")
    bounds = suffix_bounds(codes, costs)
    n = len(codes)
    incumbent, audit = bounds[0][START] + 2 * costs.insert + 1, None
    dominant = [[incumbent] * 4 for _ in range(n + 1)]
    stack = [(0, START, 0, 0, "")]
    path: list[str] = []
    while stack:
        place, state, cost, depth, letter = stack.pop()
        del path[max(0, depth - 1) :]
        if letter:
            path.append(letter)
        if cost >= dominant[place][state] or cost + bounds[place][state] >= incumbent:
            continue
        dominant[place][state] = cost
        branches = []
        if place == n and state in COMPLETE:
            incumbent, audit = cost, "".join(path)
            continue
        if place < n:
            role, fault = divmod(codes[place], 3)
            branches.append((place + 1, state, cost + costs.delete, depth + 1, "D"))
        branches.append((place, CHOSEN[state], cost + costs.insert, depth + 1, "I"))
        if place < n and fault != DELETED:
            price = cost + (costs.truncated if fault == TRUNCATED else 0)
            if role in KEPT[state]:
                branches.append((place + 1, KEPT[state][role], price, depth + 1, "K"))
            branches.append((place + 1, CHOSEN[state], price + costs.rerole, depth + 1, "R"))
        stack.extend(reversed(branches))
    return incumbent, audit


def role_number(role: str | None) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get((role or "")[:1], OTHER)


LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


class _Conversation:
    """Counts and codes of one conversation, as its entries come in order."""

    def __init__(self, name):
        self.name = name
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last_role = None

    def add(self, turn, role: str, fault: str, n: int, first: bool) -> None:
        number = role_number(role)
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.illegal += (n - 1) + (self.last_role is not None and (self.last_role, number) not in LEGAL)
        self.last_role = number
        if fault == "blank":
            self.blank += n
            self.codes += bytes([code(number, DELETED)]) * n
            return
        again = n - first
        self.duplicate += again
        if first:
            cut_short = fault == "truncated"
            self.truncated += cut_short
            self.codes.append(code(number, TRUNCATED if cut_short else FINE))
        self.codes += bytes([code(number, DELETED)]) * again

    def report(self, costs: Costs) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = cheapest_edits(bytes(self.codes), costs)
        return (self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _fault(text: Column) -> Column:
    """What is wrong with a text on its own: blank, truncated or null."""
    end = F.rtrim(text, F.lit(SPACE))
    return F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")


class Repair:
    """Faults of conversations and the cheapest edits that mend their structure.

    `rows` has (conv_id, turn, role, text) and may have `copies`, how often a row stands there;
    a row with 0 copies only says that its conversation exists. Null roles and texts count as one
    space. Rows go by turn, nulls first, then by role and the MD5 of the text, so that equal rows
    stand together. A null conv_id is a conversation too. Other columns are left out. A
    conversation is one unit: its codes, one byte a row, meet in one task; its texts do not.
    """

    def __init__(self, rows: DataFrame, costs: Costs = Costs()):
        self.costs = costs
        copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
        self.id_type = type_of(rows, "conv_id")
        self.rows = rows.select(
            "conv_id",
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
            copies.cast("long").alias("n"),
        ).withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
        self._report: DataFrame | None = None

    def _entries(self) -> DataFrame:
        """Different rows of a conversation in order, the first of equal texts behind a mark."""
        same = ["conv_id", "turn", "role", "text_key"]
        entries = cut(self.rows.groupBy(*same).agg(F.sum("n").alias("n"), F.max(_fault(F.col("text"))).alias("fault")))
        # a struct's null comes first, as the turn's does
        firsts = (
            entries.where("n > 0")
            .groupBy("conv_id", "role", "text_key")
            .agg(F.min(F.struct("turn")).alias("at"))
            .select("conv_id", "at.turn", "role", "text_key", F.lit(0).cast("long").alias("n"), F.lit("first").alias("fault"))
        )
        both = firsts.withColumn("mark", F.lit(0)).unionByName(entries.withColumn("mark", F.lit(1)))
        return both.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text_key", "mark")

    def report(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation."""
        if self._report is not None:
            return self._report
        costs = self.costs
        schema = f"conv_id {self.id_type}, {REPORT}"
        names = T.StructType.fromDDL(schema).names

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, first = None, False
            for batch in batches:
                done = []
                wanted = ("conv_id", "turn", "role", "n", "fault", "mark")
                for name, turn, role, n, fault, mark in zip(*(batch.column(c).to_pylist() for c in wanted), strict=True):
                    if current is None or current.name != name:
                        if current is not None:
                            done.append(current.report(costs))
                        current, first = _Conversation(name), False
                    if mark == 0:
                        first = True
                    elif n:
                        current.add(turn, role, fault, n, first)
                        first = False
                if done:
                    yield _batch(done, names, batch.schema.field("conv_id").type)
            if current is not None:
                yield _batch([current.report(costs)], names, batch.schema.field("conv_id").type)

        self._report = cut(self._entries().mapInArrow(judge, schema))
        return self._report

    def _edited(self) -> DataFrame:
        """Each conversation's audit, and behind it its rows in order."""
        none = F.lit(None)
        heads = self.report().select(
            "conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"),
            none.cast("binary").alias("text_key"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"),
        )
        rows = self.rows.where("n > 0").withColumn("kind", F.lit(1)).select(heads.columns)
        return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text_key")

    def repaired(self) -> DataFrame:
        """(conv_id, place, edit, role, text): the repaired conversations, places from 1."""
        schema = f"conv_id {self.id_type}, place long, edit string, role string, text string"
        names = T.StructType.fromDDL(schema).names

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = None
            rows, size = [], 0
            for kind, row in _repaired(batches):
                if row[1]:
                    rows.append(row)
                    size += len(row[4])
                if size > SLICE_BYTES or len(rows) > 10_000:
                    yield _batch(rows, names, kind)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, names, kind)

        return self._edited().mapInArrow(apply, schema)

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256) of the repaired `role:text`, joined by line feeds, of every
        conversation; taken as the rows stream by."""
        schema = f"conv_id {self.id_type}, repaired_sha256 string"

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name = sha = kind = None
            done = []
            for kind, (conv, place, _, role, text) in _repaired(batches):
                if place == 0:
                    if sha is not None:
                        done.append((name, sha.hexdigest()))
                    name, sha = conv, hashlib.sha256()
                    if len(done) > 10_000:
                        yield _batch(done, ["conv_id", "repaired_sha256"], kind)
                        done = []
                    continue
                sha.update(("\n" if place > 1 else "").encode() + f"{role}:{text}".encode())
            if sha is not None:
                yield _batch([*done, (name, sha.hexdigest())], ["conv_id", "repaired_sha256"], kind)

        return self._edited().mapInArrow(digest, schema)


def _batch(rows: list[tuple], names: list[str], id_kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    first = pa.array(columns[0], id_kind)
    return pa.RecordBatch.from_arrays([first, *[pa.array(c) for c in columns[1:]]], names=names)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, tuple]]:
    """(type of ids, (conv, place, edit, role, text)): for each conversation a row with place 0,
    then its repaired rows."""
    name = audit = id_kind = None
    at = place = state = 0
    open_ = False

    def inserted(rows: list) -> None:
        """Insertions that stand before the next row."""
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            state = CHOSEN[state]
            at, place = at + 1, place + 1
            rows.append((name, place, "I", NAMES[state], ""))

    for batch in batches:
        id_kind = batch.schema.field("conv_id").type
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            rows: list[tuple] = []
            wanted = ("conv_id", "kind", "role", "text", "n")
            for conv, kind, role, text, n in zip(*(part.column(c).to_pylist() for c in wanted), strict=True):
                if kind == 0:
                    if open_:
                        inserted(rows)
                    name, audit, at, place, state, open_ = conv, text, 0, 0, START, True
                    rows.append((name, 0, "", "", ""))
                    continue
                for _ in range(n):
                    inserted(rows)
                    edit = audit[at]
                    at += 1
                    if edit == "D":
                        continue
                    place += 1
                    if edit == "R":
                        state = CHOSEN[state]
                        rows.append((name, place, "R", NAMES[state], text))
                    else:
                        state = KEPT[state][role_number(role)]
                        rows.append((name, place, "K", role, text))
            for row in rows:
                yield id_kind, row
    if open_:
        rows = []
        inserted(rows)
        for row in rows:
            yield id_kind, row


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with known damage, by the CRC-32 of `conv_id:turn` modulo
    20: 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the
    user's. Nulls count as one space. `copies` says how often a row then stands there."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(said[2]).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said[3], "[.!?]", "")).otherwise(said[3]).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def repair_damaged(rows: DataFrame) -> DataFrame:
    """Reports and digests of the repaired conversations after known damage, one row for every
    conv_id; one that lost all rows has zeros, no edits and the digest of nothing."""
    repair = Repair(cut(damaged(rows)))
    report = repair.report()
    digests = repair.digests().withColumnRenamed("conv_id", "_conv")
    joined = report.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return joined.drop("_conv")
