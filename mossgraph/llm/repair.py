"""Conversation structure repair by the cheapest edits, on a bidirectional tight-arc DAG.

A conversation is well formed if the initials of its roles match (s?(ua)+)?.  Rows may be kept (0), get another role (2) or
be deleted (3), and rows without text may be put in anywhere (2); blank rows and copies have to go, and a truncated row that
stays adds 1.  Nodes of the DAG are a row's place and what the repaired rows before it end with (nothing, s, u or a); arcs
are edits.  Minimum costs from the front and from the back tell which arcs lie on a cheapest path (tight arcs: both costs and
their own make up the optimum).  The least of all cheapest edit strings comes from walking frontiers: all nodes that the
letters so far can reach, and of the tight arcs that leave them those with the least letter.

Spark does the grouping: faults are columns, the first of several equal rows of a conversation is found by an aggregate, and
each conversation's rows come to one task twice in one sorted stream, first without text for the search, then those that
aren't blank with theirs for the digest (SHA-256 has to see them in order).  So a task holds some thirty bytes for each row of
one conversation (the audit cell has a letter for each), and never its texts.

Defined results: rows are ordered by turn (nulls first), then role, then the text's digest; null roles and texts are one
space, so such rows are blank or have a foreign role; the null conv_id is a conversation of its own; repeated rows are
copies; an empty table gives an empty table; further columns are left out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, for_python, hot_limit, shuffle_partitions, skew_safe_lookup, tidy

#: Faults of a row in the order in which they are looked for, and their codes.
FAULTS = {"none": 0, "blank": 1, "duplicate": 2, "truncated": 3}
#: What repaired rows end with; from each, the next by the initial of a row.
NOTHING, S, U, A = range(4)
NEXT = {"s": {NOTHING: S}, "u": {NOTHING: U, S: U, A: U}, "a": {U: A}}
FINAL = (NOTHING, A)
#: Costs of edits, and of leaving a truncated row.
KEEP, REROLE, DELETE, INSERT, LEFT = 0, 2, 3, 2, 1
FAR = 1 << 20
#: The role that a row gets if repaired rows end with this one after it.
ROLES = {U: "user", A: "assistant"}


# -- damage, for trying repairs


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: rows damaged by crc32(conv_id:turn) % 20, those that drop out with ``there`` false."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), F.explode(times).alias("time")).drop("time")


# -- the DAG of one conversation


def _stepped(costs: list[int], code: int) -> list[int]:
    """Least costs after a row, from those before it; code: fault + 4 * initial."""
    fault, initial = code & 3, code >> 2
    if fault in (1, 2):
        return [c + DELETE for c in costs]
    left = LEFT if fault == 3 else 0
    new = [c + DELETE for c in costs]
    for to, frm in ((U, (NOTHING, S, A)), (A, (U,))):
        new[to] = min(new[to], min(costs[f] for f in frm) + REROLE + left)
    for frm, to in NEXT.get("sua"[initial - 1] if initial else "", {}).items():
        new[to] = min(new[to], costs[frm] + KEEP + left)
    return new


def _inserted(costs: list[int]) -> list[int]:
    """Least costs with rows put in: from nothing or s or a to u, from u to a."""
    u = min(costs[U], min(costs[NOTHING], costs[S], costs[A]) + INSERT)
    return [costs[NOTHING], costs[S], u, min(costs[A], u + INSERT)]


def _before(costs: list[int], code: int) -> list[int]:
    """Least costs to the end from before a row, from those after it."""
    fault, initial = code & 3, code >> 2
    new = [c + DELETE for c in costs]
    if fault not in (1, 2):
        left = LEFT if fault == 3 else 0
        for frm in range(4):
            new[frm] = min(new[frm], costs[A if frm == U else U] + REROLE + left)
        for frm, to in NEXT.get("sua"[initial - 1] if initial else "", {}).items():
            new[frm] = min(new[frm], costs[to] + KEEP + left)
    return _could_insert(new)


def _could_insert(costs: list[int]) -> list[int]:
    """Least costs to the end if rows may be put in first."""
    a = min(costs[A], costs[U] + INSERT)
    u = min(costs[U], a + INSERT)
    return [min(costs[NOTHING], u + INSERT), min(costs[S], u + INSERT), u, min(a, u + INSERT)]


def repaired(codes: bytes) -> tuple[int, str, bytearray]:
    """Cost, the ASCII-least audit of the cheapest repairs, and for each of its letters what the repaired rows end with.

    codes: a byte for each row, fault + 4 * initial (1 s, 2 u, 3 a, 0 another).  The forward and the backward costs of a
    place differ by little between nodes, so a byte each and one running base hold them."""
    n = len(codes)
    forward, base = np.zeros((n + 1, 4), dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    costs, total = _inserted([0, FAR, FAR, FAR]), 0
    for k in range(n + 1):
        least = min(costs)
        total += least
        costs = [min(c - least, 255) if c < FAR else FAR for c in costs]
        base[k] = total
        forward[k] = [min(c, 255) for c in costs]
        if k < n:
            costs = _inserted(_stepped(costs, codes[k]))
    back, after = np.zeros((n + 1, 4), dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    costs, total = _could_insert([0, FAR, FAR, 0]), 0
    for k in range(n, -1, -1):
        least = min(costs)
        total += least
        costs = [min(c - least, 255) if c < FAR else FAR for c in costs]
        after[k] = total
        back[k] = [min(c, 255) for c in costs]
        if k:
            costs = _before(costs, codes[k - 1])
    optimum = int(after[0]) + int(back[0][NOTHING])

    def tight(k: int, frm: int, cost: int, j: int, to: int) -> bool:
        if forward[k][frm] == 255 or back[j][to] == 255:
            return False
        return int(base[k]) + int(forward[k][frm]) + cost + int(after[j]) + int(back[j][to]) == optimum

    letters, ends = bytearray(), bytearray()
    k, frontier = 0, {NOTHING}
    while True:
        done = k == n and any(f in FINAL and int(base[k]) + int(forward[k][f]) == optimum for f in frontier)
        if done:
            break
        fault, initial = (codes[k] & 3, codes[k] >> 2) if k < n else (0, 0)
        left = LEFT if fault == 3 else 0
        after_letter: dict[str, set[int]] = {}
        for f in frontier:
            to = A if f == U else U
            if tight(k, f, INSERT, k, to):
                after_letter.setdefault("I", set()).add(to)
            if k == n:
                continue
            if tight(k, f, DELETE, k + 1, f):
                after_letter.setdefault("D", set()).add(f)
            if fault in (1, 2):
                continue
            kept = NEXT.get("sua"[initial - 1] if initial else "", {}).get(f)
            if kept is not None and tight(k, f, KEEP + left, k + 1, kept):
                after_letter.setdefault("K", set()).add(kept)
            if tight(k, f, REROLE + left, k + 1, to):
                after_letter.setdefault("R", set()).add(to)
        letter = min(after_letter)
        frontier = after_letter[letter]
        k += letter != "I"
        letters += letter.encode()
        ends.append(sum(1 << f for f in frontier))
    # Rows that stay alternate, so what they end with follows from the letters: s only where a row with s is kept first.
    at, own, k = NOTHING, bytearray(), 0
    for letter in letters.decode():
        if letter == "K":
            at = {1: S, 2: U, 3: A}[codes[k] >> 2]
        elif letter in "RI":
            at = A if at == U else U
        k += letter != "I"
        own.append(at)
    return optimum, letters.decode(), own


class _Conversation:
    """What one conversation's stream has brought so far: rows without text, then those that may stay with theirs."""

    def __init__(self):
        self.codes, self.counts = bytearray(), [0, 0, 0, 0]
        self.first = self.last = self.initial = None
        self.turns = self.illegal = 0
        self.known = None  # cost, audit, what repaired rows end with
        self.digest, self.at, self.row, self.some = hashlib.sha256(), 0, 0, False

    def light(self, turn, role: str, fault: int) -> None:
        initial = role[:1]
        self.counts[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.codes.append(fault + 4 * ("sua".find(initial) + 1 if initial else 0))

    def solve(self) -> None:
        if self.known is None:
            self.known = repaired(bytes(self.codes))

    def line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True

    def inserts(self) -> None:
        _, audit, ends = self.known
        while self.at < len(audit) and audit[self.at] == "I":
            self.line(ROLES[ends[self.at]], "")
            self.at += 1

    def rows_until(self, stop: int) -> None:
        """Pass over blank rows, which don't come a second time: they were deleted."""
        while self.row < stop:
            self.inserts()
            self.at, self.row = self.at + 1, self.row + 1

    def heavy(self, role: str, text: str) -> None:
        self.solve()
        _, audit, ends = self.known
        k = self.row
        while self.codes[k] & 3 == FAULTS["blank"]:
            k += 1
        self.rows_until(k)
        self.inserts()
        letter = audit[self.at]
        if letter != "D":
            self.line(role if letter == "K" else ROLES[ends[self.at]], text)
        self.at, self.row = self.at + 1, self.row + 1

    def result(self) -> tuple:
        self.solve()
        self.rows_until(len(self.codes))
        self.inserts()
        cost, audit, _ = self.known
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, self.counts[1], self.counts[2], self.counts[3], self.illegal, cost, audit, self.digest.hexdigest()


def told_apart(turns: DataFrame) -> DataFrame:
    """turns with digest (of the text), blank and cut (no end of a sentence at the end)."""
    shown = F.regexp_replace("text", f"{SPACE}+$", "")
    return turns.select("conv_id", "turn", "role", "text", "there", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), (shown == "").alias("blank"), (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("cut"))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, there and fault of rows of ``told_apart``; texts stay behind.

    Of equal rows (role and text) of a conversation the first turn is found by an aggregate with partial sums; rows that share
    that turn too are told apart in the stream, where they are neighbours."""
    spark = rows.sparkSession
    own = rows.select("conv_id", "turn", "role", "digest", "there", "blank", "cut", F.struct("conv_id", "role", "digest").alias("key"))
    first = own.where("there").groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min(_order()).alias("first"))
    found = skew_safe_lookup(own, first, "key", ["first"], "weight", F.struct("turn"), hot_limit(rows.count(), shuffle_partitions(spark)))
    fault = F.when(F.col("blank"), FAULTS["blank"]).when(_order() > F.col("first"), FAULTS["duplicate"]).when(F.col("cut"), FAULTS["truncated"]).otherwise(FAULTS["none"])
    return found.select("conv_id", "turn", "role", "digest", "there", fault.alias("fault"))


def _order() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("told"), F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"))


COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    turns: conv_id, turn, role, text and, for rows that only say that a conversation exists, ``there`` false."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    if "there" not in turns.columns:
        turns = turns.withColumn("there", F.lit(True))
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = told_apart(turns.select("conv_id", "turn", fill("role"), fill("text"), "there"))
    light = faults(rows).select("conv_id", F.lit(0).alias("step"), "turn", "role", "digest", F.lit(None).cast("string").alias("text"), "there", "fault")
    heavy = rows.where("there AND NOT blank").select("conv_id", F.lit(1).alias("step"), "turn", "role", "digest", "text", "there", F.lit(0).alias("fault"))
    stream = light.unionByName(heavy)
    order = ["conv_id", "step", "turn", "role", "digest"]
    parted = stream.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions(*order)
    columns = [F.col(c) for c in ["conv_id", "step", "turn", "role", "digest", "text", "there", "fault"]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done, before = None, None, [], None

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            fields = [ids, *[pa.int64()] * 6, pa.string(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields)], ["conv_id", *[f.split()[0] for f in COLUMNS.split(", ")]])
            done.clear()
            return made

        ids = None
        for batch in batches:
            ids = batch.schema.field(0).type
            for conv, step, turn, role, digest, text, there, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, *state.result()))
                    now, state, before = conv, _Conversation(), None
                if not there:
                    continue
                if step:
                    state.heavy(role, text)
                    continue
                own = (turn, role, digest)
                copy = own == before and fault != FAULTS["blank"]  # a neighbour that is equal in all
                state.light(turn, role, FAULTS["duplicate"] if copy else fault)
                before = own
            if len(done) >= 4096:
                yield out()
        if state is not None:
            done.append((now, *state.result()))
        if done:
            yield out()

    return for_python(parted, *columns).mapInArrow(tidy(each), f"conv_id {kind}, {COLUMNS}")


def repair_report(turns: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows."""
    return repair(damaged(turns))
