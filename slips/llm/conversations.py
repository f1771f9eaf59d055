"""Repair of conversations by a cheapest sequence of edits.

A conversation is good if the initials of its roles read ``(s?(ua)+)?``: at most one system turn, then user and
assistant in turn. Edits are Keep (0), Rerole to user or assistant (2), Delete (3) and Insert of an empty user or
assistant turn (2); a truncated turn that stays adds 1, and blank or duplicate turns have to go. Of the cheapest edit
sequences the one whose initials (D, I, K, R) are least in ASCII is taken.

The plan has two passes, each sorted by conversation and streamed. The first sees narrow rows only (initial, fault,
digest; no texts): conversations of like length form one bucket, whose costs are a tensor with time as the first axis.
Costs are carried from the last turn to the first for all conversations of a bucket at once, kept as small
differences, and traced forwards in the same way. The second pass meets each conversation's edits just before its
turns, so a text is read once, in order, and never held: of a long conversation a task holds about 50 bytes a turn,
in proportion to the audit that is its result. One conversation is one task in either pass, because its edits depend
on each other and its digest on all texts in order.

Turns are taken by turn number, nulls first; of equal numbers by role, then by the digest of the text. A null role or
text reads as one space; a role without an initial s, u or a (empty ones included) cannot be kept. Rows with a null
conversation id form one conversation. Repeated rows are duplicates. Gaps of turn numbers beyond 64 bits wrap.
Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Turns that are worked on at once (a longer conversation is taken alone).
BLOCK = 1 << 17

#: States: nothing yet, after system, after user, after assistant. The state after the next user or assistant.
ALTERNATE = np.array([2, 2, 3, 2])
#: State after keeping a turn of each initial (other, s, u, a) in each state; 4 is no state.
KEPT = np.array([[4, 1, 2, 4], [4, 4, 2, 4], [4, 4, 4, 3], [4, 4, 2, 4]])
NEVER = 100
OTHER, SYSTEM, USER, ASSISTANT = range(4)
FINE, BLANK, TRUNCATED, ABSENT = range(4)
D, I, K, R = b"DIKR"  # noqa: E741

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
NAMES = [x.split()[0] for x in REPORT.split(", ")]


def relax(cost: np.ndarray) -> np.ndarray:
    """Costs by state (first axis) when turns may be inserted first; two are enough to reach any state."""
    for _ in range(2):
        cost = np.minimum(cost, INSERT + cost[ALTERNATE])
    return cost


def through(after: np.ndarray, initial: np.ndarray, cut: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs by state of deleting, keeping and reroling one turn of each conversation; ``after``: costs behind it."""
    padded = np.concatenate((after, np.full((1, after.shape[1]), NEVER, after.dtype)))
    lanes = np.arange(after.shape[1])
    stay = np.where(bad, NEVER, cut * CUT).astype(after.dtype)
    return after + DELETE, padded[KEPT[:, initial], lanes] + stay, after[ALTERNATE] + REROLE + stay


def edits(initial: np.ndarray, fault: np.ndarray, duplicate: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cheapest edits of a bucket of conversations, all shaped (turn, conversation) and padded at the end.

    Returns each conversation's cost, the initials of its edits one conversation after another, and their numbers.
    """
    turns, lanes = initial.shape
    bad, cut = (fault == BLANK) | duplicate, fault == TRUNCATED
    end = relax(np.array([[0], [NEVER], [NEVER], [0]], np.int16))
    # Costs of the rest, less those of state 0: a state is at most a few edits from another, so a byte holds it.
    costs = np.empty((turns + 1, 4, lanes), np.int8)
    total = np.zeros(lanes, np.int64)
    now = np.repeat(end, lanes, axis=1)
    costs[turns] = now
    for t in range(turns - 1, -1, -1):
        new = relax(np.minimum.reduce(through(now, initial[t], cut[t], bad[t])))
        inside = t < lengths
        base = new[0]
        total += np.where(inside, base, 0)
        now = np.where(inside, new - base, now)
        costs[t] = now
    letters = np.zeros((turns + 1, 3, lanes), np.uint8)
    state, each = np.zeros(lanes, np.int64), np.arange(lanes)
    for t in range(turns + 1):
        inside, past = t < lengths, t == lengths
        here = costs[t].astype(np.int16)
        if t < turns:
            after = costs[t + 1].astype(np.int16)
            delete, keep, rerole = through(after, initial[t], cut[t], bad[t])
            base = np.minimum.reduce((delete[0], keep[0], rerole[0], INSERT + np.minimum.reduce((delete[2], keep[2], rerole[2])), 2 * INSERT + np.minimum.reduce((delete[3], keep[3], rerole[3]))))
            here = here + np.where(inside, base, 0)
        for k in range(2):
            ahead = ALTERNATE[state]
            insert = INSERT + here[ahead, each] == here[state, each]
            if t < turns:
                insert &= ~inside | (delete[state, each] != here[state, each])
            insert &= inside | past
            letters[t, k, insert] = I
            state = np.where(insert, ahead, state)
        if t < turns:
            cost = here[state, each]
            out = inside & (delete[state, each] == cost)
            stay = inside & ~out & (keep[state, each] == cost)
            turned = inside & ~out & ~stay
            letters[t, 2] = np.where(out, D, np.where(stay, K, np.where(turned, R, 0)))
            state = np.where(stay, KEPT[state, initial[t]], np.where(turned, ALTERNATE[state], state))
    flat = letters.reshape(-1, lanes).T
    return total, flat[flat > 0], (flat > 0).sum(axis=1)


def repeated(lane: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Whether an earlier row of the same lane has the same digest (two 64-bit halves)."""
    order = np.lexsort((digest[:, 1], digest[:, 0], lane))  # stable: rows stay in order within a key
    same = (lane[order][1:] == lane[order][:-1]) & (digest[order][1:] == digest[order][:-1]).all(axis=1)
    out = np.zeros(len(lane), bool)
    out[order[1:]] = same
    return out


def summary(lane: np.ndarray, n: int, turn: np.ndarray, numbered: np.ndarray, initial: np.ndarray, fault: np.ndarray, digest: np.ndarray) -> list[pa.Array]:
    """The columns of REPORT for ``n`` conversations, whose turns follow each other."""
    there = fault != ABSENT
    lane, turn, numbered, initial, fault, digest = (x[there] for x in (lane, turn, numbered, initial, fault, digest))
    duplicate = repeated(lane, digest) & (fault != BLANK)
    lengths = np.bincount(lane, minlength=n)
    first = np.cumsum(lengths) - lengths
    count = lambda which: np.bincount(lane[which], minlength=n).astype(np.int64)
    cut = (fault == TRUNCATED) & ~duplicate
    fine = np.zeros((4, 4), bool)
    fine[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True
    next_to = np.flatnonzero(lane[1:] == lane[:-1])
    illegal = np.bincount(lane[next_to[~fine[initial[next_to], initial[next_to + 1]]]], minlength=n).astype(np.int64)
    known, own = turn[numbered], lane[numbered]
    fresh = np.ones(len(known), bool)
    fresh[1:] = (known[1:] != known[:-1]) | (own[1:] != own[:-1])
    distinct, sizes = np.bincount(own[fresh], minlength=n), np.bincount(own, minlength=n)
    ends = np.cumsum(sizes)
    gaps, some = np.zeros(n, np.int64), sizes > 0
    gaps[some] = known[ends[some] - 1] - known[(ends - sizes)[some]] + 1 - distinct[some]

    cost, audits = np.zeros(n, np.int64), np.full(n, b"", object)
    bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for b in np.unique(bucket[lengths > 0]):
        who = np.flatnonzero((bucket == b) & (lengths > 0))
        own = lengths[who]
        place = np.minimum(np.arange(own.max())[:, None], own - 1) + first[who]
        total, letters, sizes = edits(initial[place], np.where(cut[place], TRUNCATED, np.where(fault[place] == BLANK, BLANK, FINE)), duplicate[place], own)
        cost[who] = total
        text, at = letters.tobytes(), np.cumsum(sizes)
        audits[who] = [text[high - size : high] for high, size in zip(at.tolist(), sizes.tolist(), strict=True)]
    columns = [gaps, count(fault == BLANK), count(duplicate), count(cut), illegal, cost]
    return [*map(pa.array, columns), pa.array([a.decode() for a in audits], pa.string())]


def sections(column: pa.Array, before: object) -> np.ndarray:
    """Rows at which a value begins that differs from the row before (null is a value); ``before``: a list with the last
    value of the batch before, or empty."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    starts = np.flatnonzero(codes[1:] != codes[:-1]) + 1
    new = not before or before[0] != column[0].as_py()
    return np.concatenate(([0], starts)) if new else starts


def reports(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """First pass: one row for each conversation."""

    def done(rows: list[pa.RecordBatch], firsts: np.ndarray) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        column = lambda c: table.column(c).combine_chunks()
        lane = np.zeros(len(table), np.int64)
        lane[firsts[1:]] = 1
        lane = np.cumsum(lane)
        turn = column("turn")
        digest = np.frombuffer(b"".join(x or bytes(16) for x in column("digest").to_pylist()), np.int64).reshape(-1, 2)
        found = summary(lane, len(firsts), turn.fill_null(0).to_numpy(), turn.is_valid().to_numpy(zero_copy_only=False), column("initial").to_numpy().astype(np.int64), column("fault").to_numpy(), digest)
        return pa.RecordBatch.from_arrays([column("conv").take(pa.array(firsts)), *found], names=names)

    held, firsts, size, last = [], [], 0, []
    for batch in batches:
        if not len(batch):
            continue
        starts = sections(batch.column(0), last)
        last = [batch.column(0)[len(batch) - 1].as_py()]
        if size + len(batch) >= BLOCK and len(starts) and (cut := int(starts[-1])) + size:
            rows = [*held, batch.slice(0, cut)] if cut else held
            yield done(rows, np.concatenate([*firsts, starts[:-1] + size]).astype(np.int64))
            held, firsts, size = [batch.slice(cut)], [np.zeros(1, np.int64)], len(batch) - cut
        else:
            held.append(batch)
            firsts.append(starts + size)
            size += len(batch)
    if held:
        yield done(held, np.concatenate(firsts).astype(np.int64))


class Repair:
    """Applies one conversation's edits to its turns, in order."""

    def __init__(self, audit: str, emit):
        self.audit, self.at, self.state, self.emit = audit, 0, 0, emit

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.step("I", None, "")
            self.at += 1

    def step(self, edit: str, role: str | None, text: str, turn: int | None = None) -> None:
        if role is None:
            self.state = int(ALTERNATE[self.state])
            role = "user" if self.state == USER else "assistant"
        else:
            self.state = " sua".index(role[0])
        self.emit(edit, role, text, turn)

    def turn(self, role: str, text: str, turn: int | None) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.step(edit, role if edit == "K" else None, text, turn)


def replay(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    """Second pass: a conversation's report, then its turns. Emits the repaired turns, or reports with a digest."""
    whole, word = pa.int64(), pa.string()
    fields = dict.fromkeys(("seq", "turn"), whole) | dict.fromkeys(("role", "text", "edit"), word) if texts else dict.fromkeys(NAMES[:-1], whole) | dict.fromkeys((NAMES[-1], "repaired_sha256"), word)
    out: list[tuple] = []
    size, now, conv, report, digest, seq = 0, None, None, None, None, 0

    def emit(edit: str, role: str, text: str, turn: int | None) -> None:
        nonlocal seq, size
        if texts:
            out.append((conv, seq, turn, role, text, edit))
            size += len(text) + 50
        else:
            line = f"{role}:{text}"
            digest.update((f"\n{line}" if seq else line).encode())
        seq += 1

    def close() -> None:
        if now is not None:
            now.insert()
            if not texts:
                out.append((conv, *report, digest.hexdigest()))

    def flush() -> pa.RecordBatch:
        columns = zip(("conv", *fields), (kind_of_conv, *fields.values()), zip(*out, strict=True), strict=True)
        found = pa.RecordBatch.from_pydict({name: pa.array(values, kind) for name, kind, values in columns})
        out.clear()
        return found

    for batch in batches:
        kind_of_conv = batch.schema.field("conv").type
        convs, starts = batch.column("conv"), batch.column("kind").to_numpy()
        columns = [batch.column(c).to_pylist() for c in ("turn", "role", "text")]
        for k, (kind, turn, role, text) in enumerate(zip(starts, *columns, strict=True)):
            if kind == 0:
                close()
                conv = convs[k].as_py()
                report = [batch.column(c)[k].as_py() for c in NAMES]
                now, digest, seq = Repair(report[-1], emit), hashlib.sha256(), 0
            else:
                now.turn(role, text, turn)
            if size > 1 << 22:
                yield flush()
                size = 0
        if len(out) > 1000:
            yield flush()
    close()
    if out:
        yield flush()


def features(turns: DataFrame, names: dict[str, str]) -> DataFrame:
    """conv, turn, role, text without nulls in role and text, and the digest of both."""
    space = lambda c: F.coalesce(F.col(names[c]).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col(names["conv"]).alias("conv"), F.col(names["turn"]).cast("long").alias("turn"), space("role"), space("text"))
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))))


def _run(turns: DataFrame, conversations: DataFrame | None, names: dict[str, str], texts: bool) -> DataFrame:
    rows = features(turns, names)
    kind = rows.schema["conv"].dataType
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(body == "", BLANK).when(F.substring(body, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    initial = F.expr("locate(substring(role, 1, 1), 'sua')")
    narrow = rows.select("conv", "turn", "role", F.when(F.col("role") == "", OTHER).otherwise(initial).cast("byte").alias("initial"), fault.cast("byte").alias("fault"), "digest")
    if conversations is not None:
        none = F.lit(None)
        absent = conversations.select(F.col(names["conv"]).cast(kind).alias("conv")).distinct()
        absent = absent.select("conv", none.cast("long").alias("turn"), none.cast("string").alias("role"), F.lit(OTHER).cast("byte").alias("initial"), F.lit(ABSENT).cast("byte").alias("fault"), none.cast("binary").alias("digest"))
        narrow = narrow.unionByName(absent)
    first = narrow.repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest").select("conv", "turn", "initial", "fault", "digest")
    found = first.mapInArrow(lambda b: reports(b, ["conv", *NAMES]), f"conv {kind.simpleString()}, {REPORT}")

    both = found.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    second = both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest").drop("digest")
    schema = f"conv {kind.simpleString()}, " + ("seq long, turn long, role string, text string, edit string" if texts else f"{REPORT}, repaired_sha256 string")
    return second.mapInArrow(lambda b: replay(b, texts), schema).withColumnRenamed("conv", names["conv"])


def _names(conv_col: str, turn_col: str, role_col: str, text_col: str) -> dict[str, str]:
    return {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col}


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns of all conversations after repair: conversation, seq (from 0), turn (null if inserted), role, text and
    edit (K, R or I)."""
    return _run(turns, None, _names(conv_col, turn_col, role_col, text_col), True)


def report(turns: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: faults, cost, audit and the SHA-256 of its repaired ``role:text`` lines.

    ``conversations`` (a column ``conv_col``) names conversations to report even if ``turns`` has none of their rows.
    """
    return _run(turns, conversations, _names(conv_col, turn_col, role_col, text_col), False)


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of ``conversations`` after the damage that the query repairs."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), lot.alias("lot")).where("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("lot") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return report(damaged(turns), turns)


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLE: dict = {}
