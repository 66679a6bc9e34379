"""Conversations damaged by rule, and their cheapest repair: dynamic programming over turns, vectorised across conversations.

A repaired conversation's role initials must read ``(s?(ua)+)?``: four states (nothing yet, after s, after u, after a).
Conversations are bucketed by length; costs are tensors of (turn, conversation, state), filled from the last turn back,
one vectorised step a turn for all conversations of a bucket; edits are traced from the first turn on in the same way.

A conversation beyond ``LONG_ROWS`` rows or ``LONG_BYTES`` bytes is cut into segments, whatever its size, so no task
holds it whole: a segment is a 4 x 4 matrix of costs in the (min, +) semiring, the matrices of a conversation are folded
from the end (costs) and, each segment's choices being known, from the beginning (states), and the segments are then
traced apart. Only the hash of the repaired text follows the segments one by one, as SHA-256 must.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LONG_ROWS, LONG_BYTES = 4096, 8 << 20
#: Rows and bytes of whole conversations that a task solves together.
BATCH_ROWS, BATCH_BYTES = 1 << 15, 16 << 20
KEEP_COST, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BREAKS = " \t\n\x0b\x0c\r"
LEGAL = frozenset(("su", "ua", "au"))
FAR = 1 << 50
#: State after keeping an initial (s, u, a, other; 4: not allowed) in each state, and after an insertion or a new role.
KEEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
FILL = np.array([2, 2, 3, 2])
ROLE = {2: "user", 3: "assistant"}
END = np.array([0, FAR, FAR, 0])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times: the rows after damage by crc32(``conv_id:turn``) % 20; dropped rows stay with times 0.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its role user. Nulls are one space in the key, role and text.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("d"))
    text = F.when(F.col("d") < 2, F.lit("")).when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", F.when(F.col("d") > 0, F.col("turn")).alias("turn"), F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))


# costs and edits of many conversations (or segments) at once; time comes first


def _relaxed(c: np.ndarray) -> np.ndarray:
    """Costs (…, 4) after as many insertions as pay."""
    two, three = np.minimum(c[..., 2], INSERT + c[..., 3]), np.minimum(c[..., 3], INSERT + c[..., 2])
    return np.stack([np.minimum(c[..., 0], INSERT + two), np.minimum(c[..., 1], INSERT + two), two, three], -1)


class Bucket:
    """Rows (turn, conversation): ``kind`` of initial, ``must`` be deleted, ``cut`` short, ``more`` copies that must be deleted, ``there`` at all."""

    def __init__(self, codes: list[np.ndarray]):
        self.length, width = max(map(len, codes), default=0), len(codes)
        self.kind, self.must, self.cut, self.more = (np.zeros((self.length, width), np.int64) for _ in range(4))
        self.there = np.zeros((self.length, width), bool)
        for i, c in enumerate(codes):
            n = len(c)
            self.kind[:n, i], self.must[:n, i], self.cut[:n, i], self.more[:n, i] = c.T
            self.there[:n, i] = True

    def backward(self, end: np.ndarray) -> np.ndarray:
        """(turn + 1, conversation, 5): the least cost of what follows, by state before the turn; the fifth state is out of reach."""
        costs = np.full((self.length + 1, self.kind.shape[1], 5), FAR, np.int64)
        costs[-1, :, :4] = _relaxed(np.broadcast_to(end, (self.kind.shape[1], 4)))
        for t in range(self.length - 1, -1, -1):
            costs[t, :, :4] = np.where(self.there[t][:, None], _relaxed(np.minimum.reduce(self.choices(t, costs[t + 1]))), costs[t + 1, :, :4])
        return np.minimum(costs, FAR)

    def choices(self, t: int, after: np.ndarray) -> list[np.ndarray]:
        """Costs of deleting, keeping and rewriting the rows of a turn, by state before it."""
        after = after + DELETE * self.more[t][:, None]
        own = TRUNCATED * self.cut[t][:, None] + FAR * self.must[t][:, None]
        keep = np.take_along_axis(after, KEEP[self.kind[t]], 1) + KEEP_COST + own
        return [after[:, :4] + DELETE, keep, after[:, FILL] + REROLE + own]

    def trace(self, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(state before each turn, insertions before it, edit 0-2 of it, state after all): of the cheapest edits those least as text, D < I < K < R."""
        width = np.arange(len(state))
        begins, fills, edits = (np.zeros((self.length, len(state)), np.int8) for _ in range(3))
        for t in range(self.length):
            begins[t] = state
            delete, keep, new = self.choices(t, costs[t + 1])
            open_ = self.there[t].copy()
            while open_.any():
                best = costs[t, width, state]
                drop = open_ & (delete[width, state] == best)
                fill = open_ & ~drop & (INSERT + costs[t, width, FILL[state]] == best)
                held = open_ & ~drop & ~fill & (keep[width, state] == best)
                edits[t] = np.where(drop, 0, np.where(held, 1, np.where(open_ & ~fill & ~drop, 2, edits[t])))
                after = np.where(held, KEEP[self.kind[t], state], np.where(open_ & ~drop, FILL[state], state))
                fills[t] += fill
                state, open_ = after, fill
        return begins, fills, edits, state


def encode(role: list[str], text: list[str], times: list[int], seen: list[bool] | None = None) -> tuple[np.ndarray, list[int]]:
    """Codes (kind, must, cut, more) of a conversation's rows in order, and its numbers of blank, duplicate, truncated rows and illegal neighbours.

    ``seen``: which rows have an equal one further up, where they are not all of the conversation.
    """
    codes, known = np.zeros((len(role), 4), np.int64), set()
    blank = duplicate = truncated = illegal = 0
    before = None
    for i, (r, t, n) in enumerate(zip(role, text, times, strict=True)):
        body = t.rstrip(BREAKS)
        empty = not body
        if seen is None:
            again = (r, t) in known
            known.add((r, t))
        else:
            again = seen[i]
        cut = not empty and not again and body[-1] not in ".!?"
        blank += n if empty else 0
        duplicate += 0 if empty else n if again else n - 1
        truncated += cut
        illegal += (before is not None and before + r[:1] not in LEGAL) + (n - 1)
        before = r[:1]
        codes[i] = ("sua".find(before) if before else -1) % 4, empty or again, cut, n - 1
    return codes, [blank, duplicate, truncated, illegal]


def repaired(role: list[str], text: list[str], more, begins, fills, edits):
    """The edits' initials and the repaired lines of one conversation (or segment)."""
    audit, lines = [], []
    for i, (r, t) in enumerate(zip(role, text, strict=True)):
        state = int(begins[i])
        for _ in range(fills[i]):
            state = int(FILL[state])
            audit.append("I")
            lines.append(ROLE[state] + ":")
        audit.append("DKR"[edits[i]] + "D" * int(more[i]))
        if edits[i] == 1:
            lines.append(f"{r}:{t}")
        elif edits[i] == 2:
            lines.append(f"{ROLE[int(FILL[state])]}:{t}")
    return "".join(audit), lines


def closing(state: int) -> list[str]:
    """The lines that lead from a state after the last row to an end."""
    out = []
    while END[state]:
        state = int(FILL[state])
        out.append(ROLE[state] + ":")
    return out


def gaps_of(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return min(max(known) - min(known) + 1 - len(known), 2**63 - 1) if known else 0


_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_KINDS = [pa.int64()] * 7 + [pa.string()] * 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], [x.split()[0] for x in _OUT.split(", ")])


def solve(conversations: list[tuple]) -> list[tuple]:
    """Result rows of whole conversations (id, turns, roles, texts, times), bucketed by powers of two of their lengths."""
    coded = [encode(r, t, n) for _, _, r, t, n in conversations]
    buckets: dict[int, list[int]] = {}
    for i, (c, _) in enumerate(coded):
        buckets.setdefault(len(c).bit_length(), []).append(i)
    out = []
    for members in buckets.values():
        b = Bucket([coded[i][0] for i in members])
        costs = b.backward(END)
        begins, fills, edits, state = b.trace(costs, np.zeros(len(members), np.int64))
        for at, i in enumerate(members):
            key, turns, role, text, _ = conversations[i]
            codes, faults = coded[i]
            audit, lines = repaired(role, text, codes[:, 3], begins[:, at], fills[:, at], edits[:, at])
            last = closing(int(state[at]))
            sha = hashlib.sha256("\n".join(lines + last).encode()).hexdigest()
            out.append((key, gaps_of(turns), *faults, int(costs[0, at, 0]), audit + "I" * len(last), sha))
    return out


def _solve(batches):
    """Partitions are sorted by conversation and turn; whole conversations are solved some at a time."""
    held: list[tuple] = []
    rows = size = 0
    for b in common.text_slices(batches):
        for key, turn, role, text, times in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times")), strict=True):
            if not held or held[-1][0] != key:
                if rows >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(solve(held))
                    held, rows, size = [], 0, 0
                held.append((key, [], [], [], []))
                rows += 1
            if times:
                for column, x in zip(held[-1][1:], (turn, role, text, times), strict=True):
                    column.append(x)
                rows, size = rows + 1, size + len(text)
    if held:
        yield _batch(solve(held))


# long conversations in segments

_SEGMENT = "seg long, conv_id long, role array<string>, text array<string>, codes array<long>, matrix array<long>, facts array<long>, ends array<string>, turns array<long>"


def _segments(most_rows: int, most_bytes: int):
    """Consecutive rows of one conversation, with the costs between all states and what neighbours need of them."""

    def made(seg, key, turn, role, text, times, seen):
        codes, faults = encode(role, text, times, seen)
        costs = Bucket([codes] * 4).backward(np.where(np.eye(4, dtype=bool), 0, FAR))
        known = [t for t in turn if t is not None]
        turns = [known[0], known[-1], len(set(known))] if known else []
        return {"seg": seg, "conv_id": key, "role": role, "text": text, "codes": codes.ravel().tolist(), "matrix": costs[0, :, :4].T.ravel().tolist(), "facts": faults, "ends": [role[0][:1], role[-1][:1]], "turns": turns}

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()), pa.list_(pa.int64())]
    schema = pa.schema([(x.split()[0], k) for x, k in zip(_SEGMENT.split(", "), kinds, strict=True)])

    def run(batches):
        seg = TaskContext.get().partitionId() << 33
        key, held, size = None, [[] for _ in range(5)], 0
        for b in common.text_slices(batches):
            for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "times", "seen")), strict=True):
                if held[0] and (row[0] != key or len(held[0]) >= most_rows or size >= most_bytes):
                    yield pa.RecordBatch.from_pylist([made(seg, key, *held)], schema)
                    seg, held, size = seg + 1, [[] for _ in range(5)], 0
                key, size = row[0], size + len(row[3])
                for column, x in zip(held, row[1:], strict=True):
                    column.append(x)
        if held[0]:
            yield pa.RecordBatch.from_pylist([made(seg, key, *held)], schema)

    return run


_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _from_the_end(pdf: pd.DataFrame) -> pd.DataFrame:
    """Least costs after each segment of a conversation, by state; and, in its first segment's row, the conversation's numbers."""
    pdf = pdf.sort_values("seg").reset_index(drop=True)
    after, cost = [], END
    for m in pdf["matrix"][::-1]:
        after.append(np.minimum(cost, FAR).tolist())
        cost = np.minimum((np.asarray(m).reshape(4, 4) + cost[None, :]).min(1), FAR)
    facts = np.sum([list(f) for f in pdf["facts"]], 0)
    ends = list(pdf["ends"])
    facts[3] += sum(a[1] + b[0] not in LEGAL for a, b in zip(ends, ends[1:], strict=False))
    known = [list(map(int, t)) for t in pdf["turns"] if len(t)]
    distinct = sum(t[2] for t in known) - sum(a[1] == b[0] for a, b in zip(known, known[1:], strict=False))
    gaps = min(known[-1][1] - known[0][0] + 1 - distinct, 2**63 - 1) if known else 0
    totals = [gaps, *map(int, facts), int(_relaxed(cost)[0])]
    out = pd.DataFrame({"seg": pdf["seg"], "after": after[::-1]})
    for i, name in enumerate(x.split()[0] for x in _TOTALS.split(", ")):
        out[name] = pd.array([totals[i]] + [None] * (len(out) - 1), dtype="Int64")
    return out


def _traced(b: dict) -> tuple[np.ndarray, Bucket, tuple]:
    codes = np.asarray(b["codes"], np.int64).reshape(-1, 4)
    bucket = Bucket([codes] * 4)
    costs = bucket.backward(np.asarray(b["after"], np.int64))
    return codes, bucket, bucket.trace(costs, np.arange(4))


def _next_states(batches):
    for b in batches:
        rows = [(r["seg"], r["conv_id"], _traced(r)[2][3].tolist()) for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["seg", "conv_id", "next"])


def _from_the_beginning(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state before each segment of a conversation; and the state after the last one (-1 in the others' rows)."""
    pdf = pdf.sort_values("seg").reset_index(drop=True)
    state, before = 0, []
    for n in pdf["next"]:
        before.append(state)
        state = int(n[state])
    return pd.DataFrame({"seg": pdf["seg"], "state": before, "final": [-1] * (len(pdf) - 1) + [state]})


def _pieces(batches):
    for b in batches:
        for r in b.to_pylist():
            codes, _, (begins, fills, edits, _) = _traced(r)
            s = r["state"]
            audit, lines = repaired(r["role"], r["text"], codes[:, 3], begins[:, s], fills[:, s], edits[:, s])
            last = closing(r["final"]) if r["final"] >= 0 else []
            lines += last
            body = "\n".join(lines).encode() if lines else None
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["seg"]], pa.int64()), pa.array([r["conv_id"]], pa.int64()), pa.array([audit + "I" * len(last)]), pa.array([body], pa.binary())], ["seg", "conv_id", "audit", "body"]
            )


def _hashed(batches):
    """Pieces in order of conversation and segment: the hash runs over them, no more than a batch is held but the audit."""
    key, totals, audit, sha, any_line = None, None, [], None, False
    names = [x.split()[0] for x in _TOTALS.split(", ")]
    for b in batches:
        for r in b.to_pylist():
            if sha is None or r["conv_id"] != key:
                if sha is not None:
                    yield _batch([(key, *totals, "".join(audit), sha.hexdigest())])
                key, totals, audit, sha, any_line = r["conv_id"], [r[n] for n in names], [], hashlib.sha256(), False
            audit.append(r["audit"])
            if r["body"] is not None:
                sha.update(b"\n" + r["body"] if any_line else r["body"])
                any_line = True
    if sha is not None:
        yield _batch([(key, *totals, "".join(audit), sha.hexdigest())])


def _same(other: str) -> Column:
    return F.col("conv_id").eqNullSafe(F.col(other))


def _repair_long(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Results of the conversations of ``rows`` (all of any length), in segments of at most ``most_rows`` rows."""
    rows = rows.filter("times > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    keyed = rows.select("*", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(2), "text", "role").alias("h2"))
    first = keyed.groupBy("conv_id", "h1", "h2").agg(F.min(turn).alias("first")).withColumnsRenamed({"conv_id": "c2", "h1": "g1", "h2": "g2"})
    same = [_same("c2"), F.col("h1") == F.col("g1"), F.col("h2") == F.col("g2")]
    told = keyed.join(first, same).select("conv_id", "turn", "role", "text", "times", (turn > F.col("first")).alias("seen"))
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    parts = told.repartitionByRange(*by, F.substring("text", 1, 64).asc()).sortWithinPartitions(*by, F.col("text").asc())
    segments = common.durable(parts.mapInArrow(_segments(most_rows, most_bytes), _SEGMENT))
    narrow = segments.select("seg", "conv_id", "matrix", "facts", "ends", "turns")
    costs = common.durable(narrow.groupBy("conv_id").applyInPandas(_from_the_end, f"seg long, after array<long>, {_TOTALS}"))
    coded = segments.select("seg", "conv_id", "codes").join(costs.select("seg", "after"), "seg")
    nexts = coded.mapInArrow(_next_states, "seg long, conv_id long, next array<long>")
    states = common.durable(nexts.groupBy("conv_id").applyInPandas(_from_the_beginning, "seg long, state int, final int"))
    chosen = segments.select("seg", "conv_id", "role", "text", "codes").join(costs.select("seg", "after"), "seg").join(states, "seg")
    pieces = chosen.mapInArrow(_pieces, "seg long, conv_id long, audit string, body binary").join(costs.drop("after"), "seg")
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_hashed, _OUT)


def repair_conversations(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, rows_damaged: bool = False) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged by ``damaged`` (``rows_damaged``: they are given with ``times`` as it returns them) and ordered by
    turn, nulls first; rows of one turn by role and text. Edits: keep 0, new role user or assistant 3, delete 4 (required
    for blank and duplicate rows), insert an empty user or assistant row 3; a truncated row that stays adds 3. ``audit``
    has the initials of the cheapest edits, of several the least in ASCII.

    Nulls of role and text are one space (so blank), a null conv_id is a conversation, an empty role has no initial.
    Repeated rows are duplicates. A conversation of which no row is left has zeros, an empty audit and the empty text's hash;
    an empty table gives no rows; other columns are ignored. gaps is held at 2 ** 63 - 1.
    """
    common.ship_code(conversations.sparkSession)
    rows = conversations if rows_damaged else damaged(conversations)
    sizes = rows.groupBy("conv_id").agg(F.sum("times").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = common.durable(sizes.filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("long_id")))
    short = rows
    if any_long := bool(long.limit(1).count()):
        short = rows.join(common.small(long), _same("long_id"), "left_anti")
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    out = short.repartition("conv_id").sortWithinPartitions(*by).mapInArrow(_solve, _OUT)
    return out.unionByName(_repair_long(rows.join(common.small(long), _same("long_id"), "left_semi"), long_rows, long_bytes)) if any_long else out


def _sql() -> str:
    """The same rows in SQL: CRC-32 from its polynomial, then costs, audits and lines of the four states, from the last row back."""
    add = lambda cost, letter, line, to: f"{{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 'l': {line} || {to}.l}}"
    least = lambda *of: f"list_sort([{', '.join(of)}])[1]"
    fill = {0: 2, 1: 2, 2: 3, 3: 2}
    line = {2: "chr(10) || 'user:'", 3: "chr(10) || 'assistant:'"}
    held = "chr(10) || r.role || ':' || r.text"
    never = "{'c': 1000000000, 'a': '', 'l': ''}"
    keep = {0: "CASE r.i WHEN 's' THEN s.s1 WHEN 'u' THEN s.s2 END", 1: "CASE r.i WHEN 'u' THEN s.s2 END", 2: "CASE r.i WHEN 'a' THEN s.s3 END", 3: "CASE r.i WHEN 'u' THEN s.s2 END"}
    chosen = ", ".join(
        least(add(4, "D", "''", f"s.s{i}"), f"CASE WHEN NOT r.must AND ({keep[i]}) IS NOT NULL THEN {add('r.cut', 'K', held, f'({keep[i]})')} ELSE {never} END", f"CASE WHEN NOT r.must THEN {add('3 + r.cut', 'R', f'{line[fill[i]]} || r.text', f's.s{fill[i]}')} ELSE {never} END")
        + f" AS c{i}" for i in range(4)
    )
    inner = f"{least('c2', add(3, 'I', line[3], 'c3'))} AS s2, {least('c3', add(3, 'I', line[2], 'c2'))} AS s3"
    outer = ", ".join(f"{least(f'c{i}', add(3, 'I', line[2], 's2'))} AS s{i}" for i in (0, 1))
    return rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i)
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d
  FROM conversations, crc_table
), hurt AS (
  SELECT k, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM given WHERE d > 0
), placed AS (
  SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS pos, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open FROM hurt
), told AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY k, role, text ORDER BY pos) > 1 AS again, coalesce(lag(i) OVER (PARTITION BY k ORDER BY pos) || i NOT IN ('su', 'ua', 'au'), false) AS bad FROM placed
), coded AS (
  SELECT k, pos, role, text, i, blank OR again AS must, CASE WHEN open THEN 3 ELSE 0 END AS cut FROM told
), facts AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
    count(*) FILTER (open AND NOT blank AND NOT again) AS truncated, count(*) FILTER (bad) AS illegal, max(pos) AS n FROM told GROUP BY k
), steps AS (
  SELECT k, n AS pos, {{'c': 0::BIGINT, 'a': '', 'l': ''}} AS s0, {{'c': 6::BIGINT, 'a': 'II', 'l': {line[2]} || {line[3]}}} AS s1, {{'c': 3::BIGINT, 'a': 'I', 'l': {line[3]}}} AS s2, {{'c': 0::BIGINT, 'a': '', 'l': ''}} AS s3 FROM facts
  UNION ALL
  SELECT k, pos, {outer}, s2, s3 FROM (SELECT k, pos, c0, c1, {inner} FROM (SELECT s.k, s.pos - 1 AS pos, {chosen} FROM steps AS s JOIN coded AS r ON r.k = s.k AND r.pos = s.pos))
)
SELECT DISTINCT g.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
  coalesce(s.s0.c, 0) AS cost, coalesce(s.s0.a, '') AS audit, sha256(coalesce(substr(s.s0.l, 2), '')) AS repaired_sha256
FROM given AS g LEFT JOIN facts AS f ON f.k = g.k LEFT JOIN steps AS s ON s.k = g.k AND s.pos = 0
"""


SQL = _sql()
