"""Damage, faults and cheapest repairs against SQL and against a plain search over edits, for conversations of any length."""

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pytest
from oracle import same

from lakeloom.llm import conversations, queries

SF = "/root/testdata/sf0.001"


def damage(rows):
    out = {}
    for k, turn, role, text in rows:
        mine = out.setdefault(k, [])
        d = zlib.crc32(f"{' ' if k is None else k}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (turn, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
        mine += [] if d == 0 else [row] * (2 if d == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def search(rows):
    """Cost, audit and lines by trying every edit at every place: not the operator's tensors, but the statement of the problem."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(at, state, inserted):
        found = [(0, "", ())] if at == len(rows) and state in ("", "a") else []
        if inserted < 2:
            for i, role in (("u", "user"), ("a", "assistant")):
                if (state, i) in step:
                    c, a, lines = best(at, step[state, i], inserted + 1)
                    found.append((c + 3, "I" + a, (role + ":", *lines)))
        if at < len(rows):
            role, text, must, cut = rows[at]
            c, a, lines = best(at + 1, state, 0)
            found.append((c + 4, "D" + a, lines))
            if not must:
                if (state, role[:1]) in step:
                    c, a, lines = best(at + 1, step[state, role[:1]], 0)
                    found.append((c + cut, "K" + a, (f"{role}:{text}", *lines)))
                for i, new in (("u", "user"), ("a", "assistant")):
                    if (state, i) in step:
                        c, a, lines = best(at + 1, step[state, i], 0)
                        found.append((c + 3 + cut, "R" + a, (f"{new}:{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows):
    out = []
    for k, mine in damage(rows).items():
        turns, seen, faults, coded, bad, prior = {r[0] for r in mine if r[0] is not None}, set(), [0, 0, 0], [], 0, None
        for _, role, text in mine:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            bad += prior is not None and prior + role[:1] not in ("su", "ua", "au")
            prior = role[:1]
            if fault is not None:
                faults[fault] += 1
            coded.append((role, text, fault in (0, 1), 3 * (fault == 2)))
        cost, audit, lines = search(tuple(coded))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((k, gaps, *faults, bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, times int, cost string")


def found(df, **options):
    return sorted((tuple(r) for r in conversations.repair_conversations(df, **options).collect()), key=str)


def made(rng, n, longest):
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "Yes.", "é ü", "done.\n", "a\nb. ", None]
    rows = []
    for k in range(n):
        for i in range(int(rng.integers(1, longest + 1))):
            turn = None if rng.random() < 0.03 else int(i + rng.integers(0, 2))
            role = rng.choice(["user", "assistant", "system", "tool", "", "unknown", None], p=[0.4, 0.3, 0.1, 0.05, 0.05, 0.05, 0.05])
            rows.append((k, turn, role and str(role), texts[rng.integers(0, len(texts))] if rng.random() < 0.6 else f"text {rng.integers(0, 50)}."))
    return rows


def test_sample_table(spark):
    same(spark, SF, queries.op12_conversation_repair, conversations.SQL)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op12_conversation_repair(spark, SF).collect()), key=str) == brute(rows)


def test_random_conversations(spark):
    rows = made(np.random.default_rng(2), 300, 14)
    assert found(frame(spark, rows).repartition(3)) == brute(rows)


@pytest.mark.parametrize("most", [1, 3, 7])
def test_segments_give_what_whole_conversations_give(spark, most):
    """Every conversation of more than a few rows goes through segments of that size, in several partitions."""
    rng = np.random.default_rng(most)
    rows = made(rng, 12, 60) + [(99, 5, "user", "again and again.")] * 40 + [(98, None, None, None)] * 9
    rows += [(None, i, ("user", "assistant")[i % 2], "ok.") for i in range(30)]
    assert found(frame(spark, rows).repartition(3), long_rows=most) == brute(rows)
    assert found(frame(spark, rows), long_rows=10**6, long_bytes=40) == brute(rows)


def test_awkward_rows(spark):
    assert found(frame(spark, []).limit(0)) == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    sound = next(k for k in range(1000) if all(zlib.crc32(f"{k}:{t}".encode()) % 20 > 4 for t in range(2)))
    ends = next(k for k in range(10000) if all(zlib.crc32(f"{k}:{t}".encode()) % 20 > 4 for t in (-(2**63), 2**63 - 1)))
    rows = [(gone, 0, "user", "x."), (sound, 0, "user", "long " * 100_000 + "."), (sound, 1, "assistant", "Fine."), (None, None, None, None)]
    want = brute(rows)
    assert found(frame(spark, rows)) == want
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want and (sound, "KK", 0) in {(r[0], r[7], r[6]) for r in want}
    far = found(frame(spark, [(ends, -(2**63), "user", "a."), (ends, 2**63 - 1, "assistant", "b.")]))
    assert far[0][1] == 2**63 - 1 and far[0][7] == "KK"
