"""A commit log of numbered records in one folder: who makes the next number has committed, everybody else sees that they came late.

A record is written aside and given its number by a link or rename that fails where the number is taken, so of two writers
one wins, in threads, processes or machines. That needs a file system whose rename fails on an existing name in one step (HDFS, local disks).

Several logs change together through a *decision*: every log gets a record that carries the name of a change, which
counts only once the file ``<root>/_changes/<name>`` says so. That file is made once, by whoever comes first: by the writer
(``commit``), or, where the writer has been silent for ``lease`` seconds, by somebody who waits for it (``abort``). A driver
killed at any point leaves either all of its records in force or none.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable
from typing import Any

from .files import Files

#: Seconds after which a change without a decision may be called off by others, and after which old numbers may go.
LEASE, KEEP_FOR = 60.0, 3600.0


class Conflict(RuntimeError):
    """Another writer has changed what this change rests on; run again on the new state, it may succeed."""


class Log:
    """The records of one folder. Records never change, so those read once are kept."""

    def __init__(self, files: Files, root: str, folder: str, lease: float = LEASE):
        self.files, self.root, self.folder, self.lease = files, root, folder, lease
        self.seen: dict[int, dict] = {}
        self.decided: dict[str, str] = {}

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json") and n[:-5].isdigit())

    def at(self, number: int) -> str:
        return f"{self.folder}/{number:020d}.json"

    def record(self, number: int) -> dict:
        if number not in self.seen:
            self.seen[number] = self.files.read_json(self.at(number))
            for old in sorted(self.seen)[:-8]:
                del self.seen[old]
        return self.seen[number]

    def decision(self, change: str) -> str | None:
        """``commit``, ``abort`` or, as yet, neither."""
        if change not in self.decided:
            path = f"{self.root}/_changes/{change}.json"
            if not self.files.exists(path):
                return None
            self.decided[change] = self.files.read_json(path)
        return self.decided[change]

    def last(self) -> tuple[int, dict | None, dict | None]:
        """(the highest number given, the record in force, a record above it that waits for its decision)."""
        numbers, waiting = self.numbers(), None
        for n in reversed(numbers):
            r = self.record(n)
            verdict = self.decision(r["change"]) if r.get("change") else "commit"
            if verdict == "commit":
                return numbers[-1], r, waiting
            waiting = r if verdict is None else waiting
        return (numbers[-1] if numbers else 0), None, waiting

    def settled(self) -> tuple[int, dict | None]:
        """As ``last``, once no change is under way; one that outlives its lease is called off."""
        while True:
            number, record, waiting = self.last()
            if waiting is None:
                return number, record
            if time.time() > waiting["began"] + self.lease:
                decide(self.files, self.root, waiting["change"], "abort")
            else:
                time.sleep(0.05 + 0.1 * random.random())

    def put(self, number: int, record: dict) -> bool:
        """Whether ``record`` got the number."""
        done = self.files.create_json(self.at(number), record)
        if done:
            self.seen[number] = record
            if number % 64 == 0:
                self._forget(number)
        return done

    def _forget(self, number: int) -> None:
        """Numbers far below the last one go, once they are so old that no writer can still take one of them for free."""
        for n in self.numbers():
            if n < number - 64 and self.files.age(self.at(n)) > KEEP_FOR:
                self.files.delete(self.at(n))

    def commit(self, make: Callable[[dict | None], dict]) -> dict:
        """Put ``make(record in force)`` next, again and again until nobody is faster; ``make`` may raise ``Conflict``."""
        while True:
            number, record = self.settled()
            new = make(record)
            if self.put(number + 1, new):
                return new


def decide(files: Files, root: str, change: str, verdict: str) -> bool:
    """Whether ``verdict`` is what holds: the first one does."""
    path = f"{root}/_changes/{change}.json"
    return files.create_json(path, verdict) or files.read_json(path) == verdict


def commit_together(files: Files, root: str, makers: list[tuple[Log, Callable[[dict | None], dict]]], unchanged: Callable[[str], bool]) -> list[dict]:
    """Put a record into each log, all in force at once or none.

    ``unchanged(change)`` is asked after all are in place and before the decision: whether what was only read still
    stands, undecided records of others counting as changes. Of two writers who each read what the other writes, at least one sees the other.
    """
    change, began, out = uuid.uuid4().hex, time.time(), []
    try:
        for log, make in sorted(makers, key=lambda m: m[0].folder):
            out.append(log.commit(lambda record, make=make: {**make(record), "change": change, "began": began}))
        if not unchanged(change):
            raise Conflict("what this change read was changed by another writer")
        if not decide(files, root, change, "commit"):
            raise Conflict("this change took too long and was called off by another writer")
    except BaseException as e:
        e.committed = not decide(files, root, change, "abort")  # it may have happened after the decision
        raise
    return out
