"""Results kept beside the tables, by what was asked and by the state of every table that was looked at.

Files of a snapshot never change, so the names of a table's parts say what it holds: a commit, whoever makes it, leads to
another state and so to another result, and nobody has to be told. Small documents (counts, ranges, hashes) are JSON files
``_results/<question>/<state>.json``, rows are Parquet folders ``_results/<question>/<state>/r-<name>``. Both are written in
one step, several writers of one result do no harm, and a result lost or half written is computed again. Results of states
gone by are deleted when a newer one is kept: documents at once, rows after as long as files of no snapshot stay.

Tables of our own have such a state always; plain files (their sizes and times) only where a folder for results is named,
as theirs may be read only; what other systems hold has none, and is asked anew each time.
"""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .store import Store

#: Settings of a session on which the values of a result depend.
SETTINGS = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive", "spark.sql.timestampType")
PLACE = "_lk_place"


def packed(v: Any) -> Any:
    """A value as JSON from which ``unpacked`` makes the same value; TypeError for kinds that have no such form."""
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return {"float": v.hex()}
    if isinstance(v, decimal.Decimal):
        return {"decimal": str(v)}
    if isinstance(v, datetime.datetime):
        return {"datetime": v.isoformat()}
    if isinstance(v, datetime.date):
        return {"date": v.isoformat()}
    if isinstance(v, (bytes, bytearray)):
        return {"binary": bytes(v).hex()}
    if isinstance(v, dict):
        return {"dict": [[packed(k), packed(x)] for k, x in v.items()]}
    if type(v) in (list, tuple):
        return {"list": [packed(x) for x in v]}
    raise TypeError(f"no plain form of {type(v).__name__}")


def unpacked(v: Any) -> Any:
    if not isinstance(v, dict):
        return v
    (kind, x), = v.items()
    if kind == "dict":
        return {unpacked(k): unpacked(y) for k, y in x}
    if kind == "list":
        return [unpacked(y) for y in x]
    return {"float": float.fromhex, "decimal": decimal.Decimal, "datetime": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat, "binary": bytearray.fromhex}[kind](x)


def _digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value).encode()).hexdigest()[:40]


def repeatable(df: DataFrame) -> bool:
    """Whether another run over the same tables gives the same rows: no chance, no clock, no user, and no function from outside."""
    patterns = df.sparkSession._jvm.org.apache.spark.sql.catalyst.trees.TreePattern
    plan = df._jdf.queryExecution().analyzed()
    return plan.deterministic() and not any(plan.containsPattern(p) for p in (patterns.CURRENT_LIKE(), patterns.PYTHON_UDF(), patterns.SCALA_UDF()))


class Results:
    def __init__(self, store: Store, root: str | None = None):
        self.store, self.given = store, root
        self.root = root.rstrip("/") if root else f"{store.root}/_results"

    def question(self, what: Any) -> str | None:
        """A name for what is asked, under the session's settings; None if it holds what has no plain form (such as a DataFrame)."""
        conf = self.store.spark.conf
        try:
            return _digest([packed(what), self.store.spark.version, self.store.root, *[conf.get(s, None) for s in SETTINGS]])
        except TypeError:
            return None

    def state(self, tables: Iterable[tuple[str, str]], now: bool = False) -> str | None:
        """A name for what the tables hold, as this statement sees them (plain files: at its first look, or ``now``); None if that can't be told."""
        found = []
        for at in sorted(set(tables)):
            if (meta := self.store.record(*at)) is not None:
                found.append([at, meta.get("home"), meta.get("parts") or [], [[k, c["type"]] for k, c in meta["columns"].items()]])
            elif plain := self.store._plain(*at):
                if not self.given:
                    return None
                found.append([at, self.store.stamps(*at, plain, now)])
            elif self.store.kind != "files":
                return None
            else:
                found.append([at, None])  # looked for, and not there
        return _digest(found) if found else None

    def document(self, what: Any, tables: Iterable[tuple[str, str]], make: Callable[[], Any]) -> Any:
        """``make()``, a small value, or what it gave for the same question and state."""
        question, state = self.question(what), self.state(tables)
        if question is None or state is None:
            return make()
        files, folder = self.store.files, f"{self.root}/{question}"
        if f"{state}.json" in (names := files.names(folder)):
            try:
                return unpacked(files.read_json(f"{folder}/{state}.json"))
            except Exception:
                if files.exists(f"{folder}/{state}.json"):
                    raise  # otherwise it went in between
        value = make()
        try:
            body = packed(value)
        except TypeError:
            return value
        if self.state(tables, now=True) != state:  # plain files were changed meanwhile
            return value
        files.create_json(f"{folder}/{state}.json", body)
        for n in names:
            if n.endswith(".json") and n != f"{state}.json":
                files.delete(f"{folder}/{n}")
        return value

    def rows(self, what: Any, tables: Iterable[tuple[str, str]], df: DataFrame) -> DataFrame:
        """The rows of ``df``, read from where they were kept for the same question and state, or kept now; in the same order if it has one.

        As they are where they can't be kept: question or state unknown, rows not repeatable, columns that Parquet doesn't hold.
        """
        question, state = self.question(what), self.state(tables)
        kinds = [f.dataType.simpleString() for f in df.schema]
        names = [c.lower() for c in df.columns]
        if question is None or state is None or len(set(names)) < len(names) or not names or any("void" in k or k == "interval" for k in kinds) or not repeatable(df):
            return df
        at = f"{self.root}/{question}/{state}"
        ordered = not df._jdf.queryExecution().optimizedPlan().outputOrdering().isEmpty()
        kept = df.select("*", F.monotonically_increasing_id().alias(PLACE)) if ordered else df
        if (held := self._held(at)) is None:
            held = f"{at}/r-{uuid.uuid4().hex}"
            kept.write.parquet(held)
            if self.state(tables, now=True) != state:
                self.store.files.delete(held)
                return df
            self._forget_before(question, state)
        elif self.store.files.exists(f"{at}/_stale"):
            self.store.files.delete(f"{at}/_stale")
        found = self.store.spark.read.schema(kept.schema).parquet(held)
        return found.orderBy(PLACE).drop(PLACE) if ordered else found

    def _held(self, at: str) -> str | None:
        files = self.store.files
        return next((f"{at}/{n}" for n in files.names(at) if files.exists(f"{at}/{n}/_SUCCESS")), None)

    def _forget_before(self, question: str, state: str) -> None:
        """Rows of other states are marked, and deleted once the mark is old enough for their readers to be through."""
        from .store import RETAIN

        files, folder = self.store.files, f"{self.root}/{question}"
        for n in files.names(folder):
            if n != state and not n.endswith(".json") and not files.create_json(f"{folder}/{n}/_stale", {}) and files.age(f"{folder}/{n}/_stale") > RETAIN:
                files.delete(f"{folder}/{n}")

    def clear(self) -> None:
        """All that is kept goes, also what readers still read."""
        self.store.files.delete(self.root)
