"""Workflows: named databases and lists of steps, from YAML or JSON, with templates."""

from __future__ import annotations

import datetime
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import SparkSession

from ..database import Database
from . import sqltext

SPLIT = 5000
_TEMPLATE = re.compile(r"\{\{\s*([^}?]+?)\s*(\?)?\s*\}\}")
MISSING = object()


class ConfigError(ValueError):
    """A configuration that can't be used."""


def read_config(path: str) -> dict:
    with open(path) as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("YAML needs the yaml package; JSON always works") from e
        return yaml.safe_load(text)


def lookup(context: Any, path: str) -> Any:
    for part in path.split("."):
        if callable(context):
            context = context(part)
        elif isinstance(context, dict) and part in context:
            context = context[part]
        elif isinstance(context, list) and part.isdigit() and int(part) < len(context):
            context = context[int(part)]
        else:
            return MISSING
    return context


def hydrate(value: Any, context: dict) -> Any:
    """Fill ``{{ path }}``; ``{{ path? }}`` may be missing (None). A key that names a list repeats its value for each item."""
    if isinstance(value, dict):
        out: dict = {}
        for k, v in value.items():
            m = _TEMPLATE.fullmatch(k) if isinstance(k, str) else None
            keys = _value(m, context) if m else hydrate(k, context)
            for key in keys if isinstance(keys, list) else [keys]:
                if key is not None:
                    out[key] = hydrate(v, {**context, "item": key} if m else context)
        return out
    if isinstance(value, list):
        return [hydrate(v, context) for v in value]
    if not isinstance(value, str):
        return value
    if m := _TEMPLATE.fullmatch(value):
        return _value(m, context)
    return _TEMPLATE.sub(lambda m: str(v) if (v := _value(m, context)) is not None else "", value)


def _value(m: re.Match, context: dict) -> Any:
    found = lookup(context, m[1])
    if found is MISSING:
        if m[2]:
            return None
        raise ConfigError(f"nothing is called {m[1]}")
    return found


def get_config(config: Any, resolvers: dict[str, Callable[[str], Any]] | None = None, env: dict | None = None) -> dict:
    """A configuration with its templates filled from the environment (``env.NAME``) and from ``resolvers``, such as a secret store."""
    config = read_config(config) if isinstance(config, str) else config
    return hydrate(config, {"env": dict(os.environ if env is None else env), **(resolvers or {}), "config": config})


class Workflow:
    """Runs the steps of one workflow in order and returns their results."""

    KINDS = {"copy": "copy", "sync": "copy", "diff": "diff", "compare": "diff", "info": "info", "inspect": "info", "query": "query", "sql": "query"}

    def __init__(self, spark: SparkSession, config: dict, name: str, verbose: bool = False, debugger: Callable[[], None] | None = None):
        workflows = config.get("workflows", {})
        if name not in workflows:
            raise ConfigError(f"no workflow {name}")
        given = workflows[name]
        self.steps = given["steps"] if isinstance(given, dict) else given
        self.spark, self.config, self.verbose, self.debugger = spark, config, verbose, debugger
        self.open: dict[tuple, Database] = {}

    def database(self, name: str, tag: str | None = None) -> Database:
        """A database of the configuration, or a URL as it is."""
        if (name, tag) not in self.open:
            known = self.config.get("databases", {})
            given = known.get(name, name if "/" in name or ":" in name else None)
            if given is None:
                raise ConfigError(f"no database {name}")
            given = {"url": given} if isinstance(given, str) else given
            self.open[name, tag] = Database(self.spark, given["url"], name, given.get("scope"), tag, verbose=self.verbose)
        return self.open[name, tag]

    def run(self) -> list:
        try:
            return [self.step(s) for s in self.steps]
        finally:
            for d in self.open.values():
                d.close()

    def step(self, step: dict) -> Any:
        kind, given = self._kind(step)
        if kind.startswith("?"):
            kind = kind[1:]
            (self.debugger or breakpoint)()
        if kind not in self.KINDS:
            raise ConfigError(f"unknown step: {kind}")
        if given.get("refresh"):
            for d in self.open.values():
                d.reset()
        return getattr(self, f"_{self.KINDS[kind]}")(given)

    def _kind(self, step: dict) -> tuple[str, dict]:
        if "type" in step:
            return step["type"], step
        for k, v in step.items():
            if k.lstrip("?") in self.KINDS:
                if isinstance(v, dict) and k.lstrip("?") != "query":
                    return k, {**v, **{a: b for a, b in step.items() if a != k}}
                return k, {"query": v, **step} if k.lstrip("?") == "sql" else step
        raise ConfigError(f"a step names its type: {step!r}")

    def _copy(self, s: dict) -> dict:
        began = time.time()
        out = self.database(s["source"], "source").copy(self.database(s["target"], "target"), s.get("scope"), check_all=s.get("check_all", True), final_diff=s.get("final_diff", True), exclude=s.get("exclude"))
        return {**out, "duration": f"{time.time() - began:.2f} seconds"}

    def _diff(self, s: dict) -> Any:
        options = {k: s[k] for k in ("data", "schema", "hashes", "exclude") if k in s}
        return self.database(s["source"], "source").diff(self.database(s["target"], "target"), s.get("scope"), **options)

    def _info(self, s: dict) -> dict:
        options = {k: s[k] for k in ("data", "schema", "hashes", "exclude") if k in s}
        return self.database(s["source"]).get_info(s.get("scope"), **options)

    def _query(self, s: dict) -> Any:
        db, fetch = self.database(s["source"]), s.get("fetch", False)
        results = [self._fetch(db, q, fetch) for q in ([s["query"]] if not s.get("split") else split_query(db, s["query"], s["split"]))]
        return results if s.get("split") else results[0]

    @staticmethod
    def _fetch(db: Database, q: Any, fetch: Any) -> Any:
        if fetch == "one":
            row = db.query_one_row(q)
            return row.asDict() if row is not None else None
        if fetch:
            return [r.asDict() for r in db.query(q)]
        out = db.execute(q)
        if isinstance(out, int) or out is None:
            return out
        out.write.format("noop").mode("overwrite").save()
        return None


def split_query(db: Database, query: Any, split: Any) -> Iterator[Any]:
    """The query once for each range of a column: ``{on, size, skip, after: {every, query}}``; sizes are seconds for times."""
    split = {"on": split} if isinstance(split, str) else split
    size, skip, after = split.get("size", SPLIT), split.get("skip", 0), split.get("after")
    on = split["on"]
    table, _, column = on.rpartition(".")
    if not table:
        clause = query[next(iter(query))] if isinstance(query, dict) else None
        source = clause.get("from", clause.get("table")) if clause else re.search(r"\b(?:from|update|into)\s+([\w.]+)", query, re.I)[1]
        table = next(iter(source.values())) if isinstance(source, dict) else source
    lo, hi = db.query_one_row({"select": {"data": {"lo": {"min": column}, "hi": {"max": column}}, "from": table}})
    if lo is None:
        return
    step: Any = size
    if isinstance(lo, datetime.datetime):
        step = datetime.timedelta(seconds=size)
    elif isinstance(lo, datetime.date):
        step = datetime.timedelta(days=max(1, -(-size // 86400)))  # a date's ranges are whole days
    at, n = lo + step * skip, 0
    while at <= hi:
        if isinstance(query, str):
            show = lambda v: f"TIMESTAMP '{v}'" if isinstance(v, datetime.datetime) else f"DATE '{v}'" if isinstance(v, datetime.date) else str(v)
            yield sqltext.within(query, f"{on} >= {show(at)} AND {on} < {show(at + step)}")
        else:
            (command, clause), = query.items()
            both = [{">=": [on, {"literal": at}]}, {"<": [on, {"literal": at + step}]}]
            yield {command: {**clause, "where": {"and": [*([clause["where"]] if clause.get("where") is not None else []), *both]}}}
        at, n = at + step, n + 1
        if after and n % after.get("every", 1) == 0:
            yield after["query"]


def run_workflow(spark: SparkSession, name: str, config: Any, **options: Any) -> list:
    return Workflow(spark, get_config(config), name, **options).run()
