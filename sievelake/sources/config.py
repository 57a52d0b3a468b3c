"""Rules and pipelines from YAML.

A rule's ``where`` is a Spark SQL condition over the trigger's columns.  A search
lists conditions ``{field, operator, value}``; a value ``{{.path}}`` is a column of
the trigger and joins history to it, any other value filters the history.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

import yaml
from pyspark.sql import functions as F

from ..operators import parsing
from ..operators import predicates as P
from ..operators.rules import Lookback, Rule

_PLACEHOLDER = re.compile(r"^\{\{\s*\.?([\w.]+)\s*\}\}$")
#: Which comparison of history and trigger a condition with a placeholder is.
_JOINED = {"filter_term": "on", "must_not_term": "unlike", "filter_match": "matching", "must_not_match": "unmatching"}
_NEUTRAL = {"confidentiality": 0, "integrity": 0, "availability": 0}


def lookback(search: dict[str, Any]) -> Lookback:
    joined: dict[str, dict[str, str]] = {name: {} for name in _JOINED.values()}
    wanted, unwanted = [], []
    for condition in search.get("with", []):
        field, operator, value = condition["field"], condition["operator"], condition["value"]
        trigger = _PLACEHOLDER.match(value) if isinstance(value, str) else None
        if operator not in _JOINED:
            raise ValueError(f"unsupported condition: {condition}")
        if trigger:
            joined[_JOINED[operator]][field] = trigger[1]
        else:
            test = P.term(field, value) if operator.endswith("term") else P.match(field, str(value))
            (wanted if operator.startswith("filter") else unwanted).append(test)
    where = P.all_of(*wanted) if wanted else None
    either = tuple(lookback(s) for s in search.get("or", []))
    return Lookback(within=search.get("within", ""), count=int(search.get("count", 1)), where=where, must_not=tuple(unwanted), either=either, **joined)


def rule(config: dict[str, Any]) -> Rule:
    """``afterEvents`` is an older name of ``correlation``; no impact counts as none."""
    searches = config.get("correlation") or config.get("afterEvents") or []
    return Rule(config["name"], F.expr(config.get("where") or "true"), tuple(lookback(s) for s in searches), {**_NEUTRAL, **(config.get("impact") or {})})


def load_rules(text: str) -> list[Rule]:
    return [rule(c) for c in yaml.safe_load(text) or []]


def step(config: dict[str, Any], templates: dict[str, str]) -> parsing.Step:
    """One step of a pipeline: a mapping of its name to its arguments."""
    (name, args), args = next(iter(config.items())), dict(next(iter(config.values())) or {})
    condition = F.expr(args.pop("where")) if args.get("where") else None
    if name == "grok":
        pairs = [(p["fieldName"], p["pattern"]) for p in args["patterns"]]
        return parsing.grok(args["source"], pairs, templates, condition)
    if name == "drop":
        return parsing.drop(condition)
    if name == "add":
        return parsing.add(args["name"], F.expr(args["value"]), condition)
    if name in ("rename", "delete", "expand"):
        return getattr(parsing, name)(**args)
    if name in ("kv", "csv", "json", "xml", "trim", "cast", "reformat"):
        return getattr(parsing, name)(**args, where=condition)
    raise ValueError(f"no such step: {name}")


def load_pipelines(texts: Sequence[str]) -> dict[str, list[parsing.Step]]:
    """Pipelines by data type from several files: pipelines add up, patterns of a
    later file replace those of the same name."""
    files = [yaml.safe_load(t) or {} for t in texts]
    templates = {k: v for f in files for k, v in (f.get("patterns") or {}).items()}
    out: dict[str, list[parsing.Step]] = {}
    for f in files:
        for pipeline in f.get("pipeline", []):
            steps = [step(s, templates) for s in pipeline["steps"]]
            for kind in pipeline["dataTypes"]:
                out.setdefault(kind, []).extend(steps)
    return out
