"""Steps of declarative log parsing.

Each step is a function from DataFrame to DataFrame; :func:`parse` runs them in
order.  A step with ``where`` touches only rows that meet it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import casts
from ..functions.record import engine_pattern, groups

Step = Callable[[DataFrame], DataFrame]


def parse(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    return reduce(lambda d, step: step(d), steps, df)


def parse_by_type(df: DataFrame, pipelines: dict[str, Sequence[Step]], column: str = "dataType") -> DataFrame:
    """Each row through the pipeline of its type; other types are left out."""
    parts = [parse(df.filter(F.col(column) == kind), steps) for kind, steps in pipelines.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _put(df: DataFrame, name: str, value: Column, where: Column | None) -> DataFrame:
    if where is None:
        return df.withColumn(name, value)
    old = F.col(name) if name in df.columns else F.lit(None)
    return df.withColumn(name, F.when(where, value).otherwise(old))


def kv(source: str, to: str, field_split: str = " ", value_split: str = "=", where: Column | None = None) -> Step:
    """A map of the key-value pairs of a text; the separators are literal."""
    literal = lambda s: re.sub(r"([^\w\s])", r"\\\1", s)
    return lambda df: _put(df, to, F.str_to_map(F.col(source), F.lit(literal(field_split)), F.lit(literal(value_split))), where)


def grok(source: str, patterns: Sequence[tuple[str, str]], templates: dict[str, str] | None = None, where: Column | None = None) -> Step:
    """Fields in sequence: each pattern is matched at the start of what the ones
    before left; ``{{name}}`` stands for a template."""

    def expand(p: str) -> str:
        for _ in range(10):
            p = re.sub(r"\{\{(\w+)\}\}", lambda m: (templates or {}).get(m[1], m[0]), p)
        return p

    def step(df: DataFrame) -> DataFrame:
        before = ""
        for name, pattern in patterns:
            held = groups(engine_pattern(before))  # counted by the engine that runs them
            if held is None or groups(engine_pattern(expand(pattern))) is None:
                raise ValueError(f"not a pattern: {pattern}")
            df = _put(df, name, F.regexp_extract(source, engine_pattern(f"^{before}({expand(pattern)})"), held + 1), where)
            before += f"(?:{expand(pattern)})"
        return df

    return step


def trim(fields: Sequence[str], function: str = "space", substring: str = "", where: Column | None = None) -> Step:
    """``prefix``, ``suffix``, ``both`` (of a substring) or ``space``."""
    literal = re.sub(r"([^\w\s])", r"\\\1", substring)
    patterns = {"prefix": f"^(?:{literal})", "suffix": f"(?:{literal})$", "both": f"^(?:{literal})|(?:{literal})$", "space": r"^\s+|\s+$"}
    pattern = patterns[function]
    return lambda df: reduce(lambda d, f: _put(d, f, F.regexp_replace(f, pattern, ""), where), fields, df)


def json(source: str, to: str, where: Column | None = None) -> Step:
    return lambda df: _put(df, to, F.try_parse_json(F.col(source)), where)


def csv(source: str, headers: Sequence[str], separator: str = ",", where: Column | None = None) -> Step:
    schema = ", ".join(f"`{h}` string" for h in headers)

    def step(df: DataFrame) -> DataFrame:
        df = df.withColumn("__csv", F.from_csv(F.col(source), schema, {"sep": separator}))
        return reduce(lambda d, h: _put(d, h, F.col(f"__csv.{h}"), where), headers, df).drop("__csv")

    return step


def xml(source: str, to: str, schema: str, where: Column | None = None) -> Step:
    return lambda df: _put(df, to, F.from_xml(F.col(source), schema), where)


def rename(to: str, sources: Sequence[str]) -> Step:
    """The first of the sources that has a value."""
    return lambda df: df.withColumn(to, F.coalesce(*[F.col(s) for s in sources])).drop(*[s for s in sources if s != to])


_CASTS = {"int": casts.cast_int64, "float": casts.cast_float64, "bool": casts.cast_bool, "string": casts.cast_string}


def cast(fields: Sequence[str], to: str, where: Column | None = None) -> Step:
    return lambda df: reduce(lambda d, f: _put(d, f, _CASTS[to](F.col(f).cast("string")), where), fields, df)


def reformat(fields: Sequence[str], from_format: str, to_format: str, where: Column | None = None) -> Step:
    """A time in another pattern; unreadable ones become null."""
    moment = lambda f: F.date_format(F.try_to_timestamp(F.col(f), F.lit(from_format)), to_format)
    return lambda df: reduce(lambda d, f: _put(d, f, moment(f), where), fields, df)


def delete(fields: Sequence[str]) -> Step:
    return lambda df: df.drop(*fields)


def drop(where: Column) -> Step:
    return lambda df: df.filter(~F.coalesce(where, F.lit(False)))


def add(name: str, value: Column, where: Column | None = None) -> Step:
    return lambda df: _put(df, name, value, where)


def expand(source: str, to: str) -> Step:
    """A row for each element of an array."""
    return lambda df: df.withColumn(to, F.explode_outer(source))


def dynamic(function: Step) -> Step:
    """A step of the user's own."""
    return function
