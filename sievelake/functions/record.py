"""Boolean functions over a JSON record column.

:class:`Record` wraps a VARIANT (or JSON string) column; its methods give
columns, to be combined with ``& | ~``.  Paths are dotted, a number steps into an
array (``contacts.0.type``).  A missing or unfit value gives false, never an
error or null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import net
from .casts import number

STAMP = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def json_path(path: str) -> str:
    """Dotted path as a JSON path."""
    out = "$"
    for step in path.split("."):
        if not step or any(c in step for c in "#*@|"):
            raise ValueError(f"unsupported path: {path}")
        out += f"[{step}]" if step.isdigit() else f".{step}" if re.fullmatch(r"[A-Za-z_]\w*", step) else f"['{step}']"
    return out


def engine_pattern(pattern: str) -> str:
    """A pattern as the engine spells it: ``(?P<name>`` is ``(?<name>``."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\(\?P<(\w+)>", lambda m: f"{m[1]}(?<{m[2].replace('_', 'U')}>", pattern)


def groups(pattern: str) -> int | None:
    """How many groups a pattern has for the engine that will run it; None where it
    refuses the pattern."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException

    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("patterns are checked by the session that runs them; start one first")
    try:
        return spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except (Py4JJavaError, IllegalArgumentException):
        return None


def compiles(pattern: str) -> bool:
    """Whether the engine that will run a pattern accepts it."""
    return groups(pattern) is not None


def where_record(df: DataFrame, column: str, condition: Callable[[Record], Column], **options) -> DataFrame:
    """Rows of ``df`` whose record meets a condition; each record is parsed once,
    however many of its fields the condition reads."""
    parsed = F.array(F.try_parse_json(F.col(column)))
    return df.filter(F.exists(parsed, lambda value: condition(Record(value, is_json=False, **options))))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _any(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


#: Functions of the user's own, by name.
_CUSTOM: dict[str, Callable[..., Column]] = {}


def register(name: str) -> Callable:
    """Decorate ``f(record, *args)``, which gives a column, as ``record.name(*args)``."""
    if not name.isidentifier() or hasattr(Record, name):
        raise ValueError(f"not a free name: {name}")

    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        _CUSTOM[name] = f
        return f

    return add


class Record:
    """Functions over one record column, and those that were registered."""

    def __getattr__(self, name: str) -> Callable[..., Column]:
        if name not in _CUSTOM:
            raise AttributeError(f"no such record function: {name}")
        return partial(_CUSTOM[name], self)

    def __init__(self, column: Column | str, templates: dict[str, str] | None = None, is_json: bool = True):
        column = F.col(column) if isinstance(column, str) else column
        self.value = F.try_parse_json(column) if is_json else column
        self.templates = templates or {}

    def _get(self, path: str, kind: str) -> Column:
        return F.try_variant_get(self.value, json_path(path), kind)

    def _kind(self, path: str) -> Column:
        return F.schema_of_variant(self._get(path, "variant"))

    def exists(self, path: str) -> Column:
        """Present, JSON null included."""
        return self._get(path, "variant").isNotNull()

    def text(self, path: str) -> Column:
        """The value if it is a string."""
        return F.when(self._kind(path) == "STRING", self._get(path, "string"))

    def boolean(self, path: str) -> Column:
        return F.when(self._kind(path) == "BOOLEAN", self._get(path, "boolean"))

    def number(self, path: str) -> Column:
        """The value if it is a number or a string that reads as one."""
        kind = self._kind(path)
        numeric = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$")
        return F.when(numeric, self._get(path, "double")).when(kind == "STRING", number(self._get(path, "string")))

    def printed(self, path: str) -> Column:
        """A scalar as it prints; null as the empty string."""
        kind = self._kind(path)
        return F.when(kind == "VOID", F.lit("")).when(~kind.rlike("^(OBJECT|ARRAY)"), self._get(path, "string"))

    def safe(self, path: str, default: Any) -> Column:
        """The value in the type of ``default``, else the default."""
        if isinstance(default, bool):
            return F.coalesce(self.boolean(path), F.lit(default))
        if isinstance(default, (int, float)):
            return F.coalesce(self.number(path), F.lit(float(default)))
        return F.coalesce(self.text(path), F.lit(default))

    def equals(self, path: str, target: Any) -> Column:
        """Numbers by value where both sides read as numbers, else like types,
        else a scalar's printed form against a string."""
        if isinstance(target, bool):
            return _sure(self.boolean(path) == target)
        if isinstance(target, (int, float)):
            return _sure(self.number(path) == float(target))
        printed = _sure(self.printed(path) == target)
        if re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", target):
            own = self.number(path)
            return F.when(own.isNotNull(), own == float(target)).otherwise(printed)
        return printed

    def equals_ignore_case(self, path: str, target: str) -> Column:
        return _sure(F.lower(self.text(path)) == target.lower())

    def one_of(self, path: str, targets: Sequence[Any]) -> Column:
        return _any([self.equals(path, t) for t in targets])

    def _texts(self, path: str, wanted: str | Sequence[str], test) -> Column:
        """A list matches by any of its trimmed items."""
        items = [wanted] if isinstance(wanted, str) else [w.strip() for w in wanted]
        return _sure(_any([test(self.text(path), w) for w in items]))

    def contains(self, path: str, wanted: str | Sequence[str]) -> Column:
        return self._texts(path, wanted, lambda t, w: t.contains(w))

    def contains_all(self, path: str, wanted: Sequence[str]) -> Column:
        """All items; an empty list holds for any string."""
        own = self.text(path)
        return _sure(reduce(lambda a, w: a & own.contains(w.strip()), wanted, own.isNotNull()))

    def starts_with(self, path: str, wanted: str | Sequence[str]) -> Column:
        return self._texts(path, wanted, lambda t, w: t.startswith(w))

    def ends_with(self, path: str, wanted: str | Sequence[str]) -> Column:
        return self._texts(path, wanted, lambda t, w: t.endswith(w))

    def in_cidr(self, path: str, network: str) -> Column:
        try:
            ends = net.network_range(network)
        except ValueError:
            return F.lit(False)
        return net.in_ranges(self.text(path), [ends])

    def regex_match(self, path: str, pattern: str) -> Column:
        """Somewhere in the string; ``{{name}}`` stands for a template; a pattern
        that the engine does not compile matches nothing.  Groups may be named
        ``(?P<name>...)``."""
        for _ in range(10):
            expanded = re.sub(r"\{\{(\w+)\}\}", lambda m: self.templates.get(m[1], m[0]), pattern)
            if expanded == pattern:
                break
            pattern = expanded
        pattern = engine_pattern(pattern)
        return _sure(self.text(path).rlike(pattern)) if compiles(pattern) else F.lit(False)

    def _compare(self, path: str, target: Any, test) -> Column:
        try:
            value = float(target)
        except (TypeError, ValueError):
            return F.lit(False)
        return _sure(test(self.number(path), F.lit(value)))

    def less_than(self, path: str, target) -> Column:
        return self._compare(path, target, lambda a, b: a < b)

    def greater_than(self, path: str, target) -> Column:
        return self._compare(path, target, lambda a, b: a > b)

    def less_or_equal(self, path: str, target) -> Column:
        return self._compare(path, target, lambda a, b: a <= b)

    def greater_or_equal(self, path: str, target) -> Column:
        return self._compare(path, target, lambda a, b: a >= b)

    def _stamp(self, path: str) -> Column:
        """The string if it is a time stamp; its own offset is kept."""
        own = self.text(path)
        valid = own.rlike(STAMP) & F.substring(own, 1, 10).try_cast("date").isNotNull()
        valid = valid & F.substring(own, 12, 2).try_cast("int").between(0, 23) & F.substring(own, 15, 2).try_cast("int").between(0, 59)
        return F.when(valid, own)

    def is_hour(self, path: str, hour: int) -> Column:
        return _sure(F.substring(self._stamp(path), 12, 2).cast("int") == hour)

    def is_minute(self, path: str, minute: int) -> Column:
        return _sure(F.substring(self._stamp(path), 15, 2).cast("int") == minute)

    def _day(self, path: str) -> Column:
        return F.dayofweek(F.substring(self._stamp(path), 1, 10).cast("date")) - 1

    def is_day_of_week(self, path: str, day: int) -> Column:
        """0 is Sunday."""
        return _sure(self._day(path) == day)

    def is_weekend(self, path: str) -> Column:
        return _sure(self._day(path).isin(0, 6))

    def is_work_day(self, path: str) -> Column:
        return _sure(self._day(path).between(1, 5))

    def is_between_time(self, path: str, start: str, end: str) -> Column:
        """Minutes of the day, both ends included; a later start wraps midnight."""
        try:
            a, b = (int(x[:2]) * 60 + int(x[3:5]) if re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d", x) else None for x in (start, end))
        except TypeError:
            return F.lit(False)
        if a is None or b is None:
            return F.lit(False)
        stamp = self._stamp(path)
        m = F.substring(stamp, 12, 2).cast("int") * 60 + F.substring(stamp, 15, 2).cast("int")
        return _sure(m.between(a, b) if a <= b else (m >= a) | (m <= b))


def to_json(value: dict) -> str:
    """A record literal."""
    return json.dumps(value)
