"""Whole correlation rules on a stream of events.

Events are tagged as in a batch: as history of searches and as triggers of rules,
under the columns by which they are searched.  Each such key has state: its
history counted in buckets of time, and the triggers that wait.  A trigger is
judged by a timer, once the watermark says that all before it has come; so rows
out of order, within the allowed lateness, change nothing, and the alerts are
those of ``evaluate_all`` over the same events.  Later rows are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from ..functions.text import tokens
from ..operators.rules import Lookback, Rule, _condition, _key, _micros, _options, _scored, seconds

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_OUT = "uid string, rule int, clause int, row string"
#: Buckets of time within a search's span.
BUCKETS = 16


def agrees(past: list, own: list, unlike: int, matching: int) -> bool:
    """Whether a history row's other columns go with a trigger's: the first
    ``unlike`` of them differ, the next ``matching`` share a word, the rest none."""
    for i, (h, t) in enumerate(zip(past, own)):
        if i < unlike:
            if h is not None and h == t:
                return False
        elif bool(set(h or ()) & set(t or ())) != (i < unlike + matching):
            return False
    return True


class RuleState(StatefulProcessor):
    """State of one key: ``counts`` and ``times`` by bucket, ``waiting`` by due time."""

    def __init__(self, probes: list[dict], spans: list[int]):
        self.probes, self.spans = probes, spans

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "bucket bigint", "n bigint")
        self.times = handle.getMapState("times", "bucket bigint", "at array<bigint>, extra array<string>")
        self.waiting = handle.getMapState("waiting", "due bigint", "at array<bigint>, probe array<int>, uid array<string>, extra array<string>, row array<string>")

    def width(self, key) -> int:
        return max(1, self.spans[json.loads(key[0])[0]] // BUCKETS)

    def handleInputRows(self, key, rows, timerValues):
        width = self.width(key)
        past: dict[int, tuple[list, list]] = {}
        due: dict[int, tuple[list, ...]] = {}
        for table in rows:
            for at, probe, uid, extra, row in zip(table["at"], table["probe"], table["uid"], table["extra"], table["row"]):
                if probe < 0:
                    held = past.setdefault(int(at) // width, ([], []))
                    held[0].append(int(at))
                    held[1].append(extra)
                else:
                    waits = due.setdefault(int(at) // 1000 + 1, ([], [], [], [], []))
                    for column, value in zip(waits, (int(at), int(probe), uid, extra, row)):
                        column.append(value)
        for bucket, (at, extra) in past.items():
            old = self.times.getValue((bucket,))
            at, extra = ([*old[0], *at], [*old[1], *extra]) if old else (at, extra)
            self.times.updateValue((bucket,), (at, extra))
            self.counts.updateValue((bucket,), (len(at),))
        for when, columns in due.items():
            old = self.waiting.getValue((when,))
            self.waiting.updateValue((when,), tuple([*o, *c] for o, c in zip(old, columns)) if old else columns)
            self.handle.registerTimer(when)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        width, when = self.width(key), expiredTimerInfo.getExpiryTimeInMs()
        waits, out = self.waiting.getValue((when,)), []
        for at, number, uid, extra, row in zip(*waits) if waits else ():
            probe = self.probes[number]
            if self.count(int(at), probe, extra, width) >= probe["count"]:
                out.append((uid, probe["rule"], probe["clause"], row))
        if waits:
            self.waiting.removeKey((when,))
        # timers come in the order of their times, so nothing due looks further back
        self.forget((when - 1) * 1000 - self.spans[json.loads(key[0])[0]], width)
        if out:
            yield pd.DataFrame({c: pd.Series(v, dtype="int32" if i in (1, 2) else object) for i, (c, v) in enumerate(zip(("uid", "rule", "clause", "row"), zip(*out)))})

    def count(self, at: int, probe: dict, extra: str, width: int) -> int:
        first, last, n = (at - probe["span"]) // width, at // width, 0
        plain = not probe["others"]
        own = None if plain else json.loads(extra)
        for bucket in range(first, last + 1):
            if plain and first < bucket < last:  # whole buckets are only counted
                held = self.counts.getValue((bucket,))
                n += held[0] if held else 0
                continue
            held = self.times.getValue((bucket,))
            for then, other in zip(*held) if held else ():
                if at - probe["span"] <= then <= at:
                    n += 1 if plain else agrees(json.loads(other), own, probe["unlike"], probe["matching"])
        return n

    def forget(self, before: int, width: int) -> None:
        for bucket in [b[0] for b in self.counts.keys()]:
            if (bucket + 1) * width <= before:
                self.counts.removeKey((bucket,))
                self.times.removeKey((bucket,))

    def close(self) -> None:
        pass


def rule_hits(events: DataFrame, rules: Sequence[Rule], late: str, ts: str = "ts") -> tuple[DataFrame, list[int]]:
    """(stream of (uid, rule, clause, row) for each clause that a trigger meets, the
    number of clauses of each rule).  Rows of a trigger come in one micro-batch.

    Every search needs a time to look back, as state would grow without end.
    """
    kinds = dict(events.dtypes)
    groups: dict[tuple, int] = {}
    tags, probes, spans, clauses = [], [], [], []
    numbered = events.withWatermark(ts, late).withColumn("__uid", F.expr("uuid()"))
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]), _STAMP)
    tag = lambda group, keys, probe, extra, whole: F.struct(F.when(~F.exists(keys, lambda k: k.isNull()), F.to_json(F.struct(F.lit(group).alias("g"), keys.alias("k")))).alias("key"), F.lit(probe).alias("probe"), extra.alias("extra"), whole.alias("row"))
    none = F.lit(None).cast("string")
    for i, rule in enumerate(rules):
        asked = [look for look in rule.lookbacks if all(o.count > 0 for o in _options(look))]
        clauses.append(max(1, len(asked)))
        for c, look in enumerate(asked or [None]):
            for option in _options(look) if look else [Lookback({}, "1ms", 0)]:
                span = seconds(option.within)
                if span is None:
                    raise ValueError(f"no time to look back: {option.within!r}")
                others = [*option.unlike.items(), *option.matching.items(), *option.unmatching.items()]
                if option.count <= 0:  # met by the trigger itself
                    others = []
                condition = _condition(option) if look else F.lit(False)
                same = (tuple(option.on), tuple(h for h, _ in others), len(option.unlike), str(condition))
                if same not in groups:
                    groups[same] = len(groups)
                    spans.append(0)
                    tags.append(F.when(condition, tag(groups[same], _key(list(option.on), kinds), -1, _extra([h for h, _ in others], len(option.unlike)), none)))
                group = groups[same]
                spans[group] = max(spans[group], round(span * 1_000_000))
                tags.append(F.when(rule.where, tag(group, _key(list(option.on.values()), kinds) if look else F.array("__uid"), len(probes), _extra([t for _, t in others], len(option.unlike)), row)))
                probes.append({"rule": i, "clause": c, "count": option.count, "span": round(span * 1_000_000), "unlike": len(option.unlike), "matching": len(option.matching), "others": len(others)})
    made = numbered.select(F.col(ts), _micros(events, ts).alias("at"), F.col("__uid").alias("uid"), F.explode(F.array_compact(F.array(*tags))).alias("t"))
    made = made.select(ts, "at", "uid", "t.probe", "t.extra", "t.row", _state_key(F.col("t.key")).alias("key")).filter("key IS NOT NULL AND at IS NOT NULL")
    hits = made.groupBy("key").transformWithStateInPandas(RuleState(probes, spans), _OUT, "append", "eventtime")
    return hits, clauses


def _state_key(key):
    """``[group, keys]`` from the struct's JSON."""
    parsed = F.from_json(key, "g int, k array<string>")
    return F.when(key.isNotNull(), F.concat(F.lit("["), parsed["g"].cast("string"), F.lit(","), F.to_json(parsed["k"]), F.lit("]")))


def _extra(columns: Sequence[str], unlike: int):
    """Other columns of a search as JSON: values, then lists of words."""
    if not columns:
        return F.lit(None).cast("string")
    parts = [F.coalesce(F.to_json(F.struct(F.col(c).cast("string").alias("v") if i < unlike else tokens(F.col(c)).alias("v"))), F.lit("{}")) for i, c in enumerate(columns)]
    values = [F.coalesce(F.regexp_extract(p, r'(?s)^\{"v":(.*)\}$', 1), F.lit("")) for p in parts]
    values = [F.when(v == "", F.lit("null")).otherwise(v) for v in values]
    return F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]"))


def alerts_of(hits: DataFrame, rules: Sequence[Rule], clauses: Sequence[int], schema) -> DataFrame:
    """Alerts from the clauses met in one micro-batch."""
    needed = F.element_at(F.array(*[F.lit(n) for n in clauses]), F.col("rule") + 1)
    whole = hits.groupBy("uid", "rule").agg(F.count_distinct("clause").alias("n"), F.first("row").alias("row")).filter(F.col("n") == needed)
    rows = whole.select(F.from_json("row", schema, _STAMP).alias("row"), F.col("rule").alias("__rule"))
    return _scored(rows.select("row.*", "__rule"), rules, F.col("__rule")).drop("__rule")


def run_rules(events: DataFrame, rules: Sequence[Rule], write: Callable[[DataFrame, int], None], checkpoint: str, late: str = "10 minutes", ts: str = "ts", trigger: dict | None = None):
    """Start the rules on a stream; ``write(alerts, batch)`` gets those of each batch.

    A batch that is run again after a failure gives the same alerts under its
    number, so a sink that keeps the numbers it has seen loses and repeats nothing.
    """
    hits, clauses = rule_hits(events, rules, late, ts)
    schema = events.schema
    session = events.sparkSession
    with keyed_state(session):
        stream = hits.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        return stream.foreachBatch(lambda df, n: write(alerts_of(df, rules, clauses, schema), n)).start()


@contextmanager
def keyed_state(session):
    """Queries started inside keep their state in RocksDB, as state by key needs."""
    before = session.conf.get(_PROVIDER, None)
    session.conf.set(_PROVIDER, _ROCKS)  # read when a query starts
    try:
        yield
    finally:
        if before is None:
            session.conf.unset(_PROVIDER)
        else:
            session.conf.set(_PROVIDER, before)


class FoldState(StatefulProcessor):
    """Runs of alerts of one key: the last time and first id, and what waits."""

    def __init__(self, span: int | None):
        self.span = span

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last bigint, first string")
        self.waiting = handle.getMapState("waiting", "due bigint", "at array<bigint>, id array<string>, row array<string>")

    def handleInputRows(self, key, rows, timerValues):
        due: dict[int, tuple[list, list, list]] = {}
        for table in rows:
            for at, name, row in zip(table["at"], table["id"], table["row"]):
                waits = due.setdefault(int(at) // 1000 + 1, ([], [], []))
                for column, value in zip(waits, (int(at), name, row)):
                    column.append(value)
        for when, columns in due.items():
            old = self.waiting.getValue((when,))
            self.waiting.updateValue((when,), tuple([*o, *c] for o, c in zip(old, columns)) if old else columns)
            self.handle.registerTimer(when)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        when = expiredTimerInfo.getExpiryTimeInMs()
        waits = self.waiting.getValue((when,))
        last, first = self.run.get() if self.run.exists() else (None, None)
        out = []
        for at, name, row in sorted(zip(*waits), key=lambda x: (x[0], json.loads(x[1]))) if waits else ():
            if last is None or (self.span is not None and at - last > self.span):
                first, parent = name, None
            else:
                parent = first
            last = at
            out.append((row, None if parent == name else parent))
        if waits:
            self.waiting.removeKey((when,))
            self.run.update((last, first))
            if self.span is not None:
                self.handle.registerTimer((last + self.span) // 1000 + 2)
        elif last is not None and self.span is not None and last + self.span < when * 1000:
            self.run.clear()  # whatever comes begins a new run
        if out:
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(("row", "parent"), zip(*out))})

    def close(self) -> None:
        pass


def fold_stream(alerts: DataFrame, by: Sequence[str], within: str, late: str, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """``fold_alerts`` on a stream: each alert, once the watermark has passed it, with
    ``parent_id``, the id of the first of its run.  Start it in ``keyed_state``.  A
    run's state goes once no alert can join it; without a bound it stays, a row a key."""
    bound = seconds(within)
    kind = alerts.schema[key].dataType
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in alerts.columns]), _STAMP)
    name = F.regexp_extract(F.to_json(F.struct(F.col(key).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    made = alerts.withWatermark(ts, late).filter(F.col(ts).isNotNull() & F.col(key).isNotNull())
    made = made.select(ts, F.to_json(F.struct(*by)).alias("by"), _micros(alerts, ts).alias("at"), name.alias("id"), whole.alias("row"))
    state = FoldState(None if bound is None else round(bound * 1_000_000))
    out = made.groupBy("by").transformWithStateInPandas(state, "row string, parent string", "append", "eventtime")
    rows = out.select(F.from_json("row", alerts.schema, _STAMP).alias("row"), F.from_json(F.concat(F.lit('{"v":'), "parent", F.lit("}")), StructType().add("v", kind))["v"].alias("parent_id"))
    return rows.select("row.*", "parent_id")
