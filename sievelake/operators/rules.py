"""Correlation rules: trigger events against earlier history.

A rule names trigger rows by a condition and asks for ``count`` earlier rows that
agree on columns, meet a condition and lie within a time before the trigger; or
for one of several such searches.  It runs as an interval join on the agreeing
columns, in batch or between streams; no search is made per event.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import written
from .predicates import all_of, none_of

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(duration: str) -> float | None:
    """``1h30m`` in seconds; None if it cannot be read, which means no bound."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", duration or "")
    if not parts or "".join(n + u for n, u in parts) != duration:
        return None
    return sum(float(n) * _UNITS[u] for n, u in parts)


@dataclass(frozen=True)
class Lookback:
    """One search: ``on`` maps history columns to trigger columns.

    ``unlike``, ``matching`` and ``unmatching`` do so too, for columns that must
    not be equal, must share a word, or must share none.
    """

    on: dict[str, str]
    within: str = ""
    count: int = 1
    where: Column | None = None
    must_not: tuple[Column, ...] = ()
    either: tuple[Lookback, ...] = ()
    unlike: dict[str, str] = field(default_factory=dict)
    matching: dict[str, str] = field(default_factory=dict)
    unmatching: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    name: str
    where: Column
    lookbacks: tuple[Lookback, ...] = ()
    severity: dict[str, int] = field(default_factory=lambda: {"confidentiality": 0, "integrity": 0, "availability": 0})


def _micros(df: DataFrame, ts: str) -> Column:
    """A time as microseconds."""
    if df.schema[ts].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(F.col(ts))


def _columns(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def _key(columns: Sequence[str], kinds: dict[str, str]) -> Column:
    """Values of columns as strings that are equal where the values are."""
    parts = [F.when(F.col(c) == 0, F.lit("0.0")).otherwise(F.col(c).cast("string")) if kinds[c] in ("float", "double") else F.col(c).cast("string") for c in columns]
    return F.array(*parts) if parts else F.array().cast("array<string>")


def _subsets(names: Sequence[str]) -> list[tuple[str, ...]]:
    return [c for n in range(len(names) + 1) for c in combinations(names, n)]


def _signed(look: Lookback) -> list[tuple[int, dict[str, str], dict[str, str]]]:
    """(sign, on, matching) of searches without negations that sum up to ``look``.

    Rows that differ in a column are all rows less those that agree in it; so
    what must not agree is counted without looking at pairs.
    """
    out = []
    for c in _subsets([*look.unlike, *(f"~{h}" for h in look.unmatching)]):
        on = {**look.on, **{h: look.unlike[h] for h in c if h in look.unlike}}
        words = {**look.matching, **{h[1:]: look.unmatching[h[1:]] for h in c if h.startswith("~")}}
        out.append(((-1) ** len(c), on, words))
    return out


def _condition(look: Lookback) -> Column:
    return all_of(*[c for c in (look.where, none_of(*look.must_not) if look.must_not else None) if c is not None])


def _tag(group: int, keys: Column, at: Column, past: int, probe: int = 0, sign: int = 0) -> Column:
    return F.struct(F.lit(group).alias("group"), keys.alias("keys"), at.alias("at"), F.lit(past).alias("past"), F.lit(probe).alias("probe"), F.lit(sign).alias("sign"))


def _probes(group: int, keys: Column, at: Column, span: float | None, probe: int, sign: int) -> list[Column]:
    """What lies within a time is what came up to its end less what came before it."""
    out = [_tag(group, keys, at, 0, probe, sign)]
    return out if span is None else [*out, _tag(group, keys, at - round(span * 1_000_000) - 1, 0, probe, -sign)]


#: Cells of time that a hot source is cut into.
CELLS = 1024


def _counts(tags: DataFrame, cells: int = CELLS) -> DataFrame:
    """(probe, id, hits), a row for each probe of tagged rows: history counted up
    to it, with its sign.

    Rows are dealt out by group, keys and a cell of time, so a source that holds
    most of them is in all tasks.  Cells end at quantiles of all times, so none is
    much fuller than the others, bursts included; a probe adds what the cells
    before its own hold, a row for each, and the exact count inside its own.
    """
    numbers = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")
    shares = numbers([i / cells for i in range(1, cells)] or [0.5], "double")
    edges = sorted(set(tags.agg(F.percentile_approx("at", shares, 20 * cells)).first()[0] or []))
    if edges:
        held = numbers(edges, "bigint")
        steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(edges).bit_length()))])
        cell = F.aggregate(steps, F.lit(0), lambda low, w: F.when(F.get(held, low + w - 1) <= F.col("at"), low + w).otherwise(low))
    else:
        cell = F.lit(0)
    cut = tags.withColumn("cell", cell)
    full = cut.filter("past = 1").groupBy("group", "keys", "cell").agg(F.count(F.lit(1)).alias("n"))
    # a probe's cell may hold no history: its base is that of the last cell before
    marks = cut.filter("past = 0").select("group", "keys", "cell", F.lit(0).cast("long").alias("n")).distinct()
    both = full.union(marks).groupBy("group", "keys", "cell").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("group", "keys").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = both.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("group", "keys", "cell").orderBy("at", F.desc("past")).rowsBetween(Window.unboundedPreceding, 0)
    found = cut.withColumn("seen", F.sum("past").over(inside)).filter("past = 0").join(base, ["group", "keys", "cell"])
    return found.select("probe", "id", (F.col("sign") * (F.col("seen") + F.col("base"))).alias("hits"))


_TAGGED = ("group", "keys", "at", "past", "probe", "sign")
_WHOLE_KEY = "at IS NOT NULL AND NOT exists(keys, k -> k IS NULL)"


def _spread(df: DataFrame, tags: Sequence[Column], *more: Column) -> DataFrame:
    """A row for each tag that is not null and has all its keys, with ``more``."""
    if not tags:
        tags = [F.when(F.lit(False), _tag(0, _key([], {}), F.lit(0).cast("long"), 1))]
    out = df.select(*more, F.explode(F.array_compact(F.array(*tags))).alias("t"))
    return out.select("*", *[F.col(f"t.{c}") for c in _TAGGED]).drop("t")


def related(triggers: DataFrame, history: DataFrame, look: Lookback, key: str, ts: str) -> DataFrame:
    """(key, hits): how many history rows each trigger finds; those without are absent.

    Triggers and history are counted along time (``_counts``), so a source with m
    rows costs m log m, not a row for each pair, and is spread over all tasks.
    Shared words make pairs, joined on the agreeing columns and a word.
    """
    past = history.filter(_condition(look)) if look.where is not None or look.must_not else history
    own = triggers.withColumn("__id", F.monotonically_increasing_id())
    span, parts = seconds(look.within), []
    plain = [(sign, on) for sign, on, words in _signed(look) if not words]
    at, then = _micros(own, ts), _micros(past, ts)
    kinds, own_kinds = _columns(past), _columns(own)
    groups = list(dict.fromkeys(tuple(on.items()) for _, on in plain))
    if plain:
        tags = [_tag(g, _key([h for h, _ in on], kinds), then, 1) for g, on in enumerate(groups)]
        probes = [p for sign, on in plain for p in _probes(groups.index(tuple(on.items())), _key(list(on.values()), own_kinds), at, span, 0, sign)]
        none = F.lit(None).cast("long").alias("id")
        both = _spread(past, tags, none).union(_spread(own, probes, F.col("__id").alias("id"))).filter(_WHOLE_KEY)
        parts.append(_counts(both).select(F.col("id").alias("__id"), "hits"))
    for sign, on, words in _signed(look):
        if words:
            parts.append(_sharing(own, past, on, words, span, ts).select("__id", (F.col("hits") * sign).alias("hits")))
    hits = reduce(DataFrame.union, parts).groupBy("__id").agg(F.sum("hits").alias("hits")).filter("hits > 0")
    return own.select("__id", key).join(hits, "__id").groupBy(key).agg(F.max("hits").alias("hits"))


def _sharing(own: DataFrame, past: DataFrame, on: dict[str, str], words: dict[str, str], span: float | None, ts: str) -> DataFrame:
    """(__id, hits) of history rows that agree on columns and share a word in
    others: an equi-join on the former and the words of the first of the latter."""
    (h, t), *others = words.items()
    left = own.select("__id", _micros(own, ts).alias("__at"), _key(list(on.values()), _columns(own)).alias("__k"), F.explode(F.array_distinct(tokens(F.col(t)))).alias("__w"), *[tokens(F.col(c)).alias(f"__t{i}") for i, (_, c) in enumerate(others)])
    rows = past.withColumn("__row", F.monotonically_increasing_id())
    right = rows.select("__row", _micros(rows, ts).alias("__then"), _key(list(on), _columns(rows)).alias("__k"), F.explode(F.array_distinct(tokens(F.col(h)))).alias("__w"), *[tokens(F.col(c)).alias(f"__h{i}") for i, (c, _) in enumerate(others)])
    pairs = left.join(right, ["__k", "__w"]).filter("__then <= __at AND NOT exists(__k, k -> k IS NULL)")
    if span is not None:
        pairs = pairs.filter(F.col("__then") >= F.col("__at") - round(span * 1_000_000))
    for i in range(len(others)):
        pairs = pairs.filter(F.arrays_overlap(f"__t{i}", f"__h{i}"))
    return pairs.select("__id", "__row").distinct().groupBy("__id").agg(F.count(F.lit(1)).alias("hits"))


def satisfied(triggers: DataFrame, history: DataFrame, look: Lookback, key: str, ts: str) -> DataFrame:
    """Keys of triggers for which the search, or one of its alternatives, succeeds."""
    if look.count <= 0:
        return triggers.select(key).distinct()
    found = related(triggers, history, look, key, ts).filter(F.col("hits") >= look.count).select(key)
    for other in look.either:
        found = found.union(satisfied(triggers, history, other, key, ts))
    return found.distinct() if look.either else found


def _scored(alerts: DataFrame, rules: Sequence[Rule], index: Column) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(r.name) for r in rules]), index + 1)
    scores = F.element_at(F.array(*[F.lit(impact_score(**r.severity)) for r in rules]), index + 1)
    return alerts.withColumns({"rule": names, "impact_score": scores})


def _by_words(look: Lookback) -> bool:
    return bool(look.matching or look.unmatching) or any(_by_words(o) for o in look.either)


def _options(look: Lookback) -> list[Lookback]:
    """A search and all its alternatives: one of them is enough."""
    return [look, *[x for o in look.either for x in _options(o)]]


def evaluate(rule: Rule, events: DataFrame, key: str = "event_id", ts: str = "ts", history: DataFrame | None = None) -> DataFrame:
    """Trigger rows of ``events`` for which all searches succeed, as alerts."""
    if not any(_by_words(look) for look in rule.lookbacks):
        return evaluate_all([rule], events, key=key, ts=ts, history=history)
    history = events if history is None else history
    alerts = events.filter(rule.where)
    for look in rule.lookbacks:
        alerts = alerts.join(satisfied(alerts, history, look, key, ts), key, "left_semi")
    return _scored(alerts, [rule], F.lit(0))


def evaluate_all(rules: Sequence[Rule], events: DataFrame, disabled: Sequence[str] = (), key: str = "event_id", ts: str = "ts", history: DataFrame | None = None) -> DataFrame:
    """Alerts of all rules that are not disabled.

    The events are read once for all rules together: each row is tagged as the
    history of searches and the trigger of rules, searches that ask for the same
    columns and conditions share their history, and all are counted in one pass.
    Only rules that compare words run each for itself.
    """
    active = [r for r in rules if r.name not in set(disabled)]
    alone = [any(_by_words(look) for look in r.lookbacks) for r in active]
    shared = [r for r, words in zip(active, alone) if not words]
    out = _evaluate_shared(shared, events, ts, history) if shared else None
    for rule in (r for r, words in zip(active, alone) if words):
        alerts = evaluate(rule, events, key, ts, history)
        out = alerts if out is None else out.unionByName(alerts)
    if out is None:
        return events.limit(0).withColumn("rule", F.lit("")).withColumn("impact_score", F.lit(0.0))
    return out


def _evaluate_shared(rules: Sequence[Rule], events: DataFrame, ts: str, history: DataFrame | None) -> DataFrame:
    if not any(r.lookbacks for r in rules):
        met = F.array_compact(F.array(*[F.when(r.where, F.lit(i)) for i, r in enumerate(rules)]))
        return _scored(events.withColumn("__rule", F.explode(met)), rules, F.col("__rule")).drop("__rule")
    kinds = _columns(events if history is None else history)
    own_kinds, at = _columns(events), _micros(events, ts)
    then = at if history is None else _micros(history, ts)
    groups: dict[tuple, int] = {}
    sets: dict[tuple, int] = {}
    asked: dict[tuple[int, int, int], int] = {}  # (group, set, back): what is counted, once for all rules
    clauses: dict[tuple, int] = {}  # a search and its alternatives: (least, signed counts) of each
    past, needs, used = [], [], []
    for rule in rules:
        needs.append([])
        used.append([])
        for look in (look for look in rule.lookbacks if all(o.count > 0 for o in _options(look))):
            options = []
            for option in _options(look):
                span, terms = seconds(option.within), []
                for sign, on, _ in _signed(option):
                    condition = _condition(option)
                    same = (tuple(on), str(condition))
                    if same not in groups:
                        groups[same] = len(groups)
                        past.append(F.when(condition, _tag(groups[same], _key(list(on), kinds), then, 1)))
                    own = sets.setdefault(tuple(on.values()), len(sets))
                    ends = [(0, sign)] if span is None else [(0, sign), (round(span * 1_000_000) + 1, -sign)]
                    terms += [(asked.setdefault((groups[same], own, back), len(asked)), s) for back, s in ends]
                options.append((option.count, tuple(terms)))
                used[-1] += [probe for probe, _ in terms]
            needs[-1].append(clauses.setdefault(tuple(options), len(clauses)))
    met = F.array_compact(F.array(*[F.when(r.where, F.lit(i)) for i, r in enumerate(rules)]))
    numbered = events.withColumn("__met", met).withColumn("__id", F.monotonically_increasing_id())
    # a trigger's row is kept whole, with the keys that its rules search by
    whole = F.when(F.size("__met") > 0, F.struct(F.lit(-1).alias("group"), F.array().cast("array<string>").alias("keys"), F.coalesce(at, F.lit(0)).alias("at"), F.lit(-1).alias("past"), F.lit(0).alias("probe"), F.lit(0).alias("sign")))
    row = F.struct(*[F.col(f"`{c}`") for c in events.columns])
    own_keys = F.array(*[_key(list(c), own_kinds) for c in sets]) if sets else F.array().cast("array<array<string>>")
    tagged = _spread(numbered, [whole, *(past if history is None else [])], F.col("__id").alias("id"), F.col("__met").alias("met"), own_keys.alias("sets"), at.isNotNull().alias("timed"), row.alias("row"))
    kept = F.col("past") == -1
    tagged = tagged.withColumns({c: F.when(kept, F.col(c)) for c in ("met", "sets", "timed", "row")})
    if history is not None:
        none = [F.lit(None).cast(tagged.schema[c].dataType).alias(c) for c in ("id", "met", "sets", "timed", "row")]
        tagged = tagged.union(_spread(history, past, *none))
    table = written(tagged.filter(_WHOLE_KEY), "tagged")
    # what rules ask for are constants; a trigger has a probe for each count that
    # one of its rules asks for, however many do
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    counted = constant([{"group": g, "set": own, "back": back} for g, own, back in asked], "array<struct<group:int,set:int,back:bigint>>")
    wanted = constant([sorted(set(u)) for u in used], "array<array<int>>")
    probes = table.filter("past = -1 AND timed").select("id", "at", "sets", F.explode(F.array_distinct(F.flatten(F.transform("met", lambda r: F.element_at(wanted, r + 1))))).alias("probe"))
    probes = probes.select("id", "at", "sets", "probe", F.element_at(counted, F.col("probe") + 1).alias("p"))
    probes = probes.select("id", F.col("p.group").alias("group"), F.element_at("sets", F.col("p.set") + 1).alias("keys"), (F.col("at") - F.col("p.back")).alias("at"), F.lit(0).alias("past"), "probe", F.lit(1).alias("sign"))
    tags = table.filter("past = 1").select("id", *_TAGGED).union(probes.filter(_WHOLE_KEY))
    hits = _counts(tags).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("probe", "hits"))).alias("hits"))
    found = table.filter("past = -1").select("id", "row", "met").join(hits, "id", "left")
    searches = constant([[{"least": least, "terms": [{"probe": p, "sign": s} for p, s in terms]} for least, terms in options] for options in clauses], "array<array<struct<least:bigint,terms:array<struct<probe:int,sign:int>>>>>")
    total = lambda terms: F.aggregate(terms, F.lit(0).cast("long"), lambda n, t: n + t["sign"] * F.coalesce(F.col("hits")[t["probe"]], F.lit(0)))
    good = F.transform(searches, lambda options: F.exists(options, lambda o: total(o["terms"]) >= o["least"]))
    needed = constant(needs, "array<array<int>>")
    # bound in an array, so that searches are judged once a trigger, not once a rule
    alerting = F.transform(F.array(good), lambda g: F.filter("met", lambda r: F.forall(F.element_at(needed, r + 1), lambda c: F.element_at(g, c + 1))))[0]
    return _scored(found.select("row", F.explode(alerting).alias("__rule")).select("row.*", "__rule"), rules, F.col("__rule")).drop("__rule")


def impact_score(confidentiality: int = 0, integrity: int = 0, availability: int = 0) -> float:
    """The mean of the three marks and their largest, each of 0 to 5."""
    marks = (confidentiality, integrity, availability)
    return (sum(marks) / 3 + max(marks)) / 2


def fold_alerts(alerts: DataFrame, by: Sequence[str], within: str, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """``parent_id`` for each alert: the first of a run of alerts that agree on
    ``by`` and follow each other within a time; a first one has none.  A time that
    cannot be read is no bound: all that agree make one run."""
    w = Window.partitionBy(*by).orderBy(ts, key)
    bound = seconds(within)
    gap = F.lag(ts).over(w).isNull() if bound is None else F.col(ts) - F.lag(ts).over(w) > F.expr(f"INTERVAL {bound:.6f} SECONDS")
    run = F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(w)
    marked = alerts.withColumn("__run", run)
    first = F.first(key).over(Window.partitionBy(*by, "__run").orderBy(ts, key))
    return marked.withColumn("__first", first).withColumn("parent_id", F.when(F.col("__first") != F.col(key), F.col("__first"))).drop("__run", "__first")
