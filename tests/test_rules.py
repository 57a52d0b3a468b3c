"""Correlation rules against plain loops over all pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievelake.functions.text import analyse
from sievelake.operators import predicates as P
from sievelake.operators import rules as R

START = datetime(2024, 1, 1)


def some_events(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = None if rng.random() < 0.03 else START + timedelta(seconds=rng.choice([rng.randrange(20_000), 500, 501, 7000]))
        user = None if rng.random() < 0.1 else "hot" if rng.random() < 0.5 else f"u{rng.randrange(8)}"
        rows.append((i, at, user, rng.choice(["a", "b", None, "c"]), rng.choice(["error", "click", "view"]), rng.choice(["red Fox", "fox hole", "blue", None, "", "hole"])))
    return rows


NAMES = ("event_id", "ts", "user", "host", "kind", "said")
SCHEMA = "event_id long, ts timestamp, user string, host string, kind string, said string"


@pytest.fixture(scope="module")
def rows():
    return some_events()


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def hits(trigger, rows, look, where=lambda h: True):
    """History rows that one trigger finds."""
    def words(x, y):
        return bool(set(analyse(x or "")) & set(analyse(y or "")))

    bound = R.seconds(look.within)
    n = 0
    for h in (dict(zip(NAMES, r)) for r in rows):
        if h["ts"] is None or trigger["ts"] is None or h["ts"] > trigger["ts"] or not where(h):
            continue
        if bound is not None and (trigger["ts"] - h["ts"]).total_seconds() > bound:
            continue
        if any(h[a] is None or h[a] != trigger[b] for a, b in look.on.items()):
            continue
        if any(h[a] is not None and h[a] == trigger[b] for a, b in look.unlike.items()):
            continue
        if any(not words(h[a], trigger[b]) for a, b in look.matching.items()):
            continue
        if any(words(h[a], trigger[b]) for a, b in look.unmatching.items()):
            continue
        n += 1
    return n


LOOKS = {
    "keys": dict(on={"user": "user"}, within="20m", count=2),
    "two keys": dict(on={"user": "user", "host": "host"}, within="1h"),
    "crossed keys": dict(on={"host": "user"}, within="1h"),
    "no bound": dict(on={"user": "user"}, within="soon", count=9),
    "no key": dict(on={}, within="3m", count=3),
    "unlike": dict(on={"user": "user"}, within="30m", count=2, unlike={"host": "host"}),
    "two unlike": dict(on={}, within="5m", count=2, unlike={"host": "host", "user": "user"}),
    "words": dict(on={"user": "user"}, within="1h", count=2, matching={"said": "said"}),
    "only words": dict(on={}, within="10m", count=2, matching={"said": "said"}),
    "no words": dict(on={"user": "user"}, within="1h", count=2, unmatching={"said": "said"}),
    "all": dict(on={"user": "user"}, within="1h", matching={"said": "said"}, unmatching={"said": "host"}, unlike={"host": "host"}),
}


@pytest.mark.parametrize("name", LOOKS)
def test_related_equals_pairs(events, rows, name):
    look = R.Lookback(**LOOKS[name])
    got = {r["event_id"]: r["hits"] for r in R.related(events.filter("kind = 'error'"), events.filter("kind <> 'error'"), look, "event_id", "ts").collect()}
    want = {}
    for t in (dict(zip(NAMES, r)) for r in rows):
        if t["kind"] == "error" and (n := hits(t, rows, look, lambda h: h["kind"] != "error")):
            want[t["event_id"]] = n
    assert got == want


@pytest.mark.parametrize("cells", [1, 2, 7, 200])
def test_cells_change_nothing(events, cells, monkeypatch):
    look = R.Lookback({"user": "user"}, "20m", 1)
    read = lambda: sorted(map(tuple, R.related(events.filter("kind = 'error'"), events, look, "event_id", "ts").collect()))
    want = read()
    monkeypatch.setattr(R._counts, "__defaults__", (cells,))
    assert read() == want


def rule_set():
    look = lambda **o: R.Lookback(**{"on": {"user": "user"}, "within": "20m", "count": 2, "where": P.term("kind", "click"), **o})
    error = P.term("kind", "error")
    return [
        R.Rule("one", error, (look(),)),
        R.Rule("both", error, (look(), look(on={"host": "host"}, count=3))),
        R.Rule("either", error, (look(count=50, either=(look(count=40, either=(look(on={}, within="1m", count=1),)),)),)),
        R.Rule("none needed", error & P.term("host", "a"), (look(count=0),)),
        R.Rule("plain", P.term("kind", "view"), (), {"confidentiality": 3, "integrity": 0, "availability": 0}),
        R.Rule("not", error, (look(must_not=(P.term("host", "b"),)),)),
        R.Rule("unlike", error, (look(unlike={"host": "host"}),)),
        R.Rule("words", error, (look(matching={"said": "said"}),)),
        R.Rule("off", error),
    ]


def expected(rows):
    """(rule, event) by loops."""
    click = lambda h: h["kind"] == "click"
    out = set()
    for t in (dict(zip(NAMES, r)) for r in rows):
        n = lambda on={"user": "user"}, within="20m", where=click, **o: hits(t, rows, R.Lookback(on, within, **o), where)
        if t["kind"] == "view":
            out.add(("plain", t["event_id"]))
        if t["kind"] != "error":
            continue
        found = {
            "one": n() >= 2,
            "both": n() >= 2 and n(on={"host": "host"}) >= 3,
            "either": n() >= 50 or n() >= 40 or n(on={}, within="1m") >= 1,
            "none needed": t["host"] == "a",
            "not": n(where=lambda h: click(h) and h["host"] != "b") >= 2,
            "unlike": n(unlike={"host": "host"}) >= 2,
            "words": n(matching={"said": "said"}) >= 2,
        }
        out |= {(k, t["event_id"]) for k, v in found.items() if v}
    return out


def test_all_rules_together(events, rows):
    got = R.evaluate_all(rule_set(), events, disabled=["off"])
    assert got.columns == [*events.columns, "rule", "impact_score"]
    found = got.collect()
    assert {(r["rule"], r["event_id"]) for r in found} == expected(rows) and len(found) == len(expected(rows))
    assert {r["impact_score"] for r in found if r["rule"] == "plain"} == {2.0}
    whole = {r[0]: r for r in rows}
    assert all(tuple(r)[:6] == whole[r["event_id"]] for r in found)


def test_each_rule_alone_and_other_history(events, rows):
    rules = rule_set()
    for rule in rules[:4]:
        for history in (None, events.filter("true")):
            got = R.evaluate(rule, events, history=history)
            assert {r["event_id"] for r in got.collect()} == {e for n, e in expected(rows) if n == rule.name}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_are_read_once(spark, sf, monkeypatch):
    read = []
    monkeypatch.setattr(R, "written", lambda df, name, f=R.written: read.append(plan_of(df)) or f(df, name))
    events = spark.read.parquet(f"{sf}/events.parquet")
    rules = [R.Rule(f"r{i}", P.between("value", gt=i), (R.Lookback({"user_id": "user_id"}, "2h", 1 + i % 3, P.term("event_type", "click")),)) for i in range(40)]
    plan = plan_of(R.evaluate_all(rules, events))
    assert len(read) == 1 and read[0].count("FileScan") == 1 and "events.parquet" not in plan


def test_no_single_task_and_no_loop(events):
    for look in (R.Lookback({}, "3m"), R.Lookback({}, "3m", unlike={"host": "host"}), R.Lookback({}, "3m", matching={"said": "said"})):
        plan = plan_of(R.related(events.filter("kind = 'error'"), events, look, "event_id", "ts"))
        assert "SinglePartition" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_hot_source_is_spread(spark):
    events = spark.range(0, 20_000, 1, 8).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "'hot' AS user", "if(id % 10 = 0, 'error', 'click') AS kind")
    look = R.Lookback({"user": "user"}, "30s", 1, P.term("kind", "click"))
    hit = R.related(events.filter("kind = 'error'"), events, look, "event_id", "ts")
    assert {r["hits"] for r in hit.filter("event_id > 100").collect()} == {27}
    past = events.select(F.lit(None).cast("long").alias("id"), F.lit(0).alias("group"), F.array("user").alias("keys"), F.unix_micros("ts").alias("at"), F.lit(1).alias("past"), F.lit(0).alias("probe"), F.lit(0).alias("sign"))
    edges = past.agg(F.percentile_approx("at", F.array(*[F.lit(i / 16) for i in range(1, 16)]), 1000)).first()[0]
    assert len(set(edges)) == 15  # cells of one source hold a share of its rows each


def test_fold_without_a_bound(spark):
    alerts = spark.createDataFrame([(1, START, "a"), (2, START + timedelta(days=90), "a"), (3, START, "b")], "event_id long, ts timestamp, user string")
    got = {r["event_id"]: r["parent_id"] for r in R.fold_alerts(alerts, ["user"], "").collect()}
    assert got == {1: None, 2: 1, 3: None}


def test_empty_tables(spark, events):
    none = events.limit(0)
    assert R.evaluate_all(rule_set(), none).count() == 0
    assert R.evaluate_all([], events).count() == 0
    assert R.evaluate(rule_set()[0], events, history=none).count() == 0


def test_many_rules_share_their_counts(events, rows, monkeypatch):
    """What is counted for a trigger grows with the distinct searches, not with the rules."""
    rules = [R.Rule(f"r{i}", P.term("kind", "error"), (R.Lookback({"user": "user"}, f"{1 + i % 2}h", 1 + i % 3, P.term("kind", "click")),)) for i in range(24)]
    seen, counts = [], R._counts
    monkeypatch.setattr(R, "_counts", lambda tags: seen.append(tags.filter("past = 0").count()) or counts(tags))
    got = {(r["event_id"], r["rule"]) for r in R.evaluate_all(rules, events).collect()}
    own = [dict(zip(NAMES, r)) for r in rows if r[4] == "error"]
    want = set()
    for i, rule in enumerate(rules):
        look = rule.lookbacks[0]
        want |= {(t["event_id"], f"r{i}") for t in own if hits(t, rows, look, lambda h: h["kind"] == "click") >= look.count}
    assert got == want and got
    timed = sum(t["ts"] is not None and t["user"] is not None for t in own)
    assert sum(seen) <= 3 * timed
