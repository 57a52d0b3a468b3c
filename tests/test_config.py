import hashlib

from pyspark.sql import functions as F

from sievelake.functions.inference import embedder
from sievelake.operators import graph, parsing
from sievelake.operators import rules as R
from sievelake.plans import queries
from sievelake.sources import config

RULES = """
- name: clicks before an error
  where: event_type = 'error'
  impact: {confidentiality: 3}
  afterEvents:
    - with:
        - {field: user_id, operator: filter_term, value: "{{.user_id}}"}
        - {field: event_type, operator: filter_term, value: click}
      within: 6h
      count: 2
- name: muted
  where: "true"
"""

PIPELINES = [
    "patterns: {num: x}\npipeline:\n- dataTypes: [web]\n  steps:\n  - grok: {source: raw, patterns: [{fieldName: verb, pattern: '[A-Z]+'}, {fieldName: gap, pattern: ' '}, {fieldName: code, pattern: '{{num}}'}]}\n  - cast: {fields: [code], to: int}\n  - drop: {where: code = 404}\n",
    "patterns: {num: '[0-9]+'}\npipeline:\n- dataTypes: [web, other]\n  steps:\n  - delete: {fields: [raw]}\n",
]


def test_rules(spark, sf):
    rules = config.load_rules(RULES)
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = R.evaluate_all(rules, events, disabled=["muted"])
    want = queries.QUERIES["correlate"](spark, sf)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect())


def test_pipelines(spark):
    logs = spark.createDataFrame([("web", "GET 200"), ("web", "GET 404"), ("other", "x"), ("none", "y")], "dataType string, raw string")
    out = parsing.parse_by_type(logs, config.load_pipelines(PIPELINES))
    assert sorted((r["dataType"], r["verb"], r["code"]) for r in out.select("dataType", "verb", "code").collect()) == [("other", None, None), ("web", "GET", 200)]


def test_graph(spark):
    seen = spark.createDataFrame([("a", -1, 0.5, ["x"], ["public"], 1), ("a", 2, 1.0, ["y", "x"], ["public"], 2), ("b", 0, 0.0, [], ["g"], 1)], "entity_id string, reputation int, accuracy double, tags array<string>, visibleBy array<string>, ts long")
    a = {r["entity_id"]: r for r in graph.consolidate(seen).collect()}["a"]
    assert (a["reputation"], a["best_reputation"], a["worst_reputation"], a["accuracy"], a["tags"], a["last_seen"]) == (2, 2, -1, 0.75, ["x", "y"], 2)
    rows = [("ip", "1.1.1.1", [("association", "domain", "a.com"), ("aggregation", "domain", "b.com")]), ("domain", "b.com", [("association", "url", "http://b.com/")])]
    nodes, edges = graph.flatten(spark.createDataFrame(rows, "type string, value string, associations array<struct<mode:string,type:string,value:string>>"))
    name = "ip-" + hashlib.sha3_256(b"1.1.1.1").hexdigest()
    assert nodes.count() == 4 and edges.count() == 3
    near = graph.neighbours(edges, nodes.filter(F.col("entity_id") == name), 2).collect()
    assert sorted(r["distance"] for r in near) == [0, 1, 1, 2]
    assert graph.relations(edges.withColumn("ts", F.lit(1))).count() == 3


def test_embedding_batches(spark):
    def load():
        def model(texts):
            assert len(texts) <= 3
            return [[len(t), 1.0] for t in texts]

        return model

    df = spark.createDataFrame([("a",), ("bb",), (None,), ("dddd",)], "x string").coalesce(1)
    assert [r[0] for r in df.select(embedder(load, 3)("x")).collect()] == [[1.0, 1.0], [2.0, 1.0], [0.0, 1.0], [4.0, 1.0]]


def test_placeholders_in_all_conditions(spark):
    """Each condition may compare with the trigger's column."""
    rows = [(1, "a", "red fox", 0), (2, "a", "red hen", 10), (3, "b", "blue hen", 20), (4, "a", "fox", 30), (5, "b", "red", 40)]
    events = spark.createDataFrame(rows, "event_id int, user string, words string, s int").selectExpr("event_id", "user", "words", "timestamp_seconds(s) as ts")
    found = {}
    for operator in ("filter_term", "must_not_term", "filter_match", "must_not_match"):
        field = "user" if operator.endswith("term") else "words"
        text = f"- name: r\n  where: event_id > 1\n  correlation:\n    - with: [{{field: {field}, operator: {operator}, value: '{{{{.{field}}}}}'}}, {{field: event_id, operator: must_not_term, value: 99}}]\n      within: 25s\n      count: 1\n"
        rule = config.load_rules(text)[0]
        # a row is in its own past: leave it out by asking for earlier ones
        history = events.selectExpr("event_id", "user", "words", "ts + interval 1 second as ts")
        found[operator] = sorted(r["event_id"] for r in R.evaluate(rule, events, history=history).collect())
    earlier = lambda i: [r for r in rows if r[3] + 1 <= rows[i - 1][3] and r[3] + 1 >= rows[i - 1][3] - 25]
    words = lambda t: set(t.split())
    want = {
        "filter_term": lambda e, h: h[1] == e[1],
        "must_not_term": lambda e, h: h[1] != e[1],
        "filter_match": lambda e, h: bool(words(h[2]) & words(e[2])),
        "must_not_match": lambda e, h: not words(h[2]) & words(e[2]),
    }
    for operator, test in want.items():
        assert found[operator] == [i for i in range(2, 6) if any(test(rows[i - 1], h) for h in earlier(i))], operator


def test_a_busy_source_is_counted_by_a_window(spark):
    """One source with half the rows gives no row for each pair of them."""
    events = spark.range(4000).selectExpr("id as event_id", "if(id % 2 = 0, 0, id) as user_id", "timestamp_seconds(id) as ts")
    rule = R.Rule("r", F.expr("event_id % 4 = 0"), (R.Lookback({"user_id": "user_id"}, within="10s", count=6),))
    out = R.evaluate(rule, events)
    assert out.count() == len([i for i in range(0, 4000, 4) if i >= 10])
    assert "Window" in out._jdf.queryExecution().toString()
