import hashlib

import pytest
from pyspark.sql import functions as F

from sievelake.functions import casts, entities, net, semantics
from sievelake.functions.record import Record, to_json, where_record
from sievelake.operators import parsing, rules
from sievelake.sources import mapping, names, tables

DOC = {
    "text_number": "100", "n": 100, "f": 100.0, "yes": True, "status": "Active", "ip": "10.1.2.3", "list": [{"type": "mail", "v": 7}],
    "at": "2024-01-15T23:45:10Z", "offset": "2024-01-13T10:30:00+05:00", "bad_time": "x", "none": None, "obj": {"a": "b"}, "empty": "", "padded": " 7 ", "zeros": "0100",
}


@pytest.fixture(scope="module")
def record(spark):
    df = spark.createDataFrame([(to_json(DOC),)], "doc string").cache()
    return lambda make: df.select(make(Record("doc"))).first()[0]


CASES = [
    (lambda r: r.equals("text_number", 100), True),
    (lambda r: r.equals("text_number", 100.0), True),
    (lambda r: r.equals("n", "100"), True),
    (lambda r: r.equals("zeros", "100"), True),
    (lambda r: r.equals("yes", "true"), True),
    (lambda r: r.equals("yes", True), True),
    (lambda r: r.equals("none", "null"), False),
    (lambda r: r.equals("none", 0), False),
    (lambda r: r.equals("none", ""), True),
    (lambda r: r.equals("obj", "b"), False),
    (lambda r: r.equals("missing", "x"), False),
    (lambda r: r.one_of("n", ["1", 100]), True),
    (lambda r: r.exists("none"), True),
    (lambda r: r.exists("missing"), False),
    (lambda r: r.exists("list.0.type"), True),
    (lambda r: r.safe("none", "d"), "d"),
    (lambda r: r.safe("missing", 5), 5.0),
    (lambda r: r.safe("status", 5), 5.0),
    (lambda r: r.safe("text_number", 5), 100.0),
    (lambda r: r.safe("padded", 5), 5.0),
    (lambda r: r.safe("yes", False), True),
    (lambda r: r.contains("n", "1"), False),
    (lambda r: r.contains("obj", "b"), False),
    (lambda r: r.contains("status", [" cti "]), True),
    (lambda r: r.contains_all("status", []), True),
    (lambda r: r.contains_all("n", []), False),
    (lambda r: r.equals_ignore_case("status", "aCTIVE"), True),
    (lambda r: r.starts_with("status", ["x", "Act"]), True),
    (lambda r: r.ends_with("status", "ive"), True),
    (lambda r: r.in_cidr("ip", "10.1.0.0/16"), True),
    (lambda r: r.in_cidr("ip", "nonsense"), False),
    (lambda r: r.in_cidr("status", "10.0.0.0/8"), False),
    (lambda r: r.regex_match("status", "tiv"), True),
    (lambda r: r.regex_match("status", "("), False),
    (lambda r: r.regex_match("empty", ".*"), True),
    (lambda r: r.less_than("status", 5), False),
    (lambda r: r.less_than("text_number", "abc"), False),
    (lambda r: r.less_than("text_number", "100.5"), True),
    (lambda r: r.greater_or_equal("n", 100), True),
    (lambda r: r.greater_than("list.0.v", 6), True),
    (lambda r: r.is_hour("at", 23), True),
    (lambda r: r.is_hour("offset", 10), True),
    (lambda r: r.is_minute("at", 45), True),
    (lambda r: r.is_day_of_week("at", 1), True),
    (lambda r: r.is_work_day("at"), True),
    (lambda r: r.is_weekend("offset"), True),
    (lambda r: r.is_weekend("bad_time"), False),
    (lambda r: r.is_between_time("at", "22:00", "06:00"), True),
    (lambda r: r.is_between_time("offset", "22:00", "06:00"), False),
    (lambda r: r.is_between_time("offset", "17:00", "08:00"), False),
    (lambda r: r.is_between_time("offset", "10:30", "10:30"), True),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_record(record, i):
    assert record(CASES[i][0]) == CASES[i][1]


def test_bad_paths():
    with pytest.raises(ValueError):
        Record("doc").exists("a.#.b")


VALID = [
    ("ip", "192.0.2.1", "192.0.2.1"), ("ip", "2001:db8::68", "2001:db8::68"), ("ip", "10.0.0.1", None), ("ip", "127.0.0.1", None), ("ip", "224.0.0.1", None), ("ip", "x", None),
    ("port", "555/TCP", "555/tcp"), ("port", "555 udp", None), ("port", "tcp/555", None), ("port", "70000/tcp", None),
    ("md5", "D41D8CD98F00B204E9800998ECF8427E", "d41d8cd98f00b204e9800998ecf8427e"), ("sha256", "ab", None), ("sha3_512", "a" * 128, "a" * 128),
    ("date", "2024-02-29", "2024-02-29"), ("date", "2023-02-29", None), ("datetime", "2024-01-15T10:00:00.1200Z", "2024-01-15T10:00:00.12Z"), ("datetime", "2024-01-15T10:00:00.000+02:00", "2024-01-15T10:00:00+02:00"),
    ("email", "Ann <Ann@Example.com>", "ann@example.com"), ("email", "nobody", None), ("fqdn", "WWW.Example.COM", "www.example.com"), ("url", "HTTPS://Example.COM/A?b=C", "https://example.com/A?b=C"), ("url", "example.com", None),
    ("mac", "aa-bb-cc-dd-ee-ff", "AA-BB-CC-DD-EE-FF"), ("mac", "aa:bb:cc:dd:ee:ff", None), ("base64", "aGVsbG8=", "aGVsbG8="), ("base64", "a", None), ("hexadecimal", "ABC", None), ("uuid", "123E4567-E89B-12D3-A456-426614174000", "123e4567-e89b-12d3-a456-426614174000"),
    ("adversary", "Lazy Bear", "Lazy Bear"), ("adversary", "example.com", None), ("city", "NEW york", "New York"), ("path", "C:\\Temp", "c:\\temp"), ("path", "http://x", None), ("regex", "a(b", None), ("cidr", "192.0.2.7/24", "192.0.2.0/24"), ("cidr", "10.0.0.0/8", None),
    ("integer", "12", "12"), ("integer", "1.5", None), ("boolean", "T", "true"), ("str", "a\u0000b", "a b"), ("istr", "AB", "ab"), ("str", "  ", None),
]


def test_validators(spark):
    kinds = sorted({k for k, _, _ in VALID})
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(VALID)], "i int, kind string, v string")
    got = {}
    for kind in kinds:
        for r in df.filter(F.col("kind") == kind).select("i", entities.validate(F.col("v"), kind).alias("r")).collect():
            got[r["i"]] = r["r"]
    for i, (kind, v, want) in enumerate(VALID):
        assert got[i]["value"] == want, (kind, v)
        assert (got[i]["error"] is None) == (want is not None)
        assert got[i]["hash"] == (None if want is None else hashlib.sha3_256(want.encode()).hexdigest())


def test_casts(spark):
    df = spark.createDataFrame([("12",), ("1.5",), (" 7 ",), ("1.5d",), (None,), ("TRUE",)], "x string")
    x = F.col("x")
    out = df.select(casts.cast_int64(x), casts.cast_float64(x), casts.cast_bool(x), casts.cast_string(x)).collect()
    assert [tuple(r) for r in out] == [(12, 12.0, False, "12"), (0, 1.5, False, "1.5"), (0, 0.0, False, " 7 "), (0, 0.0, False, "1.5d"), (0, 0.0, False, ""), (0, 0.0, True, "TRUE")]
    with pytest.raises(ValueError):
        casts.validate_reserved_field("raw")


def test_keys(spark):
    rows = [("::1",), ("fe80::a:1",), ("1:2:3:4:5:6:7:8",), ("1.2.3.4",), ("::ffff",), ("1::2::3",), ("g::1",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(net.ip_key(F.col("x"))).collect()]
    assert got == [net.key_of(x[0]) for x in rows[:5]] + [None, None]


def test_parse_steps(spark):
    df = spark.createDataFrame([("u=ann;p=22", "GET /a 200", "  x "), ("u=bob", "POST /b/c 404", "y")], "pairs string, line string, s string")
    steps = [
        parsing.kv("pairs", "m", ";", "="),
        parsing.add("user", F.col("m")["u"]),
        parsing.grok("line", [("verb", "[A-Z]+"), ("gap", " "), ("path", r"\S+"), ("gap2", " "), ("code", "{{num}}")], {"num": r"\d+"}),
        parsing.cast(["code"], "int"),
        parsing.trim(["s"]),
        parsing.delete(["gap", "gap2", "m", "pairs", "line"]),
        parsing.add("bad", F.lit(True), where=F.col("code") >= 400),
    ]
    assert [tuple(r) for r in parsing.parse(df, steps).select("user", "verb", "path", "code", "s", "bad").collect()] == [("ann", "GET", "/a", 200, "x", None), ("bob", "POST", "/b/c", 404, "y", True)]


def test_durations_and_scores():
    assert rules.seconds("1h30m") == 5400 and rules.seconds("soon") is None and rules.seconds("250ms") == 0.25
    assert rules.impact_score(3, 3, 3) == 3


def test_names():
    assert names.pattern("a", "b") == "a-b-*" and names.generation("p") == "p-000001"
    assert names.next_generation("p-000041") == "p-000042" and names.parse_generation("a-b-000007") == ("a-b", 7)
    assert not names.is_generation("p-41") and names.generation_number("p-41") == 0
    assert tables.write_generation(["p-000001", "p-000010", "q-000011"], "p") == "p-000010"


def test_writes(spark):
    now = spark.createDataFrame([("1", 1, "a"), ("2", 2, "b")], "_id string, n int, t string")
    new = spark.createDataFrame([("2", 5, None), ("3", 3, "c")], "_id string, n int, t string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(tables.update(now, new, "_id")) == [("1", 1, "a"), ("2", 5, "b")]
    good, dead = tables.create(now, new, "_id")
    assert rows(good) == [("1", 1, "a"), ("2", 2, "b"), ("3", 3, "c")] and [r["_id"] for r in dead.collect()] == ["2"]
    items = spark.createDataFrame([("1", 9, "z", "index", 1), ("1", 0, "", "delete", 2), ("4", 4, "d", "index", 3)], "_id string, n int, t string, action string, seq int")
    done, errors = tables.bulk(now, items, "_id")
    assert rows(done) == [("2", 2, "b"), ("4", 4, "d")] and errors.isEmpty()
    mixed = [("1", None, "u", "update", 1), ("1", 8, None, "update", 2), ("9", 1, "x", "update", 3), ("2", 0, "", "create", 4), ("5", 5, "e", "create", 5), ("5", 6, "f", "create", 6), ("7", 0, "", "delete", 7), ("2", 0, "", "what", 8), ("5", 7, None, "index", 9)]
    done, errors = tables.bulk(now, spark.createDataFrame(mixed, "_id string, n int, t string, action string, seq int"), "_id")
    assert rows(done) == [("1", 8, "u"), ("2", 2, "b"), ("5", 7, None)]
    assert sorted((r["seq"], r["error"]) for r in errors.collect()) == [(3, "document missing"), (4, "document already exists"), (6, "document already exists"), (7, "document missing"), (8, "unknown action")]
    twice = spark.createDataFrame([("2", 5, None, 1), ("2", 6, None, 2)], "_id string, n int, t string, o int")
    assert rows(tables.update(now, twice, "_id", "o")) == [("1", 1, "a"), ("2", 6, "b")]
    assert len(rows(tables.upsert(now, twice.drop("o"), "_id"))) == 2
    raw = spark.createDataFrame([("1", "7"), ("2", "x")], "_id string, n string")
    ok, bad = tables.checked(raw, {"n": "int"})
    assert [r["n"] for r in ok.collect()] == [7] and bad.first()["error"] == "failed to parse field n"
    tries = []
    with pytest.raises(RuntimeError):
        tables.with_retry(lambda: (tries.append(1), (_ for _ in ()).throw(RuntimeError()))[0], 3, 0.01)
    assert len(tries) == 3
    tables.alias(spark, "only_a", now, "t = 'a'")
    assert tables.sql_count(spark, "SELECT count(*) FROM only_a") == 1 and "only_a" in tables.list_tables(spark, "only*")


def test_mapping(spark):
    assert len(mapping.TYPES) == 44
    a, b = spark.createDataFrame([], "value int, x string").schema, spark.createDataFrame([], "value string").schema
    merged = mapping.merge({"one": a, "two": b})
    assert [f.name for f in mapping.conflicts(merged)] == ["value"] and merged["value"].type == "keyword"
    assert mapping.merge({"one": a, "two": b}, "most_recent")["value"].type == "keyword"
    with pytest.raises(ValueError):
        mapping.merge({"one": a, "two": b}, "strict")
    with pytest.raises(ValueError):
        mapping.check("binary", "term")
    mapping.check("text", "term")


def test_semantic_types(spark):
    assert len(semantics.KINDS) == 129 and set(semantics.KINDS.values()) <= set(entities.VALIDATORS)
    df = spark.createDataFrame([("WWW.Example.com", None)], "a string, b string")
    r = df.select(semantics.validate_semantic(F.col("a"), "hostname").alias("v"), semantics.attributes({"hostname": F.col("a"), "city": F.col("b")}).alias("m")).first()
    assert r["v"]["value"] == "www.example.com" and r["m"] == {"hostname": "WWW.Example.com"}
    with pytest.raises(ValueError):
        semantics.validate_semantic(F.col("a"), "nothing")


def test_engine_patterns(spark):
    df = spark.createDataFrame([('{"a": "xyz"}',)], "doc string")
    for pattern, want in (("(?P<q_1>x)", True), ("x{,2}y|x", False), ("(", False), ("^x.z$", True), (r"\\(?P<", False)):
        assert df.filter(Record("doc").regex_match("a", pattern)).count() == want, pattern


def test_records_are_parsed_once(spark):
    df = spark.createDataFrame([('{"a": "17", "b": {"c": 2}}',), ("no json",), (None,)], "doc string")
    found = where_record(df, "doc", lambda r: r.equals("a", 17) & r.equals("b.c", "2") & ~r.exists("d"))
    assert found.count() == 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 2


def test_accept_sets(spark):
    """Forms that the rules accept and refuse."""
    cases = {
        "phone": (["+1 (555) 123-4567", "+15551234567", "+44 20 7946"], ["+1.555.123.4567", "555-1234", "+0 12", "+1 (555) 123-4567\n"]),
        "mime": (["text/csv", "application/vnd.api+json"], ["text/c", "text", "text/cs.v.", "1/abc"]),
        "uuid": (["urn:uuid:f47ac10b-58cc-4372-a567-0e02b2c3d479", "F47AC10B58CC4372A5670E02B2C3D479", "{f47ac10b-58cc-4372-a567-0e02b2c3d479}"], ["f47ac10b", "f47ac10b-58cc-4372-a567-0e02b2c3d47"]),
        "url": (["/path/only", "http://a.b/c?d#e", "mailto:x"], ["no/slash", "", "http://a b"]),
        "fqdn": (["Example.com", "a--b.example.co"], ["a.b1", "-a.com", "a.c", "com", "a.abcdefghijklmnopqrstu"]),
    }
    for kind, (good, bad) in cases.items():
        df = spark.createDataFrame([(v,) for v in good + bad], "v string").select("v", entities.VALIDATORS[kind](F.col("v")).alias("x"))
        got = {r["v"]: r["x"] for r in df.collect()}
        assert all(got[v] is not None for v in good) and all(got[v] is None for v in bad), (kind, got)
    df = spark.createDataFrame([("abc",), ("abcd",), ("xabc",)], "v string")
    assert [r[0] for r in df.filter(entities.matches_whole(F.col("v"), "[a-c]+").isNotNull()).collect()] == ["abc"]


def test_mapped_addresses(spark):
    df = spark.createDataFrame([("::ffff:1.2.3.4",), ("64:ff9b::1.2.3.4",), ("::ffff:1.2.3.400",), ("1.2.3.4",)], "a string").select(net.ip_key(F.col("a")))
    keys = [r[0] for r in df.collect()]
    assert keys[0] == keys[3] == net.key_of("1.2.3.4") and keys[1] == net.key_of("64:ff9b::102:304") and keys[2] is None


def test_resolve_and_declared():
    schema = mapping.declared({"msg": "text", "msg.keyword": "keyword", "body": "text", "n": "long", "host.ip": "ip", "host.name": "keyword", "any": "object"})
    assert schema["n"].dataType.typeName() == "long" and schema["host"].dataType["ip"].metadata == {"type": "ip"}
    merged = mapping.merge({"t": schema})
    assert mapping.resolve(merged, "msg", "match") == "msg" and mapping.resolve(merged, "msg", "term") == "msg.keyword"
    assert mapping.resolve(merged, "n", "range") == "n" and mapping.resolve(merged, "unknown", "sort") == "unknown"
    with pytest.raises(ValueError):
        mapping.resolve(merged, "body", "sort")
    with pytest.raises(ValueError):
        mapping.declared({"a": "no such type"})
