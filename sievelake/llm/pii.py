"""Personal data by candidates and gradient-boosted trees, in DataFrame code.

Base rules find e-mail addresses, IPv4 addresses, card and phone numbers.  Beside
them high-recall generators propose further, overlapping spans: long tokens that
may be secrets, number-like runs and spelled-out addresses.  Format and context
features of each go through boosted trees; a threshold per generator, calibrated
on held-out examples to a wanted precision, selects the spans to redact.

Everything about a document stays in its row: matches, candidates and scores are
arrays, so nothing is shuffled and a document of any kind, however long, costs
only itself.
Only documents with a digit, an at or plus sign, or a spelled-out "at" are
searched; no rule can match elsewhere.

The trees are fitted in the session on ``examples`` labelled rows, half of them
held out: rows made by a rule from digests, a bound that does not grow with the
corpus.  The fit is kept for the session and is the same in every run.

Defined results: a null text is empty and has no spans; rows are treated one by
one, so ties and repeated rows are alike; an empty table gives an empty result.
Input columns named like an output column are replaced.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The base kinds in their fixed order, then the kinds that the method adds.
KINDS = ("email", "ip", "card", "phone", "secret", "number", "contact")

# Possessive forms of the fixed base patterns: they match the same text, in time
# linear in it and without recursion over long runs.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

_TOKEN = "A-Za-z0-9_+/=-"
GENERATORS = {
    "secret": rf"(?<![{_TOKEN}])[{_TOKEN}]{{16,}}+",
    "number": r"(?<![0-9A-Za-z])[0-9(][0-9\x20().-]{6,}[0-9](?![0-9A-Za-z])",
    "contact": rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]++)++",
}
GATE = r"[0-9@+]|[\[(]at[\])]"
MATCHES = "array<struct<start:int,text:string>>"
CUES = r"(?i)token|secret|passw|api|bearer|auth|key"
CONTACT_CUES = r"(?i)phone|tel\b|tel[.:]|call|mobile|fax|card|visa|account|mail|contact|reach"


def find_all(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """Leftmost, non-overlapping matches of ``pattern`` that ``keep`` accepts.

    The pieces between the matches, which ``split`` gives, place each match: its
    start is the code points of all pieces and matches before it.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(MATCHES).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        found = F.array(F.struct(at.alias("start"), x["m"].alias("text")))
        out = F.when(x["m"].isNotNull() & keep(x["m"]), F.concat(acc["out"], found)).otherwise(acc["out"])
        return F.struct((at + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"), out.alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has the right check digit."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))

    def weigh(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(figures, weigh), F.lit(0), lambda a, b: a + b) % 10 == 0


def good_ip(x: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(x, r"\."), lambda p: (F.length(part(p)) < 4) & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255))


def good_card(x: Column) -> Column:
    return F.length(digits(x)).between(14, 19) & luhn(digits(x))


def good_phone(x: Column) -> Column:
    return F.length(digits(x)).between(10, 15)


RULES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "email": (EMAIL, lambda x: F.lit(True)),
    "ip": (IP, good_ip),
    "card": (CARD, good_card),
    "phone": (PHONE, good_phone),
}


def _share(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern)) / F.greatest(F.length(x), F.lit(1))


FEATURES = ("kind", "length", "digit", "letter", "hex", "upper", "gaps", "variety", "switches", "luhn", "digits", "cue", "contact_cue", "assigned", "vowel", "closed", "dots")


def features(kind: Column, text: Column, left: Column, right: Column) -> list[Column]:
    """Numbers about a candidate of a generator (its name): its format and what
    stands around it."""
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    values = [
        F.array_position(F.array(*[F.lit(k) for k in GENERATORS]), kind) - 1,
        F.length(text),
        _share(text, "[0-9]"),
        _share(text, "[A-Za-z]"),
        _share(text, "[0-9a-f]"),
        _share(text, "[A-Z]"),
        F.regexp_count(text, F.lit(r"[\x20().-]+")),
        F.size(F.array_distinct(F.split(text, ""))) / F.greatest(F.length(text), F.lit(1)),
        F.regexp_count(text, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")),
        flag(luhn(digits(text)) & (F.length(digits(text)) > 11)),
        F.length(digits(text)),
        flag(left.rlike(CUES)),
        flag(left.rlike(CONTACT_CUES)),
        flag(left.rlike("[=:]\\x20?[\"']?$")),
        _share(text, "[aeiouAEIOU]"),
        flag(right.rlike("^[\"']")),
        F.regexp_count(text, F.lit(r"[\[(]dot[\])]")),
    ]
    return [v.cast("double") for v in values]


def examples_table(spark: SparkSession, n: int) -> DataFrame:
    """``n`` labelled candidates (kind, text, left, right, label, held), by rule.

    Secrets are digests and mixed keys after a cue; their look-alikes are long
    words, paths, dates and digests named as something else.  Numbers are phone
    numbers and cards after a cue, against dates, versions, sums and counts.
    Contacts are spelled-out addresses, against brackets without a domain.
    """
    h = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    pick = lambda salt, of: F.element_at(F.array(*[F.lit(x) for x in of]), (F.conv(F.substring(h(salt), 1, 4), 16, 10).cast("int") % len(of)) + 1)
    num = lambda salt, k: F.lpad(F.substring(F.conv(F.substring(h(salt), 1, 14), 16, 10), -k, k), k, "7")
    word = F.concat(*[pick(f"w{i}", ["er", "tion", "ing", "ach", "keit", "le", "ou", "qu", "en", "ble", "st", "ver"]) for i in range(8)])
    prose = F.concat_ws(" ", *[pick(f"p{i}", ["the", "und", "de", "ering", "thation", "keit", "of", "with", "la", "pour"]) for i in range(3)])
    cue = pick("c", ['token = "', 'api_key: ', "secret=", 'password = "', "Authorization: Bearer ", 'key="'])
    plain = pick("d", ["commit ", "see ", "the ", "file ", "of ", "page ", "build "])
    mixed = F.concat(F.substring(F.base64(F.unhex(h("m"))), 1, 24), num("m2", 4))
    call = pick("e", ["call ", "tel: ", "phone ", "mobile ", "fax ", "reach me at "])
    count = pick("f", ["on ", "of ", "about ", "total ", "version ", "from "])
    local = F.concat(F.substring(word, 1, 7), num("l", 2))
    domain = F.concat(F.substring(h("q"), 1, 5), F.lit("mail"))
    cases = [
        ("secret", F.substring(h("a"), 1, 40), cue, 1),
        ("secret", mixed, cue, 1),
        ("secret", F.substring(h("b"), 1, 32), cue, 1),
        ("secret", F.substring(word, 1, 20), plain, 0),
        ("secret", F.substring(word, 1, 18), cue, 0),
        ("secret", F.initcap(F.concat(word, F.substring(word, 3, 12))), plain, 0),
        ("secret", F.concat(F.substring(word, 1, 10), F.lit("-"), F.substring(word, 4, 9)), plain, 0),
        ("secret", F.upper(word), plain, 0),
        ("secret", F.concat(F.substring(word, 1, 9), F.lit("/"), F.substring(word, 5, 9), num("s", 2)), plain, 0),
        ("secret", F.substring(h("c"), 1, 40), plain, 0),
        ("secret", F.concat(F.lit("2024-01-"), num("t", 2), F.lit("-"), F.substring(word, 1, 8)), plain, 0),
        ("number", F.concat(F.lit("("), num("u", 3), F.lit(") 555-"), num("v", 4)), call, 1),
        ("number", F.concat(num("u", 3), F.lit("-555-"), num("v", 4)), call, 1),
        ("number", F.concat(F.lit("2024-0"), num("x", 1), F.lit("-1"), num("y", 1)), count, 0),
        ("number", num("z", 10), count, 0),
        ("number", F.concat(num("z", 4), F.lit(" "), num("y", 4), F.lit(" "), num("x", 4)), count, 0),
        ("number", F.concat(num("z", 1), F.lit("."), num("y", 3), F.lit("."), num("x", 4)), count, 0),
        ("contact", F.concat(local, F.lit(" (at) "), domain, F.lit(" (dot) com")), pick("g", ["mail ", "write to ", "contact "]), 1),
        ("contact", F.concat(local, F.lit("[at]"), domain, F.lit("[dot]org")), plain, 1),
        ("contact", F.concat(F.substring(word, 1, 4), F.lit(" (at) "), F.substring(word, 3, 7), F.lit(" (dot) net")), plain, 1),
        ("contact", F.concat(F.substring(word, 1, 3), F.lit("(at)"), F.substring(word, 4, 8), F.lit("(dot)org")), count, 1),
        ("contact", F.concat(F.substring(word, 1, 5), F.lit(" (at) "), pick("n", ["noon", "home", "once"]), F.lit(". "), F.substring(word, 3, 4)), count, 0),
    ]
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    # a plan for each case: as one expression they outgrow a compiled method
    parts = []
    for i, (kind, text, cue, label) in enumerate(cases):
        rows = spark.range(i, n, len(cases), 1)
        parts.append(rows.select("id", F.lit(kind).alias("kind"), column(text).alias("text"), F.concat(prose, F.lit(" "), column(cue)).alias("left"), F.lit(label).alias("label")))
    rows = functools.reduce(DataFrame.unionByName, parts).coalesce(1)
    closed = F.when(F.col("left").endswith('"'), F.lit('" ')).otherwise(F.lit(" "))
    return rows.withColumn("right", closed).withColumn("held", F.expr(f"(id div {len(cases)}) % 2 = 1"))


def tree_heaps(model, folder: str, spark: SparkSession, depth: int) -> list[dict]:
    """The trees of a fitted ``model``, read from its saved form in ``folder``: the
    weight ``w``, and as heaps of full ``depth`` the feature ``f`` and bound ``t``
    of each split and the value ``v`` of each leaf."""
    model.write().save(folder)
    nodes: dict[int, dict[int, tuple]] = {}
    for r in spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect():  # at most 2 ** (depth + 1) rows a tree
        nodes.setdefault(r["treeID"], {})[r["id"]] = (r["leftChild"], r["rightChild"], r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"], r["prediction"])
    out = []
    for tree, weight in enumerate(model.treeWeights):
        level, features, bounds = [0], [], []
        for _ in range(depth):
            below = []
            for at in level:
                left, right, feature, bound, _ = nodes[tree][at]
                inner = left >= 0
                # below a leaf all go on in the same leaf
                features.append(feature if inner else 0)
                bounds.append(float(bound[0]) if inner else 0.0)
                below += [left, right] if inner else [at, at]
            level = below
        out.append({"w": float(weight), "f": features, "t": bounds, "v": [float(nodes[tree][at][4]) for at in level]})
    return out


_FITTED: dict[tuple, tuple[list[dict], dict[str, float]]] = {}


def thresholds_of(held: list[tuple[str, float, int]], precision: float) -> dict[str, float]:
    """{generator: threshold} from (generator, score, label): scores are calibrated
    to precision by pooling adjacent violators, and the lowest score whose
    calibrated precision is the wanted one is the threshold, with half the gap
    to the next lower score of the other kind."""
    out = {k: 1.1 for k in GENERATORS}
    for kind in GENERATORS:
        rows = sorted((p, y) for k, p, y in held if k == kind)
        pools: list[list[float]] = []  # sum of labels, rows, lowest score
        for p, y in rows:
            pools.append([y, 1, p])
            while len(pools) > 1 and (pools[-2][2] == pools[-1][2] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
                y2, n2, _ = pools.pop()
                pools[-1][0] += y2
                pools[-1][1] += n2
        good = [low for y, n, low in pools if y >= precision * n]
        if good:
            lower = max((p for p, y in rows if p < good[0]), default=0.0)
            out[kind] = (good[0] + lower) / 2
    return out


def fit(spark: SparkSession, examples: int = 4000, rounds: int = 20, depth: int = 3, precision: float = 0.99) -> tuple[list[dict], dict[str, float]]:
    """(trees, {generator: threshold}) from ``examples`` rows."""
    key = (examples, rounds, depth, precision)
    if key in _FITTED:
        return _FITTED[key]
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = common.checkpoint(examples_table(spark, examples))
    rows = rows.select("kind", "label", "held", F.array(*features(F.col("kind"), F.col("text"), F.col("left"), F.col("right"))).alias("f"))
    rows = common.checkpoint(rows)
    train = rows.filter(~F.col("held")).select(F.col("label").cast("double").alias("label"), array_to_vector("f").alias("features"))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=7, stepSize=0.3, checkpointInterval=-1).fit(train)
    trees = tree_heaps(model, f"{common.shared_folder(spark)}/trees-{uuid.uuid4().hex}", spark, depth)
    held = rows.filter("held").select("kind", score(trees, F.col("f")).alias("p"), "label").collect()  # half of ``examples``
    _FITTED[key] = trees, thresholds_of([(r["kind"], r["p"], int(r["label"])) for r in held], precision)
    return _FITTED[key]


def score(trees: list[dict], values: Column) -> Column:
    """The probability for an array of features: every tree is walked from its
    root, going on at 2 i + 1 or 2 i + 2; the trees are one constant."""
    table = F.from_json(F.lit(json.dumps(trees)), "array<struct<w:double,f:array<int>,t:array<double>,v:array<double>>>")
    depth = len(trees[0]["v"]).bit_length() - 1

    def leaf(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            low = F.get(values, F.get(tree["f"], at)) <= F.get(tree["t"], at)
            return 2 * at + F.when(low, 1).otherwise(2)

        return F.get(tree["v"], F.aggregate(F.array(*[F.lit(i) for i in range(depth)]), F.lit(0), step) - (2**depth - 1))

    total = F.aggregate(table, F.lit(0.0), lambda acc, tree: acc + tree["w"] * leaf(tree))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(total * -2.0))


def find_spans(docs: DataFrame, context: int = 24) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``, arrays of (start, order, kind,
    end) in order of start, then kind; code points, end exclusive."""
    spark = docs.sparkSession
    trees, thresholds = fit(spark)
    docs = docs.drop("base_spans", "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    gate = text.rlike(GATE)
    none = F.array().cast(MATCHES)
    found = docs
    for kind, (pattern, keep) in RULES.items():
        found = found.withColumn(f"__{kind}", F.when(gate, find_all(text, pattern, keep)).otherwise(none))
    for kind, pattern in GENERATORS.items():
        found = found.withColumn(f"__{kind}", F.when(gate, find_all(text, pattern, lambda m: F.lit(True))).otherwise(none))

    def spanning(kind: str) -> Callable[[Column], Column]:
        def span(m: Column) -> Column:
            end = m["start"] + F.length(m["text"])
            return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), end.alias("end"))

        return span

    def measuring(kind: str) -> Callable[[Column], Column]:
        def measured(m: Column) -> Column:
            left = F.substring(text, F.greatest(m["start"] - context, F.lit(0)) + 1, F.least(m["start"], F.lit(context)))
            right = F.substring(text, m["start"] + F.length(m["text"]) + 1, F.lit(2))
            return F.struct(spanning(kind)(m).alias("span"), F.array(*features(F.lit(kind), m["text"], left, right)).alias("f"))

        return measured

    def choosing(kind: str) -> Callable[[Column], Column]:
        return lambda c: score(trees, c["f"]) >= thresholds[kind]

    base = F.concat(*[F.transform(f"__{k}", spanning(k)) for k in RULES])
    found = found.withColumn("base_spans", F.array_sort(base))
    chosen = [F.filter(F.transform(f"__{k}", measuring(k)), choosing(k)) for k in GENERATORS]
    extra = [F.transform(c, lambda x: x["span"]) for c in chosen]
    found = found.withColumn("__extra", F.concat(*extra))
    new = F.filter("__extra", lambda e: ~F.exists("base_spans", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    found = found.withColumn("spans", F.when(F.size("__extra") == 0, F.col("base_spans")).otherwise(F.array_sort(F.concat("base_spans", new))))
    return found.drop("__extra", *[f"__{k}" for k in KINDS])


def redact(found: DataFrame) -> DataFrame:
    """The texts of ``found`` with each span replaced by its kind in brackets;
    a span that overlaps an earlier one is swallowed by it."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        put = F.when(s["start"] >= acc["at"], F.concat(acc["out"], before, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), put.alias("out"))

    whole = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(F.col("text")))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in RULES], F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
