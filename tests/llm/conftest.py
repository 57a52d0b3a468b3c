import random

import pytest

#: Names that operators use for their own columns, in a table of documents.
EXTRA = "size long, shard int, slot long, copies long, target double, n_tokens long, bucket int, batch long, n_words long, kept boolean, spans string, key string, tokens string, fp long"


def make_documents(spark, rows, extra=False):
    """documents of (doc_id, text, source) rows, perhaps with clashing columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + EXTRA if extra else "")
    rest = (7, 1, 2, 3, 1.5, 4, 5, 6, 8, True, "x", "y", "z", 9) if extra else ()
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *rest) for i, t, s in rows], schema)


def odd_rows():
    """Nulls, blanks, ties, repeated rows, a very long text and near copies."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = prose(120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \n\t ", None),
        (4, "one", "b"),
        (5, "One", "b"),
        (6, base, "a"),
        (6, base, "a"),
        (7, near, "a"),
        (8, "".join(c.upper() if c.isascii() else c for c in base), "b"),
        (9, prose(6000), "c"),
        (10, "x y " * 2000, None),
        (None, prose(40), "c"),
        (11, "mail ann@example.com or +1 (555) 123-4567 😀 4111 1111 1111 1111 1.2.3.4", "a"),
        (11, prose(30), "a"),
        (12, "🎈 " + base[:200], ""),
        (13, "line one two\nline one two\n\n###", "c"),
    ]
    rows += [(100 + i, prose(rng.randint(1, 80)), rng.choice(["a", "a", "a", "b", "d"])) for i in range(60)]
    rows += [(300 + i, base + " " + str(i), "a") for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return make_documents(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark, rows):
    return make_documents(spark, rows, extra=True)


@pytest.fixture(scope="session")
def empty(spark):
    return make_documents(spark, [])
