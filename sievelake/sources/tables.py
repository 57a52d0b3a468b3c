"""Reading several tables as one, keyed writes, and views in the place of aliases.

A table is a Parquet folder under a root; keyed writes make a new DataFrame from
the current rows and the changes, which the caller writes where it wants.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .names import generation_number, is_generation


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All fields as strings, no header."""
    return spark.read.csv(path, header=False, inferSchema=False)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def natural(name: str) -> list[tuple[int, int]]:
    """A sort key: runs of digits by their number, before other characters."""
    parts = re.findall(rb"[0-9]+|[^0-9]", name.encode("utf-8", "surrogateescape"), re.S)
    return [(0, int(p)) if p.isdigit() else (1, p[0]) for p in parts]


def list_files(spark: SparkSession, folder: str, extension: str) -> list[str]:
    """Files below a folder, in any store, that end in ``.yaml`` or the like, in the
    natural order of their names; none if there is no folder."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = (fs.listFiles(path, True) if fs.exists(path) else None), []
    while found is not None and found.hasNext():
        at = found.next().getPath()
        if posixpath.splitext(at.getName())[1] == extension or at.getName() == extension:
            out.append((at.getName(), at.toString()))
    return [p for _, p in sorted(out, key=lambda x: (natural(x[0]), x[1]))]


def read_tables(tables: dict[str, DataFrame], patterns: Sequence[str]) -> DataFrame:
    """Union of the tables whose names match, with ``_index`` naming each."""
    names = [n for n in sorted(tables) if any(fnmatch.fnmatchcase(n, p) for p in patterns)]
    if not names:
        raise ValueError(f"no table matches {list(patterns)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tables[n].withColumn("_index", F.lit(n)) for n in names])


def get(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def exists(df: DataFrame, key: str, value) -> bool:
    return not get(df, key, value).isEmpty()


def _numbered(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """``__n``: 1 for the last row of each key by ``order``; ties, and rows without
    an order, by a digest of their values, so that reruns agree."""
    digest = F.xxhash64(F.to_json(F.struct("*")))
    w = Window.partitionBy(key).orderBy(*([F.desc(order)] if order else []), digest)
    return rows.withColumn("__n", F.row_number().over(w))


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``changes`` win over current rows of their key, one row a key: the last by
    ``order``."""
    changes = _numbered(changes, key, order).filter("__n = 1").drop("__n")
    return current.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def create(current: DataFrame, new: DataFrame, key: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with the new ones, dead letters): keys that exist are refused; of
    several new rows of a key the last by ``order`` is taken."""
    first = _numbered(new, key, order)
    known = current.select(key).distinct()
    fresh = first.filter("__n = 1").drop("__n").join(known, key, "left_anti")
    refused = first.filter("__n > 1").drop("__n").unionByName(first.filter("__n = 1").drop("__n").join(known, key, "left_semi"))
    return current.unionByName(fresh, allowMissingColumns=True), refused.withColumn("error", F.lit("document already exists"))


def update(current: DataFrame, partial: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Values given in ``partial`` replace those of the row, of one row a key: the
    last by ``order``; nulls leave them."""
    partial = _numbered(partial, key, order).filter("__n = 1").drop("__n")
    changed = [c for c in partial.columns if c != key]
    new = partial.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in changed])
    joined = current.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in changed else F.col(c) for c in current.columns])


def update_by_query(current: DataFrame, where, values: dict) -> DataFrame:
    sure = F.coalesce(where, F.lit(False))
    return current.withColumns({c: F.when(sure, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key), key, "left_anti")


ACTIONS = ("index", "create", "update", "delete")


def bulk(current: DataFrame, items: DataFrame, key: str, action: str = "action", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(rows, errors) after a mixed batch: items (key, action, seq and values) take
    effect one after the other by ``seq``, each key for itself.

    ``index`` puts a row, ``create`` puts one where there is none, ``update``
    replaces the values it gives (nulls leave them), ``delete`` takes a row away.
    ``errors`` (key, action, seq, error) holds a create of what is there, an
    update or delete of what is not, and unknown actions; they change nothing.
    A key's items are folded in one row, so a batch should not name one key
    millions of times.
    """
    values = [c for c in current.columns if c != key]
    given = items.select(F.col(key), F.struct(F.col(seq).alias("seq"), F.col(action).alias("action"), F.struct(*[(F.col(c) if c in items.columns else F.lit(None)).cast(current.schema[c].dataType).alias(c) for c in values]).alias("row")).alias("item"))
    steps = given.groupBy(key).agg(F.array_sort(F.collect_list("item"), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("__steps"))
    own = current.select(F.col(key), F.struct(*values).alias("__row"))
    both = own.join(steps, key, "full")
    kind = current.select(F.struct(*values).alias("r")).schema["r"].dataType.simpleString()
    seq_kind = items.schema[seq].dataType.simpleString()
    start = F.struct(F.col("__row").alias("row"), F.array().cast(f"array<struct<seq:{seq_kind},action:string,error:string>>").alias("errors"))

    def step(state, item):
        there, what, new = state["row"].isNotNull(), item["action"], item["row"]
        error = F.when(~what.isin(*ACTIONS), F.lit("unknown action")).when((what == "create") & there, F.lit("document already exists")).when(what.isin("update", "delete") & ~there, F.lit("document missing"))
        merged = F.struct(*[F.coalesce(new[c], state["row"][c]).alias(c) for c in values])
        after = F.when(error.isNotNull(), state["row"]).when(what == "delete", F.lit(None).cast(kind)).when(what == "update", merged).otherwise(new)
        noted = F.struct(item["seq"].alias("seq"), what.alias("action"), error.alias("error"))
        return F.struct(after.cast(kind).alias("row"), F.when(error.isNotNull(), F.concat(state["errors"], F.array(noted))).otherwise(state["errors"]).alias("errors"))

    done = both.select(key, F.aggregate(F.coalesce("__steps", F.array().cast(steps.schema["__steps"].dataType)), start, step).alias("s"))
    rows = done.filter("s.row IS NOT NULL").select(key, "s.row.*").select(*current.columns)
    errors = done.select(key, F.explode("s.errors").alias("e")).select(key, F.col("e.action").alias(action), F.col("e.seq").alias(seq), "e.error")
    return rows, errors


def checked(df: DataFrame, casts: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows in the types asked for, dead letters with an error naming the field)."""
    tried = df
    for name, kind in casts.items():
        tried = tried.withColumn(f"__{name}", F.col(name).try_cast(kind))
    bad = F.coalesce(*[F.when(F.col(n).isNotNull() & F.col(f"__{n}").isNull(), F.lit(f"failed to parse field {n}")) for n in casts])
    tried = tried.withColumn("error", bad)
    good = tried.filter("error IS NULL").select(*[F.col(f"__{c}").alias(c) if c in casts else F.col(c) for c in df.columns])
    return good, tried.filter("error IS NOT NULL").select(*df.columns, "error")


def with_retry(write: Callable[[], None], attempts: int = 3, delay: float = 0.5) -> None:
    """Run a write again after ``delay * 2**n`` seconds."""
    for n in range(attempts):
        try:
            return write()
        except Exception:
            if n + 1 == attempts:
                raise
            time.sleep(delay * 2**n)


def alias(spark: SparkSession, name: str, df: DataFrame, where: str | None = None) -> None:
    """A view, perhaps filtered; replacing it is one step."""
    (df.filter(where) if where else df).createOrReplaceTempView(name)


def list_tables(spark: SparkSession, pattern: str = "*") -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if fnmatch.fnmatchcase(t.name, pattern))


def write_generation(tables: Sequence[str], prefix: str) -> str | None:
    """The newest generation of a prefix."""
    own = [t for t in tables if is_generation(t) and t.rsplit("-", 1)[0] == prefix]
    return max(own, key=generation_number, default=None)


def sql_rows(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)


def sql_count(spark: SparkSession, query: str) -> int:
    """The first cell, 0 if there is none or it is no number."""
    row = spark.sql(query).first()
    return int(row[0]) if row and isinstance(row[0], (int, float)) else 0
