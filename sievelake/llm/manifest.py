"""A Merkle manifest of a table, with a checked inclusion proof for every row.

Rows are leaves, one tree a group, and the groups' roots are the leaves of one
more tree.  For every parent its preimage is stored: the hashes of its children,
one after the other.  A leaf joins the preimages of its ancestors; without its
own 64 characters they are its proof, and with another hash spliced into that
slot they fold to the root that this hash leads to.

Trees are built in blocks of 1024 places, ten levels at a time, so a tree of n
leaves takes log n / 10 rounds, each over a thousandth of the nodes of the one
before, and no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import numbered
from ..sources.shared import written
from . import common

#: Levels of a block, and characters of a hash.
LEVELS, DIGITS = 10, 64
_PATH = "array<struct<preimage:string,slot:int>>"


def field(c: Column, kind: str) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, ``:``, and the value."""
    value = c if kind == "string" else c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(df: DataFrame, columns: Sequence[str], **changed: Column) -> Column:
    """The hash of a row's ``columns``, with some of them ``changed``."""
    kinds = dict(df.dtypes)
    return F.sha2(F.concat(*[field(changed.get(c, F.col(f"`{c}`")), kinds[c]) for c in columns]), 256)


def _parents(hashes: Column, depth: Column) -> Column:
    """``parents``: preimages of ``depth`` levels above ``hashes``; ``top``: the last hashes."""
    start = F.struct(F.array().cast("array<array<string>>").alias("parents"), hashes.alias("top"))

    def up(made, _):
        below = made["top"]
        pairs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int"))
        preimages = F.transform(pairs, lambda i: F.concat(F.get(below, i * 2), F.coalesce(F.get(below, i * 2 + 1), F.lit(""))))
        return F.struct(F.concat(made["parents"], F.array(preimages)).alias("parents"), F.transform(preimages, lambda p: F.sha2(p, 256)).alias("top"))

    return F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), F.lit(1), depth), start, up)


def _path(parents: Column, place: Column) -> Column:
    """Preimages of the ancestors of a place of a block, with its slot in each."""
    shift = lambda n: F.call_function("shiftright", place, n)
    return F.transform(parents, lambda level, i: F.struct(F.get(level, shift(i + 1)).alias("preimage"), F.call_function("shiftright", place, i).bitwiseAND(F.lit(1)).alias("slot")))


def siblings(path: Column) -> Column:
    """The hashes beside a leaf's own on its way up, one after the other."""
    return F.array_join(F.transform(path, lambda p: F.overlay(p["preimage"], F.lit(""), p["slot"] * DIGITS + 1, F.lit(DIGITS))), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hash leads to, with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.overlay(p["preimage"], h, p["slot"] * DIGITS + 1, F.lit(DIGITS)), 256))


@dataclass(frozen=True)
class Forest:
    """One tree for each value of ``group``.

    ``nodes`` are the leaves with ``__block`` and ``__place``; ``parents`` has the
    preimages of each block's lowest ten levels; ``above`` the path from there up
    (``path``) and the tree's ``root``.
    """

    group: tuple[str, ...]
    nodes: DataFrame
    parents: DataFrame
    above: DataFrame

    def members(self, above: DataFrame | None = None) -> DataFrame:
        """The leaves with their whole ``path`` and what else ``above`` holds."""
        keys = [*self.group, "__block"]
        # blocks meet each other first, so that a leaf joins once and no leaf
        # carries a block's preimages into a shuffle
        block = _joined(self.parents, self.above if above is None else above, keys)
        found = _joined(self.nodes, block, keys)
        return found.withColumn("path", F.concat(_path(F.col("__parents"), F.col("__place")), F.col("path"))).drop("__parents", "__place", "__block")


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A join on ``keys``, where null equals null, with the columns of both."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    rest = [c for c in b.columns if c not in keys]
    return a.alias("a").join(b.alias("b"), same).select(*[F.col(f"a.`{c}`") for c in a.columns], *[F.col(f"b.`{c}`") for c in rest])


def forest(leaves: DataFrame, group: Sequence[str], order: Sequence[Column], leaf: str) -> Forest:
    """Trees over ``leaves``, whose hash is in ``leaf``; those of a group ascend by
    ``order``, which must tell rows apart where a large share may agree."""
    low = F.lit((1 << LEVELS) - 1)
    cut = lambda nodes: nodes.withColumn("__block", F.shiftright("__pos", LEVELS)).withColumn("__place", F.col("__pos").bitwiseAND(low).cast("int"))
    nodes = cut(numbered(leaves, group, order, "__pos", "__n"))
    keys = [*group, "__block"]
    level, rounds = nodes.select(*keys, "__place", "__n", F.col(f"`{leaf}`").alias("__h")), []
    left = nodes.agg(F.max("__n")).first()[0] or 0  # a number
    while left > 0:
        held = level.groupBy(*keys).agg(F.max("__n").alias("__n"), F.sort_array(F.collect_list(F.struct("__place", "__h")))["__h"].alias("__own"))
        depth = F.when(F.col("__n") > (1 << LEVELS), F.lit(LEVELS)).otherwise(F.ceil(F.log2(F.col("__n").cast("double"))).cast("int"))
        made = held.withColumn("__made", _parents(F.col("__own"), depth))
        top = F.get(F.col("__made.top"), F.lit(0))
        rounds.append(written(made.select(*keys, "__n", F.col("__made.parents").alias("__parents"), top.alias("__top")), "parents"))
        higher = rounds[-1].filter(F.col("__n") > (1 << LEVELS))
        higher = higher.select(*group, F.col("__block").alias("__pos"), F.ceil(F.col("__n") / (1 << LEVELS)).cast("long").alias("__n"), F.col("__top").alias("__h"))
        level = cut(higher).drop("__pos")
        left = -(-left >> LEVELS) if left > (1 << LEVELS) else 0
    none = F.array().cast(_PATH)
    empty = rounds[0] if rounds else level.select(*keys, "__n", F.lit(None).cast("array<array<string>>").alias("__parents"), F.col("__h").alias("__top")).limit(0)
    above = None
    for n, table in reversed(list(enumerate(rounds or [empty]))):
        # a tree's last block ends it; the others go on in the next round's blocks
        done = table.filter(F.col("__n") <= (1 << LEVELS)).select(*keys, none.alias("path"), F.col("__top").alias("root"))
        if above is not None:
            on = table.filter(F.col("__n") > (1 << LEVELS)).select(*group, F.col("__block").alias("__pos"))
            found = _joined(cut(on), _joined(rounds[n + 1].select(*keys, "__parents"), above, keys), keys)
            found = found.withColumn("path", F.concat(_path(F.col("__parents"), F.col("__place")), F.col("path")))
            done = done.union(found.select(*group, F.col("__pos").alias("__block"), "path", "root"))
        above = done
    return Forest(tuple(group), nodes.drop("__pos", "__n"), (rounds or [empty])[0].select(*keys, "__parents"), above)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", order: str = "doc_id", **changed: Column) -> DataFrame:
    """A leaf for every row of ``docs``, and its proof against the root of all.

    Gives ``order``, ``group``, ``leaf`` (the hash of ``columns``), ``subroot`` (of
    the row's group), ``root``, ``path`` (preimages of its ancestors and its slot in
    each), and ``seen_leaf``, the hash with the columns ``changed`` (as after
    tampering).  Nulls hash as ``-``; a null group is a group, before the others;
    a null in ``order`` comes first; rows that agree on it ascend by their leaf,
    and repeated rows are a leaf each.  Empty tables give no rows.  Columns not
    named play no part.
    """
    leaves = docs.select(F.col(order), F.col(group), leaf_hash(docs, columns).alias("leaf"), leaf_hash(docs, columns, **changed).alias("seen_leaf"))
    # texts are read once; the id tells repeated rows apart
    leaves = written(leaves.withColumn("__row", F.monotonically_increasing_id()), "leaves")
    trees = forest(leaves, [group], [F.asc_nulls_first(order), F.asc("leaf"), F.asc("__row")], "leaf")
    subroots = trees.above.groupBy(group).agg(F.first("root").alias("subroot"))
    tops = forest(subroots, [], [F.asc_nulls_first(group)], "subroot").members()
    tops = tops.select(F.col(group), "subroot", F.col("path").alias("__on"), F.col("root").alias("__root"))
    above = _joined(trees.above.drop("root"), tops, [group])
    above = above.select(group, "__block", F.concat("path", "__on").alias("path"), "subroot", F.col("__root").alias("root"))
    return trees.members(above).drop("__row")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, a seventh of them tampered with."""
    docs = common.read(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = manifest(docs, n_chars=tampered)
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.col("seen_leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"


_LEAF_SQL = "sha256(" + " || ".join(_field_sql(c) for c in COLUMNS) + ")"
_UP_SQL = "list_transform(range(0, len({h}), 2), lambda i: sha256({h}[i + 1] || coalesce({h}[i + 2], '')))"
_CRC_SQL = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({x}) + 1), lambda i: ord(substr({x}, i, 1))::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT)"
)

OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF_SQL} AS leaf,
         {_LEAF_SQL.replace("n_chars", f"(CASE WHEN {_CRC_SQL.format(x='CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN n_chars + 1 ELSE n_chars END)")} AS seen_leaf
  FROM documents),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id ASC NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS r FROM d),
t AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS h FROM p GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, {_UP_SQL.format(h="h")} FROM t WHERE len(h) > 1),
s AS (
  SELECT lang, level AS depth, h[1] AS subroot, row_number() OVER (ORDER BY lang ASC NULLS FIRST) - 1 AS place FROM t WHERE len(h) = 1),
u AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS h FROM s
  UNION ALL
  SELECT level + 1, {_UP_SQL.format(h="h")} FROM u WHERE len(h) > 1),
n AS (
  SELECT p.r, t.level AS step, (p.pos >> t.level) % 2 AS slot, coalesce(t.h[xor(p.pos >> t.level, 1) + 1], '') AS sibling
  FROM p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang WHERE len(t.h) > 1
  UNION ALL
  SELECT p.r, s.depth + u.level, (s.place >> u.level) % 2, coalesce(u.h[xor(s.place >> u.level, 1) + 1], '')
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang, u WHERE len(u.h) > 1),
f AS (
  SELECT r, 0 AS step, seen_leaf AS h FROM p
  UNION ALL
  SELECT f.r, f.step + 1, sha256(CASE WHEN n.slot = 0 THEN f.h || n.sibling ELSE n.sibling || f.h END) FROM f JOIN n ON f.r = n.r AND f.step = n.step),
e AS (SELECT r, arg_max(h, step) AS folded_root FROM f GROUP BY r),
o AS (SELECT r, sha256(string_agg(sibling, '' ORDER BY step)) AS proof_sha256 FROM n GROUP BY r),
g AS (SELECT h[1] AS root FROM u WHERE len(h) = 1)
SELECT p.doc_id, p.leaf, s.subroot, g.root, coalesce(o.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = g.root AS verified
FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN e USING (r) LEFT JOIN o USING (r), g
"""
