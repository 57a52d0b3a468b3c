"""Nearest neighbours by randomly rotated one-bit codes.

Each vector is scaled to length one, turned by ``bits`` fixed random orthogonal
matrices and kept as the signs of all turned components, packed 8 to a byte,
beside its length and the correction scalar ``f = <code, turned vector>``.  For a
query the inner product with a vector is estimated as ``|q| |v| <code, turned
query> / f``; the estimate misses by more than ``eps * sqrt(1 - f*f) / f /
sqrt(bits * dim - 1)`` (times the lengths) only with a tiny probability.  Every
vector whose upper bound reaches a query's ``k``-th best exact product so far is
reranked with the original vectors, in double precision; that product is carried
from block to block.

The queries meet the vectors in blocks: the stated query set against all rows.
A block of vectors goes once to each block of ``query_rows`` queries, with its
codes and its vectors as they are in the table: of the 4 * dim bytes of a vector
so many queries use some that joining the survivors to vectors afterwards would
move more.  A task takes one block of queries and ``group_rows`` vectors.

Defined results: vectors that are null, zero, of another dimension than the
commonest one (of equally common ones the largest), or that hold null or
non-finite components take no part, as queries or candidates; ties go to the
smaller id; repeated ids are candidates each (a query leaves out all rows with
its own id); with fewer candidates than ``k`` all come back; an empty table gives
an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK = "block long, n int, ids binary, codes binary, scalars binary, vectors binary"


def rotation(dim: int, bits: int, seed: int = 17) -> np.ndarray:
    """``bits`` random orthogonal matrices on top of each other, scaled so that
    the columns have length one."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(bits):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out) / np.sqrt(bits)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, [length, correction] per vector) of float64 ``vectors``."""
    length = np.sqrt((vectors * vectors).sum(1))
    turned = (vectors / length[:, None]) @ turn.T
    factor = np.abs(turned).sum(1) / np.sqrt(len(turn))
    return np.packbits(turned > 0, axis=1), np.stack([length, factor], 1)


def usable(vector: Column, dim: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def packed_blocks(vectors: DataFrame, dim: int, rows: int, bits: int, seed: int) -> DataFrame:
    """Blocks of at most ``rows`` coded vectors of ``vectors`` (id, vector)."""

    kind = "f4" if dict(vectors.dtypes)["__v"] == "array<float>" else "f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn, number = rotation(dim, bits, seed), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dim)
            for a in range(0, len(ids), rows):
                part = flat[a : a + rows]
                codes, scalars = encode(part, turn)
                number += 1
                blobs = [ids[a : a + rows].tobytes(), codes.tobytes(), scalars.tobytes(), part.astype(kind).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(part)], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], names=[c.split()[0] for c in BLOCK.split(", ")])

    return vectors.mapInArrow(run, BLOCK)


def in_order(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last."""
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        total += rows[:, j] * query[j]
    return total


def best_of_block(q_ids, queries, turned, q_length, ids, codes, scalars, vectors, k: int, eps: float, bar: np.ndarray):
    """(query index, vec_id, score, vectors reranked) of each query's ``k`` best in
    one block, of which only those count that reach the query's ``bar``."""
    width = turned.shape[1]
    signs = np.unpackbits(codes, axis=1)[:, :width].astype(np.float32) * 2 - 1
    length, factor = scalars[:, 0], scalars[:, 1]
    slack = (eps * np.sqrt(np.maximum(0.0, 1 - factor * factor)) / factor / np.sqrt(max(1, width - 1)) + 1e-5) * length
    scale = (length / factor / np.sqrt(width)).astype(np.float32)
    out_q, out_id, out_score, reranked = [], [], [], 0
    for low in range(0, len(q_ids), 256):
        estimate = (turned[low : low + 256].astype(np.float32) @ signs.T) * scale
        for i in range(low, min(low + 256, len(q_ids))):
            middle = estimate[i - low] * q_length[i]
            own = ids == q_ids[i]
            if own.any():
                middle = np.where(own, -np.inf, middle)
            m = min(k, len(ids) - int(own.sum()))
            if m == 0:
                continue
            least, first = bar[i], None
            if least == -np.inf:
                # the k-th best of some more than k likely ones
                n = min(4 * k, len(ids) - int(own.sum()))
                first = np.argpartition(-middle, n - 1)[:n]
                least = -np.partition(-(vectors[first] @ queries[i]), m - 1)[m - 1]
            chosen = np.flatnonzero((middle + slack * q_length[i] >= least - 1e-9) & ~own)
            if first is not None and len(chosen) < m:
                chosen = np.union1d(chosen, first)
            if not len(chosen):
                continue
            reranked += len(chosen)
            score = vectors[chosen] @ queries[i]
            # the best are summed again component by component, an order that SQL can follow
            best = np.lexsort((ids[chosen], -score))[: k + 8]
            score[best] = in_order(vectors[chosen[best]], queries[i])
            best = best[np.lexsort((ids[chosen[best]], -score[best]))][:k]
            out_q.append(np.full(len(best), i))
            out_id.append(ids[chosen][best])
            out_score.append(score[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), reranked
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score), reranked


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, eps: float = 3.5, bits: int = 8, query_rows: int = 8192, block_rows: int = 4096, group_rows: int = 32_768, seed: int = 17
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (id, vector)
    the ``k`` rows of ``vectors`` (id, vector) with the largest inner product."""
    vectors = vectors.toDF("__id", "__v")
    queries = queries.toDF("__id", "__v")
    sizes = vectors.filter("size(__v) > 0").groupBy(F.size("__v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, rows = (sizes["dim"], sizes["n"]) if sizes else (1, 0)
    vectors = vectors.filter(usable(F.col("__v"), dim) & F.col("__id").isNotNull())
    queries = queries.filter(usable(F.col("__v"), dim) & F.col("__id").isNotNull())
    kind = "f4" if dict(vectors.dtypes)["__v"] == "array<float>" else "f8"
    q_kind = "f4" if dict(queries.dtypes)["__v"] == "array<float>" else "f8"
    groups = max(1, -(-rows // group_rows))
    parts = max(1, -(-queries.count() // query_rows))
    q = packed_blocks(queries.repartition(parts, "__id"), dim, query_rows, bits, seed).drop("codes", "scalars")
    q = common.checkpoint(q)
    # numbered by task and block, of which there are few: a window over a row a block
    numbered = q.withColumn("qb", F.row_number().over(Window.orderBy("block"))).select("qb", F.col("n").alias("qn"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    numbered = numbered.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    blocks = packed_blocks(vectors, dim, block_rows, bits, seed)
    spread = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(1), F.lit(max(1, q.count())))))
    pairs = spread.join(numbered, ["qb", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, bits, seed)
        key, held, state, bar = None, None, None, None

        def merge(found):
            nonlocal state
            if state is not None:
                found = tuple(np.concatenate([a, b]) for a, b in zip(state, found))
            order = np.lexsort((found[1], -found[2], found[0]))
            who = found[0][order]
            start = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
            place = np.arange(len(who)) - (np.flatnonzero(start)[np.cumsum(start) - 1] if len(who) else 0)
            last = order[place == k - 1]
            bar[found[0][last]] = found[2][last]
            order = order[place < k]
            state = tuple(x[order] for x in found)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(held[0][state[0]]), pa.array(state[1]), pa.array(state[2])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["qb"], row["g"]) != key:
                    if key is not None:
                        yield flush()
                    key, state = (row["qb"], row["g"]), None
                    q_ids = np.frombuffer(row["q_ids"], np.int64)
                    own = np.frombuffer(row["q_vectors"], q_kind).astype(np.float64).reshape(len(q_ids), dim)
                    size = np.sqrt((own * own).sum(1))
                    held, bar = (q_ids, own, (own / size[:, None]) @ turn.T, size), np.full(len(q_ids), -np.inf)
                n = row["n"]
                *found, _ = best_of_block(
                    *held,
                    np.frombuffer(row["ids"], np.int64),
                    np.frombuffer(row["codes"], np.uint8).reshape(n, -1),
                    np.frombuffer(row["scalars"], np.float64).reshape(n, 2),
                    np.frombuffer(row["vectors"], kind).astype(np.float64).reshape(n, dim),
                    k,
                    eps,
                    bar,
                )
                merge(tuple(found))
        if key is not None:
            yield flush()

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
