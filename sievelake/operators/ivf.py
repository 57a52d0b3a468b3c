"""Vector search over an inverted file: clusters as partition folders.

Cluster centres are fitted on a bounded sample; every row lies in the folder of
its nearest centre.  A search reads the folders of the ``nprobe`` nearest centres
alone, first the byte codes of the vectors, then the vectors of the best of them,
which are scored exactly.  With all clusters and enough oversampling it is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, IntegerType, StructField, StructType

from . import knn

#: Rows of the sample that centres are fitted on, whatever the size of the table.
SAMPLE = 20_000
#: The cluster of rows without a vector of the common length; no search meets them.
NONE = -1


def _unit(x: np.ndarray, space: str) -> np.ndarray:
    return x if space == "l2" else x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _nearness(x: np.ndarray, centres: np.ndarray, space: str) -> np.ndarray:
    """Higher is nearer, by row and centre."""
    product = x @ centres.T
    return product if space != "l2" else 2 * product - (centres * centres).sum(1)


def fit_centres(sample: np.ndarray, clusters: int, space: str, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from spread-out rows; empty clusters start anew at far rows."""
    rng = np.random.default_rng(seed)
    x = _unit(sample.astype(np.float64), space)
    centres = x[rng.choice(len(x), min(clusters, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearness(x, centres, space)
        own = near.argmax(1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            new[empty] = x[near.max(1).argsort()[: len(empty)]]
        centres = _unit(new, space)
    return centres


class VectorIndex:
    """An index at ``path``, for one of the spaces of ``knn``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        meta = spark.read.parquet(f"{self.path}/centres").orderBy("cluster").collect()  # a row a cluster
        self.column, self.id_column, self.space = meta[0]["column"], meta[0]["id_column"], meta[0]["space"]
        self.centres = np.array([r["centre"] for r in meta])

    @classmethod
    def build(cls, df: DataFrame, id_column: str, column: str, path: str, clusters: int = 64, space: str = "l2", sample: int = SAMPLE) -> VectorIndex:
        """Index all rows of ``df``.  The vectors' length is that of most of the sample."""
        if space not in knn.SPACES:
            raise ValueError(f"no such space: {space}")
        spark, path = df.sparkSession, path.rstrip("/")
        some = df.filter(F.col(column).isNotNull() & ~F.exists(F.col(column), lambda v: v.isNull() | F.isnan(v))).select(id_column, column)
        held = [r[1] for r in some.orderBy(F.xxhash64(id_column), id_column).limit(sample).collect()]  # bounded by ``sample``
        if not held:
            raise ValueError("no vectors to index")
        sizes, counts = np.unique([len(v) for v in held], return_counts=True)
        size = int(sizes[counts.argmax()])
        centres = fit_centres(np.array([v for v in held if len(v) == size]), clusters, space)
        rows = [(i, [float(v) for v in c], column, id_column, space) for i, c in enumerate(centres)]
        spark.createDataFrame(rows, "cluster int, centre array<double>, column string, id_column string, space string").coalesce(1).write.parquet(f"{path}/centres")
        placed = _placed(df, column, centres, space)
        # a cluster may hold a large share of the rows: its rows go to several tasks
        placed.repartitionByRange("__cluster", F.xxhash64(id_column)).sortWithinPartitions("__cluster").write.partitionBy("__cluster").parquet(f"{path}/rows")
        return cls(spark, path)

    def nearest_clusters(self, vector: Sequence[float], nprobe: int) -> list[int]:
        x = _unit(np.array([vector], np.float64), self.space)
        near = _nearness(x, self.centres, self.space)[0]
        return np.argsort(-near, kind="stable")[:nprobe].tolist()

    def probe(self, vector: Sequence[float], nprobe: int) -> DataFrame:
        """The rows of the nearest clusters, as a source for any search."""
        return self._rows(self.nearest_clusters(vector, nprobe)).drop("__code", "__low", "__step", "__cluster")

    def _rows(self, clusters: list[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").filter(F.col("__cluster").isin(*clusters))

    def search(self, vector: Sequence[float], k: int, nprobe: int = 8, oversample: float = 3.0, filter: Column | None = None, min_score: float | None = None, max_distance: float | None = None, widen: bool = True) -> DataFrame:
        """The ``k`` best rows among those that meet ``filter``, with ``_score``.

        ``oversample`` times k rows are chosen by their codes and scored exactly; 0
        scores all rows of the clusters.  If ``filter`` leaves fewer than k rows in
        the clusters, twice as many are read, and so on to all (``widen``).
        """
        nprobe = max(1, min(nprobe, len(self.centres)))
        while True:
            rows = self._rows(self.nearest_clusters(vector, nprobe))
            if filter is not None:
                rows = rows.filter(filter)
            if not widen or filter is None or nprobe == len(self.centres) or rows.limit(k).count() == k:
                break
            nprobe = min(2 * nprobe, len(self.centres))
        if oversample:
            code = F.transform("__code", lambda c: (c.cast("double") + 128) * F.col("__step") + F.col("__low"))
            first = rows.withColumn("__near", knn.score(code, vector, self.space)).select(self.id_column, "__cluster", "__near")
            chosen = first.orderBy(F.desc("__near"), self.id_column).limit(max(k, round(k * oversample)))
            ids = [r[0] for r in chosen.select(self.id_column).collect()]  # bounded by k and oversample
            rows = rows.filter(F.col(self.id_column).isin(*ids))
        rows = rows.drop("__code", "__low", "__step", "__cluster")
        return knn.nearest(rows, self.id_column, self.column, vector, k, self.space, min_score, max_distance)


def _placed(df: DataFrame, column: str, centres: np.ndarray, space: str) -> DataFrame:
    """Rows with ``__cluster`` and the byte code of their vector: each component is
    ``(__code + 128) * __step + __low``."""
    size = centres.shape[1]
    schema = StructType([*df.schema.fields, StructField("__code", ArrayType(ByteType())), StructField("__low", DoubleType()), StructField("__step", DoubleType()), StructField("__cluster", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index(column)).to_pylist()
            good = np.array([v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v) for v in vectors], bool)
            cluster, codes = np.full(len(vectors), NONE), [None] * len(vectors)
            low, step = np.zeros(len(vectors)), np.zeros(len(vectors))
            if good.any():
                x = np.array([v for v, g in zip(vectors, good) if g], np.float64)
                cluster[good] = _nearness(_unit(x, space), centres, space).argmax(1)
                low[good], step[good] = x.min(1), np.maximum((x.max(1) - x.min(1)) / 255, 1e-300)
                coded = np.clip(np.rint((x - low[good][:, None]) / step[good][:, None]), 0, 255).astype(np.int16) - 128
                for i, c in zip(np.flatnonzero(good).tolist(), coded.astype(np.int8)):
                    codes[i] = c
            columns = [*batch.columns, pa.array(codes, pa.list_(pa.int8())), pa.array(low), pa.array(step), pa.array(cluster, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return df.mapInArrow(run, schema)
