"""A training corpus from ``documents``.

Repetition rules drop documents, near copies keep their first document, personal
data is replaced, sources are brought to their weights, and what is left is
packed into length buckets.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import common, mixing, ngram_join, packing, pii, repetition


KEEP = ("doc_id", "text", "source")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the limits on repeated passages."""
    found = repetition.repetition_rules(common.held_apart(docs, KEEP)).filter("kept")
    return common.put_back(found, docs, KEEP)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    return common.put_back(ngram_join.keep_first(common.held_apart(docs, KEEP)), docs, KEEP)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each found span replaced by its kind."""
    found = pii.redact(pii.find_spans(common.held_apart(docs, KEEP)))
    changed = {}
    if dict(docs.dtypes).get("n_chars") == "bigint":
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col(common.REST)["n_chars"])
    return common.put_back(found, docs, KEEP, **changed)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    found = mixing.repeat_rows(mixing.systematic_mix(common.held_apart(docs, KEEP)))
    return common.put_back(found, docs, KEEP)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document of the mix in its bucket and batch, read back
    from the batches of token ids."""
    folder = f"{common.shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    out = packing.pack(docs.select("doc_id", "source", "text"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "source", "n_tokens", "bucket", "bucket_len", "batch", "row_in_batch", "padding")


STAGES = [("quality", quality), ("near_copies", near_copies), ("personal_data", personal_data), ("mix", mix), ("packed", packed)]

#: Fitted scores and components have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and reread."""
    docs = common.read(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
