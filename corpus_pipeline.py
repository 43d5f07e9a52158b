"""From raw documents to packed training sequences: five stages, each over all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's documents.  All but the last return the columns of the documents they were given.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortalis.llm.decontam import decontaminated
from sortalis.llm.langid import SLICE, label, trained
from sortalis.llm.packing import packed
from sortalis.llm.queries import remainder, tokenizer
from sortalis.llm.secrets import redacted
from sortalis.llm.simhash import one_of_each_group
from sortalis.llm.textcols import slices
from sortalis.sources.shared import written

def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that no learned language has a script for; mixed ones stay."""
    model = trained(docs.where(remainder(3) != 1))
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        keep = []
        for part in slices(pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], names=["doc_id", "text"]), "text", SLICE):
            rows = label(part, shared.value)
            words, share = rows.column("n_words").to_numpy(), rows.column("recognised").to_numpy()
            keep.append(pa.array((words > 0) & ((share > 0) | (not shared.value.languages))))
        return pa.concat_arrays(keep) if keep else pa.array([], pa.bool_())

    return docs.where(accepted(F.col("text").cast("string")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences."""
    return packed(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secret_scan", secret_scan), ("packing", packing)]

ORACLE_SQL = None  # tokenizers, fingerprints and a trained model are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
