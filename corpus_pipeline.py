"""A five-stage corpus pipeline over `documents`, built from the operators of sunloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of docs; run() writes every stage's rows
as Parquet and gives what it reads back to the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.llm import decontaminate, mixing, near_dup, quality, suffix_dedup
from sunloom.llm._spark import collected, removed, shared_folder


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects as of low quality or toxic."""
    judged = quality.classify(docs, _read(spark, sf_dir, "labels"))
    return judged.where("keep").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dup.keep_representatives(docs)


#: Bytes from which a repeated string goes: fewer than any passage of over 50 words of ordinary length has.
PASSAGE_BYTES = 200


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a repeated string of PASSAGE_BYTES covers; n_chars follows the text."""
    out = suffix_dedup.remove_repeats(docs, window=PASSAGE_BYTES)
    if "n_chars" in out.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return out


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage like a benchmark item."""
    return decontaminate.drop_contaminated(docs, _read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.emit_copies(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", reject_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix),
]

#: A learned classifier and signatures are no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; a stage's rows go when the next one has written its own."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = _read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
        collected(spark)
    return docs
