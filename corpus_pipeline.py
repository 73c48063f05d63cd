"""A corpus from raw documents to packed sequences, in five stages over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import exact, langid, mixing, packing, similar
from tidemark.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that nothing else has, and the new name of each column."""
    names = {c: f"column{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter, or unlike any training text, go."""
    held, names = plain(docs)
    kept = langid.identify(held, langid.train(docs), names["text"]).filter("not _tm_rejected")
    return kept.select(*names.values()).toDF(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest id."""
    held, names = plain(docs)
    kept = exact.exact_dedup(held, names["doc_id"], names["text"], with_text=True).filter("kept")
    return kept.select(*names.values()).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts at a similarity of 0.8 or more by five words: that of the least id (null last); of rows that share it, one."""
    held, names = plain(docs)
    held = held.withColumn("h", F.xxhash64(names["text"]))
    found = similar.near_duplicates(held, names["doc_id"], names["text"], carry=("h",))
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("stay"))
    stay = Scratch(spark, "near").save(best.select(F.col("stay.doc_id").alias("stay_id"), F.col("stay.h").alias("stay_h")), "stay")
    kept = held.join(stay.hint("merge"), F.col("h").eqNullSafe(F.col("stay_h")) & F.col(names["doc_id"]).eqNullSafe(F.col("stay_id")), "left_semi")
    first = Window.partitionBy("h", names["doc_id"]).orderBy(*[n for c, n in names.items() if n not in (names["doc_id"], names["text"])] or ["h"])
    return kept.withColumn("n", F.row_number().over(first)).filter("n = 1").select(*names.values()).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask for them, in training order."""
    return mixing.repeated(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("sequences", sequences),
]
#: Fingerprints, centroids and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each reads what the one before wrote."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
