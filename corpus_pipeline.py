"""Corpus cleaning pipeline: five stages over ``documents``, each one operator of ``auger.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. All but the last return the columns of ``docs``. Rows with null texts, ids, languages and
extra columns pass through as the operators state; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auger.llm import decontaminate, jaccard, langid, packing, passages
from auger.session import write_scratch

TOKENIZER = "byte_bpe_50k.json"


def _rows_of(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with ``found`` (doc_id, text_key), null ids included."""
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    same = docs["doc_id"].cast("long").eqNullSafe(found["__id"]) & (F.xxhash64(docs["text"]) == found["__key"])
    return docs.join(found, same, how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; those without a letter or text go. Where no row has a
    language, all others stay."""
    langs, weights = langid.fit(docs.select("text", "lang"))
    if not langs:  # nothing was learned: one language for every text with a letter
        langs, weights = ["any"], np.zeros((2, 1), dtype=np.float32)
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("__row"), F.col("text").alias("__text"))
    known = langid.predict(rows, langs, weights, text="__text").where(F.col("lang_pred") != langid.UNKNOWN)
    return known.select("__row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, the one of the smallest id (of repeated rows one)."""
    number = "__n" + "_" * max(map(len, docs.columns))  # no column has this name
    # written, so that the join's rows and these have the same numbers
    numbered = write_scratch(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    kept = jaccard.jaccard_join(numbered, row=number).where("kept").select(F.col("row").alias(number))
    return numbered.join(kept, number, "left_semi").drop(number)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out that a document of a smaller id holds too; documents left without a word go."""
    return passages.remove_passages(docs, passages.repeated_passages(docs))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, re-parameterised ones too."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return _rows_of(docs, decontaminate.contaminated(docs, benchmark), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), with_ids=False)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None  # the stages are learned or approximate; tests compare them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
