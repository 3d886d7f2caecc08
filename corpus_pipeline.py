"""From raw documents to packed training sequences, one written table per stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. All but the last return the columns of ``documents``.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns; what
each makes of them is said in its operator's docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gearwatch.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from gearwatch.llm.common import crc_mod
from gearwatch.session import materialise

TOKENIZER = "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score at least one half).

    Labels are learned from the rows whose crc32 of the id modulo 3 is not 1; scores come from the texts alone.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    vectors = quality.word_vectors(docs.select("text"))
    model = quality.fit_sampled(docs, vectors, labels, crc_mod("doc_id", 3) != 1)
    return quality.drop_rejected(docs, vectors, model)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal without white space."""
    return exact_dedup.drop_exact_duplicates(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.drop_near_duplicates(docs)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like an item of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", keep_first_copies),
    ("near_dedup", keep_one_of_near),
    ("decontamination", keep_clean_of_benchmark),
    ("packing", pack),
]

#: Classifier, tokenizer and sketches have no SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each keeps is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
