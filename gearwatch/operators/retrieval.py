"""Nearest vectors, dynamic top-k, question routing and context assembly."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gearwatch.functions import text as X
from gearwatch.operators import vectors

# Similarity floor and context limits.
MIN_SIMILARITY = 0.15
DEFAULT_TOP_K = 5
MAX_TOP_K = 20
CONTEXT_ROWS = 10
CONTEXT_CHUNKS = 7
CONTEXT_CHARS = 500
REGISTRY_FIELDS = ["machine_id", "model", "manufacturer", "price", "purchase_date", "location", "status",
                   "last_maintenance", "next_maintenance", "warranty_expiry", "serial_number"]


def cosine(a: Column, b: Column) -> Column:
    """T5: cosine of two array columns in doubles; null when a side is null or has zero length."""

    def dot(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double"))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def parse_vector(text: Column) -> Column:
    """A vector stored as text."""
    return F.from_json(text, "array<float>")


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    keep: int,
    floor: float | None = None,
    metric: str = "cosine",
    corpus_id: str = "chunk_id",
    corpus_vec: str = "embedding",
    query_id: str = "question_id",
    query_vec: str = "embedding",
    exclude_self: bool = False,
) -> DataFrame:
    """Exact best ``keep`` corpus rows per query, as (query_id, corpus_id, score, rank).

    Query blocks and corpus slices meet as rows (``vectors.search``); scores are cosine similarity or minus the Euclidean
    distance, rounded to nine places so equal vectors tie.
    """
    found = vectors.search(
        corpus.select(F.col(corpus_id).alias("id"), F.col(corpus_vec).alias("v")),
        queries.select(F.col(query_id).alias("q"), F.col(query_vec).alias("v")), keep, floor, metric, exclude_self)
    return found.select(F.col("q").alias(query_id), F.col("id").alias(corpus_id), "score", "rank")


def dynamic_top_k(corpus: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, **names: str) -> DataFrame:
    """H4 + T6: chunks with similarity of at least 0.15; min(k + 2, 10) of them when more than k qualify, else k.

    For k above 8 the rule returns fewer than k when many qualify; that is its definition.
    """
    more = min(k + 2, 10)
    found = nearest(corpus, queries, max(k + 1, more), MIN_SIMILARITY, **names)
    query_id = names.get("query_id", "question_id")
    n = F.count("*").over(W.partitionBy(query_id))
    return found.withColumn("_n", n).filter(F.col("rank") <= F.when(F.col("_n") > k, more).otherwise(k)).drop("_n")


def analyse(questions: DataFrame) -> DataFrame:
    """T7-T10 for every question."""
    t = F.col("text")
    return questions.select("*", X.language(t).alias("language"), X.is_greeting(t).alias("is_greeting"),
                            X.machine_ids(t).alias("machine_ids"), X.sanitise(t).alias("safe_text"))


def route(analysed: DataFrame, db_hits: DataFrame, chunk_hits: DataFrame) -> DataFrame:
    """Query type from the analysis and the number of registry rows and chunks found."""
    rows = db_hits.groupBy("question_id").agg(F.count("*").alias("db_results"))
    found = chunk_hits.groupBy("question_id").agg(F.count("*").alias("pdf_chunks"))
    out = analysed.join(rows, "question_id", "left").join(found, "question_id", "left").fillna(0, ["db_results", "pdf_chunks"])
    zero = F.lit(0).cast("long")
    kind = (
        F.when(F.col("is_greeting"), "casual_greeting")
        .when((F.col("db_results") > 0) & (F.size("machine_ids") > 0), "machine_specific")
        .when(F.col("pdf_chunks") > 0, "technical_manual")
        .otherwise("general_knowledge")
    )
    return out.withColumns({
        "query_type": kind,
        "db_results": F.when(F.col("is_greeting"), zero).otherwise(F.col("db_results")),
        "pdf_chunks": F.when(F.col("is_greeting"), zero).otherwise(F.col("pdf_chunks")),
    })


def assemble_context(questions: DataFrame, db_rows: DataFrame, chunks: DataFrame, fields: Sequence[str] = REGISTRY_FIELDS) -> DataFrame:
    """One context text per question: up to ten registry rows, up to seven chunks of 500 characters.

    ``db_rows`` holds (question_id, rank, registry fields), ``chunks`` holds (question_id, rank, content). Ranks
    are filtered before anything is collected, so every list is short.
    """
    lines = [
        F.when(F.nullif(F.col(f).cast("string"), F.lit("")).isNotNull(),
               F.concat(F.lit(f"  - {f}: "), F.col(f).cast("string")))
        for f in fields if f in db_rows.columns
    ]
    machine = F.concat_ws("\n", F.concat(F.lit("Machine "), F.col("rank").cast("string"), F.lit(":")), *lines)
    rows = (
        db_rows.filter(F.col("rank") <= CONTEXT_ROWS)
        .select("question_id", "rank", machine.alias("line"))
        .groupBy("question_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("r"))
        .select("question_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("registry_text"))
    )
    section = F.concat(F.lit("[Manual Section "), F.col("rank").cast("string"), F.lit("]\n"),
                       F.substring("content", 1, CONTEXT_CHARS))
    manual = (
        chunks.filter(F.col("rank") <= CONTEXT_CHUNKS)
        .select("question_id", "rank", section.alias("line"))
        .groupBy("question_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("r"))
        .select("question_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("manual_text"))
    )
    return questions.join(rows, "question_id", "left").join(manual, "question_id", "left")


def query_log_metrics(log: DataFrame) -> DataFrame:
    """Hits, processing time and cache hit rate per query type."""
    return log.groupBy("query_type").agg(
        F.count("*").alias("queries"), F.sum("db_results").alias("db_results"), F.sum("pdf_chunks").alias("pdf_chunks"),
        F.avg("processing_time").alias("avg_processing_time"),
        (F.count_if(F.col("cached")) * 100.0 / F.count("*")).alias("cache_hit_pct"),
    )


def fit_encoder(corpus: DataFrame, text: str = "content", size: int = 256):
    """T4: default text encoder, hashed term counts with inverse document frequency, as an MLlib pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]).fit(corpus)


def encode(encoder, df: DataFrame, text: str = "content") -> DataFrame:
    """T4: add an ``embedding`` array; a text without known terms gets a null vector."""
    from pyspark.ml.functions import vector_to_array

    source = encoder.stages[0].getInputCol()
    out = encoder.transform(df if text == source else df.withColumn(source, F.col(text)))
    vec = vector_to_array("_unit", "float32")
    return out.withColumn("embedding", F.when(F.exists(vec, lambda v: v != 0), vec)).drop(
        "_tokens", "_tf", "_idf", "_unit", *([] if text == source else [source]))
