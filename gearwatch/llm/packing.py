"""Packing: concatenate the ids of all documents and cut the stream into windows of one width."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from gearwatch.llm.common import bounded_batches
from gearwatch.llm.tokens import Encoder, runs
from gearwatch.session import scratch_path

WIDTH, END_ID = 2048, 1
#: Rows that a task hands over at once, whatever the length of a document.
BATCH = 4096


def token_table(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """First pass: (id as text, block, begin, n, ids): the ids of each document with the end id, as little-endian uint16 bytes,
    the input part that holds it and how many ids of that part come before it. Written once to the shared folder.

    A null text counts as empty, which leaves the end id alone.
    """
    spark = docs.sparkSession

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, begin, block = Encoder.shared(tokenizer, "<u2"), 0, TaskContext.get().partitionId()
        tail = np.array([end_id], "<u2").tobytes()
        for names, texts in runs(frames):
            coded = encoder.encode(texts)
            for at in range(0, len(names), 256):
                ids = [x + tail for x in coded[at : at + 256]]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                yield pd.DataFrame({"id": names[at : at + 256], "block": np.int32(block), "begin": begin + n.cumsum() - n, "n": n, "ids": ids})
                begin += int(n.sum())

    path = scratch_path(spark, "packed-tokens")
    rows = bounded_batches(docs).select(F.col(id_column).cast("string").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    schema = "id string, block int, begin long, n long, ids binary"
    rows.mapInPandas(encode, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def pack(docs: DataFrame, tokenizer: str, width: int = WIDTH, end_id: int = END_ID, id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """One row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset).

    The stream is that of the input parts in order, a document after the other. A piece is the part of a document
    inside one window of ``width`` ids; a document over a boundary has a piece on either side. Only the last window
    may be short. Prefix sums take two passes: totals of the input parts (one row each), then the starts inside them.

    A null or empty text is its end id alone. A text may span any number of windows; pieces leave the task in bounded
    batches. Repeated rows are packed each for itself. An empty table gives no piece. Extra columns are not returned.
    """
    tokens = token_table(docs, tokenizer, end_id, id_column, text_column)
    kind = dict(docs.dtypes)[id_column]
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = tokens.groupBy("block").agg(F.sum("n").alias("total"))
    starts = totals.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("origin"))
    placed = tokens.join(F.broadcast(starts), "block")  # one row for each input part
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for frame in frames:
            for doc, origin, begin, n, ids in frame[["id", "origin", "begin", "n", "ids"]].itertuples(index=False):
                at, place = 0, origin + begin
                while at < n:
                    offset = (place + at) % width
                    size = min(width - offset, n - at)
                    rows.append((doc, at, size, np.frombuffer(ids, "<u2", size, 2 * at).astype("<u4").tobytes(), n,
                                 (place + at) // width, offset))
                    at += size
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return placed.select("id", "origin", "begin", "n", "ids").mapInPandas(
        cut, "id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    ).select(F.col("id").cast(kind).alias(id_column), *names[1:])


def piece_digests(pieces: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Pieces with the crc32 of their little-endian 32-bit ids in place of the ids."""
    return pieces.select(id_column, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
