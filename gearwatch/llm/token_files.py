"""Token ids of a corpus as coded blocks in files, in ascending order of document ids, and their reader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gearwatch.llm.common import bounded_batches
from gearwatch.llm.range_coder import BLOCK, decode_blocks, encode_blocks
from gearwatch.llm.tokens import Encoder, runs

END_ID = 2
SPANS = "array<struct<ordinal: long, id: string, total: long, start: long, n: long>>"
SCHEMA = f"part int, block long, n long, spans {SPANS}, payload binary"
#: Blocks that a writer codes and a reader decodes in step, and those whose documents a reader hands over at once.
WRITE_BLOCKS, READ_BLOCKS, GIVE_BLOCKS = 512, 1024, 256


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_column: str = "doc_id",
                 text_column: str = "text") -> None:
    """Write the ids of all rows of ``docs`` below ``path``, each document followed by ``end_id``.

    Rows are dealt out by ranges of their id (nulls first) and sorted inside the part; a part is a file. Each row of
    a file is one coded block of at most ``BLOCK`` ids with its own models and checksum, and the spans of the
    documents in it: place inside the part, id as text, ids of the whole document, where the span starts and its ids.

    A null text counts as empty and gives ``end_id`` alone; a long text spans blocks; repeated rows are written each
    for itself; an empty table gives files without rows.
    """

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part = Encoder.shared(tokenizer, "<u4"), TaskContext.get().partitionId()
        tail, ordinal, number = np.array([end_id], "<u4").tobytes(), 0, 0
        rows: list[tuple[int, list]] = []
        ready: list[np.ndarray] = []
        held, spans, size = [], [], 0

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"part": np.int32(part), "block": [b for b, _ in rows], "n": [len(x) for x in ready],
                                "spans": [s for _, s in rows], "payload": encode_blocks(ready)})
            rows.clear()
            ready.clear()
            return out

        for names, texts in runs(frames):
            for doc, raw in zip(names, encoder.encode(texts), strict=True):
                ids, start = np.frombuffer(raw + tail, "<u4"), 0
                while start < len(ids):
                    take = min(BLOCK - size, len(ids) - start)
                    held.append(ids[start : start + take])
                    spans.append({"ordinal": ordinal, "id": doc, "total": len(ids), "start": start, "n": take})
                    size, start = size + take, start + take
                    if size == BLOCK:
                        rows.append((number, spans))
                        ready.append(np.concatenate(held))
                        number, held, spans, size = number + 1, [], [], 0
                        if len(ready) == WRITE_BLOCKS:
                            yield flush()
                ordinal += 1
        if size:
            rows.append((number, spans))
            ready.append(np.concatenate(held))
        if ready:
            yield flush()

    rows = bounded_batches(docs).select(F.col(id_column).alias("order"), F.col(id_column).cast("string").alias("id"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("order").sortWithinPartitions("order").select("id", "text")
    dealt.mapInPandas(blocks, SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, id_type: str = "long", id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids): every document of the files, its little-endian 32-bit ids and the ids before it.

    Blocks are decoded each for itself and checked. The blocks of a part, which is as large as a part of the writer,
    come in order, so a document that spans blocks is whole with its last one.
    """
    stored = spark.read.schema(SCHEMA).parquet(path)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []  # what earlier blocks of the part have of a document
        for frame in frames:
            for at in range(0, len(frame), READ_BLOCKS):
                group, out = frame.iloc[at : at + READ_BLOCKS], []
                decoded = decode_blocks(group["payload"].tolist())
                for i, (part, block, spans) in enumerate(zip(group["part"], group["block"], group["spans"], strict=True)):
                    raw, place, decoded[i] = decoded[i].tobytes(), 0, None
                    for s in spans:
                        held.append(raw[4 * place : 4 * (place + s["n"])])
                        if s["start"] + s["n"] == s["total"]:
                            out.append((part, s["id"], s["total"], block * BLOCK + place - s["start"], b"".join(held)))
                            held = []
                        place += s["n"]
                    if (i + 1) % GIVE_BLOCKS == 0 or i + 1 == len(group):
                        yield pd.DataFrame(out, columns=["part", "id", "total", "first", "ids"])
                        out = []

    ordered = stored.select("part", "block", "spans", "payload").repartition("part").sortWithinPartitions("part", "block")
    rows = ordered.mapInPandas(decode, "part int, id string, total long, first long, ids binary")
    sizes = stored.groupBy("part").agg(F.sum("n").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    origins = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("origin"))
    return rows.join(F.broadcast(origins), "part").select(  # one row for each part
        F.col("id").cast(id_type).alias(id_column), (F.col("origin") + F.col("first")).alias("start"), F.col("total").alias("n_tokens"), "ids")
