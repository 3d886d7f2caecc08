"""Helpers that several operators share: column names, skew-safe group totals, running totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gearwatch.session import materialise

#: Rows of one key are spread over this many parts before they are combined.
SALTS = 64
#: Rows that a Python worker takes from Spark at once.
BATCH_ROWS = 1024
#: Bytes that a Python worker takes or gives at once, but for a row that is larger alone.
BATCH_BYTES = 4 << 20
#: What the operators' contracts call white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[ \t\n\x0B\f\r]"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Working column names that no column of ``df`` has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without_clashes(docs: DataFrame, outputs: Sequence[str], needed: Sequence[str]) -> DataFrame:
    """Drop columns of ``docs`` that have the name of a result column and are no input."""
    clash = {c.lower() for c in outputs} - {c.lower() for c in needed}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in clash])


def set_aside(docs: DataFrame, outputs: Sequence[str], needed: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that have the name of a result renamed, and the expressions that give all columns back."""
    clash = {c.lower() for c in outputs} - {c.lower() for c in needed}
    names = [c for c in docs.columns if c.lower() in clash]
    new = dict(zip(names, free_names(docs, *[f"_own_{c}" for c in names]), strict=True))
    return docs.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns]


def bounded_batches(docs: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """``docs``, after asking the session for batches of at most ``BATCH_ROWS`` rows, and ``most_bytes`` bytes: rows here hold whole texts.

    A batch holds one row at least, so a text that is larger alone is a batch of its own.
    """
    conf, arrow = docs.sparkSession.conf, "spark.sql.execution.arrow"
    sizes = [(key, most_bytes) for key in ("maxBytesPerBatch", "maxBytesPerOutputBatch") if most_bytes]
    for key, most in [("maxRecordsPerBatch", BATCH_ROWS), *sizes]:
        now = conf.get(f"{arrow}.{key}").lower().removesuffix("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            conf.set(f"{arrow}.{key}", str(most))
    return docs


def crc_mod(id_column: str, n: int) -> Column:
    """Fold of a row: crc32 of its id as text, modulo ``n``."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % n


def smallest_draws(drawn: DataFrame, key: str, draw: str, sample: int) -> DataFrame:
    """(key, draw): the ``sample`` smallest distinct draws of each key, a bounded table.

    Copies count once, so a key whose rows are copies of few texts is as sure to be drawn as any other. A share of the draws,
    twice as many as needed, is cut off first by their size, so no key is ranked in full.
    """
    distinct = materialise(drawn.select(key, draw).distinct(), "draws")
    sizes = {r[key]: r["n"] for r in distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return distinct
    grain = 1 << 30
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(grain if n <= 4 * sample else grain * 2 * sample // n))])
    few = distinct.filter(F.pmod(draw, F.lit(grain)) < share[F.col(key)])
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.pmod(draw, F.lit(grain)), draw))
    return few.withColumn("_rank", rank).filter(F.col("_rank") <= sample).select(key, draw)


def salted_totals(rows: DataFrame, keys: Sequence[str], salt: str, partial: dict[str, Column],
                  combine: Callable[[Column], Column] | dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Totals of each key, repeated for each salt that the key has: (keys, salt, names of ``partial``).

    A hot key is first combined inside its salts, so the second step sees at most ``SALTS`` rows of it, and a join of
    ``rows`` with the result on (keys, salt) deals the rows of a hot key to many tasks.
    """
    parts = rows.groupBy(*keys, salt).agg(*[c.alias(n) for n, c in partial.items()])
    whole = W.partitionBy(*keys)
    step = lambda n: combine[n] if isinstance(combine, dict) else combine
    return parts.select(*keys, salt, *[step(n)(F.col(n)).over(whole).alias(n) for n in partial])


def running_totals(df: DataFrame, order: Sequence[str], sums: Sequence[str], name: str) -> DataFrame:
    """Add ``end_<c>`` for each column of ``sums``: its inclusive running total in ascending ``order`` (nulls first).

    Two passes: rows are dealt out by ranges of ``order`` and summed inside each part while the parts are written to
    the shared folder; then the totals of the parts (one row for each part) give each part's start.
    """
    block, ends = free_names(df, "_block", *[f"end_{c}" for c in sums])[0], [f"end_{c}" for c in sums]
    schema = T.StructType([*df.schema.fields, T.StructField(block, T.IntegerType()),
                           *[T.StructField(e, T.LongType()) for e in ends]])

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, part = dict.fromkeys(sums, 0), TaskContext.get().partitionId()
        for frame in frames:
            new = [pa.array(np.full(frame.num_rows, part, np.int32))]
            for c in sums:
                total = frame.column(c).to_numpy(zero_copy_only=False).astype(np.int64).cumsum() + carry[c]
                carry[c] = int(total[-1]) if len(total) else carry[c]
                new.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*frame.columns, *new], names=schema.names)

    local = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema), name)
    totals = local.groupBy(block).agg(*[F.sum(c).alias(e) for c, e in zip(sums, ends, strict=True)])
    before = W.orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(block, *[F.coalesce(F.sum(e).over(before), F.lit(0)).alias(f"_start_{e}") for e in ends])
    out = local.join(F.broadcast(starts), block)  # one row for each part
    return out.select(*df.columns, *[(F.col(e) + F.col(f"_start_{e}")).alias(e) for e in ends])
